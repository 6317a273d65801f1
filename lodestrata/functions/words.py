"""Word lists, diacritics, and Porter stems."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that results depend on: stop words of the tokenizer, those of the answer proxies, and acronyms kept as they are.
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "of", "for", "with", "by", "from", "and", "or", "but", "not",
    "this", "that", "these", "those", "it", "its", "as", "be", "been", "being", "has", "have", "had", "do", "does", "did",
    "which", "who", "whom", "what", "how", "when", "where", "why", "can", "could", "should", "would", "will", "shall", "may", "might",
)
PROXY_STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "is", "are", "for", "what", "which", "how", "with", "on", "at", "by", "be", "as", "it",
    "this", "that", "from", "was", "were", "will", "can", "do", "does",
)
ACRONYMS = ("api", "afi", "gmp", "ayush", "ccras", "niimh", "fssai")

TOKEN = "[ऀ-ॿ]+|[a-z0-9]+"


_ODD = re.compile("[^\\x00-\\x7fऀ-ॿ]")


@lru_cache(1 << 16)
def _decomposed(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def fold(text: str | None) -> str | None:
    """Compatibility decomposition without combining marks; ASCII and Devanagari stay as they are."""
    if text is None or text.isascii():
        return text
    return _ODD.sub(lambda m: _decomposed(m.group()), text)


@F.pandas_udf(T.StringType())
def fold_diacritics(texts: pd.Series) -> pd.Series:
    return texts.map(fold)


_Y = re.compile("(?<=[^aeiou])y")
_KINDS = str.maketrans({chr(c): "v" if chr(c) in "aeiou" else "c" for c in range(128)})


def _kinds(s: str) -> str:
    """v for each vowel, c for each other letter; y is a vowel after anything but one of the other vowels."""
    return (_Y.sub("a", s) if "y" in s else s).translate(_KINDS)


def _measure(stem: str) -> int:
    return _kinds(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _kinds(stem)


def _cvc(s: str) -> bool:
    return _kinds(s).endswith("cvc") and s[-1] not in "wxy"


_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
          "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=len, reverse=True)
_STEP23 = tuple((tuple(sorted(t, key=len, reverse=True)), t) for t in (_STEP2, _STEP3))
_ENDS4 = tuple(_STEP4)


def porter(word: str) -> str:
    """The stemmer of Porter (1980)."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for ends, table in _STEP23:
        for end in ends if w.endswith(ends) else ():
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in _STEP4 if w.endswith(_ENDS4) else ():
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def one(t: str) -> str:
        if t not in known:
            known[t] = porter(t)
        return known[t]

    return tokens.map(lambda ts: None if ts is None else [one(t) for t in ts])
