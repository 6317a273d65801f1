"""Names and their synonyms, and the tokens that documents and questions are matched by.

A dictionary is JSON: an object of entries, each with lists of names by field. It is small (a few thousand names at
most, MAX_NAMES is checked), so it travels with the tokenizer; texts stay where they are and need no shuffle.
"""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import ROMANIZED
from lodestrata.functions.words import ACRONYMS, STOPWORDS, TOKEN, fold, porter

log = logging.getLogger(__name__)

# Fixed values that results depend on: the fields of an entry that hold names, those in Sanskrit, and the letters that
# mark a word as written with diacritics.
NAME_FIELDS = ("sanskrit", "latin", "hindi", "english", "ayurvedic", "modern")
SANSKRIT_FIELDS = ("sanskrit", "hindi", "ayurvedic")
DIACRITIC = "[À-ɏḀ-ỿ]"
MAX_NAMES = 100_000
MAX_KNOWN = 200_000  # tokens whose company a task remembers from batch to batch; results don't depend on it

_TOKENS, _MARKED, _LATIN = re.compile(TOKEN), re.compile(DIACRITIC), re.compile("[A-Za-z]{3,}")
_ROMANIZABLE = re.compile("|".join(old for old, _ in ROMANIZED))
_STOPWORDS, _ACRONYMS = frozenset(STOPWORDS), frozenset(ACRONYMS)


def read_dictionary(spark: SparkSession, path: str) -> dict[str, dict]:
    """The entries of a JSON dictionary; none, with a warning, if it is missing or isn't an object."""
    try:
        text = spark.read.text(path, wholetext=True).first()
        found = json.loads(text[0]) if text else None
    except (PySparkException, ValueError) as problem:
        log.warning("no dictionary at %s: %s", path, problem)
        return {}
    if not isinstance(found, dict):
        log.warning("no dictionary at %s: not an object", path)
        return {}
    return {k: v for k, v in found.items() if isinstance(v, dict)}


def names_of(entry: dict, fields: Iterable[str] = NAME_FIELDS) -> list[str]:
    return list(dict.fromkeys(n.strip() for f in fields for n in entry.get(f) or () if isinstance(n, str) and n.strip()))


def romanized(word: str) -> str:
    """As functions.text.romanization_key, for one word."""
    if _ROMANIZABLE.search(word) and _LATIN.fullmatch(word):
        for old, new in ROMANIZED:
            word = word.replace(old, new)
    return word


def common_words(texts: Column | str, docs: DataFrame, most: int = 50_000) -> frozenset[str]:
    """The most frequent words of a corpus of plain English, which romanization has to leave alone. most bounds what is collected."""
    text = F.col(texts) if isinstance(texts, str) else texts
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return frozenset(r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most).collect())


@dataclass
class Lexicon:
    """Synonyms by exact name and by romanization key, and which words count as Sanskrit or as English."""

    entries: list[dict]
    english: frozenset[str] = frozenset()
    exact: dict[str, set[str]] = field(init=False)
    keyed: dict[str, set[str]] = field(init=False)
    sanskrit: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        names = [names_of(e) for e in self.entries]
        if sum(map(len, names)) > MAX_NAMES:
            raise ValueError(f"a dictionary may have {MAX_NAMES} names")
        self.sanskrit = frozenset(w for e in self.entries for n in names_of(e, SANSKRIT_FIELDS) for w in re.findall("[a-z]+", fold(n).lower()))
        self.exact, self.keyed = {}, {}
        for group in names:
            for name in group:
                if " " not in name:  # the words of longer names belong to many entries
                    self.exact.setdefault(name.lower(), set()).update(group)
        for name, group in self.exact.items():
            plain = fold(name).lower()
            if self.wants_key(plain):
                self.keyed.setdefault(romanized(plain), set()).update(group)

    @classmethod
    def load(cls, spark: SparkSession, paths: Iterable[str], english: frozenset[str] = frozenset()) -> Lexicon:
        return cls([e for p in paths for e in read_dictionary(spark, p).values()], english)

    def wants_key(self, token: str, marked: frozenset[str] | set[str] = frozenset()) -> bool:
        """Whether a folded token is looked up by its romanization key: Sanskrit by its letters or the dictionary, or no English word, nor its key."""
        return token in marked or token in self.sanskrit or not (token in self.english or romanized(token) in self.english)

    def synonyms(self, term: str) -> set[str]:
        """All names of the entries that term names, and term itself."""
        if not term:
            return set()
        plain = fold(term).lower()
        by_key = self.keyed.get(romanized(plain), set()) if self.wants_key(plain) else set()
        return {term} | self.exact.get(term.lower(), set()) | by_key

    def with_keys(self, tokens: Iterable[str], marked: set[str] | frozenset[str] = frozenset()) -> Iterator[str]:
        """Each token, and after it its romanization key if that is another word."""
        for t in tokens:
            yield t
            if t.isascii() and t not in _ACRONYMS and (key := romanized(t)) != t and self.wants_key(t, marked):
                yield key

    def variants(self, token: str) -> list[str]:
        """The tokens of a token's synonyms, as documents have them."""
        names = sorted(self.synonyms(token)) if token.lower() in self.exact or romanized(fold(token).lower()) in self.keyed else (token,)
        return [t for n in names for t in self.with_keys(_TOKENS.findall(fold(n).lower())) if t not in _STOPWORDS]

    def marked(self, text: str) -> set[str]:
        """The tokens of the words of a text that are written with diacritics."""
        return {t for w in text.lower().split() if not w.isascii() and _MARKED.search(w) for t in _TOKENS.findall(fold(w))}

    def tokenize(self, text: str | None, synonyms: bool = True, stem: bool = True, known: Company | None = None) -> list[str]:
        """Distinct tokens in order: surface forms without stop words, each followed by its key, synonyms and stems.

        Runs of Devanagari stay whole; they and acronyms get no keys, synonyms or stems. known remembers a token's
        company, for many texts; synonyms and stem are then as known has them.
        """
        if not text:
            return []
        known = Company(self, synonyms, stem) if known is None else known
        found = dict.fromkeys(_TOKENS.findall(fold(text).lower()))
        marked = self.marked(text) if self.english and not text.isascii() else ()  # without English words every token wants its key
        company = (known.marked[t] if t in marked else known[t] for t in found) if marked else map(known.__getitem__, found)
        return list(dict.fromkeys(chain.from_iterable(company)))

    def tokens(self, synonyms: bool = True, stem: bool = True):
        """tokenize as a function of columns, in Arrow batches."""

        @F.arrow_udf("array<string>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = Company(self, synonyms, stem)
            for texts in batches:
                known.bound()
                yield pa.array([self.tokenize(t, synonyms, stem, known) for t in texts.to_pylist()], pa.list_(pa.string()))

        return run

    def synonym_index(self, spark: SparkSession) -> DataFrame:
        """name, key, variant: the exact index as a table."""
        rows = [(name, romanized(fold(name).lower()), v) for name, group in sorted(self.exact.items()) for v in sorted(group)]
        return spark.createDataFrame(rows, "name string, key string, variant string")


class Company(dict):
    """By surface token: the token, its key, and the synonyms and stems of both, made when first asked for; none for a stop
    word. marked has the same for tokens written with diacritics."""

    def __init__(self, lexicon: Lexicon, synonyms: bool = True, stem: bool = True, marks: bool = False) -> None:
        self.lexicon, self.synonyms, self.stem, self.marks = lexicon, synonyms, stem, marks
        self.marked = None if marks else Company(lexicon, synonyms, stem, True)

    def __missing__(self, token: str) -> tuple[str, ...]:
        found: dict[str, None] = {}
        for t in self.lexicon.with_keys((token,), {token} if self.marks else frozenset()) if token not in _STOPWORDS else ():
            for c in (t, *self.lexicon.variants(t)) if self.synonyms and t.isascii() and t not in _ACRONYMS else (t,):
                if c not in found:
                    found[c] = None
                    if self.stem and c.isascii() and c not in _ACRONYMS:
                        found[porter(c)] = None
        self[token] = out = tuple(found)
        return out

    def bound(self) -> None:
        """Forgets what it has if that is over MAX_KNOWN tokens."""
        for each in (self, self.marked):
            if len(each) > MAX_KNOWN:
                each.clear()


def lookup_names(entries: dict[str, dict], shortest: int = 4) -> list[tuple[str, str, str]]:
    """(entry, what to call it, a name of it in lower case) for each name of shortest characters at least, in order of the dictionary."""
    out = []
    for key, entry in entries.items():
        display = next(iter(names_of(entry, ("sanskrit",))), key)
        out += [(key, display, n) for n in dict.fromkeys(x.lower() for x in names_of(entry)) if len(n) >= shortest]
    return out
