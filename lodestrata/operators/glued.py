"""Words that scans ran together: which sources have them, which words are safe, and where to part them.

Words are parted where the sum of their costs is least, the cost of a word being the logarithm of its rank (Zipf).
The vocabulary is that of the corpus without its glued sources, and a ranked list of common words where one is given.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import letter_runs
from lodestrata.functions.words import fold, fold_diacritics
from lodestrata.session import saved

# Fixed values that results depend on: the length of a glued run, the share of them that marks a source, lengths and
# counts of safe words, the least run to be parted, the share of it that has to be known, and the words that stand
# alone, or may end a name.
GLUED_LENGTH, GLUED_SHARE, SAFE_LENGTH, SAFE_COUNT = 15, 0.05, 3, 3
LEAST_RUN, KNOWN_SHARE, SHORT, SHORT_COUNT, SHORT_RANK, KNOWN_RANK = 8, 0.6, 3, 50, 2_000, 100_000
FUNCTION_WORDS = frozenset("a an and are as at be by for from has he his i in is it its of on or that the their this to was were which with".split())
ENDING_WORDS = frozenset("and are etc for from has its the their this was were which with".split())
UNKNOWN_LETTER = 1e6
# Bounds of what is broadcast, of what one task sorts, and of the parted runs that it remembers; results don't depend on them.
BROADCAST_SOURCES, SORTED_WORDS, MAX_KNOWN = 1_000_000, 100_000, 200_000
_RUN, _CASE = re.compile("[A-Za-z]+"), re.compile("(?<=[a-z])(?=[A-Z])")
#: Runs that may be parted: of LEAST_RUN letters, or with a change from lower to upper case.
_LONG_RUN = re.compile("(?<![A-Za-z])(?:[A-Za-z]{%d,}|(?=[A-Za-z]*[a-z][A-Z])[A-Za-z]+)" % LEAST_RUN)


def glued_ratio(docs: DataFrame, key: str = "source", text: str | Column = "text") -> DataFrame:
    """key, ratio: the share of a source's letter runs that are GLUED_LENGTH letters and more."""
    text = F.col(text) if isinstance(text, str) else text
    runs = docs.select(key, F.explode(letter_runs(text)).alias("w"))
    return runs.groupBy(key).agg(F.avg((F.length("w") >= GLUED_LENGTH).cast("int")).alias("ratio"))


def protected_words(docs: DataFrame, key: str = "source", text: str | Column = "text", extra: Iterable[str] = ()) -> DataFrame:
    """word, n: words of the sources that aren't glued, in lower case, seen SAFE_COUNT times; extra words count as seen that often.

    A source may be a large part of the corpus, so no word goes where its source goes: the glued sources, few, are
    broadcast, and words are counted before they are shuffled.
    """
    text = F.col(text) if isinstance(text, str) else text
    glued = saved(glued_ratio(docs, key, text).where(F.col("ratio") > GLUED_SHARE).select(key), "glued-sources")
    glued = F.broadcast(glued) if glued.count() <= BROADCAST_SOURCES else glued
    good = F.length("w").between(SAFE_LENGTH, GLUED_LENGTH - 1)
    runs = docs.join(glued, key, "left_anti").select(F.explode(letter_runs(text)).alias("w"))
    counts = runs.where(good).groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SAFE_COUNT)
    more = sorted({w for e in extra for w in _RUN.findall(fold(e).lower()) if len(w) >= SAFE_LENGTH})
    if more:
        added = docs.sparkSession.createDataFrame([(w, SAFE_COUNT) for w in more], "word string, n long")
        counts = counts.unionByName(added).groupBy("word").agg(F.max("n").alias("n"))
    return counts


@dataclass
class Splitter:
    """Parts glued runs. counts: safe words and how often they were seen; ranked: common words, the most frequent first."""

    counts: dict[str, int]
    ranked: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        rank = {w: i for i, w in enumerate(self.ranked)}
        for i, w in enumerate(sorted(self.counts, key=lambda w: (-self.counts[w], w))):
            rank[w] = min(i, rank.get(w, i))
        size = math.log(max(len(rank), 2))
        self.cost = {w: math.log((r + 1) * size) for w, r in rank.items()}
        self.longest = max(map(len, rank), default=1)
        self.known = frozenset(self.ranked[:KNOWN_RANK]) | self.counts.keys()
        self.short = frozenset(w for w in self.ranked[:SHORT_RANK] if len(w) <= SHORT) | {w for w, n in self.counts.items() if len(w) <= SHORT and n >= SHORT_COUNT}

    def sure(self, piece: str) -> bool:
        return piece.lower() in (self.short if len(piece) <= SHORT else self.known)

    def cheapest(self, run: str) -> list[str]:
        """The words of least total cost that make up the run; letters that begin no word stand alone."""
        low, best, step, cost = run.lower(), [0.0], [0], self.cost.get
        for end in range(1, len(run) + 1):
            total, length = best[end - 1] + cost(low[end - 1 : end], UNKNOWN_LETTER), 1
            for at in range(end - 2, max(0, end - self.longest) - 1, -1):  # of equal totals, the shortest last word
                if (c := cost(low[at:end])) is not None and best[at] + c < total:
                    total, length = best[at] + c, end - at
            best.append(total)
            step.append(length)
        out, end = [], len(run)
        while end:
            out.append(run[end - step[end] : end])
            end -= step[end]
        return out[::-1]

    def part(self, run: str) -> str:
        """A run of one case pattern, parted by spaces where that is safe, else as it is."""
        if len(run) < LEAST_RUN or run.lower() in self.known:
            return run
        pieces = self.cheapest(run)
        if len(pieces) < 2:
            return run
        if run[0].isupper() and len(run) < GLUED_LENGTH:  # most likely a name, with a small word before or after it
            last = pieces[-1]
            if pieces[0].lower() in FUNCTION_WORDS and all(map(self.sure, pieces)):
                return " ".join(pieces)
            return f"{run[: -len(last)]} {last}" if last.lower() in ENDING_WORDS and len(run) - len(last) >= 4 else run
        words = self.grouped(pieces)
        odd = [w for w, sure in words if not sure]
        share = 1 - sum(map(len, odd)) / len(run)
        good = len(words) > 1 and (share >= KNOWN_SHARE or len(odd) == 1 and len(odd[0]) >= 5)
        return " ".join(w for w, _ in words) if good else run

    def grouped(self, pieces: list[str]) -> list[tuple[str, bool]]:
        """Pieces with whether they are sure. Doubtful neighbours are one; short pieces beside them are parts of them, and
        a doubtful scrap of two letters belongs to what stands before it."""
        sure = [self.sure(p) for p in pieces]
        loose = [len(p) <= SHORT and p.lower() not in FUNCTION_WORDS for p in pieces]
        for order, back in ((range(1, len(pieces)), -1), (range(len(pieces) - 2, -1, -1), 1)):
            for i in order:
                sure[i] = sure[i] and not (loose[i] and not sure[i + back])
        out: list[tuple[str, bool]] = []
        for p, ok in zip(pieces, sure, strict=True):
            scrap = len(p) <= 2 and p.lower() not in ("a", "i")
            if out and not ok and (scrap or not out[-1][1]):
                out[-1] = (out[-1][0] + p, out[-1][1])
            else:
                out.append((p, ok))
        return out

    def split(self, text: str | None) -> str | None:
        """The text without diacritics, its letter runs parted; a change from lower to upper case parts them too."""
        return None if text is None else _RUN.sub(lambda m: " ".join(map(self.part, _CASE.split(m.group()))), fold(text))

    def column(self):
        @F.arrow_udf("string")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known: dict[str, str] = {}

            def one(m: re.Match) -> str:
                r = m.group()
                if r not in known:
                    known[r] = " ".join(map(self.part, _CASE.split(r)))
                return known[r]

            for texts in batches:
                if len(known) > MAX_KNOWN:
                    known.clear()
                yield pa.array([None if t is None else _LONG_RUN.sub(one, fold(t)) for t in texts.to_pylist()], pa.string())

        return run


def most_frequent(words: DataFrame, most: int) -> DataFrame:
    """words (word of letters a to z, n), each once: the first most by n, the largest first, then by word.

    How many words have an n, and then how many begin alike, tells where the last one stands; no task sorts all words.
    """
    room = most
    for n, k in sorted(words.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):
        if k > room:
            break
        room -= k
    else:
        return words
    start, tied, taken = "", words.where(F.col("n") == n), F.col("n") > n
    while k > max(SORTED_WORDS, room):
        heads = tied.groupBy(F.substring("word", 1, len(start) + 3).alias("h")).agg(F.count(F.lit(1)).alias("k"))
        for start, k in sorted(heads.collect()):
            if k > room:
                break
            room -= k
        taken = taken | (F.col("n") == n) & (F.col("word") < start)
        tied = tied.where(F.startswith("word", F.lit(start)))
    return words.where(taken).unionByName(tied.orderBy("word").limit(room))


def with_matching_text(children: DataFrame, extra: Iterable[str] = (), ranked: tuple[str, ...] = (), most: int = 500_000) -> DataFrame:
    """children (source, text) with bm25_text, what keywords are matched against.

    The vocabulary is learned from the same children, in a pass before; most bounds what of it reaches the driver, the
    rarest words being left out.
    """
    words = most_frequent(saved(protected_words(children, "source", fold_diacritics("text"), extra), "protected-words"), most)
    splitter = Splitter({r["word"]: r["n"] for r in words.collect()}, ranked)
    return children.withColumn("bm25_text", splitter.column()("text"))
