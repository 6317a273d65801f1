"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted texts and the raw corpus.

Words and word pairs are hashed into n_buckets. The raw multinomial counts every n-gram of every document; the target
multinomial counts those of all trusted documents (quality 1, not toxic), whose ids are joined to the corpus whatever
their number, or of the max_target ones with the smallest id hashes if that is given. No text is shuffled for that, unless
ids lie so far apart that the executors shouldn't all hold them (see marked). The target is smoothed towards
the raw corpus, so that a bucket without evidence weighs nothing. A document's score is the mean log ratio of its
n-grams; it is kept if that reaches min_score and the base rules hold. Weights are whole millionths, so sums are exact
in any order. Everything is DataFrame expressions; only the n_buckets weights and the blocks of ids, most_blocks at most,
pass through the driver.

A window of eight words is known by a 64-bit hash: pairs of word hashes are hashed, then pairs of pairs, then pairs of those.

Edge cases: a null text has no words, fails the base rule (under 20 words) and isn't kept; without labels or trusted
documents all ratios are 0, so the base rules decide; a label row repeated counts once; rows that repeat an id are
judged one by one; an empty table gives no rows. Other columns are ignored by score_documents and kept by keep_good.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.words import WORD, words
from lodestrata.session import table

N_BUCKETS = 8192
MIN_SCORE = -0.05
SPAN = 8
MICRO = 1_000_000
MOST_BLOCKS = 1 << 19  # of 64 ids each


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def doubled(hashes: Column, step: int) -> Column:
    """Hashes of the pairs of hashes that stand step places apart, one for each place that has such a partner."""
    return F.when(F.size(hashes) <= step, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice(hashes, step + 1, F.greatest(F.size(hashes) - step, F.lit(0))), lambda x, i: F.xxhash64(F.get(hashes, i), x)))


def repeat_words(windows: Column, span: int = SPAN) -> Column:
    """Words inside windows of span words that the text has twice or more."""
    def flagged(placed: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        twice = F.filter(placed, lambda x, i: same(x, F.get(placed, i - 1)) | same(x, F.get(placed, i + 1)))
        places = F.sort_array(F.transform(twice, lambda x: x["at"]))
        total = F.aggregate(
            places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-span).cast("long").alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(span).cast("long"), p - acc["last"])).alias("n"), p.alias("last")))
        return total["n"]

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("at"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(placed, flagged))


def base_counts(text: Column, w: Column, windows: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(WORD)))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(windows),
    }


def trusted_ids(labels: DataFrame, max_target: int | None = None) -> DataFrame:
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    ids = good.select(F.col("doc_id").cast("long").alias("t_id")).distinct()
    return ids if max_target is None else ids.orderBy(F.xxhash64("t_id"), "t_id").limit(max_target)


def marked(docs: DataFrame, ids: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """docs (id and other columns) with t, 1 where ids (t_id) has the id, else 0.

    Each 64 ids from a multiple of 64 on are the bits of one long. Up to most_blocks of those that aren't 0 are sent to all
    executors, so that docs stay where they are; if there are more, docs and ids are shuffled and merged.
    """
    blocks = ids.groupBy(F.shiftright("t_id", 6).alias("block")).agg(F.expr("bit_or(shiftleft(1L, cast(t_id & 63 as int)))").alias("bits"))
    if blocks.count() > most_blocks:
        return docs.join(ids.hint("merge"), F.col("id") == F.col("t_id"), "left").withColumn("t", F.col("t_id").isNotNull().cast("long")).drop("t_id")
    met = docs.join(F.broadcast(blocks), F.shiftright("id", 6) == F.col("block"), "left")
    return met.withColumn("t", F.expr("coalesce(getbit(bits, cast(id & 63 as int)), 0)").cast("long")).drop("block", "bits")


def bucket_weights(docs: DataFrame, labels: DataFrame, n_buckets: int = N_BUCKETS, max_target: int | None = None,
                   id_col: str = "doc_id", text_col: str = "text", most_blocks: int = MOST_BLOCKS) -> list[int]:
    """The log ratio of each bucket in millionths."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = marked(slim, trusted_ids(labels, max_target), most_blocks)  # texts are smaller than their hashes where they're shuffled
    both = let(word_hashes(words(F.col("text"))), lambda h: F.concat(h, doubled(h, 1)))
    grams = joined.select("t", F.explode(both).alias("h"))
    rows = grams.select("t", F.pmod("h", F.lit(n_buckets)).cast("int").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")).collect()  # n_buckets rows at most
    return weights_of({r["b"]: (r["raw"], r["target"]) for r in rows}, n_buckets)


def weights_of(counts: dict[int, tuple[int, int]], n_buckets: int) -> list[int]:
    raw_total, target_total = (sum(x[i] for x in counts.values()) for i in (0, 1))
    out = [0] * n_buckets
    for b, (raw, target) in counts.items():
        share = raw / raw_total
        out[b] = round(MICRO * (math.log((target + n_buckets * share) / (target_total + n_buckets)) - math.log(share)))
    return out


def verdict_of(text: Column, weights: list[int], min_score: float = MIN_SCORE) -> Column:
    """A struct of the base counts, base_failed, score and kept. Words and hashes are found once a row."""
    table_of = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<long>")  # folded into a literal
    zero = F.lit(0).cast("long")

    def scored(w: Column, h: Column, pairs: Column) -> Column:
        weight = lambda acc, x: acc + F.get(table_of, F.pmod(x, F.lit(len(weights))).cast("int"))
        total = F.aggregate(pairs, F.aggregate(h, zero, weight), weight)
        n_grams = F.size(h) + F.size(pairs)
        score = F.when(n_grams > 0, total.cast("double") / n_grams / MICRO).otherwise(0.0)
        windows = let(doubled(pairs, 2), lambda four: doubled(four, 4))
        return let(windows, lambda eight: F.struct(*[c.alias(k) for k, c in base_counts(text, w, eight).items()], score.alias("score")))

    def judged(x: Column) -> Column:
        failed = (x["n_words"] < 20) | (100 * x["n_repeat_words"] > 30 * x["n_words"])
        counts = [x[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return F.struct(*counts, failed.alias("base_failed"), x["score"].alias("score"), (~failed & (x["score"] >= min_score)).alias("kept"))

    return let(words(text), lambda w: let(word_hashes(w), lambda h: let(let(doubled(h, 1), lambda pairs: scored(w, h, pairs)), judged)))


def with_verdict(docs: DataFrame, weights: list[int], min_score: float = MIN_SCORE, text_col: str = "text", name: str = "_verdict") -> DataFrame:
    """docs with a struct column: the base counts, base_failed, score and kept.

    A generator gives it: no filter is pushed below one, so what reads the verdict never evaluates it again.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select("*", F.explode_outer(F.array(verdict_of(text, weights, min_score))).alias(name))


def free_name(columns: list[str], name: str) -> str:
    """name, with as many underscores before it as no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def score_documents(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE, **kwargs) -> DataFrame:
    weights = bucket_weights(docs, labels, **kwargs)
    slim = docs.select("doc_id", F.col("text").alias("text"))
    return with_verdict(slim, weights, min_score).select("doc_id", "_verdict.*")


def keep_good(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE, **kwargs) -> DataFrame:
    """The rows of docs that are kept, as they are."""
    weights = bucket_weights(docs, labels, **kwargs)
    name = free_name(docs.columns, "_verdict")
    return with_verdict(docs, weights, min_score, name=name).where(F.col(f"`{name}`.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
