"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents stand in one permuted order (MD5 of seed, id and text), and that stream of words is cut into
blocks. A source's quota is the number of blocks to draw: all of them in each full epoch, and in a last one as many as
reach the target, the last of which is cut to fit. The quotas are split over the output shards: a node of the tree
draws its left half from a multivariate hypergeometric law, so every draw goes to exactly one shard and each shard's mix
is exact in expectation. A Feistel permutation of a source's blocks in an epoch says which block a draw takes; shards
hold disjoint ranges of the draws. What a document gives is what the draws take of its blocks, nothing else, so one that
lies in blocks the last epoch doesn't draw gives nothing there. Shards order what they hold by a hash of their own.

Documents are measured once; what is planned on are their sizes, in a table of their own, where rows of one source, id and
text are counted. Running sums over a source are taken in two steps, inside hash buckets and over the buckets' sums, so
that no task sees a whole source. Texts join what is drawn of them at the end. What reaches the driver is one row a source, and MAX_CUTS quotas at most: shards grow instead.

Edge cases: a null text has size 0 and is never taken; null is a source of its own, last in order; rows that repeat
an id are documents of their own; sources without words get target 0; an empty table gives no rows. Other columns
are ignored by mix_slices; mix_documents keeps the columns of its input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.quality import let
from lodestrata.llm.words import n_words, words
from lodestrata.session import saved, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 17
MAX_BLOCKS = 2**28
BLOCK_WORDS = 256
MAX_CUTS = 4_000_000
# Fixed values that results depend on: the prime and factors of the permutation, which the SQL shares.
PRIME, FACTOR, ROUNDS = 2**31 - 1, 48271, 6
KEY_FACTORS = (7919, 104729, 1299709, 15485863)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_no (from 0, nulls last), source_size, target, n_docs. Water filling: capped sources come first in order of cap by weight."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    cap = F.col("source_size") * max_repeats
    order = W.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (
        by_source.withColumn("rank", rank)
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("capped_before", F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped_before")).cast("double") / F.col("weight_left"))
        .withColumn("free", cap > F.col("weight") * F.col("level"))
    )
    final = F.min(F.when(F.col("free"), F.struct((cap / F.col("weight")).alias("r"), F.col("level").alias("level")))).over(W.partitionBy())
    return level.withColumn("final", final).select(
        "source", (F.col("rank") - 1).cast("int").alias("source_no"), "source_size", "n_docs",
        F.when(F.col("free"), F.col("weight") * F.col("final.level")).otherwise(cap.cast("double")).alias("target"),
    )


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources: how many blocks of each source go to each shard."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(counts: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid, total = (lo + hi) // 2, int(counts.sum())
        n_left = total * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(counts, n_left, method="marginals") if total else counts
        split(left, lo, mid)
        split(counts - left, mid, hi)

    split(np.asarray(quotas, np.int64), 0, shards)
    return out


def permuted(x: np.ndarray, n: int, seed: int, source_no: int, epoch: int) -> np.ndarray:
    """A permutation of 0..n-1: a Feistel network on pairs of digits to the base root(n), walked until it lands below n."""
    base = math.isqrt(max(n - 1, 0)) + 1

    def once(v: np.ndarray) -> np.ndarray:
        high, low = v // base, v % base
        for r in range(ROUNDS):
            key = sum(f * k for f, k in zip(KEY_FACTORS, (seed, source_no, epoch, r), strict=True)) % PRIME
            y = ((high if r % 2 else low) + key) % PRIME
            y = (y * y % PRIME * FACTOR + key) % PRIME
            if r % 2:
                low = (low + y) % base
            else:
                high = (high + y) % base
        return high * base + low

    v = once(np.asarray(x, np.int64))
    while len(far := np.flatnonzero(v >= n)):
        v[far] = once(v[far])
    return v


@dataclass
class Draws:
    """A source's blocks and how often they are drawn: epochs times all of them, then the first `more` in permuted order.

    The last of these gives its first last_words words.
    """

    no: int
    n_words: int
    n_blocks: int
    epochs: int
    more: int
    last_words: int

    @property
    def quota(self) -> int:
        return self.epochs * self.n_blocks + self.more


def draws_of(no: int, n_words: int, take: int, block: int, seed: int) -> Draws:
    if not n_words or not take:
        return Draws(no, n_words, math.ceil(n_words / block), 0, 0, 0)
    n, epochs, rest = math.ceil(n_words / block), take // n_words, take % n_words
    if not rest:
        return Draws(no, n_words, n, epochs, 0, 0)
    lacks = n * block - n_words  # words that the source's last block is short of
    place = int(permuted(np.array([n - 1]), n, seed, no, epochs)[0])
    words_before = lambda k: k * block - (lacks if place < k else 0)
    more = math.ceil(rest / block)
    more += words_before(more) < rest
    return Draws(no, n_words, n, epochs, more, rest - words_before(more - 1))


@dataclass
class Mix:
    """takes: a row for each document and epoch that may draw from it, and what is drawn: starts, lengths (words of the
    document), shards, one entry a block, all empty where nothing is. It has row_key, doc_id, source, source_no, size, source_size,
    target, key, epoch, and row if it was kept. cuts: running quotas, shards x sources."""

    takes: DataFrame
    repeated: DataFrame | None
    draws: list[Draws]
    cuts: np.ndarray
    block_words: int
    seed: int


def drawn(draws: list[Draws], cuts: np.ndarray, block: int, seed: int):
    """A function of (source_no, epoch, at, size), size words from place at of the source's stream: starts, lengths, shards."""

    @F.pandas_udf("starts array<long>, lengths array<long>, shards array<int>")
    def run(no: pd.Series, epoch: pd.Series, at: pd.Series, size: pd.Series) -> pd.DataFrame:
        no, epoch, at, size = (x.to_numpy(np.int64) for x in (no, epoch, at, size))
        count = np.where(size > 0, (at + np.maximum(size, 1) - 1) // block - at // block + 1, 0)
        ends = np.cumsum(count)
        row = np.repeat(np.arange(len(no)), count)
        blocks = at[row] // block + np.arange(len(row)) - np.repeat(ends - count, count)
        place, limit = np.full(len(row), -1), np.zeros(len(row), np.int64)
        for s, e in {(int(a), int(b)) for a, b in zip(no, epoch, strict=True)}:
            d = draws[s]
            mine = np.flatnonzero((no[row] == s) & (epoch[row] == e))
            if not len(mine) or e > d.epochs:
                continue
            order = permuted(blocks[mine], d.n_blocks, seed, s, e)
            place[mine] = np.where(e * d.n_blocks + order < d.quota, e * d.n_blocks + order, -1)
            limit[mine] = np.where((e == d.epochs) & (order == d.more - 1), d.last_words, block)
        begin = np.maximum(at[row], blocks * block)
        stop = np.minimum(np.minimum(at[row] + size[row], (blocks + 1) * block), blocks * block + limit)
        good = (place >= 0) & (stop > begin)
        shard = np.zeros(len(row), np.int32)
        for s in np.unique(no):
            mine = np.flatnonzero(good & (no[row] == s))
            shard[mine] = np.searchsorted(cuts[:, s], place[mine], side="right")
        cut = np.searchsorted(row[good], np.arange(1, len(no)))
        parts = [np.split(x[good], cut) for x in (begin - at[row], stop - begin, shard)]
        return pd.DataFrame(dict(zip(("starts", "lengths", "shards"), parts, strict=True)))

    return run


def _key(seed: int, id_col: str, text: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             shard_words: int = 4_000_000, block_words: int = BLOCK_WORDS, seed: int = SEED) -> Mix:
    text = F.col(f"`{text_col}`").cast("string")
    measured = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(text).alias("size"), _key(seed, id_col, text).alias("key"))
    rows = saved(measured.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("n")), "sizes")
    n_docs, most = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    digits = max(1, math.ceil(math.log(max(n_docs, 1) / 1000 + 1, 16)))
    rows = rows.withColumn("bucket", F.substring("key", 1, digits)).withColumn("words", F.col("size") * F.col("n"))
    plan = [r.asDict() for r in source_targets(rows.select("source", F.col("words").alias("size"))).orderBy("source_no").collect()]  # one row a source
    total = sum(r["source_size"] for r in plan)
    block_words = max(block_words, math.ceil(MAX_REPEATS * total / MAX_BLOCKS))
    shards = min(max(1, math.ceil(total / shard_words)), max(1, MAX_CUTS // max(len(plan), 1)))
    draws = [draws_of(r["source_no"], r["source_size"], math.floor(r["target"] + 0.5), block_words, seed) for r in plan]
    cuts = split_quotas(np.array([d.quota for d in draws], np.int64), shards, seed).cumsum(axis=0) if plan else np.zeros((1, 0), np.int64)
    schema = T.StructType([
        T.StructField("k_source", T.StringType()), T.StructField("source_no", T.IntegerType()), T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()), T.StructField("last_epoch", T.IntegerType()),
    ])
    last = lambda d: d.epochs if d.more else max(d.epochs - 1, 0)
    known = docs.sparkSession.createDataFrame([(r["source"], r["source_no"], r["source_size"], r["target"], last(d)) for r, d in zip(plan, draws, strict=True)], schema)
    sums = rows.groupBy("source", "bucket").agg(F.sum("words").alias("bucket_size"))
    offsets = sums.withColumn(
        "offset", F.coalesce(F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    in_bucket = W.partitionBy("source", "bucket").orderBy("key", "size", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("in_bucket", F.sum("words").over(in_bucket) - F.col("words"))
    o = offsets.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), "offset")
    k = F.broadcast(known) if len(plan) <= 10_000 else known
    placed = (
        placed.join(o, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
        .join(k, F.col("source").eqNullSafe(F.col("k_source")))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .withColumn("at", F.col("offset") + F.col("in_bucket") + (F.col("copy") - 1) * F.col("size"))
    )
    takes = (
        placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.when(F.col("size") > 0, F.col("last_epoch")).otherwise(0))))
        .withColumn("d", drawn(draws, cuts, block_words, seed)("source_no", "epoch", "at", "size"))
        .select(F.concat_ws("/", F.col("source_no").cast("string"), "key", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), F.col("copy").cast("string")).alias("row_key"),
                "doc_id", "source", "source_no", "size", "source_size", "target", "key", "copy", "epoch", "d.*")
    )
    return Mix(takes, rows.where("n > 1").select("source", "key", "doc_id") if most > 1 else None, draws, cuts, block_words, seed)


def mix_slices(docs: DataFrame, **kwargs) -> DataFrame:
    """row_key, doc_id, size, source_size, target, and for each slice of a document drawn: epoch, start, n_taken, shard, order.

    A document has one row with n_taken 0 for each epoch that draws nothing of it.
    """
    mix = plan_mix(docs, **kwargs)
    one = F.explode_outer(F.arrays_zip("starts", "lengths", "shards")).alias("x")
    return mix.takes.select("row_key", "doc_id", "source", "source_no", "size", "source_size", "target", "key", "copy", "epoch", one).select(
        "row_key", "doc_id", "source", "size", "source_size", "target", "epoch", F.col("x.starts").alias("start"),
        F.coalesce("x.lengths", F.lit(0)).cast("long").alias("n_taken"), F.col("x.shards").alias("shard"),
        F.xxhash64(F.lit(mix.seed), "source_no", "key", "copy", "epoch", "x.starts").alias("order"))


def mix_documents(docs: DataFrame, **kwargs) -> DataFrame:
    """The mix with the columns of docs: a row for each epoch that draws from a document, in shards in their shuffled order.

    A text of which only a part is drawn is cut to those words, in order, joined by one space. Its shard is that of the
    first of them.
    """
    mix = plan_mix(docs, **kwargs)
    text = F.col("row.text").cast("string")
    heavy = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("r_source"),
                        _key(mix.seed, "doc_id", F.col("text").cast("string")).alias("r_key"), F.col("doc_id").alias("r_id"))
    alike = lambda d: F.col("r_source").eqNullSafe(d["source"]) & (F.col("r_key") == d["key"]) & F.col("r_id").eqNullSafe(d["doc_id"])
    one = F.lit(1).cast("long").alias("r_copy")
    if mix.repeated is None:
        numbered = heavy.select("*", one)
    else:
        no = F.row_number().over(W.partitionBy("r_source", "r_key", "r_id").orderBy(F.xxhash64(F.to_json("row")))).cast("long").alias("r_copy")
        many = heavy.join(mix.repeated.hint("merge"), alike(mix.repeated), "left_semi").select("*", no)
        numbered = heavy.join(mix.repeated.hint("merge"), alike(mix.repeated), "left_anti").select("*", one).unionByName(many)
    takes = mix.takes.where(F.size("starts") > 0)
    taken = numbered.join(takes.hint("merge"), alike(takes) & (F.col("r_copy") == takes["copy"]))
    n_taken = F.aggregate("lengths", F.lit(0).cast("long"), lambda acc, n: acc + n)
    parts = let(words(text), lambda w: F.flatten(F.zip_with("starts", "lengths", lambda a, n: F.slice(w, a.cast("int") + 1, n.cast("int")))))
    cut = F.when(n_taken == F.col("size"), text).otherwise(F.array_join(parts, " "))
    columns = [(cut if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    shard, order = F.element_at("shards", 1).alias("_shard"), F.xxhash64("source_no", "key", "copy", "epoch").alias("_order")
    return taken.select(F.struct(*columns).alias("row"), shard, order).repartition("_shard").sortWithinPartitions("_shard", "_order").select("row.*")


def op7_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken is the sum of the slices that the shards draw. Which shard draws a slice doesn't change it, so SQL can check it."""
    slices = mix_slices(table(spark, sf_dir, "documents"))
    return slices.groupBy("row_key", "doc_id", "size", "source_size", "target").agg(F.sum(F.when(F.col("shard") >= 0, F.col("n_taken")).otherwise(0)).alias("taken")).drop("row_key")


OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
    sum(source_size) OVER ()::BIGINT AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
    FROM w WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST)),
f AS (SELECT *, 3 * source_size > weight * lev AS free FROM l),
t AS (SELECT source, no, source_size, CASE WHEN free THEN weight * (SELECT arg_min(lev, (3 * source_size)::DOUBLE / weight) FROM f WHERE free)
    ELSE (3 * source_size)::DOUBLE END AS target FROM f),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS take, (source_size + {BLOCK_WORDS} - 1) // {BLOCK_WORDS} AS n, ceil(sqrt((source_size + {BLOCK_WORDS} - 1) // {BLOCK_WORDS}))::BIGINT AS base,
    CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
p(no, x, n, base, epochs, high, low, i) AS (
  SELECT no, x, n, base, epochs, x // base, x % base, 0::BIGINT FROM (SELECT *, unnest(range(0, n)) AS x FROM b WHERE n > 0)
  UNION ALL
  SELECT no, x, n, base, epochs, CASE WHEN i % 2 = 0 THEN (high + y) % base ELSE high END, CASE WHEN i % 2 = 1 THEN (low + y) % base ELSE low END, i + 1
  FROM (SELECT *, (((CASE WHEN i % 2 = 1 THEN high ELSE low END + key) % {PRIME}) * ((CASE WHEN i % 2 = 1 THEN high ELSE low END + key) % {PRIME}) % {PRIME} * {FACTOR} + key) % {PRIME} AS y
    FROM (SELECT *, ({KEY_FACTORS[0] * SEED} + {KEY_FACTORS[1]} * no + {KEY_FACTORS[2]} * epochs + {KEY_FACTORS[3]} * (i % {ROUNDS})) % {PRIME} AS key FROM p
      WHERE i = 0 OR i % {ROUNDS} > 0 OR high * base + low >= n))),
o AS (SELECT no, x, least({BLOCK_WORDS}, source_size - {BLOCK_WORDS} * x) AS words, high * p.base + low AS place FROM p JOIN b USING (no) WHERE i > 0 AND i % {ROUNDS} = 0 AND high * p.base + low < p.n),
g AS (SELECT no, x, greatest(0, least(words, take % source_size - (sum(words) OVER (PARTITION BY no ORDER BY place) - words)))::BIGINT AS got FROM o JOIN b USING (no)),
c AS (SELECT d.*, b.no, b.source_size, b.target, b.epochs, sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS pos
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
m AS (SELECT *, row_number() OVER () AS row_no FROM c),
e AS (SELECT row_no, sum(greatest(0, least(pos + size, x * {BLOCK_WORDS} + got) - greatest(pos, x * {BLOCK_WORDS})))::BIGINT AS more
    FROM (SELECT *, unnest(range(pos // {BLOCK_WORDS}, (pos + size - 1) // {BLOCK_WORDS} + 1)) AS x FROM m WHERE size > 0) JOIN g USING (no, x) GROUP BY row_no)
SELECT doc_id, size, source_size, target, (epochs * size + coalesce(more, 0))::BIGINT AS taken FROM m LEFT JOIN e USING (row_no)
"""
