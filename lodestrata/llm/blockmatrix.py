"""Exact top-k inner products by a block matrix join.

Vectors are dealt into blocks of bounded size, queries into blocks of their own, and each tile of the grid is one
task: its int8 product (in float32, which holds these integers exactly) gives every inner product up to an error
bound; pairs whose upper bound reaches the query's k-th lower bound are computed again in double precision, and the
tiles' short lists are merged by heaps, FAN_IN lists at a time, in a tree. Nothing is pruned that the bound doesn't exclude, so recall is 1.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids;
vectors meet only vectors of their own length; rows that repeat an id count once, with the smallest vector; ties go
to the smaller id; with fewer than k candidates, all are returned. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.session import table

BLOCK_ROWS = 8192
QUERY_ROWS = 4096
FAN_IN = 64
MERGE_QUERIES = 256


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    v = F.col(vec_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    )
    return kept.groupBy("id").agg(F.min("v").alias("v"))


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values as float32, their scale, the norm of what is lost, and the norm of what is kept."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(x / scale[:, None])
    kept = codes * scale[:, None]
    return codes.astype(np.float32), scale, np.linalg.norm(x - kept, axis=1), np.linalg.norm(kept, axis=1)


def _matrix(t: pa.Table, id_col: str, vec_col: str) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column(id_col).to_numpy()
    values = t.column(vec_col).combine_chunks()
    flat = (values.flatten() if isinstance(values, pa.Array) else pa.concat_arrays([c.flatten() for c in values.chunks])).to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), -1)[order]


def exact_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def tile(queries: tuple[np.ndarray, np.ndarray], block: tuple[np.ndarray, np.ndarray], k: int, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score of each query's k nearest in the block."""
    qid, q = queries
    vid, v = block
    vc, vs, v_lost, v_kept = _quantised(v)
    v_norm = np.linalg.norm(v, axis=1)
    exact_float = v.shape[1] * 127 * 127 < 2**24
    out: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, len(qid), step):
        ids, x = qid[at : at + step], q[at : at + step]
        xc, xs, x_lost, x_kept = _quantised(x)
        near = (xc @ vc.T if exact_float else xc.astype(np.float64) @ vc.T.astype(np.float64)) * xs[:, None] * vs[None, :]
        bound = x_lost[:, None] * v_norm[None, :] + x_kept[:, None] * v_lost[None, :]
        bound += 1e-9 * (np.abs(near) + bound) + 1e-300
        low = near - bound
        low[ids[:, None] == vid[None, :]] = -np.inf
        if low.shape[1] > k:
            kth = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
        else:
            kth = np.full(len(ids), -np.inf)
        rows, cols = np.nonzero((near + bound >= kth[:, None]) & (ids[:, None] != vid[None, :]))
        score = exact_dots(x[rows], v[cols])
        order = np.lexsort((vid[cols], -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < k
        for part, got in zip(out, (ids[rows], vid[cols], score), strict=True):
            part.append(got[keep])
    return tuple(np.concatenate(p) if p else np.zeros(0) for p in out)  # type: ignore[return-value]


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20,
            block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by every."""
    good = usable(vectors, id_col, vec_col)
    n, n_queries = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col(id_col) % every == 0).cast("int")), F.lit(0))).first()
    n_blocks, q_blocks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(n_queries / query_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    q_block = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(q_blocks)).cast("int")
    every_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # The sides of a cogroup mustn't share attributes, so these have new ones.
    candidates = good.select(F.col("id").alias("c_id"), F.col("v").alias("c_v"), F.size("v").alias("dim"), block.alias("b"), every_of(q_blocks).alias("q"))
    queries = good.where(F.col("id") % every == 0).select("id", "v", F.size("v").alias("dim"), every_of(n_blocks).alias("b"), q_block.alias("q"))

    def tiles(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            found, b = tile(_matrix(left, "id", "v"), _matrix(right, "c_id", "c_v"), k), left["b"][0].as_py()
        else:
            found, b = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), 0
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64()),
                         "b": pa.array(np.full(len(found[0]), b), pa.int32()), "rank": pa.array(np.zeros(len(found[0])), pa.int32())})

    def merged(t: pa.Table) -> pa.Table:
        """The best of each query's lists, by heaps."""
        rows = sorted(zip(t["query_id"].to_pylist(), (-t["score"].to_numpy()).tolist(), t["vec_id"].to_pylist(), strict=True), key=lambda r: r[0])
        got = [(qid, vid, -score, t["b"][0].as_py() // FAN_IN, i + 1) for qid, run in groupby(rows, key=lambda r: r[0]) for i, (_, score, vid) in enumerate(heapq.nsmallest(k, run, key=lambda r: r[1:]))]
        cols = list(zip(*got, strict=True)) if got else [()] * 5
        return pa.table([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)],
                        names=["query_id", "vec_id", "score", "b", "rank"])

    lists = "query_id long, vec_id long, score double, b int, rank int"
    short = queries.groupBy("dim", "b", "q").cogroup(candidates.groupBy("dim", "b", "q")).applyInArrow(tiles, lists)
    # A merge takes FAN_IN lists of each of some MERGE_QUERIES queries; as many rounds as it takes to be left with one.
    group = F.pmod(F.xxhash64("query_id"), F.lit(max(1, math.ceil(n_queries / MERGE_QUERIES)))).alias("group")
    left = n_blocks
    while True:
        short = short.groupBy(group, F.floor(F.col("b") / FAN_IN).alias("over")).applyInArrow(merged, lists)
        left = math.ceil(left / FAN_IN)
        if left == 1:
            return short.select("query_id", "rank", "vec_id", "score")


def op10_block_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
