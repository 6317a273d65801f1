"""Conflict-constrained best-fit packing of documents into fixed-length sequences.

A document is cut into pieces of capacity words; full pieces fill bins of their own and the rests are packed, largest
first. Bins stand in the order of their residual room and carry bitmaps: of their sources (one bitmap a layer, so
that max_per_source pieces of a source may meet) and of their duplicate clusters. The successor search starts at the
smallest residual that holds the piece and goes on until it finds the tightest bin without a conflict; a piece that
fits nowhere opens a bin. Among bins of one residual the oldest is taken.

Pieces are dealt at random into groups of bounded expected size, each packed by itself, so no task sees more than one
group however hot a source or cluster is; a few bins a group stay less than full, which is the price.

Edge cases: a document without words, or null, has one piece of 0 words and no bin; null is a source of its own; the
cluster defaults to the text in lower case with single spaces, so copies never share a bin; rows that repeat an id
are packed as rows of their own (copies, so in bins of their own); an empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.words import words
from lodestrata.session import saved, table

CAPACITY = 2048
MAX_PER_SOURCE = 2
GROUP_PIECES = 8192


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, max_per_source: int) -> list[int]:
    """The bin of each piece, given largest first. sources, clusters: single-bit integers, cluster 0: no conflict."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin has residual r
    layers: list[list[int]] = []
    members: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        found, room = -1, 0
        ahead = rooms >> size
        room = size
        while ahead:
            step = (ahead & -ahead).bit_length() - 1
            room += step
            for i in by_room[room]:
                if not (layers[i][-1] & source or members[i] & cluster):
                    found = i
                    break
            if found >= 0:
                break
            ahead >>= step + 1
            room += 1
        if found < 0:
            found, room = len(members), capacity
            layers.append([0] * max_per_source)
            members.append(0)
        else:
            by_room[room].remove(found)
            if not by_room[room]:
                rooms &= ~(1 << room)
        for j in range(max_per_source):
            if not layers[found][j] & source:
                layers[found][j] |= source
                break
        members[found] |= cluster
        left = room - size
        if left:
            slot = by_room[left]
            slot.append(found)
            if len(slot) > 1 and slot[-2] > found:
                slot.sort()
            rooms |= 1 << left
        out.append(found)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None,
         capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, n_words, source, bin_id, bin_words: one row a piece; bins hold capacity words at most.

    cluster_col: what mustn't share a bin; where it is null, or not given, the text decides. Reruns give the same bins.
    """
    w = words(F.col(f"`{text_col}`").cast("string"))
    same = F.md5(F.lower(F.array_join(w, " ")))
    cluster = same if cluster_col is None else F.coalesce(F.col(f"`{cluster_col}`").cast("string"), same)
    described = saved(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
                                  F.size(w).cast("long").alias("size"), cluster.alias("cluster")), "sizes")
    groups = max(1, math.ceil(described.count() / group_pieces))
    # Rows that are alike are counted, then told apart by a number, so that no group of copies meets in one task.
    counted = described.groupBy("doc_id", "source", "size", "cluster").agg(F.count(F.lit(1)).alias("n"))
    sized = counted.select("doc_id", "source", "size", "cluster", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    full = F.floor(F.col("size") / capacity).cast("int")
    rest = (F.col("size") % capacity).cast("int")
    whole = sized.where(F.col("size") >= capacity).select(
        "doc_id", F.posexplode(F.sequence(F.lit(0), full - 1)).alias("piece", "_"), "source", "cluster", "copy",
    ).select(
        "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).alias("n_words"), "source",
        F.concat_ws("-", F.lit("whole"), F.md5(F.to_json(F.struct("doc_id", "source", "cluster"))), F.col("copy").cast("string"), F.col("piece").cast("string")).alias("bin_id"),
        F.lit(capacity).alias("bin_words"),
    )
    none = sized.where("size = 0").select(
        "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).alias("n_words"), "source",
        F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("int").alias("bin_words"))
    rests = sized.where(rest > 0).select(
        "doc_id", full.alias("piece"), (full.cast("long") * capacity).alias("start"), rest.alias("n_words"), "source", "cluster",
        F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(groups)).cast("int").alias("g"))

    def packed(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (-r["n_words"], r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["cluster"] or "", r["source"] or ""))
        source_bit: dict = {}
        counts: dict = {}
        for r in rows:
            source_bit.setdefault(r["source"], 1 << len(source_bit))
            counts[r["cluster"]] = counts.get(r["cluster"], 0) + 1
        shared = [c for c, n in counts.items() if n > 1 and c is not None]
        cluster_bit = {c: 1 << i for i, c in enumerate(shared)}
        bins = best_fit([r["n_words"] for r in rows], [source_bit[r["source"]] for r in rows],
                        [cluster_bit.get(r["cluster"], 0) for r in rows], capacity, max_per_source)
        filled: dict[int, int] = {}
        for r, b in zip(rows, bins, strict=True):
            filled[b] = filled.get(b, 0) + r["n_words"]
        col = lambda name, kind: pa.array([r[name] for r in rows], kind)
        return pa.table({
            "doc_id": col("doc_id", t.schema.field("doc_id").type), "piece": col("piece", pa.int32()), "start": col("start", pa.int64()),
            "n_words": col("n_words", pa.int32()), "source": col("source", pa.string()),
            "bin_id": pa.array([f"{rows[0]['g']}-{b}" for b in bins], pa.string()), "bin_words": pa.array([filled[b] for b in bins], pa.int32()),
        })

    kind = dict(described.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, n_words int, source string, bin_id string, bin_words int"
    return rests.groupBy("g").applyInArrow(packed, schema).unionByName(whole).unionByName(none)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
