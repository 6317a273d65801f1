"""Substring deduplication over words, by fixed-block anchors.

Non-overlapping blocks of BLOCK words are the index; every rolling window of BLOCK words of every document probes it.
A repeat of SPAN >= 2 * BLOCK - 1 words holds a whole block wherever it lies, so blocks without a second place rule
out their surroundings. Around the others, hits are extended: all windows of SPAN words that hold such a block are
compared by 64-bit hashes, the smallest document of each is found, and in all others they are removed; windows that
overlap merge into the maximal repeats. Per window only a minimum is kept, so a passage in a million documents costs
what its places cost, not their pairs.

A chunk sends one record for each distinct window it holds, whatever the number of its documents that share it.

Edge cases: a null or empty text has no words and empty kept text; texts under SPAN words lose nothing; the order is
by id, a null id comes last, and rows that share an id don't remove each other's words; an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.hashing import U, split_words, window_hashes
from lodestrata.llm.repeats import (
    ANCHORS, ANCHORS_DDL, CHUNK_BYTES, HITS, HITS_DDL, NO_ID, anchor_rows, by_part, chunk_from, chunks_of, covered, grouped, places, places_from, repeated_anchors,
)
from lodestrata.session import table

SPAN = 13
BLOCK = 7
WINDOWS = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()), ("doc_no", pa.binary()), ("at", pa.binary())])
WINDOWS_DDL = "part int, chunk int, hashes binary, docs binary, doc_no binary, at binary"


def _anchors(span: int, block: int, n_parts: int):
    def run(t: pa.Table):
        c = chunk_from(t)
        _, _, _, words, first = split_words(c.texts)
        hashes = window_hashes(words, block)
        if not len(hashes):
            return
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        inside = np.arange(len(hashes))
        inside = inside[(first[1:][doc[: len(hashes)]] - inside >= block) & (np.diff(first)[doc[: len(hashes)]] >= span)]
        yield from anchor_rows(c.no, hashes[inside], inside, (inside - first[doc[inside]]) % block == 0, n_parts)

    return run


def _extend(span: int, block: int, n_parts: int):
    """Windows around the hits: those that a smaller document of the chunk holds are decided, one of each other is sent."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[dict] = []
        if left.num_rows and right.num_rows:
            c = chunk_from(left)
            _, _, _, words, first = split_words(c.texts)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            hit = np.concatenate([places_from(x) for x in right["at"].to_pylist()])
            starts = np.unique((hit[:, None] - np.arange(span - block + 1)[None, :]).ravel())
            starts = starts[starts >= 0]
            starts = starts[starts + span <= first[1:][doc[starts]]]
            # A window holds the block that it was found by only if both are in one document.
            held = -(-(starts - first[doc[starts]]) // block) * block + first[doc[starts]]
            starts = starts[np.isin(held, hit)]
            if len(starts):
                hashes = window_hashes(words, span)[starts]
                order = np.argsort(hashes, kind="stable")  # places ascend in each run, and so do ids
                sorted_ = hashes[order]
                new = np.ones(len(order), bool)
                new[1:] = sorted_[1:] != sorted_[:-1]
                least = c.ids[doc[starts[order[new]]]][np.cumsum(new) - 1]
                own = c.ids[doc[starts[order]]]
                lost, sent = starts[order[own > least]], order[own == least]
                if len(lost):
                    rows.append({"part": -1, "chunk": c.no, "at": places(np.sort(lost))})
                sent = np.sort(sent)
                part = ((hashes[sent] >> U(20)) % U(n_parts)).astype(np.int64)
                for p, i in by_part(part, n_parts):
                    at = starts[sent[i]]
                    held_by, no = np.unique(doc[at], return_inverse=True)
                    rows.append({"part": p, "chunk": c.no, "hashes": hashes[sent[i]].tobytes(), "docs": c.ids[held_by].astype(np.int64).tobytes(),
                                 "doc_no": no.astype(np.uint32 if len(held_by) > 65535 else np.uint16).tobytes(), "at": places(at)})
        return pa.Table.from_pylist(rows, schema=WINDOWS)

    return run


def _first_documents(t: pa.Table):
    """Places of the windows that a smaller document holds."""
    hashes = [np.frombuffer(x, U) for x in t["hashes"].to_pylist()]
    ids = []
    for docs, no in zip(t["docs"].to_pylist(), t["doc_no"].to_pylist(), strict=True):
        docs = np.frombuffer(docs, np.int64)
        ids.append(docs[np.frombuffer(no, np.uint32 if len(docs) > 65535 else np.uint16)])
    ends = np.cumsum([0] + [len(x) for x in hashes])
    value, owner = np.concatenate(hashes), np.concatenate(ids)
    order = np.argsort(value)
    sorted_ = value[order]
    new = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    least = np.repeat(np.minimum.reduceat(owner[order], new), np.diff(np.append(new, len(order))))
    lost = np.zeros(len(value), bool)
    lost[order] = owner[order] > least
    for i, (chunk, at) in enumerate(zip(t["chunk"].to_pylist(), t["at"].to_pylist(), strict=True)):
        if (mine := lost[ends[i] : ends[i + 1]]).any():
            yield {"h_chunk": chunk, "at": places(places_from(at)[mine])}


def _remove(span: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_pylist([], schema=schema)
        c = chunk_from(left)
        split = [t.split() for t in c.texts]
        counts = np.array([len(w) for w in split], np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        lost = [places_from(x) for x in right["at"].to_pylist()] if right.num_rows else []
        gone = covered(np.concatenate(lost), span, first[-1]) if lost else np.zeros(first[-1], bool)
        texts, removed, spans = [], [], []
        for w, a, b in zip(split, first[:-1], first[1:], strict=True):
            mine = gone[a:b]
            if mine.any():
                step = np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))
                spans.append(np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1).tolist())
                w = [w[i] for i in np.flatnonzero(~mine)]
            else:
                spans.append([])
            removed.append(int(mine.sum()))
            texts.append(b" ".join(w))
        ids = pa.array(c.ids, pa.int64(), mask=c.ids == NO_ID)
        return pa.Table.from_arrays([ids, pa.array(counts), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()),
                                     pa.array(spans, schema.field("spans").type)], schema=schema)

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, block: int = BLOCK,
                    chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by one space), spans (removed word ranges)."""
    if span < 2 * block - 1:
        raise ValueError("a span must hold a whole block wherever it lies")
    chunks = chunks_of(docs, id_col, text_col, chunk_bytes)
    parts, window_parts = chunks.parts(12 << 20), chunks.parts(24 << 20)
    anchors = grouped(chunks.frame, "chunk", _anchors(span, block, parts), ANCHORS, ANCHORS_DDL)
    hits = grouped(anchors, "part", repeated_anchors, HITS, HITS_DDL)
    texts = chunks.frame.groupBy("chunk")
    windows = texts.cogroup(hits.groupBy("h_chunk")).applyInArrow(_extend(span, block, window_parts), WINDOWS_DDL)
    decided = windows.where("part < 0").select(F.col("chunk").alias("h_chunk"), "at")
    lost = grouped(windows.where("part >= 0"), "part", _first_documents, HITS, HITS_DDL)
    return texts.cogroup(decided.unionByName(lost).groupBy("h_chunk")).applyInArrow(
        _remove(span), "doc_id long, n_words long, n_removed long, text string, spans array<array<long>>")


def op1_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM s),
m AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (g) WHERE doc_id > first),
p AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS x,
    CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda t, j: NOT list_contains(gone, j)) END AS kept FROM d LEFT JOIN p USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, x::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
