"""What the two exact-repeat operators share: chunks of documents, and hashes dealt by value to parts and back.

Documents are dealt by a hash of their id into chunks of some megabytes, each in order of id, so a place in a chunk is
one number and any task can rebuild a chunk. Hashes travel as packed arrays, one row for each chunk and part, not as
one row each; answers go back as places. The shuffle of the texts by chunk is one exchange that Spark reuses.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.hashing import trimmed
from lodestrata.session import bounded_batches

U = np.uint64
CHUNK_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max


@dataclass
class Chunks:
    """frame: chunk, doc_id, text, hash-partitioned by chunk. total: bytes of text."""

    frame: DataFrame
    total: int

    def parts(self, bytes_each: int) -> int:
        return max(1, math.ceil(self.total / bytes_each))


def chunks_of(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES, keep: tuple[str, ...] = ()) -> Chunks:
    """keep: columns of docs that travel along, as x0, x1 and so on."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(keep)])
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / chunk_bytes))
    partitions = max(1, min(n, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (32 << 20)))))
    chunk = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(n)).cast("int")  # rows without an id spread by text
    return Chunks(slim.select(chunk.alias("chunk"), *slim.columns).repartition(partitions, "chunk"), total)


@dataclass
class Chunk:
    no: int
    ids: np.ndarray  # NO_ID for null
    texts: list[bytes]
    rows: pa.Table  # in the same order


def chunk_from(t: pa.Table) -> Chunk:
    ids = t["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
    texts = [x or b"" for x in t["text"].cast(pa.large_binary()).to_pylist()]
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    return Chunk(t["chunk"][0].as_py(), ids[order], [texts[i] for i in order], t.take(order))


def by_part(part: np.ndarray, n_parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each part that has members: its number and the members' indexes in ascending order. Takes no time for parts that have none."""
    order = np.argsort(part.astype(np.uint16) if n_parts <= 65536 else part, kind="stable")
    if len(order):
        for members in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            yield int(part[members[0]]), members


def places(at: np.ndarray) -> bytes:
    """Ascending places as gaps, two bytes each where that is enough."""
    gaps = np.diff(at, prepend=0).astype(np.uint32)
    return b"\x02" + gaps.astype(np.uint16).tobytes() if not len(gaps) or gaps.max() < 65536 else b"\x04" + gaps.tobytes()


def places_from(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint16 if data[:1] == b"\x02" else np.uint32, offset=1), dtype=np.int64)


def grouped(df: DataFrame, key: str, run: Callable[[pa.Table], Iterator[dict] | list[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    def go(t: pa.Table) -> pa.Table:
        out = pa.Table.from_pylist(list(run(t)), schema=schema)
        trimmed()
        return out

    return df.groupBy(key).applyInArrow(go, ddl)


ANCHORS = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("at", pa.binary())])
ANCHORS_DDL = "part int, chunk int, low binary, high binary, at binary"
HITS = pa.schema([("h_chunk", pa.int32()), ("at", pa.binary())])
HITS_DDL = "h_chunk int, at binary"


def anchor_rows(chunk: int, hashes: np.ndarray, at: np.ndarray, flags: np.ndarray, n_parts: int) -> Iterator[dict]:
    """39 bits of each hash beside those that name its part, with its flag: five bytes."""
    part = ((hashes >> U(40)) % U(n_parts)).astype(np.int64)
    value = ((hashes & U((1 << 39) - 1)) << U(1)) | flags.astype(U)
    low, high = value.astype(np.uint32), (value >> U(32)).astype(np.uint8)
    for p, i in by_part(part, n_parts):
        yield {"part": p, "chunk": chunk, "low": low[i].tobytes(), "high": high[i].tobytes(), "at": places(at[i])}


def repeated_anchors(t: pa.Table) -> Iterator[dict]:
    """The flagged places of each chunk whose hash has another place, in one chunk or two."""
    lows = [np.frombuffer(x, np.uint32) for x in t["low"].to_pylist()]
    value = np.concatenate(lows).astype(U) | (np.concatenate([np.frombuffer(x, np.uint8) for x in t["high"].to_pylist()]).astype(U) << U(32))
    ends = np.cumsum([0] + [len(x) for x in lows])
    order = np.argsort(value)
    sorted_ = value[order]
    same = (sorted_[1:] >> U(1)) == (sorted_[:-1] >> U(1))
    twice = np.zeros(len(value), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(len(value), bool)
    hit[order[twice & ((sorted_ & U(1)) == U(1))]] = True
    for i, (chunk, at) in enumerate(zip(t["chunk"].to_pylist(), t["at"].to_pylist(), strict=True)):
        if (mine := hit[ends[i] : ends[i + 1]]).any():
            yield {"h_chunk": chunk, "at": places(places_from(at)[mine])}


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places the runs cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0
