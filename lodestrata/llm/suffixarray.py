"""Repeats of SPAN bytes and more, by the common-prefix intervals of an enhanced suffix array.

A suffix array of all documents has intervals of common prefixes of SPAN bytes; each is the set of all occurrences of
one string. They are found without sorting every suffix: of each window of SPAN bytes the place with the smallest
hash of GRAM bytes is its anchor, alike wherever the window occurs, and windows whose anchor has no second place don't
repeat. The windows of a repeated anchor are cut out as one segment of at most 2 * SPAN - GRAM bytes and dealt by the
anchor, so all occurrences of a window meet. Equal segments are one leaf of the interval tree, with all their
occurrences. The suffixes of the different ones are sorted, and their common prefixes scanned with a stack: an interval
closes with all suffixes that share its prefix, and if they differ in the byte to their left (or begin a segment) it is a
maximal repeat; those that extend to the left alike are parts of longer ones and are passed over. The tree alone decides
what goes: all occurrences of a repeat but the first. An interval hands only its first occurrence to the one that holds
it, since a later one is already gone by a longer repeat, so each occurrence is decided once however deep the tree is.

repeat_groups gives the maximal repeats themselves, each with all its occurrences. A repeat longer than a segment is
several groups there, one an anchor, which overlap.

Suffixes are compared byte by byte; hashes only choose what is compared.

Edge cases: a null text is empty; texts under SPAN bytes lose nothing; documents are in order of id, a null id last,
rows that share an id in order of their text (those without an id in an order of their texts' hashes), as if they
followed each other in one document without a match across the border; removal may cut characters of several bytes, so
kept bytes are binary; an empty table gives no rows. Other columns are ignored by without_repeats and repeat_groups;
drop_repeats keeps the columns of its input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.hashing import BASE, BASE_INVERSE, BYTE_VALUES, U, mix, trimmed
from lodestrata.llm.repeats import (
    ANCHORS, ANCHORS_DDL, CHUNK_BYTES, NO_ID, Chunk, Chunks, anchor_rows, by_part, chunk_from, chunks_of, covered, grouped, places, places_from, repeated_anchors, HITS, HITS_DDL,
)
from lodestrata.session import table

SPAN = 100
GRAM = 50
PIECE = 1 << 19
SEGMENTS = pa.schema([(n, pa.int32() if n in ("part", "chunk") else pa.binary()) for n in ("part", "chunk", "lengths", "data", "piece_no", "docs", "doc_no", "at")])
SEGMENTS_DDL = "part int, chunk int, lengths binary, data binary, piece_no binary, docs binary, doc_no binary, at binary"
LOST = pa.schema([("h_chunk", pa.int32()), ("at", pa.binary()), ("at_lengths", pa.binary())])
LOST_DDL = "h_chunk int, at binary, at_lengths binary"
GROUPS = pa.schema([("h_chunk", pa.int32()), ("group", pa.int64()), ("length", pa.int64()), ("at", pa.int64()), ("is_first", pa.bool_())])
GROUPS_DDL = "h_chunk int, group long, length long, at long, is_first boolean"


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of gram bytes, in pieces that fit the processor's cache."""
    n = len(data) - gram + 1
    out = np.empty(max(n, 0), U)
    size = min(PIECE, max(n, 1))
    base, inverse = (np.full(size + gram, U(b % 2**64)) for b in (BASE, BASE_INVERSE))
    base[0] = inverse[0] = 1
    base, inverse = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
    for at in range(0, n, size):
        stop = min(n, at + size)
        piece = data[at : stop + gram - 1]
        sums = np.zeros(len(piece) + 1, U)
        np.cumsum(BYTE_VALUES[piece] * base[: len(piece)], out=sums[1:])
        m = stop - at
        out[at:stop] = mix((sums[gram : gram + m] - sums[:m]) * inverse[:m])
    return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n, done = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while done * 2 <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    return np.minimum(x[:n], x[width - done : width - done + n])


def runs_of(texts: list[bytes], span: int, gram: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, the texts' offsets, and for each run of windows with one anchor: first and last window, anchor, its hash.

    Windows are looked at PIECE at a time, so what is held beside the bytes doesn't grow with a text.
    """
    data = b"".join(texts)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    array = np.frombuffer(data, np.uint8)
    low = U((1 << (PIECE + span).bit_length()) - 1)
    parts: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(len(data) - span + 1, 0), PIECE):
        hashes = gram_hashes(array[at : at + PIECE + span - 1], gram)
        least = sliding_least((hashes & ~low) | np.arange(len(hashes), dtype=U), span - gram + 1)
        ok = np.ones(len(least), bool)
        for end in offsets[(offsets > at) & (offsets < at + len(least) + span)].tolist():
            ok[max(end - at - span + 1, 0) : max(end - at, 0)] = False  # windows across the end of a text
        starts = np.flatnonzero(ok)
        anchor = (least[starts] & low).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
        parts.append((starts[new] + at, starts[np.append(new[1:], len(starts)) - 1] + at if len(new) else new, anchor[new] + at, hashes[anchor[new]]))
    first, last, anchor, value = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else anchor  # runs that a piece's end cut in two
    last = last[np.append(new[1:], len(last)) - 1] if len(new) else last
    return data, offsets, first[new], last, anchor[new], value[new]


def suffix_array(segments: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segment, place, and common prefix with the suffix before, of the suffixes of least bytes and more in order.

    Also the byte left of each suffix, -1 where it begins its segment. Common prefixes end with the shorter suffix.
    """
    lengths = np.array([len(s) for s in segments], np.int64)
    width = int(lengths.max())
    starts = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(segments) + bytes(width + 8), np.uint8)
    counts = np.maximum(lengths - least + 1, 0)
    owner = np.repeat(np.arange(len(segments)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = starts[owner] + place
    rest = lengths[owner] - place
    # Big-endian words of eight bytes sort as the bytes do; least bytes first, the tail only where suffixes tie.
    eight = np.zeros(len(data) - 7, U)
    for j in range(8):
        eight = (eight << U(8)) | data[j : len(data) - 7 + j]
    order, rank, done = np.arange(len(begin)), np.zeros(len(begin), np.int64), 0
    if least >= 8 and len(begin):
        order, done = np.argsort(eight[begin], kind="stable"), 8
        first = eight[begin][order]
        rank[order] = np.maximum.accumulate(np.where(np.concatenate([[True], first[1:] != first[:-1]]), np.arange(len(order)), 0))
    for at in range(done, width, 8):
        word = eight[np.minimum(begin + at, len(eight) - 1)]
        left = rest - at
        word = np.where(left <= 0, U(0), np.where(left < 8, word & ~((U(1) << (U(8) * np.clip(8 - left, 0, 7).astype(U))) - U(1)), word))
        r = rank[order]
        tied = np.zeros(len(order), bool)
        same = r[1:] == r[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        members = order[where]
        by = np.lexsort((np.minimum(left[members], 8), word[members], rank[members]))
        members = members[by]
        order[where] = members
        change = np.ones(len(members), bool)
        change[1:] = (rank[members][1:] != rank[members][:-1]) | (word[members][1:] != word[members][:-1]) | (np.minimum(left[members], 8)[1:] != np.minimum(left[members], 8)[:-1])
        # Ranks only have to tell members of one run apart.
        rank[members] = where[np.maximum.accumulate(np.where(change, np.arange(len(members)), 0))]
        single = order[np.flatnonzero(~tied)]
        rank[single] = np.flatnonzero(~tied)
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        a, b = begin[order[:-1]], begin[order[1:]]
        limit = np.minimum(rest[order[:-1]], rest[order[1:]])
        for at in range(0, len(a), 50_000):
            i, j = a[at : at + 50_000], b[at : at + 50_000]
            live, shared = np.arange(len(i)), np.full(len(i), width)
            for k in range(0, width, 8):
                x = eight[np.minimum(i[live] + k, len(eight) - 1)] ^ eight[np.minimum(j[live] + k, len(eight) - 1)]
                bad = np.flatnonzero(x)
                if len(bad):
                    zero = np.zeros(len(bad), np.int64)
                    for s in range(56, -1, -8):
                        zero += ((x[bad] >> U(s)) == 0)
                    shared[live[bad]] = k + zero
                    live = np.delete(live, bad)
                if not len(live):
                    break
            common[at + 1 : at + 1 + len(i)] = np.minimum(shared, limit[at : at + 50_000])
    left_byte = np.where(place > 0, data[np.maximum(begin - 1, 0)].astype(np.int64), -1)
    return owner[order], place[order], common, left_byte[order]


def maximal_repeats(common: np.ndarray, left_byte: np.ndarray, least: int, key: np.ndarray | None = None) -> Iterator[tuple[int, int, int, list[int]]]:
    """(from, to, length, later): the suffixes from..to are all occurrences of a maximal repeat of length bytes.

    later are those of them that come after the interval's first by key (their order if none is given), and that no
    longer repeat has as later ones; suffixes of one key are one occurrence. The stack holds open intervals as length,
    first suffix, the left byte of all (None once they differ; -1 differs from everything), the first by key, and later.
    """
    lcp, left, n = common.tolist(), left_byte.tolist(), len(common)
    order = range(n) if key is None else key.tolist()

    def join(node: list, mark: int | None, first: int) -> None:
        if node[2] != mark:
            node[2] = None
        if order[first] < order[node[3]]:
            node[3], first = first, node[3]
        if order[first] != order[node[3]]:
            node[4].append(first)

    stack: list[list] = []
    for i in range(1, n + 1):
        here = lcp[i] if i < n else 0
        if here < least and not stack:
            continue
        lo, mark, first = i - 1, left[i - 1] if left[i - 1] >= 0 else None, i - 1
        while stack and stack[-1][0] > here:
            node = stack.pop()
            join(node, mark, first)
            length, lo, mark, first, later = node
            if mark is None:
                yield lo, i, length, later
        if here >= least:
            if stack and stack[-1][0] == here:
                join(stack[-1], mark, first)
            else:
                stack.append([here, lo, mark, first, []])


def _anchors(span: int, gram: int, n_parts: int):
    def run(t: pa.Table):
        c = chunk_from(t)
        _, _, _, _, at, value = runs_of(c.texts, span, gram)  # anchors ascend
        if len(at):
            yield from anchor_rows(c.no, value, at, np.ones(len(at), bool), n_parts)

    return run


def _segments(span: int, gram: int, n_parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[dict] = []
        if left.num_rows and right.num_rows:
            c = chunk_from(left)
            data, offsets, low, last, anchor, value = runs_of(c.texts, span, gram)
            hit = np.zeros(len(data), bool)
            hit[np.concatenate([places_from(x) for x in right["at"].to_pylist()])] = True
            good = hit[anchor]
            low, high, value = low[good], last[good] + span, value[good]
            doc = np.searchsorted(offsets, low, side="right") - 1
            part = ((value >> U(40)) % U(n_parts)).astype(np.int64)
            bounds = list(zip(low.tolist(), high.tolist(), strict=True))
            for p, i in by_part(part, n_parts):
                # Equal segments of a chunk travel once, with all their places.
                pieces: dict[bytes, int] = {}
                no = np.array([pieces.setdefault(data[slice(*bounds[j])], len(pieces)) for j in i.tolist()], np.uint32)
                held_by, doc_no = np.unique(doc[i], return_inverse=True)
                rows.append({"part": p, "chunk": c.no, "lengths": np.array([len(x) for x in pieces], np.uint16).tobytes(), "data": b"".join(pieces),
                             "piece_no": b"" if len(pieces) == len(no) else no.tobytes(),
                             "docs": c.ids[held_by].astype(np.int64).tobytes(), "doc_no": doc_no.astype(np.uint32).tobytes(), "at": places(low[i])})
        out = pa.Table.from_pylist(rows, schema=SEGMENTS)
        trimmed()
        return out

    return run


@dataclass
class Leaves:
    """The different segments of a part in order of their first occurrence, and all occurrences, sorted by segment, then
    by document, chunk and place: those of segment i are begin[i]..begin[i + 1]."""

    pieces: list[bytes]
    begin: np.ndarray
    chunk: np.ndarray
    doc: np.ndarray
    at: np.ndarray


def leaves_of(t: pa.Table) -> Leaves:
    known: dict[bytes, int] = {}
    owners, chunks, docs, ats = [], [], [], []
    for row in t.select(["chunk", "lengths", "data", "piece_no", "docs", "doc_no", "at"]).to_pylist():
        ends = np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], np.uint16), dtype=np.int64)]).tolist()
        mine = np.array([known.setdefault(row["data"][a:b], len(known)) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.int64)
        owners.append(mine[np.frombuffer(row["piece_no"], np.uint32)] if row["piece_no"] else mine)
        docs.append(np.frombuffer(row["docs"], np.int64)[np.frombuffer(row["doc_no"], np.uint32)])
        ats.append(places_from(row["at"]))
        chunks.append(np.full(len(ats[-1]), row["chunk"]))
    owner, chunk, doc, at = (np.concatenate(x) for x in (owners, chunks, docs, ats))
    order = np.lexsort((at, chunk, doc))
    seen, first = np.unique(owner[order], return_index=True)
    rank = np.empty(len(known), np.int64)
    rank[seen[np.argsort(first)]] = np.arange(len(known))
    owner = rank[owner]
    order = np.lexsort((at, chunk, doc, owner))
    pieces: list[bytes] = [b""] * len(known)
    for piece, i in known.items():
        pieces[rank[i]] = piece
    return Leaves(pieces, np.searchsorted(owner[order], np.arange(len(known) + 1)), chunk[order], doc[order], at[order])


def _tree(leaves: Leaves, span: int):
    """Suffixes of the different segments in order: owner, the chunk and place of its first occurrence, place in the segment,
    common prefix with the one before; and their maximal repeats."""
    owner, place, common, left = suffix_array(leaves.pieces, span)
    first = leaves.begin[owner]
    doc, chunk, at = leaves.doc[first], leaves.chunk[first], leaves.at[first] + place
    order = np.lexsort((at, chunk, doc))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(doc[order]) != 0) | (np.diff(chunk[order]) != 0) | (np.diff(at[order]) != 0)
    key = np.empty(len(order), np.int64)
    key[order] = np.cumsum(new)
    return owner, chunk, at, place, common, maximal_repeats(common, left, span, key)


def _later(span: int):
    """What the interval tree of a part removes."""

    def run(t: pa.Table):
        leaves = leaves_of(t)
        copies = np.ones(len(leaves.at), bool)  # occurrences of a leaf after its first
        copies[leaves.begin[:-1]] = False
        sizes = np.repeat([len(p) for p in leaves.pieces], np.diff(leaves.begin))
        owner, chunk, at, _, _, repeats = _tree(leaves, span)
        later, lengths = [], []
        for _, _, length, ones in repeats:
            later += ones
            lengths += [length] * len(ones)
        found = np.stack([np.concatenate(x) for x in ((leaves.chunk[copies], chunk[later]), (leaves.at[copies], at[later]), (sizes[copies], np.array(lengths, np.int64)))], axis=1).astype(np.int64)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        for rows in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1) if len(found) else ():
            yield {"h_chunk": int(rows[0, 0]), "at": places(rows[:, 1]), "at_lengths": rows[:, 2].astype(np.uint16).tobytes()}

    return run


def _groups(span: int):
    """The maximal repeats of a part, each with all its occurrences."""

    def run(t: pa.Table) -> pa.Table:
        leaves = leaves_of(t)
        owner, _, _, place, common, repeats = _tree(leaves, span)
        # A segment with several occurrences is a repeat of its own, unless others begin with it: then an interval has it.
        whole = np.flatnonzero(place == 0)
        shared = np.maximum(common, np.append(common[1:], 0))[whole]
        alone = {int(i) for i, n in zip(owner[whole], shared, strict=True) if n < len(leaves.pieces[i]) and leaves.begin[i + 1] - leaves.begin[i] > 1}
        found = [(len(leaves.pieces[i]), [(i, 0)]) for i in sorted(alone)]
        found += [(length, list(zip(owner[lo:hi].tolist(), place[lo:hi].tolist(), strict=True))) for lo, hi, length, _ in repeats]
        parts = []
        for no, (length, members) in enumerate(found):
            spots = np.unique(np.concatenate([np.stack([leaves.doc[a:b], leaves.chunk[a:b], leaves.at[a:b] + p], axis=1)
                                              for i, p in members for a, b in [(leaves.begin[i], leaves.begin[i + 1])]]), axis=0)
            group = int.from_bytes(hashlib.blake2b(f"{t['part'][0].as_py()}/{no}".encode(), digest_size=8).digest(), "little", signed=True)
            if len(spots) > 1:
                n = len(spots)
                parts.append(pa.table([pa.array(spots[:, 1], pa.int32()), pa.array(np.full(n, group)), pa.array(np.full(n, length)), pa.array(spots[:, 2]), pa.array(np.arange(n) == 0)], schema=GROUPS))
        return pa.concat_tables(parts) if parts else GROUPS.empty_table()

    return run


def _located(left: pa.Table, right: pa.Table) -> pa.Table:
    """Places of a chunk as documents and starts."""
    schema = pa.schema([("group", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("is_first", pa.bool_())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    c = chunk_from(left)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in c.texts])])
    at = right["at"].to_numpy()
    doc = np.searchsorted(offsets, at, side="right") - 1
    ids = c.ids[doc]
    return pa.table([right["group"], right["length"], pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(at - offsets[doc]), right["is_first"]], schema=schema)


def _remove(n_kept: int, as_text: bool):
    """as_text: what is kept is text, without the characters that a cut breaks."""
    kind = pa.string() if as_text else pa.binary()
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept", kind), ("spans", pa.list_(pa.list_(pa.int64())))]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        extra = [left.schema.field(f"x{i}") for i in range(n_kept)] if left.num_rows else []
        schema = pa.schema([pa.field(*f) for f in fields] + extra)
        if not left.num_rows:
            return pa.Table.from_pylist([], schema=schema)
        c: Chunk = chunk_from(left)
        lengths = np.array([len(t) for t in c.texts], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        gone = np.zeros(offsets[-1], bool)
        if right.num_rows:
            at = np.concatenate([places_from(x) for x in right["at"].to_pylist()])
            size = np.concatenate([np.frombuffer(x, np.uint16) for x in right["at_lengths"].to_pylist()]).astype(np.int64)
            gone = covered(at, size, offsets[-1])
        kept, removed, spans = [], [], []
        for text, a, b in zip(c.texts, offsets[:-1], offsets[1:], strict=True):
            mine = gone[a:b]
            n = int(mine.sum())
            removed.append(n)
            if n:
                step = np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))
                spans.append(np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1).tolist())
                kept.append(np.frombuffer(text, np.uint8)[~mine].tobytes())
            else:
                spans.append([])
                kept.append(text)
        ids = pa.array(c.ids, pa.int64(), mask=c.ids == NO_ID)
        if as_text:
            kept = [k.decode("utf-8", "ignore") for k in kept]
        return pa.Table.from_arrays([ids, pa.array(lengths), pa.array(removed, pa.int64()), pa.array(kept, kind), pa.array(spans, schema.field("spans").type), *[c.rows[f.name] for f in extra]], schema=schema)

    return run


def _segmented(chunks: Chunks, span: int, gram: int) -> DataFrame:
    parts, segment_parts = chunks.parts(64 << 20), chunks.parts(4 << 20)
    anchors = grouped(chunks.frame, "chunk", _anchors(span, gram, parts), ANCHORS, ANCHORS_DDL)
    hits = grouped(anchors, "part", repeated_anchors, HITS, HITS_DDL)
    return chunks.frame.groupBy("chunk").cogroup(hits.groupBy("h_chunk")).applyInArrow(_segments(span, gram, segment_parts), SEGMENTS_DDL)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM,
                    keep: tuple[str, ...] = (), chunk_bytes: int = CHUNK_BYTES, as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, kept (the remaining bytes, or text), spans (removed byte ranges), and docs' columns in keep as x0, x1 and so on."""
    chunks = chunks_of(docs, id_col, text_col, chunk_bytes, keep)
    lost = grouped(_segmented(chunks, span, gram), "part", _later(span), LOST, LOST_DDL)
    schema = T._parse_datatype_string(f"doc_id long, n_bytes long, n_removed long, kept {'string' if as_text else 'binary'}, spans array<array<long>>")
    for i, c in enumerate(keep):
        schema = schema.add(f"x{i}", docs.schema[c].dataType)
    return chunks.frame.groupBy("chunk").cogroup(lost.groupBy("h_chunk")).applyInArrow(_remove(len(keep), as_text), schema)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """group, length, doc_id, start, is_first: every occurrence of every maximal repeat."""
    chunks = chunks_of(docs, id_col, text_col, chunk_bytes)
    groups = _segmented(chunks, span, gram).groupBy("part").applyInArrow(_groups(span), GROUPS_DDL)
    return chunks.frame.groupBy("chunk").cogroup(groups.groupBy("h_chunk")).applyInArrow(_located, "group long, length long, doc_id long, start long, is_first boolean")


def drop_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs with the repeats cut out of text; characters that a cut breaks go too. n_chars, if there, is counted anew."""
    columns = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = without_repeats(docs, span=span, keep=tuple(columns), as_text=True)
    out = found.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("kept").alias("text"),
                       *[F.col(f"x{i}").alias(c) for i, c in enumerate(columns)])
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_interval_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
