"""Near-duplicate detection by b-bit MinHash.

A document is the set of its shingles' 64-bit hashes. Documents with one set are one class. Of each set, n_hashes
minima are taken; bands of them give the candidate buckets, and the low b bits of each are packed into a signature,
whose equal fields, counted by bits, estimate the similarity once chance agreement (2**-b) is taken out. Candidates
over a generous estimate are confirmed on their full sets.

Rows stay linear in the corpus however large a group of copies is. A bucket's hub is its member with the most company
over all buckets, which among edited copies is their original: each class meets the hub whose buckets it shares most
often, and confirmed links give components. Buckets that still hold several components are searched in full, in tiles
of bounded size, but a tile gives only a spanning forest of the pairs of components whose estimates allow a link. The
connected parts of these forests are clusters of whole components, and no link leaves its cluster. Inside a cluster,
again in bounded tiles, full sets of all members are compared between components, and each tile gives a spanning forest
of the links it finds; the largest component of a cluster isn't compared with itself. A pair of similarity 0.8 shares
no band with probability 5e-8.

Edge cases: a document without words has an empty set and is linked with nothing; one with fewer words than a shingle
has one shingle; a null id is linked with nothing and keeps a null component; rows that repeat an id count as versions
of one document, linked as soon as one of them is; an empty table gives no rows. Other columns are ignored by
near_duplicates and kept by keep_first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.components import connected, release, saved
from lodestrata.llm.hashing import COEFFICIENTS, U, batches_of, mix, split_words, trimmed, window_hashes
from lodestrata.llm.words import n_words
from lodestrata.session import table

N_HASHES = 128
ROWS = 4
BITS = 2
SLACK = 5.0
TILE = 4096
CLUSTER_TILE = 1024
TILE_SHINGLES = 2_000_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RNG = np.random.default_rng(77)
MULTIPLIERS = _RNG.integers(0, 2**64, N_HASHES, dtype=U) | U(1)
ADDENDS = _RNG.integers(0, 2**64, N_HASHES, dtype=U)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for lo, hi in batches_of(texts):
        _, _, _, words, first = split_words([(t or b"").translate(LOWER) for t in texts[lo:hi]])
        windows = window_hashes(words, k)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                out.append(np.unique(windows[a : b - k + 1]))
            elif b > a:
                out.append(mix(np.array([(words[a:b] * COEFFICIENTS[100 : 100 + b - a]).sum(dtype=U) + U(b - a)], U)))
            else:
                out.append(np.zeros(0, U))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """documents x hashes, 32 bits each; the sets mustn't be empty."""
    out = np.zeros((len(sets), N_HASHES), np.uint32)
    at = 0
    while at < len(sets):
        stop, size = at, 0
        while stop < len(sets) and (stop == at or size + len(sets[stop]) <= 100_000):
            size += len(sets[stop])
            stop += 1
        x = np.concatenate(sets[at:stop])
        starts = np.cumsum([0] + [len(s) for s in sets[at : stop - 1]])
        for j in range(N_HASHES):
            out[at:stop, j] = np.minimum.reduceat((x * MULTIPLIERS[j] + ADDENDS[j]) >> U(32), starts)
        at = stop
    return out


def packed(minimum: np.ndarray, bits: int = BITS) -> np.ndarray:
    """documents x bytes: the low bits of each minimum."""
    planes = [(minimum >> b) & 1 for b in range(bits)]
    return np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)


def estimate(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Similarity of rows of packed signatures (uint64 words, plane after plane), less what chance explains."""
    differ = a ^ b
    width = differ.shape[-1] // bits
    any_plane = differ[..., :width].copy()
    for p in range(1, bits):
        any_plane |= differ[..., p * width : (p + 1) * width]
    equal = 1.0 - np.bitwise_count(any_plane).sum(axis=-1) / (width * 64)
    return (equal - 2.0**-bits) / (1 - 2.0**-bits)


def least_estimate(threshold: float, bits: int = BITS) -> float:
    """SLACK standard deviations below the threshold."""
    chance = 2.0**-bits
    p = threshold + (1 - threshold) * chance
    return threshold - SLACK * (p * (1 - p) / N_HASHES) ** 0.5 / (1 - chance)


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            for lo, hi in batches_of(texts, 8 << 20):
                sets = shingle_sets(texts[lo:hi], k)
                full = [i for i, s in enumerate(sets) if len(s)]
                prints: list[bytes | None] = [None] * len(sets)
                bands: list = [None] * len(sets)
                signatures: list[bytes | None] = [None] * len(sets)
                if full:
                    low = minima([sets[i] for i in full])
                    signature = packed(low)
                    key = np.zeros((len(full), N_HASHES // ROWS), U)
                    for r in range(ROWS):
                        key += low[:, r::ROWS].astype(U) * COEFFICIENTS[200 + r]
                    key = mix(key + np.arange(N_HASHES // ROWS, dtype=U) * COEFFICIENTS[210]).view(np.int64)
                    for j, i in enumerate(full):
                        s = sets[i]
                        prints[i] = np.array([mix(s.copy()).sum(dtype=U), (mix(s * COEFFICIENTS[300]) * COEFFICIENTS[301]).sum(dtype=U), U(len(s))], U).tobytes()
                        bands[i], signatures[i] = key[j], signature[j].tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], ["doc_id", "n_shingles", "print", "bands", "signature"])
        trimmed()

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right = batch.column(2).cast(pa.large_binary()), batch.column(3).cast(pa.large_binary())
            good = []
            for lo in range(0, len(a), 256):
                hi = min(lo + 256, len(a))
                others = shingle_sets(right.slice(lo, hi - lo).to_pylist(), k)
                for i, other in zip(range(lo, hi), others, strict=True):
                    if a[i] not in known:  # pairs come sorted by their first document
                        known = {a[i]: shingle_sets([left[i].as_py()], k)[0]}
                    one = known[a[i]]
                    both = len(np.intersect1d(one, other, assume_unique=True))
                    good.append(100 * both >= percent * (len(one) + len(other) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    other = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text"))
    first = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text"))
    with_b = pairs.select("a", "b").join(other.hint("merge"), "b")
    with_both = with_b.join(first.hint("merge"), "a").select("a", "b", "a_text", "b_text").sortWithinPartitions("a")
    return with_both.mapInArrow(_confirm(k, percent), "a long, b long")


def _estimated(least: float, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), U).reshape(batch.num_rows, -1) for i in (2, 3))
            n, m = (batch.column(i).to_numpy() for i in (4, 5))
            mask = pa.array((estimate(a, b) >= least) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def forest(near: Callable[[int, np.ndarray], np.ndarray], comps: np.ndarray, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph in which i is next to those of rest that near(i, rest) finds.

    Nodes of one component stand together without an edge. With sides, only nodes of different sides are compared.
    """
    rest = np.arange(len(comps))
    edges: list[tuple[int, int]] = []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            taken = comps[rest] == comps[i]
            mates = rest[taken]
            far = np.flatnonzero(~taken) if sides is None else np.flatnonzero(~taken & (sides[rest] != sides[i]))
            if len(far):
                met = far[near(i, rest[far])]
                edges += [(i, int(j)) for j in rest[met]]
                taken[met] = True
                todo += rest[met].tolist()
            todo += mates.tolist()
            rest = rest[~taken]
    return edges


def _edge_table(edges: list[tuple[int, int]], ids: np.ndarray) -> pa.Table:
    pairs = np.array([(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in edges if ids[i] != ids[j]], np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _tile_candidates(least: float, percent: int):
    """A spanning forest of a bucket's components, next to each other where the sizes and estimate of a pair allow a link."""

    def run(t: pa.Table) -> pa.Table:
        comps, parts, sizes = (t[c].to_numpy() for c in ("component", "part", "n_shingles"))
        sig = np.frombuffer(b"".join(t["signature"].to_pylist()), U).reshape(len(comps), -1)

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            fits = 100 * np.minimum(sizes[i], sizes[rest]) >= percent * np.maximum(sizes[i], sizes[rest])
            return fits & (estimate(sig[i][None, :], sig[rest]) >= least)

        return _edge_table(forest(near, comps, None if t["tile_a"][0] == t["tile_b"][0] else parts), comps)

    return run


def _tile_links(k: int, percent: int):
    """A spanning forest of the links between components in a tile of a cluster, found on full sets."""

    def run(t: pa.Table) -> pa.Table:
        sets = shingle_sets(t["text"].cast(pa.large_binary()).to_pylist(), k)
        by_size = np.argsort([len(s) for s in sets], kind="stable")
        sets = [sets[i] for i in by_size]
        ids, comps, parts = (t[c].to_numpy()[by_size] for c in ("doc_id", "component", "part"))
        sizes = np.array([len(s) for s in sets], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        values, codes = np.unique(np.concatenate(sets), return_inverse=True)
        flags = np.zeros(len(values), bool)

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            # Sets of a size that allows a link are neighbours in the order of sizes.
            lo = int(np.searchsorted(100 * sizes, percent * sizes[i]))
            hi = int(np.searchsorted(percent * sizes, 100 * sizes[i], side="right"))
            lo, hi = max(lo, int(rest[0])), min(hi, int(rest[-1]) + 1)
            found = np.zeros(len(rest), bool)
            inside = (rest >= lo) & (rest < hi)
            if inside.any():
                mine = codes[ends[i] : ends[i + 1]]
                flags[mine] = True
                both = np.add.reduceat(flags[codes[ends[lo] : ends[hi]]], ends[lo:hi] - ends[lo], dtype=np.int64)
                flags[mine] = False
                j = rest[inside]
                n = both[j - lo]
                found[inside] = 100 * n >= percent * (sizes[i] + sizes[j] - n)
            return found

        edges = _edge_table(forest(near, comps, None if t["tile_a"][0] == t["tile_b"][0] else parts), ids)
        trimmed()
        return edges

    return run


def _in_tiles(rows: DataFrame, n_parts: Column) -> DataFrame:
    """Each row once for each tile of its group that it belongs to: part, tile_a, tile_b."""
    return (
        rows.withColumn("_n", n_parts)
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("_n")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumns({"tile_a": F.least("part", "_other"), "tile_b": F.greatest("part", "_other")})
        .drop("_n", "_other")
    )


def _in_cluster_tiles(rows: DataFrame) -> DataFrame:
    """As _in_tiles, for rows of clusters: doc_id, cluster, component, n_shingles. No tile is of the largest component alone.

    A cluster that fits into one tile is one; else the largest component has parts of its own, each to meet the others'.
    """
    sums = (F.sum("n").alias("n"), F.sum("m").alias("m"))
    sizes = rows.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("m"))
    totals = sizes.groupBy("cluster").agg(*sums, F.max(F.struct("n", "m", "component")).alias("main"))
    parts = lambda n, m: F.ceil(F.greatest(n / CLUSTER_TILE, m / TILE_SHINGLES)).cast("int")
    fits = (F.col("n") <= CLUSTER_TILE) & (F.col("m") <= TILE_SHINGLES)
    plan = totals.select(
        "cluster", F.col("main.component").alias("_main"),
        F.when(fits, 1).otherwise(parts(F.col("n") - F.col("main.n"), F.col("m") - F.col("main.m"))).alias("_rest"),
        F.when(fits, 0).otherwise(parts(F.col("main.n"), F.col("main.m"))).alias("_own"))
    of_main = (F.col("component") == F.col("_main")) & (F.col("_own") > 0)
    code = F.xxhash64("doc_id")
    part = F.when(of_main, F.col("_rest") + F.pmod(code, F.greatest("_own", F.lit(1)))).otherwise(F.pmod(code, F.col("_rest")))
    last = F.when(of_main, F.col("_rest")).otherwise(F.col("_rest") + F.col("_own")) - 1
    return (
        rows.join(plan.hint("merge"), "cluster")
        .withColumn("part", part.cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
        .withColumns({"tile_a": F.least("part", "_other"), "tile_b": F.greatest("part", "_other")})
        .drop("_main", "_rest", "_own", "_other", "n_shingles")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = saved(slim.mapInArrow(_describe(k), "doc_id long, n_shingles long, print binary, bands array<long>, signature binary"), "minhash")
    linkable = described.where("print is not null and doc_id is not null")
    classes = linkable.groupBy("print").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "signature")).alias("r"))
    reps = saved(classes.select("print", "r.*"), "classes")
    least = least_estimate(percent / 100)

    members = reps.select("doc_id", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = members.join(sizes.hint("merge"), "key")
    weights = met.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    shared = saved(met.join(weights.hint("merge"), "doc_id").select("key", "doc_id", "weight"), "buckets")
    hubs = shared.groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("h"))).alias("m")).select("key", (-F.col("m.h")).alias("hub"))
    meets = shared.join(hubs.hint("merge"), "key").where("hub <> doc_id").groupBy("doc_id", "hub").agg(F.count(F.lit(1)).alias("bands"))
    best = meets.groupBy("doc_id").agg(F.max(F.struct("bands", (-F.col("hub")).alias("h"))).alias("m")).select(F.col("doc_id").alias("b"), (-F.col("m.h")).alias("a"))
    sigs = reps.select("doc_id", "signature", "n_shingles")
    side = lambda x: sigs.select(*[F.col(c).alias(f"{x}_{c}" if c != "doc_id" else x) for c in sigs.columns])
    rated = best.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a").select("a", "b", "a_signature", "b_signature", "a_n_shingles", "b_n_shingles")
    pairs = rated.mapInArrow(_estimated(least, percent), "a long, b long")
    links = saved(confirmed(pairs, slim, k, percent), "links")
    first = saved(connected(links), "components")
    release(docs)

    own = reps.select("doc_id", "n_shingles", "signature").join(first.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id"))
    placed = shared.select("key", "doc_id").join(own.hint("merge"), "doc_id")
    mixed = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("n")).where("c0 < c1").select("key", "n")
    tiled = _in_tiles(placed.join(mixed.hint("merge"), "key"), F.ceil(F.col("n") / TILE).cast("int"))
    across = tiled.groupBy("key", "tile_a", "tile_b").applyInArrow(_tile_candidates(least, percent), "a long, b long").distinct()
    clusters = saved(connected(saved(across, "pairs")).select(F.col("node").alias("component"), F.col("component").alias("cluster")), "clusters")
    release(docs)

    inside = _in_cluster_tiles(own.select("doc_id", "component", "n_shingles").join(clusters.hint("merge"), "component"))
    cut = inside.join(slim.hint("merge"), "doc_id").where(n_words(F.col("text")) > 0)
    more = saved(cut.groupBy("cluster", "tile_a", "tile_b").applyInArrow(_tile_links(k, percent), "a long, b long"), "links")
    joined = saved(connected(links.unionByName(more)), "components")
    release(docs)

    of_class = reps.select("print", F.col("doc_id").alias("rep")).join(joined.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    of_class = of_class.select("print", F.coalesce("component", "rep").alias("component_id"))
    return described.select("doc_id", "n_shingles", "print").join(of_class.hint("merge"), "print", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose document is the first of its component, as they are.

    Rows that share an id and a text are copies, of which one stays (that with the least hash of all its columns); rows
    that share an id with different texts are versions of one document and stay or go together; rows without an id stay.
    """
    found = near_duplicates(docs, k=k, percent=percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("_k")).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = row.where("row.doc_id is not null").join(found.hint("merge"), F.col("row.doc_id").cast("long") == F.col("_k"))
    one = named.groupBy("_k", F.xxhash64("row.text").alias("_t"), F.md5("row.text").alias("_m")).agg(
        F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return one.select("row").unionByName(row.where("row.doc_id is null")).select("row.*")


def op6_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
