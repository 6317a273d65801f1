import math
import re
import time
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
M = 2**64


def signed(x):
    return x - M if x >= M // 2 else x


def h_word(w):
    return xxhash.xxh64(w.encode(), seed=42).intdigest()


def h_longs(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64((v % M).to_bytes(8, "little"), seed=seed).intdigest()
    return seed


def grams(text, n):
    hashes = [h_word(w) for w in WORD.findall(text or "")]
    return [signed(h) % n for h in hashes] + [signed(h_longs(p)) % n for p in zip(hashes, hashes[1:])]


def brute(rows, labels, n_buckets=quality.N_BUCKETS, min_score=quality.MIN_SCORE):
    trusted = {d for d, q, t in labels if q == 1 and not t and d is not None}
    raw, target = Counter(), Counter()
    for d, text in rows:
        raw.update(grams(text, n_buckets))
        if d in trusted:
            target.update(grams(text, n_buckets))
    weights = quality.weights_of({b: (n, target[b]) for b, n in raw.items()}, n_buckets)
    out = []
    for d, text in rows:
        text = text or ""
        w = WORD.findall(text)
        g = grams(text, n_buckets)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        twice = {x for x, n in Counter(windows).items() if n > 1}
        covered = {i + j for i, x in enumerate(windows) if x in twice for j in range(8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        score = sum(weights[b] for b in g) / len(g) / quality.MICRO if g else 0.0
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed, score, not failed and score >= min_score))
    return out


def check(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("kept", F.lit("x"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs, lab).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got, want = sorted(map(tuple, got), key=key), sorted(brute(rows, labels), key=key)
    assert [g[:7] + g[8:] for g in got] == [w[:7] + w[8:] for w in want]
    assert all(math.isclose(g[7], w[7], abs_tol=1e-9) for g, w in zip(got, want))
    return got


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    got = check(spark, rows, labels)
    good = {d for d, q, t in labels if q == 1 and not t}
    assert sum(r[8] for r in got if r[0] in good and not r[6]) >= 0.98 * sum(not r[6] for r in got if r[0] in good)


def test_edges(spark):
    a = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, a), (4, a), (None, a + " | é x"), (5, "a b c d e f g h " * 9), (6, "x\n x\nx\n\ny\nx"),
            (7, " ".join(["q"] * 5000)), (8, "one two three four five six seven eight"), (9, "t " + "one two three four five six seven eight nine " * 2)]
    check(spark, rows, [(4, 1, 0), (4, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, None)])
    check(spark, rows, [])
    check(spark, [], [(1, 1, 0)])


def test_all_trusted_ids(spark):
    labels = spark.range(20_500).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert quality.trusted_ids(labels).count() == 20_500
    assert quality.trusted_ids(labels, 7).count() == 7


def test_clashing_columns(spark):
    a = " ".join(f"w{i}" for i in range(30))
    rows = [(1, a, "x", 2, "v", "k", 1.5), (1, a, "x", 2, "v", "k", 1.5), (2, None, None, None, None, None, None), (None, a + " b", "", 0, "", "", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _w string, _h int, _verdict string, kept string, `a.b` double")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if r[1]), key=str)


def test_filter_evaluates_the_verdict_once(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    plan = quality.keep_good(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(quality.WORD + ", 0") == 1
    took = []
    for run in (quality.score_documents, quality.keep_good, quality.score_documents, quality.keep_good):
        began = time.time()
        run(docs, labels).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[3] < 2 * took[2] + 1


def shuffled_bytes(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_no_text_is_shuffled(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where there are too many ids for it
    try:
        before = shuffled_bytes(spark)
        weights = quality.bucket_weights(docs, labels, n_buckets=64)
        assert shuffled_bytes(spark) - before < size / 20
        assert quality.bucket_weights(docs, labels, n_buckets=64, most_blocks=0) == weights
        assert shuffled_bytes(spark) - before > size / 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def test_marked_ids(spark):
    have = [-(2**63), -(2**40), -65, -64, -1, 0, 62, 63, 64, 127, 128, 2**40, 2**63 - 1]
    docs = spark.createDataFrame([(x + d,) for x in have for d in (-1, 0, 1) if -(2**63) <= x + d < 2**63] + [(None,), (0,)], "id long")
    ids = spark.createDataFrame([(x,) for x in have], "t_id long")
    for most in (quality.MOST_BLOCKS, 0):
        got = quality.marked(docs, ids, most)
        assert got.columns == ["id", "t"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(((r.id, int(r.id in have)) for r in docs.collect()), key=str)
        assert {r.t for r in quality.marked(docs, ids.limit(0), most).collect()} == {0}
