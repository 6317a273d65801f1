import random
from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm import test_neardup, test_quality, test_suffixarray
from pyspark.sql import functions as F

from lodestrata.llm import mixing
from lodestrata.llm.components import saved


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "minhash near-dedup", "suffix-array dedup", "source mixing", "best-fit packing"]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]

    good = saved(stages["quality rules"](spark, docs, sf), "t")
    assert good.columns == columns
    kept = {d for d, *_, k in test_quality.brute(rows, labels) if k}
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    assert {d for d, _ in rows} == kept

    alone = saved(stages["minhash near-dedup"](spark, good, sf), "t")
    assert alone.columns == columns
    kept = {d for d, _, _, k in test_neardup.brute(rows, k=5) if k}
    rows = [x for x in rows if x[0] in kept]
    assert sorted((r.doc_id, r.text) for r in alone.collect()) == rows

    cut = saved(stages["suffix-array dedup"](spark, alone, sf), "t")
    assert cut.columns == columns
    want = sorted((d, k.decode("utf-8", "ignore")) for d, _, _, _, k in test_suffixarray.brute(rows))
    assert sorted((r.doc_id, r.text) for r in cut.collect()) == want
    other = {r.doc_id: (r.lang, r.source) for r in docs.collect()}
    assert all(other[r.doc_id] == (r.lang, r.source) and r.n_chars == len(r.text) for r in cut.collect())

    mixed = saved(stages["source mixing"](spark, cut, sf), "t")
    assert mixed.columns == columns
    taken = Counter()
    for r in mixed.collect():
        taken[r.source] += len(test_quality.WORD.findall(r.text))
    sized = cut.select("source", mixing.n_words(F.col("text")).alias("size"))
    for r in mixing.source_targets(sized).collect():
        assert abs(taken[r.source] - r.target) <= 1

    bins = stages["best-fit packing"](spark, mixed, sf).collect()
    assert sum(r.n_words for r in bins) == sum(taken.values())
    room = defaultdict(int)
    for r in bins:
        room[r.bin_id] += r.n_words
    assert max(room.values()) <= 2048 and all(r.bin_words == room[r.bin_id] for r in bins)


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    rng = random.Random(1)
    say = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    rows = [(i, say(60), "en", f"s{i % 3}", 1) for i in range(12)]
    rows += [rows[3], rows[3], (5, say(60), None, None, None), (None, say(70), "en", None, 2), (None, say(70), None, "s1", 3), (20, None, "en", "s1", 0), (21, "", None, None, 0), (22, "x " * 30, "fr", "s2", 60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, kept in (("some", rows), ("none", [])):
        at = f"file://{tmp_path}/{name}"
        spark.createDataFrame(kept, schema).withColumn("_verdict", F.lit(7)).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 0)] if kept else [], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = saved(run(spark, docs, at), "t")
            assert docs.columns == columns
            if stage == "quality rules" and kept:
                assert Counter(r.doc_id for r in docs.collect()) == Counter(r[0] for r in rows if r[0] not in (20, 21, 22))
            if stage == "minhash near-dedup" and kept:
                assert Counter(r.doc_id for r in docs.collect()) == {**{i: 1 for i in range(12)}, 5: 2, None: 2}
        bins = corpus_pipeline.STAGES[-1][1](spark, docs, at).collect()
        assert bool(bins) == bool(kept) and all(r.n_words <= r.bin_words <= 2048 for r in bins)
