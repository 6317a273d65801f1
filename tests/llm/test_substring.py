import random
import re

from pyspark.sql import functions as F

from lodestrata.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, span=13):
    low = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    big = float("inf")
    for d, w in split:
        for i in range(len(w) - span + 1):
            g = tuple(w[i : i + span])
            low[g] = min(low.get(g, big), big if d is None else d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - span + 1):
            if low[tuple(w[i : i + span])] < (big if d is None else d):
                gone |= set(range(i, i + span))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[3]))


def run(spark, rows, **kwargs):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit(1)).withColumn("at", F.lit("x"))
    got = [tuple(r) for r in substring.without_repeats(docs, **kwargs).select("doc_id", "n_words", "n_removed", "text").collect()]
    return sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[3]))


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_small_alphabet_and_edges(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{rng.randrange(50)}" for _ in range(60))
    rows = [(i, " ".join([f"a{i}"] * (i % 9) + [passage] + [rng.choice("xyz") for _ in range(rng.randrange(40))])) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice("ab") for _ in range(rng.randrange(80)))) for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \t\x0b"), (203, "é \x85 " * 30), (204, "é \x85 " * 30), (204, passage), (None, passage + " q"), (None, passage)]
    rng.shuffle(rows)
    assert run(spark, rows, chunk_bytes=2000) == brute(rows)
    assert run(spark, []) == []


def test_a_very_long_text(spark):
    rng = random.Random(7)
    words = [f"v{rng.randrange(3000)}" for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[50_000:50_200])), (3, " ".join(words[:20] + ["x"] + words[90_000:]))]
    assert run(spark, rows) == brute(rows)
