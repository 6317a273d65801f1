import random
import re

from pyspark.sql import functions as F

from lodestrata.llm import components, neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(text, k):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=4, percent=80):
    s = [sets_of(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, x in enumerate(s):
        for g in x:
            by.setdefault(g, []).append(i)
    for i, x in enumerate(s):
        near = {j for g in x for j in by[g] if j < i}
        for j in near:
            n = len(x & s[j])
            if 100 * n >= percent * (len(x) + len(s[j]) - n):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(x), low[find(i)], low[find(i)] == d) for i, ((d, _), x) in enumerate(zip(rows, s)))


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("kept", F.lit("x"))
    return sorted(map(tuple, neardup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_chains_and_edges(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(40):  # a chain: neighbours are similar, its ends aren't
        rows.append((100 - i, " ".join(base[i * 5 : i * 5 + 150])))
    rows += [(200 + i, " ".join(base[:100] + [f"x{i}y{j}" for j in range(60)])) for i in range(30)]  # a shared passage, not near
    rows += [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "É a b c"), (8, "é a b c"), (300, "x " * 3000), (301, "X " * 2000)]
    assert run(spark, rows) == brute(rows)
    twice = rows[:5] + rows[:5]
    assert run(spark, twice) == brute(twice)
    assert run(spark, [(None, "a b c d e"), (9, "a b c d e")]) == [(9, 2, 9, True), (None, 2, None, True)]
    assert run(spark, []) == []


def straggling():
    """Families of edits of one text: a dominant component, and a straggler near to just one member, which is no hub."""
    rng = random.Random(8)
    rows = []
    for family in range(4):
        base = [f"f{family}w{j}x{rng.randrange(10**6)}" for j in range(200)]
        edit = lambda places: " ".join(f"{w}e" if j in places else w for j, w in enumerate(base))
        shared, further = {10, 20}, {30, 40, 50, 60}
        free = range(70, 195, 5)
        texts = [edit(set()), edit(shared), edit(shared | further)]
        texts += [edit({j}) for j in range(68, 168)] + [edit(shared | set(rng.sample(free, 3))) for _ in range(30)]
        rng.shuffle(texts)
        rows += [(1000 * family + i, t) for i, t in enumerate(texts)]
    return rows


def test_stragglers_of_a_dominant_component(spark, monkeypatch):
    rows = straggling()
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(neardup, "CLUSTER_TILE", 40)
    assert run(spark, rows) == brute(rows)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = dict(map(tuple, components.connected(links).collect()))
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def bridged(groups=60):
    """In each group two originals, edited copies of both, and one pair across of similarity 0.8 that alone joins them."""
    rng = random.Random(3)
    rows = []
    for g in range(groups):
        left = [f"g{g}a{i}" for i in range(203)]
        right = left[:160] + [f"g{g}b{i}" for i in range(43)]
        edit = lambda w, n: [f"{x}e{rng.randrange(10**6)}" if j in set(at) else x for at in [rng.sample(range(3, 200), n)] for j, x in enumerate(w)]
        texts = [left, right] + [edit(left, 2) for _ in range(12)] + [edit(right, 2) for _ in range(12)]
        bridge = left[:180] + [f"g{g}c{i}" for i in range(2)]
        texts += [bridge, bridge[:161] + right[161:182]]
        rng.shuffle(texts)
        rows += [(100 * g + i, " ".join(t)) for i, t in enumerate(texts)]
    return rows


def test_bridges_between_families(spark):
    rows = bridged()
    assert run(spark, rows) == brute(rows)


def test_keep_first(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(5, t, 1, "a"), (5, t, 1, "a"), (5, t, 1, "b"), (7, t + " x", 2, "c"), (8, "other words here entirely and more", 3, "d"), (8, "a second text of that id, unlike it", 3, "e"),
            (None, t, 4, "f"), (None, t, 4, "f"), (9, None, 5, None), (10, "", 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k_id int, _row string")
    got = neardup.keep_first(docs)
    assert got.columns == docs.columns
    got = sorted(map(tuple, got.collect()), key=str)
    assert [r[0] for r in got] == sorted([10, 5, 8, 8, 9, None, None], key=str) and len(got) == 7
    assert sorted(got, key=str) == sorted(map(tuple, neardup.keep_first(docs).collect()), key=str)
    assert neardup.keep_first(docs.limit(0)).collect() == []
