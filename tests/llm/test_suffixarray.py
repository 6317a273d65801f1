import random

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import suffixarray


def brute(rows, span=100):
    big = float("inf")
    texts = sorted(((big if d is None else d, (t or "").encode()) for d, t in rows), key=lambda r: (r[0], r[1]))
    seen, out = set(), []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            w = t[i : i + span]
            if w in seen:
                gone[i : i + span] = b"\1" * span
            seen.add(w)
        runs = len([x for x in bytes(gone).split(b"\0") if x])
        out.append((d, len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def run(spark, rows, **kwargs):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit(1)).withColumn("at", F.lit("x"))
    got = suffixarray.without_repeats(docs, **kwargs).select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept").collect()
    return sorted(((float("inf") if r[0] is None else r[0], *r[1:4], bytes(r[4])) for r in got), key=lambda r: (r[0], r[1], r[2], r[4]))


def check(spark, rows, **kwargs):
    assert run(spark, rows, **kwargs) == sorted(brute(rows), key=lambda r: (r[0], r[1], r[2], r[4]))


def test_documents(spark, sf):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_overlaps_and_edges(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(600))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(rng.randrange(50))) + base[rng.randrange(300) :][: rng.randrange(80, 400)] + "é" * rng.randrange(3)) for i in range(80)]
    rows += [(100, "ab" * 300), (101, "ab" * 90), (102, None), (103, ""), (104, "x" * 99), (105, "x" * 100), (106, "x" * 100), (107, "\0" * 250), (None, base), (108, base), (108, "short")]
    rng.shuffle(rows)
    check(spark, rows, chunk_bytes=3000)
    check(spark, [])


def test_suffix_array_and_intervals():
    rng = random.Random(1)
    for _ in range(60):
        segments = ["".join(rng.choice("ab\0") for _ in range(rng.randrange(3, 30))).encode() for _ in range(rng.randrange(1, 8))]
        least = rng.randrange(1, 5)
        if max(map(len, segments)) < least:
            continue
        owner, place, common, left = suffixarray.suffix_array(segments, least)
        suffixes = [segments[o][p:] for o, p in zip(owner, place)]
        assert suffixes == sorted(suffixes)
        assert sorted(zip(owner.tolist(), place.tolist())) == [(i, j) for i, s in enumerate(segments) for j in range(len(s) - least + 1)]
        for i in range(1, len(suffixes)):
            a, b = suffixes[i - 1], suffixes[i]
            n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert common[i] == n
        repeats = list(suffixarray.maximal_repeats(common, left, least, owner * 100 + place))
        got = {suffixes[lo][:n]: set(zip(owner[lo:hi].tolist(), place[lo:hi].tolist())) for lo, hi, n, _ in repeats}
        seen, gone = set(), [set() for _ in segments]
        for i, s in enumerate(segments):
            for j in range(len(s) - least + 1):
                if s[j : j + least] in seen:
                    gone[i] |= set(range(j, j + least))
                seen.add(s[j : j + least])
        later = [(j, n) for _, _, n, ones in repeats for j in ones]
        assert len({j for j, _ in later}) == len(later)  # each occurrence is decided once
        mine = [set() for _ in segments]
        for j, n in later:
            mine[owner[j]] |= set(range(place[j], place[j] + n))
        assert mine == gone
        want = {}
        for i, s in enumerate(segments):
            for j in range(len(s)):
                for n in range(least, len(s) - j + 1):
                    want.setdefault(s[j : j + n], set()).add((i, j))
        maximal = {}
        for w, occ in want.items():
            if len(occ) < 2:
                continue
            lefts = {segments[i][j - 1] if j else (-1, i) for i, j in occ}
            rights = {segments[i][j + len(w)] if j + len(w) < len(segments[i]) else (-1, i) for i, j in occ}
            if (len(lefts) > 1 or any(j == 0 for _, j in occ)) and (len(rights) > 1 or any(j + len(w) == len(segments[i]) for i, j in occ)):
                maximal[w] = occ
        assert got == maximal, (segments, least)


def test_groups_have_all_occurrences(spark):
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    x, y = say(120), say(130)
    rows = [(3, say(30) + x + say(20)), (1, x), (7, say(10) + y + x), (9, y + say(200)), (12, say(300)), (None, y), (15, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("group", F.lit(1))
    groups = {}
    for r in suffixarray.repeat_groups(docs, chunk_bytes=300).collect():
        groups.setdefault((r.group, r.length), []).append((r.doc_id, r.start, r.is_first))
    text = {d: (t or "").encode() for d, t in rows}
    for (_, length), places in groups.items():
        assert len({text[d][a : a + length] for d, a, _ in places}) == 1 and length >= 100
        word = text[places[0][0]][places[0][1] : places[0][1] + length]
        assert sum(t.count(word) for t in text.values()) == len(places)
        order = sorted(places, key=lambda p: (p[0] is None, p[0] or 0, p[1]))
        assert [f for _, _, f in order] == [True] + [False] * (len(order) - 1)
    windows = {}
    for d, t in text.items():
        for i in range(len(t) - 99):
            windows.setdefault(t[i : i + 100], []).append((d, i))
    held = {length: [{(d, a) for d, a, _ in g} for (_, n), g in groups.items() if n == length] for _, length in groups}
    for spots in windows.values():  # each repeated window lies in a group that has all its occurrences
        if len(spots) > 1:
            assert any({(d, i - s) for d, i in spots} == g for n, gs in held.items() for s in range(n - 99) for g in gs)
    assert suffixarray.repeat_groups(docs.limit(0)).count() == 0


def test_many_rows_without_an_id(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(None, base[i * 7 :][:250]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = b"".join(bytes(r.kept) for r in suffixarray.without_repeats(docs, chunk_bytes=500).collect())
    windows = {base[i : i + 100] for r in rows for i in [base.index(r[1])]}
    assert len(kept) < 800 and windows


def test_a_very_long_text(spark, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(300_000))
    rows = [(1, text), (2, text[150_000:150_400]), (3, "x" + text[290_000:])]
    check(spark, rows)
    texts = [t.encode() for _, t in rows]
    whole = suffixarray.runs_of(texts, 100, 50)
    monkeypatch.setattr(suffixarray, "PIECE", 1000)
    again = suffixarray.runs_of(texts, 100, 50)
    assert all((a == b).all() for a, b in zip(whole[1:], again[1:]))  # pieces change nothing
