"""Packing, mixing, extraction, language, archives, neighbours."""

import gzip
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import blockmatrix, htmltext, language, mixing, packing, warc


def brute_fit(sizes, sources, clusters, capacity, most):
    bins, out = [], []
    for s, a, c in zip(sizes, sources, clusters):
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= s and b["sources"].count(a) < most and not (c and c in b["clusters"])]
        if fits:
            i = min(fits)[1]
        else:
            bins.append({"room": capacity, "sources": [], "clusters": []})
            i = len(bins) - 1
        bins[i]["room"] -= s
        bins[i]["sources"].append(a)
        bins[i]["clusters"].append(c)
        out.append(i)
    return out


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randrange(1, 120)
        sizes = sorted((rng.randrange(1, 60) for _ in range(n)), reverse=True)
        sources, clusters = [1 << rng.randrange(4) for _ in sizes], [rng.choice([0, 1, 2, 4]) for _ in sizes]
        assert packing.best_fit(sizes, sources, clusters, 64, 2) == brute_fit(sizes, sources, clusters, 64, 2)


def test_pack_edges(spark):
    rows = [(1, "a " * 5000, "s"), (2, None, "s"), (3, "", None), (4, "x y", None), (4, "X  y", None), (None, "q", "t")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("bin_id", F.lit(1))).collect()
    assert sum(r.n_words for r in got) == 5005 and {r.n_words for r in got if r.doc_id in (2, 3)} == {0}
    assert len({r.bin_id for r in got if r.doc_id == 4}) == 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_pack_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(spark.createDataFrame([(None, "one and the same text", None)] * 300, docs.schema))
    got = packing.pack(docs, capacity=512, max_per_source=2, group_pieces=64).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = docs.collect()
    assert sum(r.n_words for r in got) == sum(count(r.text) for r in rows)
    pieces = Counter((r.doc_id, r.piece, r.start, r.n_words, r.source) for r in got)
    want = Counter()
    for r in rows:
        n = count(r.text)
        for i in range(max(1, -(-n // 512))):
            want[r.doc_id, i, 512 * i, min(512, n - 512 * i), r.source] += 1
    assert pieces == want
    text = {r.doc_id: " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")).lower() for r in rows}
    bins = {}
    for r in got:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for members in bins.values():
        assert sum(r.n_words for r in members) == members[0].bin_words <= 512
        assert max(Counter(r.source for r in members).values()) <= 2
        assert len({text[r.doc_id] for r in members}) == len(members)
    again = packing.pack(docs.repartition(3), capacity=512, max_per_source=2, group_pieces=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_pack_by_cluster(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"s{i}", "c" if i < 4 else None) for i in range(8)], "doc_id long, text string, source string, cluster string")
    got = packing.pack(docs, cluster_col="cluster").collect()
    assert len({r.bin_id for r in got if r.doc_id < 4}) == 4 and len({r.bin_id for r in got}) == 4


def test_mix_edges(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 3}") for i in range(60)] + [(99, None, None), (100, "a b c", None), (100, "a b c", None), (None, "z", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(1))
    slices = mixing.mix_slices(docs)
    got = slices.groupBy("row_key", "doc_id", "size", "source").agg(F.sum("n_taken").alias("taken")).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    assert abs(sum(r.taken for r in got) - total) <= 4
    assert sorted(map(tuple, slices.collect()), key=str) == sorted(map(tuple, mixing.mix_slices(docs).collect()), key=str)
    assert mixing.mix_slices(spark.createDataFrame([], docs.schema)).count() == 0
    assert mixing.mix_documents(docs).columns == docs.columns


def test_tree_is_exact_and_permutations_permute():
    quotas = np.array([1000, 0, 17, 3])
    parts = mixing.split_quotas(quotas, 7, 1)
    assert (parts.sum(axis=0) == quotas).all() and parts.sum(axis=1).max() - parts.sum(axis=1).min() <= 3
    for n in (1, 2, 3, 64, 1000):
        for epoch in (0, 1):
            assert sorted(mixing.permuted(np.arange(n), n, 9, 4, epoch)) == list(range(n))
    assert list(mixing.permuted(np.arange(64), 64, 9, 4, 0)) != list(mixing.permuted(np.arange(64), 64, 9, 4, 1))


def test_what_the_draws_take(spark):
    """Against brute force: every block of every epoch in permuted order, until the target is met, word by word."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(rng.choice([0, 1, 5, 40, 300]))), rng.choice(["a", "a", "a", "b", None])) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row_key", F.lit(1))
    block = 16
    mix = mixing.plan_mix(docs, block_words=block, shard_words=500)
    slices = mixing.mix_slices(docs, block_words=block, shard_words=500).collect()
    assert mix.cuts.shape[0] > 3
    targets = {r.source: r for r in mixing.source_targets(docs.select("source", mixing.n_words(F.col("text")).alias("size"))).collect()}
    key = lambda i, t: hashlib.md5(f"17:{i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
    taken, per_shard = {}, {}
    for source, t in targets.items():
        stream = [w for _, text in sorted((key(i, text), text) for i, text, s in rows if s == source) for w in text.split()]
        n, left, d = -(-len(stream) // block), int(t.target + 0.5), 0
        for epoch in range(4):
            order = sorted(range(n), key=lambda b: mixing.permuted(np.array([b]), n, mixing.SEED, t.source_no, epoch)[0])
            for b in order:
                got = stream[b * block : (b + 1) * block][:left]
                if not got:
                    break
                left -= len(got)
                shard = int(np.searchsorted(mix.cuts[:, t.source_no], d, side="right"))
                d += 1
                for w in got:
                    taken[w] = taken.get(w, 0) + 1
                    per_shard[shard, w] = per_shard.get((shard, w), 0) + 1
        assert left == 0 and d == mix.draws[t.source_no].quota == mix.cuts[-1, t.source_no]
    words_of = {i: t.split() for i, t, _ in rows}
    mine = {}
    for r in slices:
        for w in words_of[r.doc_id][r.start or 0 : (r.start or 0) + r.n_taken]:
            mine[r.shard, w] = mine.get((r.shard, w), 0) + 1
    assert mine == per_shard
    whole = mixing.mix_documents(docs, block_words=block, shard_words=500).collect()
    counted = {}
    for r in whole:
        for w in r.text.split():
            counted[w] = counted.get(w, 0) + 1
    assert counted == taken and max(taken.values()) <= 3


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a<b) x="</p>";</script></head><body class="post sidebar-left">
<div id="cookie-notice">We use cookies to improve this long long sentence of ours.</div><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div class=content><h1>Head &amp; line</h1><p>First <b>bold</b>&nbsp;text, with enough words to weigh something.<p>Second<br>line <a href=x>link</a> of the text.
<form><p>Your name?</form></div><aside>More</aside><div class="comments"><p>Great article, thanks a lot for it!</p></div><!-- <p>no</p> --><footer>(c)</footer></body></html>"""


def test_extract():
    assert htmltext.extract(PAGE) == "Head & line\nFirst bold text, with enough words to weigh something.\nSecond line link of the text."
    assert htmltext.extract(PAGE[: PAGE.index(" of the text")]).endswith("Second line link")
    assert [htmltext.extract(x) for x in (None, "", "<p>", "a &lt; b", "<p>x<p>y")] == ["", "", "", "a < b", "x\ny"]
    assert htmltext.extract("<div>" * 5000 + "deep") == "deep"


def test_densities_by_brute_force():
    """The tree's densities and sums against a second parser and the formula written out."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.root = self.now = ["html", [], None]

        def handle_starttag(self, tag, attrs):
            node = [tag, [], self.now]
            self.now[1].append(node)
            if tag not in ("br", "img"):
                self.now = node

        def handle_endtag(self, tag):
            self.now = self.now[2]

        def handle_data(self, data):
            self.now[1].append(data)

    def counts(n):
        if isinstance(n, str):
            return len("".join(n.split())), 0, 0, 0
        parts = [counts(c) for c in n[1]]
        chars, tags = sum(p[0] for p in parts), sum(p[1] for p in parts) + sum(not isinstance(c, str) for c in n[1])
        links = (chars, 1 + sum(p[3] for p in parts)) if n[0] == "a" else (sum(p[2] for p in parts), sum(p[3] for p in parts))
        return chars, tags, *links

    def dense(n, share):
        c, t, lc, lt = counts(n)
        if not c:
            return 0.0
        plain = c - lc if c > lc else 1
        ratio = (c / (lc or 1)) * ((t or 1) / (lt or 1))
        return (c / (t or 1)) * (math.log(ratio) if ratio > math.e else 1.0) / math.log(c * lc / plain + share * c + math.e)

    rng = random.Random(12)

    def page(depth=0):
        out = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.choice(["text", "text", "div", "span", "a", "section", "b", "br"]) if depth < 5 else "text"
            if kind == "text":
                out.append(" ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 12))))
            elif kind == "br":
                out.append("<br>")
            else:
                out.append(f"<{kind}>{page(depth + 1)}</{kind}>")
        return "".join(out)

    for _ in range(60):
        source = page()
        other = Tree()
        other.feed(source)
        other.close()
        mine = htmltext.parse(source)
        htmltext._weigh(mine)
        c, _, lc, _ = counts(other.root)
        share = lc / c if c else 0.0
        todo = [(mine.children[0], other.root)]
        while todo:
            a, b = todo.pop()
            kids = [x for x in b[1] if not isinstance(x, str)]
            assert a.total == pytest.approx(sum(dense(x, share) for x in b[1])) and (b is other.root or a.density == pytest.approx(dense(b, share)))
            todo += zip([x for x in a.children if not isinstance(x, str)], kids, strict=True)


def test_self_closed_icons():
    for icon in ("<svg/>", '<svg class="i" />', "<math/>", "<SVG viewBox='0 0 1 1'/>", "<svg><path d='x'/></svg>"):
        assert htmltext.extract(f"<p>before {icon}after<p>more</p>") == "before after\nmore"
        assert htmltext.extract(f"<p>before {icon}after<p>more <svg>x</svg>end") == "before after\nmore end"


def test_class_words():
    text = "<h2>Head</h2><p>A paragraph of the article that has words enough to weigh.<p>And another one, to be sure."
    want = "Head\nA paragraph of the article that has words enough to weigh.\nAnd another one, to be sure."
    for tag, name in (("div", 'class="content has-sidebar"'), ("main", "class=with-sidebar"), ("article", 'class="post comments-open"'), ("div", "id='page-header-fixed'"),
                      ("div", "class=sidebar"), ("main", "class=sidebar"), ("article", "id=footer"), ("section", "class=related-work"), ("div", "class=legal-background")):
        assert htmltext.extract(f"<{tag} {name}>{text}</{tag}><div class=ad>Buy</div>") == want
        assert htmltext.extract(f"<div><div {name}>{text}</div><div class='cookie-notice left'>We use cookies</div></div>") == want
    assert htmltext.extract(f"<article>{text}<p class=search-results>The results of the search, in a sentence.</article>") == want + "\nThe results of the search, in a sentence."
    for name in ("sidebar", "sidebar-left", "adSlot1", "comments_area", "x site-footer"):
        assert htmltext.extract(f"<div>{text}</div><div class='{name}'><p>Beside the article, a sentence.</div>") == want
    assert htmltext.extract(f"<article>{text}</article><div class=comments><p>{'A long remark. ' * 99}</div>") == want


def test_extract_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "", "<p>t")]
    got = htmltext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 1), (1, len(htmltext.extract(PAGE))), (1, len(htmltext.extract(PAGE))), (2, 0)]


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "", "fr"), (10**6 + 2, "123 $", None), (10**6 + 3, "x" * 300_000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs.select("doc_id", "text", "lang").unionByName(extra).withColumn("score", F.lit("x"))).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for d, r in got.items() if r.held_out and d in lang]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(got[10**6 + i].lang_pred == "und" and got[10**6 + i].score == 0 for i in range(3))
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = docs.limit(0)
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_kernel_and_ridge_by_brute_force():
    rng = np.random.default_rng(5)
    say = lambda letters, n: " ".join("".join(rng.choice(list(letters), 4)) for _ in range(n))
    texts = [say(letters, 6) for _ in range(12) for letters in ("abcdé", "cdefg", "xyzab")]
    langs = ["p", "q", "r"] * 12
    model = language.fit(texts, langs, n_landmarks=3, ridge=0.01)
    grams = lambda t: {b[i : i + n] for b in [t.lower().encode()] for n in (1, 2, 3) for i in range(len(b) - n + 1)}
    marks = [grams(texts[i]) for k in "pqr" for i in [j for j, x in enumerate(langs) if x == k][:3]]
    known = set().union(*marks)
    sets = [grams(t) & known for t in texts]
    k = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    landmarks = np.array([[k(a, b) for b in marks] for a in marks])
    cross = np.array([[k(a, b) for b in marks] for a in sets])
    # Ridge on Nystrom features is the minimum of |cross a - y|^2 + lambda a' K a.
    y = np.array([[float(x == label) for label in "pqr"] for x in langs])
    a = np.linalg.solve(cross.T @ cross + 0.01 * len(texts) * landmarks, cross.T @ y)
    new = [say("abcdé", 3), say("xyzab", 9), "ABCD"]
    want = np.array([[k(grams(t) & known, m) for m in marks] for t in new]) @ a
    got, score = language.predict(model, new, model.table())
    assert got == ["pqr"[i] for i in want.argmax(axis=1)] and score == pytest.approx(np.clip(want.max(axis=1), 0, 1), abs=1e-5)


def test_language_of_copies_and_long_texts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    say = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    rows = [(i, say("abcde", 9), "a") for i in range(40)] + [(100 + i, "fghij " * 9, "b") for i in range(2000)]
    rows += [(3000 + i, say("fghij", 9), "b") for i in range(40)] + [(4000 + i, say("klmno", 30 + i), "c") for i in range(40)]
    learned = []
    monkeypatch.setattr(language, "fit", lambda texts, labels: learned.extend(zip(labels, texts)))
    language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", max_train=8, max_chars=100)
    assert [sum(x == k for x, _ in learned) for k in "abc"] == [8, 8, 8]
    free = sorted(len(t) for i, t, _ in rows if i >= 4000 and zlib.crc32(str(i).encode()) % 5)
    assert sorted(len(t) for x, t in learned if x == "c") == free[:8]


def test_archive_round_trip(spark, tmp_path):
    bodies = ["<p>a</p>", "<p>a</p>", None, "", "x\r\n\r\nWARC/1.1\r\n\r\n", "é" * 1000, "<p>a</p>"]
    rows = [(10 - i, f"http://h/{i} x" if i % 2 else None, b) for i, b in enumerate(bodies)] + [(None, "u", "é" * 1000), (4, "u", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = f"file://{tmp_path}/w"
    warc.write_archive(warc.resolve_revisits(pages, "page_id", "url", "html"), path)
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archive(spark, path).collect()}
    assert got == {(4, 8, "response", None), (10, 8, "revisit", 4), (9, 8, "revisit", 4), (7, 0, "response", None), (8, 0, "revisit", 7),
                   (6, len(bodies[4]), "response", None), (5, 2000, "response", None), (None, 2000, "revisit", 5)}
    data = b"".join(gzip.open(p).read() for p in (tmp_path / "w").glob("part-*"))
    assert sum(1 for _ in warc.parse_archive(io.BytesIO(data))) == len(rows)
    sized = warc.resolve_revisits(pages, "page_id", "url", "html", min_revisit_bytes=9).where("is_revisit")
    assert {r.id for r in sized.collect()} == {None}
    assert warc.resolve_revisits(pages, "page_id", "url", "html", min_revisit_bytes=9).count() == len(rows)
    with pytest.raises(ValueError):
        list(warc.parse_archive(io.BytesIO(data[:-9])))


def test_archive_of_long_and_many_pages(spark, tmp_path):
    rows = [(i, "u", "x" * (300_000 + i % 2)) for i in range(6)] + [(100 + i, "u", "same") for i in range(50)] + [(200, "u", None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_archive(warc.resolve_revisits(pages, "page_id", "url", "html"), path, records_per_file=7)
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archive(spark, path).collect())
    assert got[:3] == [(0, 300_000, "response", None), (1, 300_001, "response", None), (2, 300_000, "revisit", 0)]
    assert got[7] == (101, 4, "revisit", 100) and got[-2:] == [(200, 0, "response", None)] * 2 and len(got) == len(rows)
    assert warc.read_archive(spark, path).count() == len(rows)
    empty = f"file://{tmp_path}/e"
    warc.write_archive(warc.resolve_revisits(pages.limit(0), "page_id", "url", "html"), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)]
    rows += [(400, None), (420, [0.0] * 6), (440, [1.0, None] * 3), (460, [float("nan")] * 6), (480, [float("inf")] * 6), (500, [1.0, 2.0]), (20, rows[20][1]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in blockmatrix.nearest(df, block_rows=64, query_rows=8).collect()}
    vectors = {i: v for i, v in rows[:300]}
    want = {}
    for q in range(0, 300, 20):
        near = sorted((-sum(np.cumsum(np.array(vectors[q]) * np.array(v))[-1:]), i) for i, v in vectors.items() if i != q)[:20]
        want |= {(q, j + 1): (i, pytest.approx(-s, abs=1e-12)) for j, (s, i) in enumerate(near)}
    assert got == want
    monkeypatch.setattr(blockmatrix, "FAN_IN", 2)
    monkeypatch.setattr(blockmatrix, "MERGE_QUERIES", 4)
    again = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in blockmatrix.nearest(df, block_rows=32, query_rows=8).collect()}
    assert again == got
    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)] + [(60, [1.0, 0.0])], "vec_id long, embedding array<double>")
    near = [r.vec_id for r in blockmatrix.nearest(ties, block_rows=8, query_rows=2).where("query_id = 20").orderBy("rank").collect()]
    assert near == [i for i in range(21) if i != 20]
    assert blockmatrix.nearest(df.limit(0)).count() == 0
