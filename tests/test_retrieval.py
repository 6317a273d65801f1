import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata import catalogue
from lodestrata.functions.words import fold, porter
from lodestrata.operators import context, lexicon, retrieval
from lodestrata.operators.lexicon import Lexicon, lookup_names, read_dictionary, romanized


def test_porter():
    # Examples of the published algorithm, step by step.
    pairs = ("caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing "
             "conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky "
             "relational relat conditional condit rational ration valenci valenc digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope "
             "formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope "
             "goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit "
             "replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog "
             "effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll").split()
    assert [porter(w) for w in pairs[::2]] == pairs[1::2]


def test_fold():
    assert fold("Aśvagandhā ½ ﬁ é") == "Asvagandha 1⁄2 fi e"
    assert fold("अश्व Ā") == "अश्व A" and fold(None) is None


NAMES = [
    {"sanskrit": ["Aśvagandhā", "Vajigandha"], "latin": ["Withania somnifera"], "english": ["Winter Cherry"], "family": ["Solanaceae"]},
    {"sanskrit": ["Krishna", "Maricha"], "latin": ["Piper nigrum"], "english": ["pepper"]},
    {"sanskrit": ["Krishna", "Pippali"], "english": ["long pepper", None, " "]},
    {"ayurvedic": ["Amavata"], "modern": ["rheumatism"]},
]


def test_lexicon():
    lex = Lexicon(NAMES, frozenset(["ship", "sip", "the", "braces"]))
    assert romanized("ashwagandha") == "asvagandha" and romanized("ab") == "ab"
    assert lex.synonyms("Krishna") == {"Krishna", "Maricha", "Piper nigrum", "pepper", "Pippali", "long pepper"}
    assert "Withania somnifera" in lex.synonyms("ashwagandha") and "Solanaceae" not in lex.synonyms("ashwagandha")
    assert lex.synonyms("somnifera") == {"somnifera"} and lex.synonyms("") == set()
    assert not lex.wants_key("ship") and not lex.wants_key("braches") and lex.wants_key("ship", {"ship"}) and lex.wants_key("pippali")
    assert lex.tokenize("The ship") == ["ship"]
    got = lex.tokenize("Ashwagandha and configuring API अश्वगन्धा")
    assert {"ashwagandha", "asvagandha", "withania", "somnifera", "winter", "cherry", "configuring", "configur", "api", "अश्वगन्धा"} <= set(got)
    assert "and" not in got and len(got) == len(set(got))
    assert set(lex.tokenize("Aśvagandhā")) & set(lex.tokenize("ashwagandha")) >= {"asvagandha"}
    assert lex.tokenize("running", synonyms=False, stem=False) == ["running"] and lex.tokenize(None) == [] and lex.tokenize(" ") == []


def test_company_across_batches(spark, monkeypatch):
    # A task works out a token's stems, key and synonyms once, not once a batch, and forgets them only beyond a bound.
    asked = []
    monkeypatch.setattr(lexicon, "porter", lambda w: (asked.append(w), porter(w))[1])
    lex = Lexicon(NAMES, frozenset(["ship", "the"]))
    texts = [["The running Śhip of ashwagandha", None], ["ship running, ashwagandha", "ŚHIP"]]
    got = [b.to_pylist() for b in lex.tokens().func(iter(map(pa.array, texts)))]
    assert asked.count("running") == 1 and asked.count("ship") == 2  # once as written plainly, once with diacritics
    assert got == [[lex.tokenize(t) for t in batch] for batch in texts]
    assert "sip" in got[0][0] and "sip" not in got[1][0] and got[1][1] == ["ship", "sip"]  # only as written with diacritics
    known = lexicon.Company(lex)
    monkeypatch.setattr(lexicon, "MAX_KNOWN", 1)
    lex.tokenize("one two three", known=known)
    known.bound()
    assert not known and lex.tokenize("one two", known=known) == lex.tokenize("one two")


def test_lexicon_in_search(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"a": {"sanskrit": ["Ashvagandha"], "english": ["winter cherry"]}, "bad": 3}')
    (tmp_path / "broken.json").write_text("{")
    assert read_dictionary(spark, str(tmp_path / "broken.json")) == {} and read_dictionary(spark, str(tmp_path / "none.json")) == {}
    assert [n for *_, n in lookup_names(read_dictionary(spark, str(tmp_path / "d.json")))] == ["ashvagandha", "winter cherry"]
    lex = Lexicon.load(spark, [str(tmp_path / "d.json")])
    docs = spark.createDataFrame([(1, "roots of aśvagandhā"), (2, "the cherry"), (3, "nothing here"), (4, None), (5, "some other text"), (6, "and more"), (7, "words")], "doc_id long, text string")
    index = retrieval.Index.build(docs, "doc_id", F.col("text"), lex.tokens())
    asked = spark.createDataFrame([(0, "Ashwagandha"), (1, ""), (2, "unheard")], "qid int, text string")
    assert [(r.qid, r.id) for r in index.search(asked, "qid", 5, lex.tokens()).orderBy("qid", "rank").collect()] == [(0, 1), (0, 2)]
    assert lex.synonym_index(spark).count() == 2


def test_bm25_by_hand(spark):
    texts = {1: "a b c", 2: "a d", 3: "e f g h", 4: "", 5: "b b e"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = spark.createDataFrame([(7, "b e"), (8, "zzz")], "item_id long, text string")
    sets = {i: set(t.split()) for i, t in texts.items() if t}
    n, average = len(sets), sum(map(len, sets.values())) / len(sets)
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t in set().union(*sets.values()) for d in [sum(t in s for s in sets.values())]}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    want = sorted(((round(sum(idf[t] for t in s & {"b", "e"}) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(s) / average)), 9), -i) for i, s in sets.items()), reverse=True)
    got = [(r.score, -r.id) for r in retrieval.bm25(docs, asked, 10).orderBy("rank").collect()]
    assert got == [w for w in want if w[0] > 0]


@pytest.mark.parametrize("bounds", [{}, {"ASKED_ROWS": 5, "CELLS": 7, "MATCHES": 11}])
def test_search_is_exact_and_written_once(spark, monkeypatch, bounds):
    # Many ties, blocks of questions and of documents, an id seen twice: what remains is the best by score, then by id.
    for name, value in bounds.items():
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)]
    texts = [(i % 38, " ".join(rng.choice(words, rng.integers(0, 6)))) for i in range(40)]
    docs = spark.createDataFrame([(None if i == 0 else f"d{i:02}", t) for i, t in texts], "doc_id string, text string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(rng.choice([*words, "zzz"], 4))) for i in range(9)] + [(None, "w1 w2")], "item_id long, text string")
    index = retrieval.Index.build(docs, "doc_id", F.col("text"))
    idf = {r.token: r.idf for r in index.terms.collect()}
    rows = [(i, set(t.split())) for i, t in texts if t]
    average = sum(len(t) for _, t in rows) / len(rows)
    want = set()
    for q in asked.collect():
        score = {}
        for i in {i for i, _ in rows}:
            own = [t for j, t in rows if j == i]
            total = sum(idf[w] for t in own for w in t & set(q.text.split()))
            score[i] = round(total * 2.5 / (1 + 1.5 * (0.25 + 0.75 * max(map(len, own)) / average)), 9)
        best = sorted((-s, i) for i, s in score.items() if s > 0)[:3]
        want |= {(q.item_id, None if i == 0 else f"d{i:02}", -s, k) for k, (s, i) in enumerate(best, 1)}
    hits = index.search(asked, "item_id", 3)
    assert {(r.qid, r.id, round(r.score, 9), r["rank"]) for r in hits.collect()} == want
    assert all("/hits-" in f for f in hits.inputFiles())  # who reads them twice doesn't search twice
    assert index.search(asked.where("text = 'none'"), "item_id", 3).count() == 0


def test_cosine(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (60, 5)).astype(float)
    v[7] = 0
    rows = [(i, v[i].tolist(), i % 3) for i in range(60)] + [(99, None, 0)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>, kind int")
    queries = spark.createDataFrame([(i, v[i].tolist(), i % 3) for i in range(0, 60, 7)], "qid long, q array<double>, want int")

    def brute(filtered):
        out = []
        for q in range(0, 60, 7):
            norm = np.linalg.norm(v, axis=1) * np.linalg.norm(v[q])
            s = np.round(np.where(norm == 0, 0, v @ v[q] / np.where(norm == 0, 1, norm)), 9) + 0.0
            best = sorted((-s[i], i) for i in range(60) if not filtered or i % 3 == q % 3)[:4]
            out += [(q, i, r) for r, (_, i) in enumerate(best, 1)]
        return sorted(out)

    for filtered in (False, True):
        got = retrieval.cosine_topk(vectors, queries, 4, block=16, filtered=filtered)
        assert sorted((r.qid, r.id, r["rank"]) for r in got.collect()) == brute(filtered)


def test_diverse(spark):
    vectors = np.array([[1.0, 0.0], [1.0, 0.01], [0.0, 1.0]])
    assert retrieval.select_diverse(np.array([0.9, 0.89, 0.3]), vectors, 0.3, 2) == [0, 2]
    assert retrieval.select_diverse(np.array([0.9, 0.89, 0.3]), vectors, 1.0, 3) == [0, 1, 2]
    assert retrieval.select_diverse(np.array([0.5, 0.5]), vectors[:2], 0.7, 5) == [0, 1]
    rows = [(1, r + 1, i, s, vectors[i].tolist(), [0.0, 1.0]) for r, (i, s) in enumerate([(0, 0.9), (1, 0.8), (2, 0.7)])]
    rows += [(2, r, i, None, v, q) for _, r, i, _, v, q in rows] + [(3, 5, 0, None, [1.0, 0.0], None)]
    c = spark.createDataFrame(rows, "qid int, rank int, id int, rerank_score double, v array<double>, q array<double>")
    got = sorted((r.qid, r["rank"], r.id) for r in retrieval.diverse(c, 0.3, 2).collect())
    assert got == [(1, 1, 0), (1, 2, 2), (2, 1, 2), (2, 2, 0), (3, 5, 0)]


def test_fusion_edges(spark):
    rows = [(1, 0, 1, "a"), (1, 0, 2, None), (1, 0, 3, "b"), (1, 1, 1, "b"), (1, 1, 2, "c"), (1, 1, 3, "b")]
    lists = spark.createDataFrame(rows, "qid int, list_no int, pos int, id string").withColumn("retriever", F.concat(F.lit("r"), "list_no"))
    got = retrieval.reciprocal_rank_fusion(lists).orderBy("rank").collect()
    assert [(r.id, r["rank"], r.retrievers) for r in got] == [("b", 0, ["r0", "r1"]), ("a", 1, ["r0"]), ("c", 2, ["r1"])]
    assert got[0].score == pytest.approx(1 / 63 + 1 / 61 + 1 / 63)
    assert retrieval.reciprocal_rank_fusion(lists.limit(0)).collect() == []


def test_mentions_and_safety(spark):
    texts = spark.createDataFrame([(1, "Take Amla, or the winter  cherry."), (2, "Amlas and WINTER CHERRY (dry)"), (3, None)], "id int, text string")
    names = spark.createDataFrame([("a", "amla"), ("w", "winter cherry"), ("x", "a.b")], "entry string, name string")
    assert sorted(map(tuple, context.mentioned(texts, names).collect())) == [(1, "a"), (2, "w")]
    mentions = spark.createDataFrame([(1, "a", 0), (1, "w", 1)], "qid int, entry string, place int")
    passages = spark.createDataFrame([(1, "a", 1, "Fine. Avoid amla and winter cherry when ill! More."), (1, "w", 1, "Avoid  amla and winter cherry when ill! Caution with winter cherry. " + "x" * 10)],
                                     "qid int, entry string, rank int, text string")
    notes = context.herb_notes(mentions, passages, names, most_chars=25)
    assert sorted(map(tuple, notes.select("entry", "note").collect())) == [("a", "Avoid amla and winter che…"), ("w", "Caution with winter cherr…")]
    answers = spark.createDataFrame([(1, "Use it.", ["Rasa texts"]), (2, "Use bhasma. " + context.DISCLAIMER, ["x"])], "qid int, answer string, documents array<string>")
    got = {r.qid: r.answer for r in context.with_safety(answers, notes).collect()}
    assert got[1] == f"Use it.\n\nSafety Notes:\n- a: Avoid amla and winter che…\n- w: Caution with winter cherr…\n\n{context.DISCLAIMER}"
    assert got[2] == f"Use bhasma. {context.DISCLAIMER}\n\nSafety Notes:\n- {context.METAL_WARNING}"
    got = spark.createDataFrame([("It is fine. It may INTERACT badly? Avoid it",)], "t string").select(context.risk_sentences(F.col("t"))).first()[0]
    assert got == ["It may INTERACT badly?", "Avoid it"]


def test_parents(spark):
    parents = spark.createDataFrame([("p", "old", 1), ("p", "new", 2), (None, "x", 3)], "chunk_id string, text string, no int")
    kept = context.parent_store(parents, "no")
    assert list(map(tuple, kept.collect())) == [("p", "new")]
    hits = spark.createDataFrame([(1, 2, "c1", "p"), (1, 1, "c0", "p"), (1, 3, "c2", "q")], "qid int, rank int, id string, parent_id string")
    assert list(map(tuple, context.parents_of(hits, kept).collect())) == [(1, 1, "p", "new")]
    ids = spark.createDataFrame([("a_P3",), ("a_P3_C12",), ("a",)], "id string").select(context.chunk_no(F.col("id")))
    assert [r[0] for r in ids.collect()] == [3, 12, 0]


def test_names_of_queries():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
