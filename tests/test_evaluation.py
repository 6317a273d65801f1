import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import evaluation, providers, retrieval
from lodestrata.plans import evaluate
from lodestrata.sources import evaluation as sources
from lodestrata.sources import stores
from lodestrata.sources.stores import Store


class Model:
    """Vectors count words; reranking counts a question's words; completions follow a script."""

    WORDS = ("neem", "honey", "fever", "cure", "milk", "rice")

    def __init__(self, fail_on: str = "", said: str = ""):
        self.fail_on, self.said = fail_on, said

    def embed(self, texts, kind):
        return [[float(t.lower().count(w)) for w in self.WORDS] for t in texts]

    def rerank(self, question, texts, top_n):
        if self.fail_on and self.fail_on in question:
            raise RuntimeError("no service")
        scores = sorted(((-sum(t.lower().count(w) for w in question.lower().split()), i) for i, t in enumerate(texts)))
        return [(i, -float(s)) for s, i in scores][:top_n]

    def complete(self, prompt, max_tokens):
        if "Score the answer" in prompt:
            return 'Well: {"faithfulness": 8, "relevance": "9", "completeness": 7, "reasoning": "fine"}'
        if self.fail_on and self.fail_on in prompt:
            raise RuntimeError("no credits")
        return self.said or "Neem cures fever 【1】 and 【9】."


def engine(spark, model):
    rows = [(f"s_pdf_{p}_P0_C{i}", t, f"s_pdf_{p}_P0", "s.pdf", p, None if p % 2 else "clinical") for p, t in enumerate(
        ["neem cures fever", "honey and milk", "rice with milk", "fever and cure", "neem honey", "plain words here", "milk milk fever", "rice rice", "cure of neem"]) for i in (0,)]
    chunks = spark.createDataFrame(rows, "id string, text string, parent_id string, source string, page int, doc_type string")
    none = F.lit(None).cast("string")
    chunks = chunks.withColumns({"text_name": none, "citation": none, "sthana": none, "heading_path": F.array().cast("array<string>"), "context_header": none})
    chunks = providers.embed(chunks, F.col("text"), model, "m")
    parents = chunks.select("parent_id", F.concat(F.lit("whole "), "text").alias("parent_text"))
    return evaluate.Engine(retrieval.Index.build(chunks, "id", F.col("text")), chunks, parents, model, "m")


ITEMS = [("q1", "neem fever", "it cures", ["s.pdf"], ["s_pdf_0_P0"]), ("q2", "milk", "drink", ["other"], ["s_pdf_7_P0", "s_pdf_1_P0"]), ("q3", "zebra", "none", ["s.pdf"], [])]
ITEM = "qid string, question string, gold_answer string, gold_works array<string>, gold_passages array<string>"


def test_run(spark, tmp_path):
    items = spark.createDataFrame(ITEMS, ITEM)
    out = str(tmp_path)
    run = evaluate.run_evaluation(spark, engine(spark, Model()), items, k=2, judge=True, out=out)
    per = {r.qid: r for r in run.per_question.collect()}
    assert run.status == "VALID" and run.summary["n_questions"] == 3 and run.summary["rerank_skips"] == 0
    assert per["q1"].recall == 1 and per["q1"].mrr == 1 and per["q1"].passage_recall == 1 and per["q1"].citation_accuracy == 1 and per["q1"].judge_relevance == 9
    assert per["q2"].recall == 0 and per["q2"].passage_recall == 1 and per["q3"].passage_recall is None
    assert per["q1"].answer == "Neem cures fever 【1】 and ."
    files = sources.list_files(spark, f"{out}/*")
    assert len(files) == 2
    lines = [json.loads(x) for x in open(files[1].removeprefix("file:"))]
    assert lines[0]["type"] == "run" and lines[0]["status"] == "VALID" and [x["id"] for x in lines[1:]] == ["q1", "q2", "q3"]
    saved = json.load(open(files[0].removeprefix("file:")))
    assert len(saved["results"]) == 3 and saved["summary"]["recall"] == lines[0]["summary"]["recall"]
    # A trace alone gives the run's own metrics, and other metrics with other labels.
    meta, asked = sources.read_runs(spark, [out])
    assert [(r.config, r.pipeline, r.k, r.status) for r in meta.collect()] == [("rerank", "rerank", 2, "VALID")]
    again = evaluation.summary(evaluate.rescored(asked, sources.gold_works(items), sources.gold_passage_ids(items), 2), evaluate.METRICS).first()
    assert all(again[m] == run.summary[m] for m in evaluate.METRICS)
    labels = spark.createDataFrame([("q2", "s.pdf")], "qid string, work string")
    one = evaluate.rescored(asked, labels, None, 2).collect()
    assert [(r.qid, r.recall) for r in one] == [("q2", 1.0)]
    missing = evaluation.missing_labels(asked.select(F.col("id").alias("qid")), labels)
    assert sorted(r.qid for r in missing.collect()) == ["q1", "q3"]
    ranges, cells, marks = evaluate.report(spark, {"": [out], "before": [out]}, sources.gold_works(items), comparisons=(("before:rerank", "rerank"),))
    assert {r.config for r in ranges.collect()} == {"rerank", "before:rerank"} and ranges.first().hit.startswith("0.")
    assert {r.qid: r.rerank for r in cells.collect()}["q1"] == "1"
    tally = {r.mark: r.n for r in evaluation.mark_tally(marks["before:rerank", "rerank"]).collect()}
    assert sum(tally.values()) == 3 and set(tally) <= {"=", "."}
    assert evaluate.markdown(cells, "qid").startswith("| qid |")


def test_failures(spark):
    items = spark.createDataFrame(ITEMS, ITEM)
    run = evaluate.run_evaluation(spark, engine(spark, Model(fail_on="milk")), items, k=2, pipeline="rerank_mmr")
    assert run.status == "INVALID" and run.summary["rerank_skips"] == 1
    assert {r.qid: r.answer for r in run.per_question.collect()}["q2"] is None
    with pytest.raises(ValueError):
        evaluate.retrieve(engine(spark, Model()), items.select("qid", F.col("question").alias("text")), "best")


def test_without_model_and_variants(spark):
    e = engine(spark, Model(said="honey\nMILK\nrice water"))
    asked = spark.createDataFrame([("q2", "milk"), ("q9", " ")], "qid string, text string")
    got = evaluate.retrieve(e, asked, "rrf", expand=True, use_hypothetical=True, infer_types=True)
    assert {r.stage for r in got.lists.collect()} == {"fused", "mmr"} and got.scored_stage == "fused"
    assert {r.passage for r in got.hypothetical.collect()} == {"honey\nMILK\nrice water", None}
    plain = evaluate.Engine(e.index, e.chunks, e.parents)
    assert evaluate.retrieve(plain, asked, "rerank").lists.where("stage = 'rerank' and rank = 1").count() == 1
    block, numbered = evaluate.contexts(plain, evaluate.retrieve(plain, asked, "rrf"))
    assert block.first().context.startswith("【Source 1】\nDocument: s.pdf\nPage: 1\n") and "whole honey and milk" in block.first().context


def test_query_understanding(spark):
    asked = spark.createDataFrame([(1, " Fever? "), (2, ""), (3, "bad one")], "qid int, text string")
    got = providers.expand_questions(asked, Model(fail_on="bad", said=" fever? \n\nHot body\nhot BODY")).orderBy("qid", "variant").collect()
    assert [(r.qid, r.text) for r in got] == [(1, "Fever?"), (1, "Hot body"), (3, "bad one")]
    kinds = providers.infer_doc_types(asked, Model(fail_on="bad", said=" Clinical\n"))
    assert {r.qid: r.doc_type for r in kinds.collect()} == {1: "clinical", 2: None, 3: None}
    assert {r.doc_type for r in providers.infer_doc_types(asked, Model(said="none")).collect()} == {None}
    assert {r.qid: r.passage for r in providers.hypothetical_passages(asked, Model(fail_on="bad", said=" A text. ")).collect()} == {1: "A text.", 2: None, 3: None}


def test_retries():
    waits, calls = [], []

    def failing(*problems):
        queue = list(problems)

        def call():
            calls.append(1)
            if queue:
                raise RuntimeError(queue.pop(0))
            return "ok"

        return call

    assert providers.Retry(6, 2.0, 62.0, sleep=waits.append)(failing("boom", "429", "boom")) == "ok" and waits == [2.0, 62.0, 8.0]
    with pytest.raises(providers.QuotaExhausted):
        providers.Retry(6, sleep=waits.append)(failing("429: 1000 calls / month"))
    with pytest.raises(RuntimeError, match="boom"):
        providers.Retry(6, only_rate=True, sleep=waits.append)(failing("boom"))
    now = [0.0]
    pace = providers.Pace(30, lambda: now[0], waits.append)
    waits.clear()
    pace.wait()
    now[0] = 0.5
    pace.wait()
    assert waits == [1.5]
    slept = []
    throttle = providers.Throttle(100, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    throttle.wait(80)
    throttle.wait(50)
    throttle.wait(500)
    assert slept == [60.5, 60.5]
    r = providers.Registry(a=lambda: object())
    assert r["a"] is r["a"]
    with pytest.raises(KeyError):
        r["b"]


def test_embedding_cache(spark, tmp_path):
    cache = Store(spark, str(tmp_path / "cache"))
    df = spark.createDataFrame([(1, "neem"), (2, "neem"), (3, None), (4, " "), (5, "milk")], "id int, text string")
    got = {r.id: r.embedding for r in providers.embed(df, F.col("text"), Model(), "m", cache=cache).collect()}
    assert got[1] == got[2] == [1, 0, 0, 0, 0, 0] and got[3] is None and got[4] is None and cache.count() == 2

    class Broken:
        def embed(self, texts, kind):
            raise RuntimeError("not asked")

    again = {r.id: r.embedding for r in providers.embed(df, F.col("text"), Broken(), "m", cache=cache).collect()}
    assert again == got
    assert providers.cached_questions(df.where("id = 1"), cache, "m") == 0  # another kind of vector


def test_passages(spark):
    gold = spark.createDataFrame([(1, "s_pdf_4_P0"), (1, "afi_pdf_7_P1"), (1, "noid")], "qid int, passage string")
    on = evaluation.gold_passages(gold)
    ranked = spark.createDataFrame([(1, 1, "afi_pdf", 8, None), (1, 2, "s_pdf", 5, None), (1, 3, "afi_pdf", 7, None), (1, 4, "t", None, "noid"), (1, 5, "s_pdf", 6, "x")],
                                   "qid int, rank int, stem string, page long, parent_id string")
    assert sorted(map(tuple, evaluation.covered_passages(ranked, on).collect())) == [(1, 2, "s_pdf_4_P0"), (1, 3, "afi_pdf_7_P1"), (1, 4, "noid")]
    assert evaluation.score_passages(ranked, on, 3).first().passage_recall == pytest.approx(2 / 3)


def test_reports(spark):
    assert evaluation.estimated_calls({"rrf": ("rrf", False), "rerank": ("rerank", False), "m": ("rerank_mmr", False), "h": ("rerank", True)}, 30, 10) == {
        "query_embed": 20, "rerank": 150, "candidate_embed": 30, "passage_embed": 90, "total": 290, "completions": 90}
    assert evaluation.consistency_error(46827, 46826, True, True) is None and "builds" in evaluation.consistency_error(100, 200, True, True)
    assert "lack" in evaluation.consistency_error(10, 10, False, True)
    old = spark.createDataFrame([(["s_1", "afi_1"], ["afi_2"])], "o array<string>, n array<string>")
    assert old.select(evaluation.replaced_gold(F.col("o"), F.col("n"), "afi")).first()[0] == ["s_1", "afi_2"]
    runs = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("b", 0.25), ("c", None)], "config string, hit double")
    assert {r.config: r.hit for r in evaluation.run_ranges(runs, ("hit",)).collect()} == {"a": "0.750 (0.500–1.000)", "b": "0.250", "c": "n/a"}


def test_stores(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s")).ensure("chunk_id string, n int")
    assert s.count() == 0
    s.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, n int"), "chunk_id")
    s.upsert(spark.createDataFrame([("a", 3)], "chunk_id string, n int"), "chunk_id")
    assert sorted(map(tuple, s.read().collect())) == [("a", 3), ("b", 2)]
    t = Store(spark, str(tmp_path / "t"))
    assert s.promote(t) == 2 and t.count() == 2
    rows = spark.createDataFrame([("c", [1.0], "x" * 5000, None, ["p", None], 3, {"k": 1}), ("d", None, "y", "z", None, 4, None)],
                                 "chunk_id string, embedding array<double>, text string, work string, path array<string>, page int, extra map<string,int>")
    got = stores.vector_rows(rows).collect()
    assert len(got) == 1 and json.loads(got[0].metadata) == {"text": "x" * 4000, "path": ["p"], "page": 3, "extra": '{"k":1}'}
    path = str(tmp_path / "items.json")
    sources.write_document(spark, path, json.dumps([{"id": "q1", "question": "?", "gold_works": ["W"], "gold_passages": None}]))
    items = sources.read_dataset(spark, path)
    assert sources.gold_works(items).collect()[0].work == "W" and sources.gold_passage_ids(items).count() == 0
    assert len(sources.labels_digest(spark, path)) == 64
    bad = str(tmp_path / "bad.json")
    sources.write_dictionary(spark, bad, {"a": {}})
    with pytest.raises(ValueError):
        sources.read_dataset(spark, bad)
    for name in ("after_1", "after_2", "before_1"):
        (tmp_path / name).mkdir()
    assert sources.latest_phase(spark, str(tmp_path), "after").endswith("after_2") and sources.latest_phase(spark, str(tmp_path), "none") is None
