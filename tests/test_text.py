import pyarrow as pa
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import glued
from lodestrata.operators.metadata import PHARMACOPOEIA_LETTERS


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_glyphs(spark):
    api, afi, ss, ah, ch = "Ayurvedic Pharmacopoeia of India", "Ayurvedic Formulary of India", "Sushruta Samhita", "Ashtanga Hridaya", "Charaka Samhita"
    rows = [("KaraµjaÀ 5 µm ƒÊg 105°C L°hita", api), ("24 £. x £ 5£", afi), ("V£yu our­\n selves £5 £Bc £bc a£", ss), ("V£yu", ah), ("V£yu x­ y", ch), ("V£yu", None), (None, api)]
    got = one(spark, rows, "t string, n string", T.fix_glyphs(F.col("t"), F.col("n"), PHARMACOPOEIA_LETTERS))
    assert got == ["Karañjaṣ 5 µm µg 105°C Lohita", "24 g. x £ 5g", "Vāyu ourselves £5 £Bc ābc aā", "Vāyu", "V£yu x­ y", "V£yu", None]


def test_title_case(spark):
    rows = [("KAISORA GUGGULU",), ("PROPERTIES AND ACTION",), ("THE Book of (RT) x",), ("AND OF",), ("  a  B ",)]
    assert one(spark, rows, "t string", T.title_case(F.col("t"))) == ["Kaisora Guggulu", "Properties and Action", "The Book of (Rt) x", "And of", "a B"]


part = glued.Splitter.part
COMMON = tuple("the of and to a in is for on with as that it was by from be this are which alleviate patient should medicine fever cure taken water milk honey drink".split())


def test_splitter():
    s = glued.Splitter({"haemoptysis": 4, "kakolyadi": 3, "indivara": 5, "vata": 60, "hem": 3, "rag": 3}, COMMON)
    assert s.split("shouldbetakenwithwater") == "should be taken with water"
    assert s.split("theKakolyadi") == "the Kakolyadi"
    assert s.split("patient fever") == "patient fever" and s.split("haemoptysis") == "haemoptysis"
    assert s.split("Xyzzyqwrtpl") == "Xyzzyqwrtpl"
    assert s.split("Indivaraand") == "Indivara and"
    assert s.split("alleviatehemrag") == "alleviate hemrag" and s.split("alleviatexqzjkwv") == "alleviatexqzjkwv"
    assert s.split(None) is None and s.split("Ā shortrun") == "A shortrun"


def test_matching_text(spark):
    good = "the patient should drink water with honey and milk for the fever " * 4
    rows = [("a", good), ("b", "thepatientshoulddrinkwater withhoneyandmilk forthefeverofpatient"), ("c", None)]
    docs = spark.createDataFrame(rows, "source string, text string")
    ratio = {r.source: r.ratio for r in glued.glued_ratio(docs).collect()}
    assert ratio["a"] == 0 and ratio["b"] == 1.0
    words = {r.word: r.n for r in glued.protected_words(docs, extra=["Winter-Cherry", "ab"]).collect()}
    assert words["patient"] == 4 and words["winter"] == 3 and words["cherry"] == 3 and "ab" not in words and not any(len(w) > 14 for w in words)
    got = {r.source: r.bm25_text for r in glued.with_matching_text(docs, ranked=COMMON).collect()}
    assert got["a"] == good and got["b"].split()[:5] == "the patient should drink water".split() and got["c"] is None


def test_words_of_a_large_source_stay_in_place(spark):
    good = "the patient should drink water with honey and milk for the fever " * 4
    docs = spark.createDataFrame([("a", good), ("b", "thepatientshoulddrinkwater withhoneyandmilk patient"), (None, good)], "source string, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = glued.protected_words(docs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert {r.word: r.n for r in got.collect()}["patient"] == 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "hashpartitioning(source" not in plan


def test_most_frequent(spark, monkeypatch):
    monkeypatch.setattr(glued, "SORTED_WORDS", 2)
    rows = [("a" * i, 3) for i in range(1, 9)] + [(w, 3) for w in "abcde abcdf abcdfg abcdh b baa".split()] + [("top", 9), ("next", 4), ("other", 4)]
    words = spark.createDataFrame(rows, "word string, n long")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for most in range(len(rows) + 2):
        assert sorted(map(tuple, glued.most_frequent(words, most).collect())) == sorted(order[:most])
    plan = glued.most_frequent(words, 12)._jdf.queryExecution().optimizedPlan().toString()
    assert "abcd" in plan  # only words that begin so are sorted


def test_parted_runs_across_batches(spark, monkeypatch):
    # A task parts a run once, not once a batch; runs that are short and of one case aren't looked at.
    s, asked = glued.Splitter({"vata": 60, "honey": 9}, COMMON), []
    monkeypatch.setattr(glued.Splitter, "part", lambda self, run: (asked.append(run), part(self, run))[1])
    texts = [["shouldbetakenwithwater and milk", None], ["shouldbetakenwithwater", "theVata waterā"]]
    got = [b.to_pylist() for b in s.column().func(iter(map(pa.array, texts)))]
    assert asked == ["shouldbetakenwithwater", "the", "Vata"]
    assert got == [["should be taken with water and milk", None], ["should be taken with water", "the Vata watera"]]
