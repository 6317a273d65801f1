import json
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestrata.operators import metadata
from lodestrata.plans import ingest
from lodestrata.sources import files, stores
from lodestrata.streaming.ingest import stream_chunks


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "raw"
    (root / "clinical").mkdir(parents=True)
    (root / "classical_texts").mkdir()
    (root / "clinical/a.txt").write_text("Some  text,\r\nlong enough to stay.\n" * 60)
    (root / "clinical/b.HTML").write_text("<p>Seen &amp; kept in the text</p><script>no()</script><style>no</style>")
    (root / "clinical/short.md").write_text("too short")
    (root / "clinical/c.xyz").write_text("an unknown kind of file, not read")
    (root / "clinical/bad.docx").write_bytes(b"no archive at all, though long enough")
    (root / "classical_texts/charaka_vol1.txt").write_text("left out by its name, whatever it says")
    with zipfile.ZipFile(root / "clinical/d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
                   "<w:p><w:r><w:t>First part </w:t></w:r><w:r><w:t>of it</w:t></w:r></w:p><w:p><w:r><w:t>Second one</w:t></w:r></w:p></w:body></w:document>")
    (root / "clinical/e.pdf").write_bytes(b"one page that is long enough\fanother page, long enough too\fthird page, long enough too")
    return str(root)


def test_scan(spark, folder):
    def pdf(content, most):
        return content.decode().split("\f")

    got = {(r.source, r.page): r for r in files.records_of(files.list_files(spark, folder), pdf, 2).collect()}
    assert set(got) == {("a.txt", None), ("b.HTML", None), ("d.docx", None), ("e.pdf", 1), ("e.pdf", 2)}
    assert got["b.HTML", None].text == "Seen & kept in the text" and got["d.docx", None].text == "First part of it\nSecond one"
    assert {r.doc_type for r in got.values()} == {"clinical"} and "\r" not in got["a.txt", None].text


def test_corpus_and_stores(spark, folder, tmp_path):
    corpus = ingest.build_corpus(spark, folder)
    stats = {r.source: r for r in corpus.stats.collect()}
    assert stats["charaka_vol1.txt"].excluded == 1 and stats["charaka_vol1.txt"].records == 0 and stats["a.txt"].children > 2
    parents = {r.chunk_id for r in corpus.parents.collect()}
    assert {r.parent_id for r in corpus.children.collect()} == parents
    first = ingest.run_ingestion(spark, folder, f"file://{tmp_path}/out")
    assert first == ingest.run_ingestion(spark, folder, f"file://{tmp_path}/out")
    store = stores.Store(spark, f"file://{tmp_path}/out/children")
    n = store.read().where("source = 'a.txt'").count()
    assert store.delete_source("a.txt") == first["children"] - n
    with pytest.raises(ValueError):
        store.write(store.read().limit(1), at_least=5)
    with pytest.raises(FileNotFoundError):
        stores.Store(spark, f"file://{tmp_path}/none").read()


def test_enrich(spark):
    rows = [("sushruta_1.pdf", "classical_text", 3, "SUTRASTHANAM\nChapter XIV of it"), ("api_v1.pdf", "pharmacopoeia", 2, "DOSE\nRasa : Madhura \nGu¸a: Laghu"), ("x", "clinical", 1, "plain")]
    got = metadata.enrich(metadata.repair(spark.createDataFrame(rows, "source string, doc_type string, page int, text string"))).collect()
    assert got[0].sthana == "Sutrasthana" and got[0].chapter == "14" and got[0].citation == "Sushruta Samhita, Sutrasthana, Chapter 14, p. 3"
    assert got[1].is_monograph and got[1].rasa == "Madhura" and got[1].guna == "Laghu" and got[2].citation is None


def test_trace(spark, tmp_path):
    path = f"file://{tmp_path}/t.jsonl"
    run = spark.createDataFrame([("c", 2)], "config string, n_questions int")
    questions = spark.createDataFrame([("q2", ["b"]), ("q1", ["a"])], "id string, gold_works array<string>")
    stores.write_trace(run, questions, path)
    lines = [json.loads(x) for p in (tmp_path / "t.jsonl").glob("part-*") for x in p.read_text().splitlines()]
    assert [x["type"] for x in lines] == ["run", "question", "question"]
    got = stores.read_trace(spark, path, "id string, gold_works array<string>").collect()
    assert [(r.id, r.gold_works) for r in got] == [("q1", ["a"]), ("q2", ["b"])]


def test_stream(spark, tmp_path):
    rows = [("s", 1, "word " * 300), ("s", 2, "other text " * 20)]
    spark.createDataFrame(rows, "source string, page int, text string").write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        stream_chunks(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/store", f"file://{tmp_path}/check").awaitTermination(120)
    got = stores.Store(spark, f"file://{tmp_path}/store").read()
    assert got.count() == got.select("chunk_id").distinct().count() > 3


def test_command_line(spark, folder, tmp_path):
    from lodestrata.__main__ import main, run

    out = f"file://{tmp_path}/out"
    assert "| clinical | " in run(spark, ["catalog", folder])
    assert "| a.txt |" in run(spark, ["ingest", folder, out, "--dry-run"])
    counts = json.loads(run(spark, ["ingest", folder, out]))
    assert counts["children"] == counts["indexed"] > 3 and counts["terms"] > 5
    said = run(spark, ["search", out, "kept", "unheard"])
    assert "Document: b.HTML" in said and "Seen & kept in the text" in said and said.rstrip().endswith("Nothing found.")
    (tmp_path / "set.json").write_text(json.dumps([{"id": "q1", "question": "seen and kept", "gold_works": ["b.HTML"], "gold_passages": ["b_HTML_P0"]}, {"id": "q2", "question": "nowhere", "gold_works": ["x"]}]))
    got = json.loads(run(spark, ["evaluate", out, str(tmp_path / "set.json"), "--results", f"{tmp_path}/runs"]))
    assert got["status"] == "VALID" and got["n_questions"] == 2 and got["recall"] == 0.5 and got["passage_recall"] == 1.0
    said = run(spark, ["rescore", f"{tmp_path}/runs", "--labels", str(tmp_path / "set.json"), "--per-question"])
    assert "| rrf | 0.500 |" in said and "| q1 | 1 |" in said
    with pytest.raises(SystemExit):
        main(["ingest"])


def test_folder_rules(spark, folder):
    listed = files.list_files(spark, folder)
    assert {r.doc_type: r.files for r in files.catalog(listed).collect()} == {"clinical": 6, "classical_text": 1}
    two = files.first_files(files.records_of(listed), 2)
    assert {r.source for r in two.collect()} == {"a.txt", "b.HTML"}
    names = spark.createDataFrame([("Charaka_1.pdf",), ("ashtanga_hridaya_srikantha_murthy_2.pdf",), ("Ashtanga_Hridaya_sanskrit_commentaries.txt",), ("sushruta.pdf",)], "s string")
    assert [r[0] for r in names.select(files.excluded_reason(F.col("s"))).collect()] == ["exclude_charaka", "exclude_ah_srikantha_murthy", "exclude_ah_sanskrit_commentaries", None]
