"""Questions with their gold labels, runs and their traces, and the documents that reports go to."""

from __future__ import annotations

import json
import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = (
    "id string, question string, gold_answer string, gold_works array<string>, gold_passages array<string>, "
    "gold_chapters array<struct<source: string, chapter: string, first_page: int, last_page: int>>, category string, difficulty string, "
    "provenance struct<method: string, criteria_version: string, labeled_on: string, source_commit: string, "
    "supporting_chunk_ids: array<string>, reviewed_by: string>"
)
CANDIDATE = "chunk_id: string, parent_id: string, work: string, source: string, text_name: string, page: double, score: double, retrievers: array<string>"
QUESTION = (
    "id string, question string, gold_works array<string>, gold_passages array<string>, config string, scored_stage string, scored_n int, "
    f"rerank_skipped boolean, hyde_passage string, stages map<string, array<struct<{CANDIDATE}>>>"
)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The items of a JSON list, with qid; ValueError if the file holds anything else."""
    text = spark.read.text(path, wholetext=True)
    if text.where(F.col("value").rlike(r"^\s*\[")).isEmpty():
        raise ValueError(f"{path} isn't a list of items")
    return text.select(F.explode(F.from_json("value", f"array<struct<{ITEM}>>")).alias("x")).select("x.*").withColumn("qid", F.col("id"))


def labels_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of the file's bytes, lowercase hex."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def gold_works(items: DataFrame) -> DataFrame:
    """qid, work."""
    return items.select("qid", F.explode("gold_works").alias("work")).distinct()


def gold_passage_ids(items: DataFrame) -> DataFrame:
    """qid, passage; supporting chunks aren't gold."""
    return items.select("qid", F.explode("gold_passages").alias("passage")).distinct()


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files and folders that match, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or ())


def trace_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The .jsonl files of folders in order, and files as they are given."""
    return [f for p in paths for f in ([p] if p.endswith(".jsonl") else list_files(spark, f"{p.rstrip('/')}/*.jsonl"))]


def read_runs(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Runs (file, config, pipeline, k, status) and their questions (file, config, and QUESTION), of any number of traces."""
    lines = spark.read.text(trace_files(spark, paths)).where(F.length(F.trim("value")) > 0).withColumn("file", F.col("_metadata.file_name"))
    kind = F.get_json_object("value", "$.type")
    field = lambda k: F.get_json_object("value", f"$.{k}")
    runs = lines.where(kind == "run").select("file", field("config.name").alias("config"), field("config.pipeline").alias("pipeline"), field("config.k").cast("int").alias("k"), field("status").alias("status"))
    asked = lines.where(kind == "question").select("file", F.from_json("value", QUESTION).alias("q")).select("file", "q.*")
    return runs, asked


def candidates_of(questions: DataFrame) -> DataFrame:
    """qid, stage, scored_stage, scored_n, rank from 1, and the candidate's columns, of traced questions."""
    keep = [c for c in ("file", "config") if c in questions.columns]
    stages = questions.select(*keep, F.col("id").alias("qid"), "scored_stage", "scored_n", F.explode("stages").alias("stage", "list"))
    return stages.select(*keep, "qid", "scored_stage", "scored_n", "stage", F.posexplode("list").alias("pos", "c")).select(
        *keep, "qid", "stage", "scored_stage", "scored_n", (F.col("pos") + 1).alias("rank"), "c.*")


def latest_phase(spark: SparkSession, root: str, phase: str) -> str | None:
    """The last of the folders named phase_..., by name."""
    found = list_files(spark, f"{root.rstrip('/')}/{phase}_*")
    return found[-1] if found else None


def rebuilt_pages(parents: DataFrame, joint: str = " ") -> DataFrame:
    """source, page, text, parts (id, begin, stop): pages put together again from their parents (chunk_id, source, page, text)."""
    no = F.regexp_extract("chunk_id", r"_P(\d+)$", 1).cast("int")
    pages = parents.groupBy("source", F.coalesce("page", F.lit(0)).alias("page")).agg(F.array_sort(F.collect_list(F.struct(no.alias("no"), F.col("chunk_id").alias("id"), "text"))).alias("p"))
    ends = F.aggregate("p", F.array().cast("array<struct<id: string, begin: int, stop: int>>"), lambda acc, x: F.concat(acc, F.array(_placed(acc, x, len(joint)))))
    return pages.select("source", "page", F.array_join(F.transform("p", lambda x: x["text"]), joint).alias("text"), ends.alias("parts"))


def _placed(done: Column, part: Column, gap: int) -> Column:
    begin = F.when(F.size(done) == 0, 0).otherwise(F.coalesce(F.element_at(done, -1)["stop"], F.lit(0)) + gap)
    return F.struct(part["id"].alias("id"), begin.cast("int").alias("begin"), (begin + F.length(part["text"])).cast("int").alias("stop"))


def write_document(spark: SparkSession, path: str, text: str) -> str:
    """A small document, a report or the results of a run, as one file at path, which mustn't be there."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


def results_path(spark: SparkSession, folder: str, config: str, now: datetime | None = None) -> str:
    """folder/eval_time_config.json, numbered from 2 where that or its trace is taken."""
    stem = f"{folder.rstrip('/')}/eval_{now or datetime.now():%Y%m%d_%H%M%S}_{re.sub(r'[^A-Za-z0-9+_.-]', '_', config)}"
    n, path = 1, f"{stem}.json"
    while list_files(spark, path) or list_files(spark, f"{path}l"):
        n += 1
        path = f"{stem}_{n}.json"
    return path


def write_dictionary(spark: SparkSession, path: str, entries: dict[str, dict]) -> str:
    """A dictionary of names, as read_dictionary reads it."""
    return write_document(spark, path, json.dumps(entries, ensure_ascii=False, indent=2, sort_keys=False) + "\n")
