"""From a folder of files to parents, children and postings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import chunking, glued, headers, lexicon, metadata, retrieval
from lodestrata.sources import files as sources
from lodestrata.sources.stores import Store


@dataclass
class Corpus:
    parents: DataFrame
    children: DataFrame
    stats: DataFrame


def build_corpus(spark: SparkSession, root: str, max_files: int | None = None, max_pages: int | None = None, pdf: sources.PageParser | None = None) -> Corpus:
    """Nothing is written. stats: files, excluded files, records and children of each source."""
    listed = sources.list_files(spark, root)
    records = sources.records_of(listed, pdf, max_pages)
    if max_files is not None:
        records = sources.first_files(records, max_files)
    records = metadata.enrich(metadata.repair(records))
    chunks = chunking.chunk_pages(records)
    found = headers.decided(headers.marks(records))
    places = chunks.select(F.col("chunk_id").alias("id"), "source", "page", F.col("middle").alias("off"))
    placed = headers.headers_at(found, places).select(F.col("id").alias("chunk_id"), F.nullif("context_header", F.lit("")).alias("context_header"))
    chunks = chunks.drop("middle").join(placed, "chunk_id", "left")
    about = records.select("source", "page", "doc_type", "text_name", "sthana", "chapter", "citation").dropDuplicates(["source", "page"])
    known = about.select(F.col("source").alias("_s"), F.col("page").cast("long").alias("_p"), *about.columns[2:])
    full = chunks.join(known, F.col("source").eqNullSafe(F.col("_s")) & F.col("page").eqNullSafe(F.col("_p")), "left").drop("_s", "_p")
    parents = full.select(F.col("parent_id").alias("chunk_id"), F.col("parent_text").alias("text"), *[c for c in full.columns if c not in ("parent_id", "parent_text", "chunk_id", "text", "context_header")], F.lit(True).alias("is_parent"))
    stats = listed.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count("reason").alias("excluded")).join(
        records.groupBy("source").agg(F.count(F.lit(1)).alias("records")), "source", "left").join(
        chunks.groupBy("source").agg(F.count(F.lit(1)).alias("children")), "source", "left").na.fill(0)
    return Corpus(parents.dropDuplicates(["chunk_id"]), full.drop("parent_text").withColumn("is_parent", F.lit(False)), stats)


def run_ingestion(spark: SparkSession, root: str, out: str, skip_existing: bool = True, names: lexicon.Lexicon | None = None, split_glued: bool = True, **kwargs) -> dict[str, int]:
    """Rows in each store after it. Children that are there already stay as they are.

    Keywords are matched against texts with glued words parted, unless split_glued is off; with names, by its tokens.
    """
    corpus = build_corpus(spark, root, **kwargs)
    parents, children = (Store(spark, f"{out}/{n}") for n in ("parents", "children"))
    new = children.missing(corpus.children, "chunk_id") if skip_existing else corpus.children
    counts = {"parents": parents.upsert(corpus.parents, "chunk_id"), "children": children.upsert(new, "chunk_id")}
    kept = children.read()
    extra = sorted(v for group in names.exact.values() for v in group) if names else ()
    matched = glued.with_matching_text(kept, extra) if split_glued else kept.withColumn("bm25_text", F.col("text"))
    index = retrieval.Index.build(matched, "chunk_id", F.col("bm25_text"), names.tokens() if names else None).save(f"{out}/index")
    return {**counts, "indexed": index.docs.count(), "terms": index.terms.count()}
