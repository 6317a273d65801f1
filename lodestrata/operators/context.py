"""From hits to cited context and checked answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import strip

DISCLAIMER = "Consult a qualified practitioner before use."
METAL_WARNING = "Preparations of metals or minerals need expert preparation and supervision."
# Fixed values that results depend on: what marks a sentence as a safety note, and what a text on metals.
METALS = ("rasa shastra", "bhasma", "parad", "mercury")
RISK_WORDS = ("contraindicat", "caution", "avoid", "pregnan", "toxic", "interact", "overdose", "side effect", "adverse")


def expand_to_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """hits: qid, rank, id, parent_id, text; parents: parent_id, parent_text. The first hit of each parent, with the parent's text.

    Hits without a parent stay, each by itself. The hit's own text is retrieval_text.
    """
    found = hits.join(parents.withColumn("known", F.lit(True)), "parent_id", "left")
    first = F.row_number().over(W.partitionBy("qid", "parent_id").orderBy("rank", "id"))
    return found.withColumn("n", first).where("known is null or n = 1").select(
        "qid", "rank", F.when(F.col("known"), F.col("parent_id")).otherwise(F.col("id")).alias("id"), "parent_id",
        F.coalesce("parent_text", "text").alias("text"), F.col("text").alias("retrieval_text"))


def chunk_no(chunk_id: Column) -> Column:
    return F.coalesce(F.when(chunk_id.rlike(r"_[PC]\d+$"), F.regexp_extract(chunk_id, r"_[PC](\d+)$", 1).cast("int")), F.lit(0))


def reading_order(chunks: DataFrame) -> DataFrame:
    """place from 1 by source, page and number in the page; equals keep their rank's order."""
    order = [F.coalesce("source", F.lit("")), F.coalesce("page", F.lit(0)), chunk_no(F.col("id")), F.col("rank")]
    return chunks.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(*order)).cast("int"))


def build_context(chunks: DataFrame) -> DataFrame:
    """chunks: qid, place, document, page, section, text. qid, context: numbered sources joined by a rule."""
    block = F.concat(F.lit("【Source "), F.col("place"), F.lit("】\nDocument: "), F.coalesce(F.nullif("document", F.lit("")), F.lit("Unknown")), F.lit("\nPage: "),
                     F.coalesce(F.col("page").cast("string"), F.lit("None")), F.lit("\nSection: "), F.coalesce(F.nullif("section", F.lit("")), F.lit("—")), F.lit("\nContent:\n"), "text")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("b")))), lambda x: x["b"])
    return chunks.groupBy("qid").agg(F.array_join(parts, "\n---\n").alias("context"))


def verify_citations(answers: DataFrame) -> DataFrame:
    """answers: answer, n_sources. Adds cleaned, used, hallucinated: markers of no source go, the numbers are sorted and distinct."""
    numbers = F.transform(F.regexp_extract_all("answer", F.lit(r"【(\d+)】"), F.lit(1)), lambda x: x.cast("int"))
    valid = lambda n: (n >= 1) & (n <= F.col("n_sources"))
    marks = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"【\d+】"), F.lit(0)))
    bad = F.filter(marks, lambda m: ~valid(F.regexp_extract(m, r"(\d+)", 1).cast("int")))
    return answers.withColumns({
        "used": F.array_sort(F.array_distinct(F.filter(numbers, valid))),
        "hallucinated": F.array_sort(F.array_distinct(F.filter(numbers, lambda n: ~valid(n)))),
        "cleaned": F.aggregate(bad, F.col("answer"), lambda acc, m: F.replace(acc, m, F.lit(""))),
    })


def citation_accuracy(used: Column, hallucinated: Column) -> Column:
    total = F.size(used) + F.size(hallucinated)
    return F.when(total == 0, 1.0).otherwise(F.size(used) / total)


def risk_sentences(text: Column, words: tuple[str, ...] = RISK_WORDS) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(s), w)))


def has_disclaimer(answer: Column) -> Column:
    return F.contains(F.lower(answer), F.lit("qualified")) & F.contains(F.lower(answer), F.lit("practitioner"))


def with_disclaimer(answer: Column) -> Column:
    return F.when(has_disclaimer(answer), answer).otherwise(F.concat(answer, F.lit("\n\n" + DISCLAIMER)))


def parent_store(parents: DataFrame, order: str | None = None) -> DataFrame:
    """parent_id, parent_text of parents (chunk_id, text): those with an id, of repeated ids the last in order."""
    named = parents.where("chunk_id is not null")
    last = F.max_by("text", order) if order else F.max("text")
    return named.groupBy(F.col("chunk_id").alias("parent_id")).agg(last.alias("parent_text"))


def parents_of(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """qid, rank, parent_id, parent_text: the bare parents of hits, each once, by the rank of its first hit."""
    return hits.groupBy("qid", "parent_id").agg(F.min("rank").alias("rank")).join(parents, "parent_id").select("qid", "rank", "parent_id", "parent_text")


def mentioned(texts: DataFrame, names: DataFrame) -> DataFrame:
    """texts: id, text; names: entry, name (lower case, of one or several words). id, entry: whole words, in any case.

    Names are found by an equi-join on their first word; only those of several words are then looked for in the text.
    """
    low = texts.select("id", F.lower("text").alias("low"))
    words = low.select("id", "low", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(r"(?U)\w+"), F.lit(0)))).alias("word"))
    known = names.withColumn("word", F.regexp_extract("name", r"(?U)\w+", 0)).where("word <> ''")
    met = words.join(known, "word")
    whole = F.col("name") == F.col("word")
    pattern = F.concat(F.lit(r"(?Us)\b\Q"), F.col("name"), F.lit(r"\E\b"))
    return met.where(whole | F.regexp_like("low", pattern)).select("id", "entry").distinct()


def herb_notes(mentions: DataFrame, passages: DataFrame, names: DataFrame, most_herbs: int = 6, most_chars: int = 220) -> DataFrame:
    """qid, place, entry, note: of each herb the first sentence about a risk that names it.

    mentions: qid, entry, place (its place in the dictionary); passages: qid, entry, rank, text, what was found on the
    herb; names: entry, name. An answer's first most_herbs herbs are looked up; a sentence serves one herb of an answer,
    so the next herb takes its own next. An answer has few herbs and passages, so they fit one group.
    """
    first = mentions.withColumn("_n", F.row_number().over(W.partitionBy("qid").orderBy("place"))).where(F.col("_n") <= most_herbs)
    called = names.groupBy("entry").agg(F.collect_set("name").alias("names"))
    sentences = passages.select("qid", "entry", "rank", F.posexplode(risk_sentences(F.col("text"))).alias("pos", "sentence"))
    sentences = sentences.withColumn("sentence", strip(F.col("sentence"))).join(called, "entry")
    naming = sentences.where(F.exists("names", lambda n: F.contains(F.lower("sentence"), n)))
    found = first.join(naming, ["qid", "entry"]).select("qid", "place", "entry", "rank", "pos", "sentence")

    def run(pdf):
        seen, rows = set(), []
        for (place, entry), own in pdf.sort_values(["place", "rank", "pos"]).groupby(["place", "entry"], sort=False):
            for s in own["sentence"]:
                if (plain := " ".join(s.lower().split())) not in seen:
                    seen.add(plain)
                    rows.append((own["qid"].iloc[0], place, entry, s if len(s) <= most_chars else s[:most_chars].rstrip() + "…"))
                    break
        return pd.DataFrame(rows, columns=["qid", "place", "entry", "note"])

    kinds = dict(found.dtypes)
    return found.groupBy("qid").applyInPandas(run, f"qid {kinds['qid']}, place {kinds['place']}, entry string, note string")


def with_safety(answers: DataFrame, notes: DataFrame, warning: str = METAL_WARNING, disclaimer: str = DISCLAIMER) -> DataFrame:
    """answers: qid, answer, documents (names of the sources); notes: qid, place, entry, note. answer gets its notes and the disclaimer."""
    lines = notes.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry", "note"))),
                                                 lambda x: F.concat(F.lit("- "), x["entry"], F.lit(": "), x["note"])).alias("_lines"))
    said = F.lower(F.concat_ws(" ", F.col("answer"), F.col("documents")))
    metal = F.lit(False)
    for word in METALS:
        metal = metal | F.contains(said, F.lit(word))
    every = F.concat(F.coalesce("_lines", F.array().cast("array<string>")), F.when(metal, F.array(F.lit(f"- {warning}"))).otherwise(F.array().cast("array<string>")))
    noted = F.when(F.size(every) > 0, F.concat(F.col("answer"), F.lit("\n\nSafety Notes:\n"), F.array_join(every, "\n"))).otherwise(F.col("answer"))
    joined = answers.join(lines, "qid", "left").withColumn("answer", noted).drop("_lines")
    return joined.withColumn("answer", F.when(F.contains("answer", F.lit(disclaimer)), F.col("answer")).otherwise(F.concat("answer", F.lit(f"\n\n{disclaimer}"))))
