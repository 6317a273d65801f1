"""Retrieval and passage metrics, aggregation, rescoring of traces, and comparison of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import content_words, overlap, work_key
from lodestrata.functions.words import PROXY_STOPWORDS
from lodestrata.operators.context import citation_accuracy, has_disclaimer, verify_citations

# Fixed value that results depend on: works of which only the passage's own page counts.
EXACT_WORKS = ("Ayurvedic Formulary of India",)


def score_retrieval(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """ranked: qid, rank from 1, work; gold: qid, work. qid, recall, precision, mrr, hit, first_rank within the first k.

    Recall counts works once, precision counts every hit; questions without gold have recall 0.
    """
    g = gold.distinct()
    n_gold = g.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"))
    flagged = ranked.where(F.col("rank") <= k).join(g.withColumn("relevant", F.lit(1)), ["qid", "work"], "left")
    per = flagged.groupBy("qid").agg(
        F.count_distinct(F.when(F.col("relevant") == 1, F.col("work"))).alias("found"),
        F.avg(F.coalesce("relevant", F.lit(0)).cast("double")).alias("precision"),
        F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first_rank"))
    return per.join(n_gold, "qid", "left").select(
        "qid", F.coalesce(F.col("found") / F.col("n_gold"), F.lit(0.0)).alias("recall"), "precision", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("found") > 0, 1.0).otherwise(0.0).alias("hit"), "first_rank")


def support_of(passage: Column) -> Column:
    """stem, page of a parent's id (stem_page_Pn); null if it isn't one."""
    page = F.regexp_extract(passage, r"(?s)^(.+)_(\d+)_P\d+$", 2)
    return F.when(page != "", F.struct(F.regexp_extract(passage, r"(?s)^(.+)_(\d+)_P\d+$", 1).alias("stem"), page.try_cast("long").alias("page")))


def parent_of(chunk_id: Column, parent_id: Column) -> Column:
    """The parent of a chunk: the one it names, else that in its own id."""
    own = F.when(chunk_id.rlike(r"_C\d+$"), F.regexp_replace(chunk_id, r"_C\d+$", ""))
    return F.coalesce(F.nullif(parent_id, F.lit("")), own)


def gold_passages(gold: DataFrame) -> DataFrame:
    """gold: qid, passage, where a passage is a parent's id. Adds stem, page, and work, which sets how near a page must be."""
    found = gold.withColumn("_s", support_of(F.col("passage")))
    return found.select("qid", "passage", "_s.stem", "_s.page", work_key(F.col("_s.stem")).alias("work"))


def covered_passages(ranked: DataFrame, gold: DataFrame, allowed: int = 1) -> DataFrame:
    """ranked: qid, rank, stem, page, parent_id; gold: qid, passage, stem, page, and work if known. qid, rank, passage.

    A hit covers a passage that is its parent, or whose page in the same file is allowed pages away at most; of works
    in EXACT_WORKS, whose neighbouring pages treat other things, the page itself. A gold page is looked up at each page
    that covers it, so the join is by equality.
    """
    reach = F.when(F.col("work").isin(*EXACT_WORKS), 0).otherwise(allowed) if "work" in gold.columns else F.lit(allowed)
    near = gold.where("page is not null").withColumn("page", F.explode(F.sequence(F.col("page") - reach, F.col("page") + reach)))
    by_page = ranked.join(near.select("qid", "stem", "page", "passage"), ["qid", "stem", "page"]).select("qid", "rank", "passage")
    same = ranked.select("qid", "rank", F.col("parent_id").alias("passage")).join(gold.select("qid", "passage").distinct(), ["qid", "passage"]).select("qid", "rank", "passage")
    return by_page.unionByName(same).distinct()


def score_passages(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """qid, passage_hit, passage_recall, passage_mrr, first_rank: questions with gold passages only."""
    hits = covered_passages(ranked.where(F.col("rank") <= k), gold)
    n = gold.groupBy("qid").agg(F.count_distinct("passage").alias("n"))
    per = hits.groupBy("qid").agg(F.count_distinct("passage").alias("found"), F.min("rank").alias("first_rank"))
    return n.join(per, "qid", "left").select(
        "qid", F.when(F.col("found") > 0, 1.0).otherwise(0.0).alias("passage_hit"), (F.coalesce("found", F.lit(0)) / F.col("n")).alias("passage_recall"),
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("passage_mrr"), "first_rank")


def score_generation(answers: DataFrame) -> DataFrame:
    """answers: answer, question, context, n_sources. Adds citation_accuracy, hallucinated, grounding, relevance, has_disclaimer."""
    checked = verify_citations(answers)
    words = {c: content_words(F.col(c), PROXY_STOPWORDS) for c in ("answer", "question", "context")}
    return checked.select(
        *answers.columns, citation_accuracy(F.col("used"), F.col("hallucinated")).alias("citation_accuracy"), F.size("hallucinated").alias("hallucinated"),
        overlap(words["answer"], words["context"]).alias("grounding"), overlap(words["question"], words["answer"]).alias("relevance"),
        has_disclaimer(F.col("answer")).alias("has_disclaimer"))


def summary(per_question: DataFrame, metrics: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Means over the rows that have a value, to 4 places."""
    return per_question.groupBy(*by).agg(F.count(F.lit(1)).alias("n_questions"), *[F.round(F.avg(F.col(m).cast("double")), 4).alias(m) for m in metrics])


def rank_pivot(first_ranks: DataFrame, configs: list[str]) -> DataFrame:
    """first_ranks: qid, config, first_rank. A column a config; - where nothing was found."""
    cell = F.first(F.coalesce(F.col("first_rank").cast("string"), F.lit("-")))
    return first_ranks.groupBy("qid").pivot("config", configs).agg(cell)


def compare_marks(first_ranks: DataFrame, a: str, b: str) -> DataFrame:
    """qid, mark: + where b is ahead of a, - behind, = alike, . where neither found anything."""
    side = lambda c: F.min(F.when(F.col("config") == c, F.col("first_rank")))
    both = first_ranks.groupBy("qid").agg(side(a).alias("ra"), side(b).alias("rb"))
    ahead = F.coalesce("rb", F.lit(2**31 - 1)) < F.coalesce("ra", F.lit(2**31 - 1))
    return both.select("qid", F.when(F.col("ra").isNull() & F.col("rb").isNull(), ".").when(F.col("ra").eqNullSafe(F.col("rb")), "=").when(ahead, "+").otherwise("-").alias("mark"))


def rescore(traces: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """traces: qid, stage, scored_stage, scored_n, rank, work. The metrics from a trace alone, against any labels.

    Questions without labels are left out; missing_labels lists them.
    """
    traces = traces.join(labels.select("qid").distinct(), "qid", "left_semi")
    scored = traces.where((F.col("stage") == F.col("scored_stage")) & (F.col("rank") <= F.col("scored_n"))).select("qid", "rank", "work")
    return score_retrieval(scored, labels, k)


def carry_forward(marks: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """The label in effect at each row: the last one that isn't null, the empty one included."""
    return marks.withColumn("in_effect", F.last(label, ignorenulls=True).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def missing_labels(traces: DataFrame, labels: DataFrame) -> DataFrame:
    return traces.select("qid").distinct().join(labels, "qid", "left_anti")


def run_ranges(runs: DataFrame, metrics: tuple[str, ...], by: str = "config") -> DataFrame:
    """runs: by, and a column a metric, one row a run. Each metric as text: its mean, and its range where there are several runs."""
    three = lambda c: F.format_string("%.3f", c.cast("double"))

    def cell(m: str) -> Column:
        mean, low, high = three(F.avg(m)), three(F.min(m)), three(F.max(m))
        return F.when(F.count(m) == 0, "n/a").when(F.count(m) == 1, mean).otherwise(F.concat(mean, F.lit(" ("), low, F.lit("–"), high, F.lit(")"))).alias(m)

    return runs.groupBy(by).agg(*[cell(m) for m in metrics])


def rank_cells(first_ranks: DataFrame, configs: list[str]) -> DataFrame:
    """first_ranks: qid, config, run, first_rank. A column a config with the ranks of its runs: 1/3/-."""
    ranks = F.array_sort(F.collect_list(F.struct("run", F.coalesce(F.col("first_rank").cast("string"), F.lit("-")).alias("r"))))
    return first_ranks.groupBy("qid").pivot("config", configs).agg(F.array_join(F.transform(ranks, lambda x: x["r"]), "/"))


def mark_tally(marks: DataFrame) -> DataFrame:
    """mark, n."""
    return marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n"))


def mode_of(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value, n: the most frequent value of each key, of equals the one seen first in order."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("first"))).alias("m")).select(key, f"m.{value}", "m.n")


def chapter_gold(cited: DataFrame, chapter_parents: DataFrame, most_pages: int = 25, single_topic: DataFrame | None = None) -> DataFrame:
    """cited: qid, source, chapter; chapter_parents: source, chapter, parent_id, page. Adds first_page, last_page, too_long to each parent.

    A chapter of over most_pages pages is too long to be gold as a whole, unless single_topic (source, chapter) has it.
    """
    on = ["source", "chapter"]
    spans = chapter_parents.groupBy(*on).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    long = F.col("last_page") - F.col("first_page") + 1 > most_pages
    if single_topic is not None:
        spans = spans.join(single_topic.select(*on).distinct().withColumn("_one", F.lit(True)), on, "left")
        long = long & F.col("_one").isNull()
    return cited.distinct().join(spans.withColumn("too_long", long), on).join(chapter_parents, on).select("qid", *on, "parent_id", "page", "first_page", "last_page", "too_long")


def replaced_gold(old: Column, new: Column, prefix: str) -> Column:
    """The gold passages without those of one prefix, and the new ones after them."""
    return F.concat(F.filter(old, lambda p: ~F.startswith(p, F.lit(prefix))), new)


def estimated_calls(configs: dict[str, tuple[str, bool]], n_questions: int, n_cached: int, hypothetical_runs: int = 3) -> dict[str, int]:
    """Provider calls that a comparison takes. configs: name to pipeline and whether it searches hypothetical passages."""
    runs = {name: hypothetical_runs if h else 1 for name, (_, h) in configs.items()}
    per = lambda test: sum(runs[name] for name, c in configs.items() if test(*c)) * n_questions
    calls = {
        "query_embed": max(0, n_questions - n_cached), "rerank": per(lambda p, h: p != "rrf"),
        "candidate_embed": sum(p == "rerank_mmr" for p, _ in configs.values()) * n_questions, "passage_embed": per(lambda p, h: h),
    }
    return {**calls, "total": sum(calls.values()), "completions": per(lambda p, h: h)}


def consistency_error(n_vectors: int, n_chunks: int, has_headers: bool, wants_headers: bool, tolerance: float = 0.005) -> str | None:
    """Why stores aren't of one build, or not of the build that is wanted; None if they are."""
    if abs(n_vectors - n_chunks) > tolerance * max(n_chunks, 1):
        return f"{n_vectors} vectors and {n_chunks} chunks are of different builds"
    return None if has_headers == wants_headers else f"the chunks {'have' if has_headers else 'lack'} context headers"
