"""From questions to ranked lists, context, answers, scores and traces: all questions in one job."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import sanitize_id, work_key
from lodestrata.operators import context, evaluation, providers, retrieval
from lodestrata.session import saved
from lodestrata.sources import evaluation as sources
from lodestrata.sources.stores import Store

# Fixed values that results depend on: how deep each list is, and which list each pipeline is scored by.
DEPTH, RERANKED, CHOSEN = 50, 15, 6
SCORED_STAGE = {"rrf": "fused", "rerank": "rerank", "rerank_mmr": "mmr"}
METRICS = ("recall", "precision", "mrr", "hit", "passage_hit", "passage_recall", "passage_mrr")


@dataclass
class Engine:
    """What questions are put to. chunks: id, text, parent_id, source, page, text_name, citation, sthana, heading_path,
    context_header, doc_type, embedding (missing ones are null); parents: parent_id, parent_text."""

    index: retrieval.Index
    chunks: DataFrame
    parents: DataFrame
    model: object | None = None  # embeds, reranks, completes
    model_name: str = "model"
    tokenize: retrieval.Tokenizer | None = None


def open_engine(spark: SparkSession, out: str, model: object | None = None, model_name: str = "model", tokenize: retrieval.Tokenizer | None = None) -> Engine:
    """What plans.ingest.run_ingestion left in out. With a model, chunks are embedded, each once for all time."""
    children, parents = (Store(spark, f"{out}/{n}").read() for n in ("children", "parents"))
    nothing = {c: F.lit(None).cast(t) for c, t in (("heading_path", "array<string>"), ("context_header", "string"), ("citation", "string"), ("sthana", "string"), ("embedding", "array<double>"))
               if c not in children.columns}
    chunks = children.withColumnRenamed("chunk_id", "id").withColumns(nothing)
    if model is not None:
        text = providers.contextual_text(F.col("text"), F.col("context_header"))
        chunks = providers.embed(chunks.drop("embedding"), text, model, model_name, cache=Store(spark, f"{out}/vectors"))
    return Engine(retrieval.Index.load(spark, f"{out}/index"), chunks, context.parent_store(parents), model, model_name, tokenize)


@dataclass
class Retrieved:
    """lists: qid, stage, rank from 1, id, score, retrievers; skipped: qid; hypothetical: qid, passage."""

    lists: DataFrame
    scored_stage: str
    skipped: DataFrame
    hypothetical: DataFrame | None


def question_vectors(engine: Engine, asked: DataFrame, kind: str) -> DataFrame:
    """qid, q, of asked: qid, text."""
    got = providers.embed(asked, F.col("text"), engine.model, engine.model_name, kind)
    return got.where("embedding is not null").select("qid", F.col("embedding").alias("q"))


def semantic(engine: Engine, asked: DataFrame, hypothetical: DataFrame | None = None, doc_types: DataFrame | None = None, n: int = DEPTH) -> DataFrame:
    """qid, rank, id, score: the nearest chunks to any of a question's variants (qid, variant, text) and passages (qid, passage).

    doc_types: qid, doc_type; a question with one finds chunks of that kind only.
    """
    own = question_vectors(engine, asked.select(F.struct("qid", "variant").alias("qid"), "text"), "search_query")
    if hypothetical is not None:
        passages = hypothetical.where("passage is not null").select(F.struct("qid", F.lit(2**30).alias("variant")).alias("qid"), F.col("passage").alias("text"))
        own = own.unionByName(question_vectors(engine, passages, "search_document"))
    vectors = engine.chunks.where("embedding is not null").select("id", F.col("embedding").alias("v"), F.xxhash64("doc_type").alias("kind"))
    keyed = own.select(F.to_json("qid").alias("qid"), "q", F.col("qid.qid").alias("of"), F.col("qid.variant").alias("variant"))
    if doc_types is None:
        hits = retrieval.cosine_topk(vectors, keyed, n)
    else:
        typed = keyed.join(doc_types.select(F.col("qid").alias("of"), "doc_type"), "of", "left")
        narrow = typed.where("doc_type is not null").withColumn("want", F.xxhash64("doc_type"))
        hits = retrieval.cosine_topk(vectors, typed.where("doc_type is null"), n).unionByName(retrieval.cosine_topk(vectors, narrow, n, filtered=True))
    named = hits.join(keyed.select("qid", "of", "variant"), "qid").select(F.col("of").alias("qid"), "variant", "rank", "id", "score")
    return retrieval.best_of_variants(named, n)


def keyword(engine: Engine, asked: DataFrame, n: int = DEPTH) -> DataFrame:
    """qid, rank, id, score, over a question's variants; blank ones find nothing."""
    key = asked.select(F.to_json(F.struct("qid", "variant")).alias("key"), "qid", "variant", "text")
    hits = engine.index.search(key, "key", n, engine.tokenize).withColumnRenamed("qid", "key").join(key.select("key", "qid", "variant"), "key")
    return retrieval.best_of_variants(hits.select("qid", "variant", "rank", "id", "score"), n)


def retrieve(engine: Engine, questions: DataFrame, pipeline: str = "rerank", k: int = CHOSEN, use_hypothetical: bool = False, need_context: bool = True,
             expand: bool = False, infer_types: bool = False) -> Retrieved:
    """questions: qid, text. Without a model the keyword list alone is fused, and reranking leaves the order as it is."""
    if pipeline not in SCORED_STAGE:
        raise ValueError(f"pipeline must be one of {tuple(SCORED_STAGE)}, not {pipeline!r}")
    asked = questions.select("qid", F.lit(0).alias("variant"), "text")
    if expand and engine.model is not None:
        asked = saved(providers.expand_questions(questions, engine.model), "variants")
    passages = saved(providers.hypothetical_passages(questions, engine.model), "hypothetical") if use_hypothetical else None
    found = [keyword(engine, asked).select("qid", F.lit(1).alias("list_no"), F.col("rank").alias("pos"), "id", F.lit("keyword").alias("retriever"))]
    if engine.model is not None:
        types = saved(providers.infer_doc_types(questions, engine.model), "types") if infer_types else None
        near = semantic(engine, asked, passages, types)
        found.append(near.select("qid", F.lit(0).alias("list_no"), F.col("rank").alias("pos"), "id", F.lit("semantic").alias("retriever")))
    lists = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    fused = saved(retrieval.reciprocal_rank_fusion(lists).withColumn("rank", F.col("rank") + 1), "fused")
    stage = lambda df, name, score: df.select("qid", F.lit(name).alias("stage"), F.col("rank").cast("int").alias("rank"), "id", score.cast("double").alias("score"),
                                              (F.col("retrievers") if name == "fused" else F.lit(None).cast("array<string>")).alias("retrievers"))
    stages = [stage(fused, "fused", F.col("score"))]
    known = engine.chunks.select("id", "text", "context_header", "embedding")
    skipped = questions.select("qid").limit(0)
    if pipeline == "rrf":
        ranked = fused.where(F.col("rank") <= RERANKED).select("qid", "id", "rank", F.lit(None).cast("double").alias("rerank_score"))
    else:
        texts = fused.select("qid", "id", "rank").join(known, "id").join(questions.select("qid", F.col("text").alias("question")), "qid")
        texts = texts.select("qid", "question", "id", "rank", providers.contextual_text(F.col("text"), F.col("context_header")).alias("text"))
        if engine.model is None:
            ranked = texts.where(F.col("rank") <= RERANKED).select("qid", "id", "rank", F.lit(None).cast("double").alias("rerank_score"))
        else:
            ranked = saved(providers.rerank(texts, engine.model, RERANKED), "ranked")
            skipped = ranked.where("skipped").select("qid").distinct()
        stages.append(stage(ranked, "rerank", F.col("rerank_score")))
    if pipeline == "rerank_mmr" or need_context:
        vectors = ranked.join(known.select("id", F.col("embedding").alias("v")), "id")
        if engine.model is None:
            chosen = ranked.where(F.col("rank") <= k).select("qid", "rank", "id")
        else:
            own = question_vectors(engine, questions, "search_query")
            chosen = retrieval.diverse(vectors.join(own, "qid", "left"), k=k)
        stages.append(stage(chosen.join(ranked.select("qid", "id", "rerank_score"), ["qid", "id"]), "mmr", F.col("rerank_score")))
    every = stages[0]
    for s in stages[1:]:
        every = every.unionByName(s)
    return Retrieved(saved(every, "lists"), SCORED_STAGE[pipeline], skipped, passages)


def contexts(engine: Engine, got: Retrieved) -> tuple[DataFrame, DataFrame]:
    """qid, context; and the sources it numbers: qid, place, document, page."""
    hits = got.lists.where("stage = 'mmr'").select("qid", "rank", "id").join(engine.chunks, "id")
    whole = context.expand_to_parents(hits.select("qid", "rank", "id", "parent_id", "text"), engine.parents)
    about = engine.chunks.groupBy("parent_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("source", "page", "text_name", "citation", "sthana", "heading_path")])
    ordered = context.reading_order(whole.join(about, "parent_id", "left"))
    document = F.coalesce("citation", "text_name", "source")
    section = F.coalesce(F.nullif(F.array_join(F.col("heading_path"), " > "), F.lit("")), "sthana")
    numbered = ordered.select("qid", "place", document.alias("document"), "page", section.alias("section"), "text")
    return context.build_context(numbered), numbered.select("qid", "place", "document", "page")


def traced(engine: Engine, items: DataFrame, got: Retrieved, config: str) -> DataFrame:
    """The questions of a trace, as sources.evaluation reads them."""
    about = engine.chunks.select("id", F.col("id").alias("chunk_id"), F.coalesce("parent_id", evaluation.parent_of(F.col("id"), F.lit(None).cast("string"))).alias("parent_id"),
                                 work_key(F.coalesce("text_name", "source")).alias("work"), "source", "text_name", F.col("page").cast("double").alias("page"))
    full = got.lists.join(about, "id")
    one = F.struct("chunk_id", "parent_id", "work", "source", "text_name", "page", "score", "retrievers")
    per_stage = full.groupBy("qid", "stage").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("c")))), lambda x: x["c"]).alias("list"))
    nested = per_stage.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("stage", "list"))).alias("stages"))
    flags = items.join(nested, "qid", "left").join(got.skipped.withColumn("_s", F.lit(True)), "qid", "left")
    if got.hypothetical is not None:
        flags = flags.join(got.hypothetical, "qid", "left")
    scored = F.coalesce(F.size(F.element_at("stages", got.scored_stage)), F.lit(0))
    return flags.select(
        F.col("qid").cast("string").alias("id"), "question", "gold_works", F.coalesce("gold_passages", F.array().cast("array<string>")).alias("gold_passages"), F.lit(config).alias("config"),
        F.lit(got.scored_stage).alias("scored_stage"), F.greatest(scored, F.lit(0)).alias("scored_n"), F.coalesce("_s", F.lit(False)).alias("rerank_skipped"),
        (F.col("passage") if got.hypothetical is not None else F.lit(None).cast("string")).alias("hyde_passage"), "stages")


def rescored(questions: DataFrame, works: DataFrame, passages: DataFrame | None, k: int) -> DataFrame:
    """qid, METRICS, first_gold_rank, first_passage_rank: the metrics of traced questions against any labels (qid, work) and (qid, passage)."""
    listed = sources.candidates_of(questions).withColumn("stem", sanitize_id(F.coalesce("source", F.lit(""))))
    scored = listed.where((F.col("stage") == F.col("scored_stage")) & (F.col("rank") <= F.col("scored_n")))
    gold = works.select("qid", work_key(F.col("work")).alias("work")).distinct()
    per = evaluation.rescore(listed.select("qid", "stage", "scored_stage", "scored_n", "rank", "work"), gold, k).drop("first_rank")
    first = scored.join(gold, ["qid", "work"]).groupBy("qid").agg(F.min("rank").alias("first_gold_rank"))
    out = questions.select(F.col("id").alias("qid")).distinct().join(gold.select("qid").distinct(), "qid").join(per, "qid", "left").join(first, "qid", "left").na.fill(0.0, ["recall", "precision", "mrr", "hit"])
    if passages is None:
        return out.withColumns({m: F.lit(None).cast("double") for m in METRICS[4:]} | {"first_passage_rank": F.lit(None).cast("int")})
    on = evaluation.gold_passages(passages)
    ranked = scored.select("qid", "rank", "stem", F.col("page").cast("long").alias("page"), "parent_id")
    near = evaluation.score_passages(ranked, on, k).drop("first_rank")
    first = evaluation.covered_passages(ranked, on).groupBy("qid").agg(F.min("rank").alias("first_passage_rank"))
    return out.join(near, "qid", "left").join(first, "qid", "left")


@dataclass
class Run:
    status: str  # INVALID if a question's reranking was skipped
    summary: dict
    per_question: DataFrame
    questions: DataFrame


def run_evaluation(spark: SparkSession, engine: Engine, items: DataFrame, mode: str = "both", pipeline: str = "rerank", k: int = CHOSEN, use_hypothetical: bool = False,
                   judge: bool = False, config: str | None = None, out: str | None = None, labels_file: str | None = None) -> Run:
    """Evaluates items (qid, question, gold_answer, gold_works, gold_passages). mode: retrieval, generation or both.

    With out, the results and the trace are written there. A question whose answer or judgement fails has null metrics.
    """
    if mode not in ("retrieval", "generation", "both"):
        raise ValueError(f"no mode {mode!r}")
    config = config or pipeline + ("+hyde" if use_hypothetical else "")
    asked = items.select("qid", F.col("question").alias("text"))
    got = retrieve(engine, asked, pipeline, k, use_hypothetical, need_context=mode != "retrieval")
    questions = saved(traced(engine, items, got, config), "traced")
    ids = items.select(F.col("qid").cast("string").alias("qid"), F.col("qid").alias("_q"))
    per = ids.drop("_q")
    columns: list[str] = []
    if mode != "generation":
        text = items.withColumn("qid", F.col("qid").cast("string"))
        per = per.join(rescored(questions, sources.gold_works(text), sources.gold_passage_ids(text), k), "qid", "left")
        columns += METRICS
    if mode != "retrieval":
        block, numbered = contexts(engine, got)
        counted = numbered.groupBy("qid").agg(F.count(F.lit(1)).cast("int").alias("n_sources"))
        prompts = items.select("qid", "question", "gold_answer").join(block, "qid").join(counted, "qid")
        answers = saved(providers.generate_answers(prompts, engine.model), "answers")
        checked = context.verify_citations(answers.where("failure is null").drop("prompt", "failure"))
        # Metrics are of the checked answer, in which markers of no source are gone.
        good = checked.withColumn("answer", F.col("cleaned")).select("qid", "question", "gold_answer", "context", "n_sources", "answer")
        scored = evaluation.score_generation(good)
        per = per.join(scored.select(F.col("qid").cast("string").alias("qid"), "answer", "citation_accuracy", "hallucinated", "grounding", "relevance", "has_disclaimer"), "qid", "left")
        columns += ["citation_accuracy", "hallucinated", "grounding", "relevance", "has_disclaimer"]
        if judge:
            judged = providers.judge_answers(good, engine.model)
            per = per.join(judged.select(F.col("qid").cast("string").alias("qid"), *[F.col(f"scores.{m}").alias(f"judge_{m}") for m in ("faithfulness", "relevance", "completeness")]), "qid", "left")
            columns += ["judge_faithfulness", "judge_relevance", "judge_completeness"]
    per = saved(per, "scores")
    n_skipped = got.skipped.count()
    summary = {**evaluation.summary(per, tuple(columns)).first().asDict(), "rerank_skips": n_skipped}
    run = Run("INVALID" if n_skipped else "VALID", summary, per, questions)
    if out is not None:
        path = sources.results_path(spark, out, config)
        head = {"timestamp": datetime.now().isoformat(timespec="seconds"), "config": {"name": config, "pipeline": pipeline, "use_hyde": use_hypothetical, "mode": mode, "k": k, "judge": judge},
                "labels_file": labels_file, "labels_sha256": sources.labels_digest(spark, labels_file) if labels_file else None, "n_questions": summary["n_questions"], "status": run.status, "summary": summary}
        rows = [json.loads(r[0]) for r in per.orderBy("qid").select(F.to_json(F.struct(*per.columns))).collect()]  # a row a question
        lines = [r[0] for r in questions.orderBy("id").select(F.to_json(F.struct(F.lit("question").alias("type"), *questions.columns))).collect()]
        sources.write_document(spark, f"{path}l", "".join(f"{x}\n" for x in (json.dumps({"type": "run", **head}, ensure_ascii=False, default=str), *lines)))
        sources.write_document(spark, path, json.dumps({**head, "results": rows}, ensure_ascii=False, indent=2, default=str))
    return run


def report(spark: SparkSession, phases: dict[str, list[str]], works: DataFrame, passages: DataFrame | None = None, k: int = CHOSEN,
           comparisons: tuple[tuple[str, str], ...] = ()) -> tuple[DataFrame, DataFrame, dict[tuple[str, str], DataFrame]]:
    """phases: label prefix ('' for the current one) to its traces. Ranges of the metrics a config, rank cells a question, and marks a comparison."""
    parts, ranks = [], []
    for prefix, paths in phases.items():
        for no, path in enumerate(sources.trace_files(spark, paths)):
            runs, asked = sources.read_runs(spark, [path])
            meta = runs.first()
            label = f"{prefix}:{meta['config']}" if prefix else meta["config"]
            per = saved(rescored(asked, works, passages, k), "rescored")
            parts.append(evaluation.summary(per, METRICS).withColumn("config", F.lit(label)))
            ranks.append(per.select("qid", F.lit(label).alias("config"), F.lit(no).alias("run"), F.col("first_gold_rank").alias("first_rank")))
    if not parts:
        raise ValueError("no traces")
    summaries, firsts = parts[0], ranks[0]
    for p, r in zip(parts[1:], ranks[1:], strict=True):
        summaries, firsts = summaries.unionByName(p), firsts.unionByName(r)
    labels = sorted(r["config"] for r in summaries.select("config").distinct().collect())  # a label a config
    marks = {(a, b): evaluation.compare_marks(firsts, a, b) for a, b in comparisons if {a, b} <= set(labels)}
    return evaluation.run_ranges(summaries, METRICS), evaluation.rank_cells(firsts, labels), marks


def markdown(df: DataFrame, order: str) -> str:
    """A small table as Markdown."""
    rows = df.orderBy(order).collect()
    lines = [df.columns, ["---"] * len(df.columns), *[["" if x is None else str(x) for x in r] for r in rows]]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines) + "\n"
