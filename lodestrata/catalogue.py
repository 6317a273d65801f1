"""All queries of the library by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions.words import PROXY_STOPWORDS, fold_diacritics, stems
from lodestrata.operators import chunking, context, evaluation, glued, lexicon, providers, retrieval
from lodestrata.session import table
from lodestrata.sources import evaluation as runs
from lodestrata.sources import files
from lodestrata.sources import stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Tokens, postings and BM25 scores of documents for the questions of benchmark, as SQL.
BM25_SQL = """
t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents),
p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM t),
n AS (SELECT count(*) AS n, avg(len(t)) AS avg_dl FROM t WHERE len(t) > 0),
s AS (SELECT token, count(*) AS df, ln(any_value(n.n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, n GROUP BY token),
i AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM s) ELSE raw END AS idf FROM s),
q AS (SELECT item_id AS qid, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM benchmark),
c AS (SELECT qid, doc_id, round(sum(idf) * (2.5 / (1 + 1.5 * (0.25 + 0.75 * any_value(dl) / any_value(avg_dl)))), 9) AS score FROM q JOIN p USING (token) JOIN i USING (token), n
      GROUP BY qid, doc_id HAVING score > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM c)
"""


_INDEXES: dict[tuple[str, str], retrieval.Index] = {}


def _index(spark: SparkSession, sf_dir: str) -> retrieval.Index:
    """The keyword index of documents, built once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = retrieval.Index.build(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return _INDEXES[key]


def _bm25(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return _index(spark, sf_dir).search(table(spark, sf_dir, "benchmark"), "item_id", n)


@query(f"WITH {BM25_SQL} SELECT qid, doc_id AS id, round(score, 6) AS score, rank FROM r WHERE rank <= 6")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 6).withColumn("score", F.round("score", 6))


@query("""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents)
SELECT doc_id AS id, len(t)::INT AS dl, unnest(t) AS token FROM t""")
def token_postings(spark, sf_dir):
    return retrieval.postings(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query(f"WITH {BM25_SQL} SELECT token, df, round(idf, 6) AS idf FROM s JOIN i USING (token)")
def term_stats_idf(spark, sf_dir):
    return _index(spark, sf_dir).terms.withColumn("idf", F.round("idf", 6))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\x{A0}]+', ' ', 'g'),
  '(?m)^ +| +$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM documents""")
def whitespace_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@query("SELECT doc_id, length(trim(text, ' ' || chr(10)))::INT AS n FROM documents WHERE length(trim(text, ' ' || chr(10))) >= 20")
def min_length_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("n", F.length(T.strip(F.col("text"))))
    return docs.where(F.col("n") >= T.MIN_RECORD_CHARS).select("doc_id", "n")


@query("""SELECT page_id, CASE WHEN list_contains(string_split(lower(url), '/'), 'clinical') THEN 'clinical' WHEN list_contains(string_split(lower(url), '/'), 'formulations')
THEN 'formulation' ELSE 'unknown' END AS doc_type, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM pages""")
def doc_type_case(spark, sf_dir):
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    return table(spark, sf_dir, "pages").select("page_id", T.doc_type_of(F.col("url")).alias("doc_type"), host.alias("host"))


_WORK_CASES = " ".join(f"WHEN {' OR '.join(f'contains(lower(s), {w!r})' for w in words)} THEN '{title}'" for title, words in T.WORKS)
_WORK_EXACT = " ".join(f"WHEN lower(s) = '{title.lower()}' THEN '{title}'" for title, _ in T.WORKS)


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || '_api_v1.pdf' WHEN doc_id % 3 = 1 THEN 'Madhava Nidana' ELSE source END AS s FROM documents)
SELECT doc_id, CASE {_WORK_CASES} END AS text_name, coalesce(CASE {_WORK_CASES} {_WORK_EXACT} END, lower(s), '') AS work FROM d""")
def work_key_case(spark, sf_dir):
    named = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("_api_v1.pdf"))).when(F.col("doc_id") % 3 == 1, "Madhava Nidana").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", T.text_name_of(named).alias("text_name"), T.work_key(named).alias("work"))


@query("""WITH RECURSIVE w AS (SELECT DISTINCT upper(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS s FROM documents),
m AS (SELECT * FROM w WHERE regexp_full_match(s, '[IVXLCDM]+')),
v(s, i, total, most) AS (SELECT s, length(s), 0, 0 FROM m UNION ALL
  SELECT s, i - 1, total + CASE WHEN d < most THEN -d ELSE d END, greatest(most, d)
  FROM (SELECT *, CASE s[i] WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 ELSE 1000 END AS d FROM v WHERE i > 0))
SELECT s AS token, total::INT AS value FROM v WHERE i = 0 AND total <> 0""")
def roman_to_int(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("token"))
    words = words.select(F.upper("token").alias("token")).distinct().withColumn("value", T.roman_to_int(F.col("token")))
    return words.where("value is not null")


@query(r"""SELECT doc_id, list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^[A-Z][A-Z0-9 ,.&()/''-]{2,48}$')), 1, 5) AS headings,
  list_sort(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: upper(trim(x))), lambda x: x IN ('DOSE', 'SYNONYMS', 'DESCRIPTION')))) AS sections FROM documents""")
def headings_and_sections(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.headings(F.col("text")).alias("headings"), F.array_sort(T.monograph_sections(F.col("text"))).alias("sections"))


_ROMAN_SQL = "token"
for _old, _new in T.ROMANIZED:
    _ROMAN_SQL = f"replace({_ROMAN_SQL}, '{_old}', '{_new}')"


@query(f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents)
SELECT token, CASE WHEN regexp_full_match(token, '[A-Za-z]{{3,}}') THEN {_ROMAN_SQL} ELSE token END AS key FROM t""")
def romanization_key(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(retrieval.tokens(F.col("text"))).alias("token")).distinct()
    return words.withColumn("key", T.romanization_key(F.col("token")))


@query("""WITH r AS (SELECT source, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)
SELECT source, round(avg((length(w) >= 15)::INT), 9) AS ratio FROM r GROUP BY source""")
def glued_run_ratio(spark, sf_dir):
    return glued.glued_ratio(table(spark, sf_dir, "documents")).withColumn("ratio", F.round("ratio", 9))


@query("""WITH r AS (SELECT source, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents),
g AS (SELECT source FROM r GROUP BY source HAVING avg((length(w) >= 15)::INT) > 0.05)
SELECT lower(w) AS word, count(*) AS n FROM r WHERE source NOT IN (SELECT source FROM g) AND length(w) >= 3 AND length(w) < 15 GROUP BY 1 HAVING count(*) >= 3""")
def protected_vocab(spark, sf_dir):
    return glued.protected_words(table(spark, sf_dir, "documents"))


@query("""WITH c AS (SELECT source, unnest(string_split(text, '')) AS ch FROM documents)
SELECT source, ch, count(*) AS n FROM c WHERE unicode(ch) > 127 AND unicode(ch) NOT BETWEEN 2304 AND 2431 GROUP BY source, ch""")
def char_inventory(spark, sf_dir):
    odd = F.explode(F.regexp_extract_all("text", F.lit(r"[^\x00-\x7Fऀ-ॿ]"), F.lit(0)))
    return table(spark, sf_dir, "documents").select("source", odd.alias("ch")).groupBy("source", "ch").agg(F.count(F.lit(1)).alias("n"))


@query()
def split_text_chunks(spark, sf_dir):
    return chunking.chunk_pages(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "page"))


@query("""WITH s AS (SELECT doc_id, text, trim(regexp_replace(source || '_' || doc_id, '[^A-Za-z0-9]+', '_', 'g'), '_') AS stem FROM documents WHERE length(text) > 0),
p AS (SELECT *, unnest(range(0, ((length(text) - 1) // 450 + 1)::BIGINT)) AS i FROM s)
SELECT stem || '_P0_C' || i AS chunk_id, stem || '_P0' AS parent_id, text[(i * 450 + 1):(i * 450 + 450)] AS piece FROM p""")
def hard_split_ids(spark, sf_dir):
    stem = T.sanitize_id(F.concat_ws("_", "source", F.col("doc_id").cast("string")))
    docs = table(spark, sf_dir, "documents").where("length(text) > 0").withColumn("stem", stem)
    cut = docs.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 450).cast("int"))))
    return cut.select(F.concat("stem", F.lit("_P0_C"), "i").alias("chunk_id"), F.concat("stem", F.lit("_P0")).alias("parent_id"),
                      F.substring("text", F.col("i") * 450 + 1, F.lit(450)).alias("piece"))


@query()
def folded_stems(spark, sf_dir):
    folded = F.lower(fold_diacritics("text"))
    words = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(folded, F.lit("[a-z0-9]+"), F.lit(0))).alias("tokens"))
    return words.select("doc_id", F.array_distinct(F.concat("tokens", stems("tokens"))).alias("tokens"))


COSINE_SQL = """
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT q.vec_id AS qid, e.vec_id AS id, q.label AS want, e.label AS kind,
  round(CASE WHEN list_inner_product(e.v, e.v) * list_inner_product(q.v, q.v) = 0 THEN 0 ELSE
    list_inner_product(e.v, q.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(q.v, q.v))) END, 9) AS score
  FROM v q, v e WHERE q.vec_id % 20 = 0)
"""


def _cosine(spark, sf_dir, filtered):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("kind"))
    queries = vectors.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"), F.col("kind").alias("want"))
    return retrieval.cosine_topk(vectors, queries, 10, filtered=filtered)


@query(f"WITH {COSINE_SQL}, r AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM c) SELECT * FROM r WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    return _cosine(spark, sf_dir, False)


@query(f"WITH {COSINE_SQL}, r AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM c WHERE kind = want) SELECT * FROM r WHERE rank <= 10")
def cosine_topk_filtered(spark, sf_dir):
    return _cosine(spark, sf_dir, True)


def _two_lists(spark, sf_dir):
    v = _cosine(spark, sf_dir, False).select("qid", F.lit(0).alias("list_no"), F.col("rank").alias("pos"), "id", F.lit("semantic").alias("retriever"))
    f = _cosine(spark, sf_dir, True).select("qid", F.lit(1).alias("list_no"), F.col("rank").alias("pos"), "id", F.lit("keyword").alias("retriever"))
    return v.unionByName(f)


@query(f"""WITH {COSINE_SQL}, a AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS pos FROM c),
b AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS pos FROM c WHERE kind = want),
u AS (SELECT *, 0 AS list_no, 'semantic' AS retriever FROM a WHERE pos <= 10 UNION ALL SELECT *, 1, 'keyword' FROM b WHERE pos <= 10),
s AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + pos)), 12) AS score, min(list_no * 1000 + pos) AS first, list(retriever ORDER BY list_no) AS retrievers FROM u GROUP BY qid, id)
SELECT qid, id, score, retrievers, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) - 1)::INT AS rank FROM s""")
def rrf_fuse(spark, sf_dir):
    return retrieval.reciprocal_rank_fusion(_two_lists(spark, sf_dir))


@query()
def mmr_select(spark, sf_dir):
    near = _cosine(spark, sf_dir, False)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return retrieval.mmr(near.join(vectors, "id").select("qid", F.col("rank").alias("pos"), "id", F.col("score").alias("relevance"), "v"))


@query(f"""WITH {BM25_SQL}, h AS (SELECT qid % 20 AS g, qid AS variant, rank, doc_id, score FROM r WHERE rank <= 20),
m AS (SELECT g AS qid, doc_id AS id, max(score) AS score, min(variant * 1000 + rank) AS first FROM h GROUP BY ALL),
z AS (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY m.score DESC, first)::INT AS rank FROM m) SELECT * FROM z WHERE rank <= 20""")
def bm25_multivariant_best(spark, sf_dir):
    hits = _bm25(spark, sf_dir, 20).select((F.col("qid") % 20).alias("qid"), F.col("qid").alias("variant"), "rank", "id", "score")
    return retrieval.best_of_variants(hits, 20).withColumn("score", F.round("score", 6))


@query("""SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def existing_anti_join(spark, sf_dir):
    return stores.absent(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("""WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, event_id, value FROM e WHERE n = 1""")
def upsert_latest_wins(spark, sf_dir):
    return stores.latest_by(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id").drop("ts")


@query(f"""WITH {BM25_SQL}, e AS (SELECT qid, rank, doc_id AS id, source || ' ' || lang AS parent_id, text FROM r JOIN documents USING (doc_id) WHERE rank <= 15),
pf AS (SELECT source || ' ' || lang AS parent_id, min(doc_id) AS first FROM documents WHERE lang <> 'en' GROUP BY ALL),
pt AS (SELECT pf.parent_id, first, text AS parent_text FROM pf JOIN documents ON doc_id = first),
k AS (SELECT *, row_number() OVER (PARTITION BY qid, parent_id ORDER BY rank, id) AS n FROM e)
SELECT qid, rank, CASE WHEN pt.first IS NULL THEN k.id::VARCHAR ELSE k.parent_id END AS id, coalesce(pt.parent_text, k.text) AS text,
  k.text AS retrieval_text FROM k LEFT JOIN pt USING (parent_id) WHERE n = 1 OR pt.first IS NULL""")
def parent_expand_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("parent_id", F.concat_ws(" ", "source", "lang"))
    hits = _bm25(spark, sf_dir, 15).join(docs, F.col("id") == F.col("doc_id")).select("qid", "rank", F.col("id").cast("string").alias("id"), "parent_id", "text")
    parents = docs.where("lang <> 'en'").groupBy("parent_id").agg(F.min_by("text", "doc_id").alias("parent_text"))
    return context.expand_to_parents(hits, parents).drop("parent_id")


@query(f"""WITH {BM25_SQL}, h AS (SELECT qid, rank, doc_id AS id, source, doc_id AS page, text FROM r JOIN documents USING (doc_id) WHERE rank <= 6),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY source, page, rank) AS place FROM h)
SELECT qid, string_agg('【Source ' || place || '】' || chr(10) || 'Document: ' || source || chr(10) || 'Page: ' || page || chr(10) || 'Section: —' || chr(10) || 'Content:' || chr(10) || text,
  chr(10) || '---' || chr(10) ORDER BY place) AS context FROM o GROUP BY qid""")
def context_block(spark, sf_dir):
    hits = _bm25(spark, sf_dir, 6).join(table(spark, sf_dir, "documents"), F.col("id") == F.col("doc_id"))
    hits = hits.select("qid", "rank", F.col("id").cast("string").alias("id"), "source", F.col("doc_id").alias("page"), "text")
    return context.build_context(context.reading_order(hits).select("qid", "place", F.col("source").alias("document"), "page", F.lit(None).cast("string").alias("section"), "text"))


_ANSWER = "text || ' 【' || (conv_id % 7) || '】 and 【' || (turn + 1) || '】.'"


@query(f"""WITH a AS (SELECT conv_id, turn, {_ANSWER} AS answer FROM conversations WHERE role = 'assistant'),
m AS (SELECT *, list_transform(regexp_extract_all(answer, '【(\\d+)】', 1), lambda x: x::INT) AS n FROM a)
SELECT conv_id, turn, list_sort(list_distinct(list_filter(n, lambda x: x BETWEEN 1 AND 3))) AS used, list_sort(list_distinct(list_filter(n, lambda x: NOT x BETWEEN 1 AND 3))) AS hallucinated,
  regexp_replace(answer, '【(0|[4-9]|\\d\\d+)】', '', 'g') AS cleaned FROM m""")
def citation_verify(spark, sf_dir):
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.expr(_ANSWER).alias("answer"), F.lit(3).alias("n_sources"))
    return context.verify_citations(answers).select("conv_id", "turn", "used", "hallucinated", "cleaned")


_STOP_SQL = ", ".join(f"'{w}'" for w in PROXY_STOPWORDS)


def _content_sql(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP_SQL})))"


@query(f"""WITH q AS (SELECT conv_id, turn, {_content_sql('text')} AS w FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, {_content_sql('text')} AS w FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, round(CASE WHEN len(q.w) = 0 OR len(a.w) = 0 THEN 0 ELSE len(list_intersect(q.w, a.w)) / len(q.w) END, 9) AS relevance,
  round(CASE WHEN len(q.w) = 0 OR len(a.w) = 0 THEN 0 ELSE len(list_intersect(q.w, a.w)) / len(a.w) END, 9) AS grounding FROM q JOIN a USING (conv_id, turn)""")
def answer_proxies(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").withColumn("w", T.content_words(F.col("text"), PROXY_STOPWORDS))
    q = words.where("role = 'user'").select("conv_id", "turn", F.col("w").alias("q"))
    a = words.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("a"))
    return q.join(a, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.overlap(F.col("q"), F.col("a")), 9).alias("relevance"), F.round(T.overlap(F.col("a"), F.col("q")), 9).alias("grounding"))


EVAL_SQL = f"""{BM25_SQL}, k AS (SELECT qid, rank, source AS work FROM r JOIN documents USING (doc_id) WHERE rank <= 6),
gold AS (SELECT item_id AS qid, 'src' || (item_id % 20) AS work FROM benchmark UNION ALL SELECT item_id, 'src0' FROM benchmark WHERE item_id % 20 <> 0),
ng AS (SELECT qid, count(*) AS n FROM gold GROUP BY qid),
f AS (SELECT k.qid, k.rank, k.work, gold.work IS NOT NULL AS rel FROM k LEFT JOIN gold ON k.qid = gold.qid AND k.work = gold.work),
per AS (SELECT qid, count(DISTINCT CASE WHEN rel THEN work END) / any_value(n) AS recall, avg(rel::INT) AS precision, coalesce(1.0::DOUBLE / min(CASE WHEN rel THEN rank END), 0) AS mrr,
  max(rel::INT)::DOUBLE AS hit, min(CASE WHEN rel THEN rank END) AS first_rank FROM f JOIN ng USING (qid) GROUP BY qid)"""


def _gold(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    one = items.select("qid", F.concat(F.lit("src"), (F.col("qid") % 20).cast("string")).alias("work"))
    return one.unionByName(items.select("qid", F.lit("src0").alias("work")))


def _works(spark, sf_dir, n=6):
    return _bm25(spark, sf_dir, n).join(table(spark, sf_dir, "documents"), F.col("id") == F.col("doc_id")).select("qid", "rank", F.col("source").alias("work"))


@query(f"WITH {EVAL_SQL} SELECT qid, round(recall, 9) AS recall, round(precision, 9) AS precision, round(mrr, 9) AS mrr, hit, first_rank FROM per")
def recall_precision_mrr(spark, sf_dir):
    got = evaluation.score_retrieval(_works(spark, sf_dir), _gold(spark, sf_dir), 6)
    return got.select("qid", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "mrr")], "hit", "first_rank")


@query(f"WITH {EVAL_SQL} SELECT count(*) AS n_questions, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(mrr), 4) AS mrr, round(avg(hit), 4) AS hit FROM per")
def eval_summary(spark, sf_dir):
    return evaluation.summary(evaluation.score_retrieval(_works(spark, sf_dir), _gold(spark, sf_dir), 6), ("recall", "precision", "mrr", "hit"))


@query(f"WITH {EVAL_SQL} SELECT qid, round(recall, 9) AS recall, round(precision, 9) AS precision, round(mrr, 9) AS mrr, hit, first_rank FROM per")
def rescore_from_trace(spark, sf_dir):
    traces = _works(spark, sf_dir, 15).select("qid", F.lit("fused").alias("stage"), F.lit("fused").alias("scored_stage"), F.lit(6).alias("scored_n"), "rank", "work")
    got = evaluation.rescore(traces.unionByName(traces.withColumn("stage", F.lit("mmr"))), _gold(spark, sf_dir), 6)
    return got.select("qid", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "mrr")], "hit", "first_rank")


@query(f"""WITH {BM25_SQL}, k AS (SELECT qid, rank, doc_id, source FROM r JOIN documents USING (doc_id) WHERE rank <= 10),
gold AS (SELECT qid, source, doc_id AS page FROM k WHERE rank IN (2, 5)),
h AS (SELECT DISTINCT k.qid, rank, gold.page AS passage FROM k JOIN gold ON k.qid = gold.qid AND k.source = gold.source AND abs(k.doc_id - gold.page) <= 1),
ng AS (SELECT qid, count(DISTINCT page) AS n_gold FROM gold GROUP BY qid), pf AS (SELECT qid, count(DISTINCT passage) AS found, min(rank) AS first_rank FROM h GROUP BY qid)
SELECT qid, round(coalesce(found, 0) / n_gold, 9) AS passage_recall, round(coalesce(1.0::DOUBLE / first_rank, 0), 9) AS passage_mrr, first_rank FROM ng LEFT JOIN pf USING (qid)""")
def passage_band_join(spark, sf_dir):
    hits = _bm25(spark, sf_dir, 10).join(table(spark, sf_dir, "documents"), F.col("id") == F.col("doc_id"))
    ranked = hits.select("qid", "rank", F.col("source").alias("stem"), F.col("doc_id").alias("page"), F.lit(None).cast("string").alias("parent_id"))
    gold = ranked.where("rank in (2, 5)").select("qid", F.col("page").cast("string").alias("passage"), "stem", "page")
    got = evaluation.score_passages(ranked, gold, 10)
    return got.select("qid", F.round("passage_recall", 9).alias("passage_recall"), F.round("passage_mrr", 9).alias("passage_mrr"), "first_rank")


_FIRST_SQL = f"""{EVAL_SQL}, fr AS (SELECT qid, 'all' AS config, first_rank FROM per UNION ALL SELECT qid, 'deep', CASE WHEN first_rank > 2 THEN first_rank - 1 END FROM per)"""


def _first_ranks(spark, sf_dir):
    per = evaluation.score_retrieval(_works(spark, sf_dir), _gold(spark, sf_dir), 6)
    one = per.select("qid", F.lit("all").alias("config"), "first_rank")
    return one.unionByName(per.select("qid", F.lit("deep").alias("config"), F.when(F.col("first_rank") > 2, F.col("first_rank") - 1).alias("first_rank")))


@query(f"""WITH {_FIRST_SQL} SELECT qid, max(CASE WHEN config = 'all' THEN coalesce(first_rank::VARCHAR, '-') END) AS "all", max(CASE WHEN config = 'deep' THEN coalesce(first_rank::VARCHAR, '-') END) AS deep FROM fr GROUP BY qid""")
def first_gold_rank_pivot(spark, sf_dir):
    return evaluation.rank_pivot(_first_ranks(spark, sf_dir), ["all", "deep"])


@query(f"""WITH {_FIRST_SQL}, b AS (SELECT qid, min(CASE WHEN config = 'all' THEN first_rank END) AS a, min(CASE WHEN config = 'deep' THEN first_rank END) AS d FROM fr GROUP BY qid)
SELECT qid, CASE WHEN a IS NULL AND d IS NULL THEN '.' WHEN a IS NOT DISTINCT FROM d THEN '=' WHEN coalesce(d, 99) < coalesce(a, 99) THEN '+' ELSE '-' END AS mark FROM b""")
def compare_marks(spark, sf_dir):
    return evaluation.compare_marks(_first_ranks(spark, sf_dir), "all", "deep")


@query("""SELECT event_id, user_id, last_value(CASE event_type WHEN 'view' THEN NULL ELSE event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS in_effect FROM events""")
def carry_forward_asof(spark, sf_dir):
    marks = table(spark, sf_dir, "events").withColumn("label", F.when(F.col("event_type") != "view", F.col("event_type")))
    return evaluation.carry_forward(marks, "user_id", ["ts", "event_id"], "label").select("event_id", "user_id", "in_effect")


@query("""WITH t AS (SELECT source, doc_id AS at, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS until FROM documents WHERE doc_id % 5 = 0)
SELECT d.doc_id, t.at AS span FROM documents d JOIN t ON d.source = t.source AND d.doc_id >= t.at AND (t.until IS NULL OR d.doc_id < t.until)""")
def span_lead_containment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    marked = docs.withColumn("title", F.when(F.col("doc_id") % 5 == 0, F.col("doc_id")))
    held = evaluation.carry_forward(marked, "source", ["doc_id"], "title").where("in_effect is not null")
    return held.select("doc_id", F.col("in_effect").alias("span"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source, lang), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS k FROM c)
SELECT source, lang, n FROM r WHERE k = 1""")
def mode_per_group(spark, sf_dir):
    return evaluation.mode_of(table(spark, sf_dir, "documents"), "source", "lang", "doc_id")


@query(f"""WITH {BM25_SQL}, h AS (SELECT qid, doc_id AS id, rank AS old FROM r WHERE rank <= 20),
qt AS (SELECT item_id AS qid, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark),
z AS (SELECT qid, id, old, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_intersect(w, t.t)) / len(w) END AS score FROM h JOIN qt USING (qid) JOIN t ON t.doc_id = h.id),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, old)::INT AS rank FROM z) SELECT qid, id, round(score, 9) AS rerank_score, rank FROM k WHERE rank <= 15""")
def lexical_rerank(spark, sf_dir):
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = _bm25(spark, sf_dir, 20).select("qid", "id", "rank").join(texts, "id").join(questions, "qid")
    ranked = retrieval.rerank(hits, retrieval.lexical_rerank_score(F.col("question"), F.col("text")))
    return ranked.select("qid", "id", F.round("rerank_score", 9).alias("rerank_score"), "rank")


@query("SELECT doc_id, sha256('hashed-64|search_document|' || text) AS key FROM documents")
def embed_cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", providers.cache_key("hashed-64", "search_document", F.col("text")).alias("key"))


@query("""SELECT source, count(*) AS n, sum(length(text))::BIGINT // 4 + 1 AS tokens, ceil(count(*) / 96)::BIGINT AS calls FROM documents GROUP BY source""")
def batch_plan(spark, sf_dir):
    return providers.call_plan(table(spark, sf_dir, "documents"), "source", F.col("text"))


@query("""SELECT event_id, user_id, (sum(length(props) // 4 + 1) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW))::BIGINT AS used FROM events""")
def token_throttle_window(spark, sf_dir):
    tokens = (F.floor(F.length("props") / 4) + 1).cast("long")
    return providers.usage_window(table(spark, sf_dir, "events"), "user_id", "ts", tokens).select("event_id", "user_id", "used")


_RESPONSE = """CASE WHEN event_id % 7 = 0 THEN 'no scores' ELSE 'Scores: {"faithfulness": ' || (event_id % 11) || ', "relevance": ' ||
  CASE WHEN event_id % 5 = 0 THEN 'null' ELSE '"' || (event_id % 10) || '"' END || ', "completeness": ' || (event_id % 9) || ', "reasoning": "' || event_type || '"}' END"""


@query(f"""WITH r AS (SELECT event_id, regexp_extract({_RESPONSE}, '\\{{.*\\}}', 0) AS j FROM events),
k AS (SELECT event_id, TRY_CAST(j->>'faithfulness' AS INT) AS f, TRY_CAST(j->>'relevance' AS INT) AS r, TRY_CAST(j->>'completeness' AS INT) AS c, j->>'reasoning' AS w
  FROM (SELECT event_id, CASE WHEN j = '' THEN NULL ELSE j::JSON END AS j FROM r))
SELECT event_id, CASE WHEN f + r + c IS NOT NULL THEN f END AS faithfulness, CASE WHEN f + r + c IS NOT NULL THEN r END AS relevance,
  CASE WHEN f + r + c IS NOT NULL THEN c END AS completeness, CASE WHEN f + r + c IS NOT NULL THEN w END AS reasoning FROM k""")
def judge_json_parse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", providers.judge_scores(F.expr(_RESPONSE)).alias("s")).select("event_id", "s.*")


@query("""WITH w AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS name FROM conversations),
n AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{8,}'))) AS name FROM benchmark)
SELECT DISTINCT conv_id * 100 + turn AS id, name AS entry FROM w JOIN n USING (name)""")
def mentioned_terms(spark, sf_dir):
    low = F.lower(F.translate("text", "İ", "i"))  # its lower case is two characters to Spark and one to SQL
    plain = F.regexp_replace(low, "[^a-z0-9_]+", " ")  # words end at any other letter in the SQL; the operator takes them whole
    texts = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), plain.alias("text"))
    names = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0))).alias("n")).select(F.lower("n").alias("name")).distinct()
    return context.mentioned(texts, names.withColumn("entry", F.col("name")))


@query()
def safety_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", context.risk_sentences(F.col("text")).alias("sentences"))


@query("""SELECT count(*) AS n_documents, count(DISTINCT source) AS n_sources, sum(n_chars)::BIGINT AS n_chars, sum((length(text) < 20)::INT)::BIGINT AS n_short FROM documents""")
def corpus_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_documents"), F.count_distinct("source").alias("n_sources"), F.sum("n_chars").alias("n_chars"),
                                                 F.sum((F.length("text") < T.MIN_RECORD_CHARS).cast("long")).alias("n_short"))


@query("""WITH c AS (SELECT source, doc_id AS page, source || '_' || doc_id || '_P' || i AS id, i, text[(i * 400 + 1):(i * 400 + 400)] AS t
  FROM (SELECT *, unnest(range(0, ((length(text) - 1) // 400 + 1)::BIGINT)) AS i FROM documents WHERE length(text) > 0))
SELECT source, page, string_agg(t, ' ' ORDER BY i) AS text, max(i * 401 + length(t))::INT AS stop, count(*)::INT AS n_parts FROM c GROUP BY source, page""")
def rebuild_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("length(text) > 0")
    cut = docs.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 400).cast("int"))))
    parents = cut.select(F.concat_ws("_", "source", "doc_id", F.concat(F.lit("P"), "i")).alias("chunk_id"), "source", F.col("doc_id").alias("page"),
                         F.substring("text", F.col("i") * 400 + 1, F.lit(400)).alias("text"))
    pages = runs.rebuilt_pages(parents)
    return pages.select("source", "page", "text", F.element_at("parts", -1)["stop"].alias("stop"), F.size("parts").alias("n_parts"))


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '_pdf_' || doc_id || '_P1' WHEN 1 THEN source || '_P2' ELSE source || '_x_' || doc_id || '_P0_C3' END AS p FROM documents)
SELECT doc_id, nullif(regexp_extract(p, '^(.+)_(\\d+)_P\\d+$', 1), '') AS stem, TRY_CAST(nullif(regexp_extract(p, '^(.+)_(\\d+)_P\\d+$', 2), '') AS BIGINT) AS page,
  CASE WHEN regexp_matches(p, '_C\\d+$') THEN regexp_replace(p, '_C\\d+$', '') END AS parent FROM d""")
def support_ids(spark, sf_dir):
    p = F.when(F.col("doc_id") % 4 == 0, F.concat_ws("_", "source", F.lit("pdf"), "doc_id", F.lit("P1"))).when(F.col("doc_id") % 4 == 1, F.concat("source", F.lit("_P2"))).otherwise(
        F.concat_ws("_", "source", F.lit("x"), "doc_id", F.lit("P0_C3")))
    found = table(spark, sf_dir, "documents").select("doc_id", p.alias("p")).select("doc_id", "p", evaluation.support_of(F.col("p")).alias("s"))
    return found.select("doc_id", "s.stem", "s.page", evaluation.parent_of(F.col("p"), F.lit(None).cast("string")).alias("parent"))


@query("""WITH p AS (SELECT source, lang AS chapter, doc_id AS page FROM documents), s AS (SELECT source, chapter, min(page) AS first_page, max(page) AS last_page FROM p GROUP BY ALL),
c AS (SELECT DISTINCT item_id AS qid, 'src' || (item_id % 20) AS source, CASE WHEN item_id % 2 = 0 THEN 'fr' ELSE 'de' END AS chapter FROM benchmark)
SELECT qid, source, chapter, page::VARCHAR AS parent_id, page, first_page, last_page, last_page - first_page + 1 > 25 AND source <> 'src3' AS too_long
FROM c JOIN s USING (source, chapter) JOIN p USING (source, chapter)""")
def chapter_gold(spark, sf_dir):
    parents = table(spark, sf_dir, "documents").select("source", F.col("lang").alias("chapter"), F.col("doc_id").cast("string").alias("parent_id"), F.col("doc_id").alias("page"))
    cited = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"), F.when(F.col("item_id") % 2 == 0, "fr").otherwise("de").alias("chapter"))
    whole = parents.where("source = 'src3'").select("source", "chapter").distinct()
    return evaluation.chapter_gold(cited, parents, single_topic=whole)


@query(f"""WITH {EVAL_SQL}, rr AS (SELECT qid, qid % 2 AS config, first_rank FROM per UNION ALL SELECT qid, qid % 2, CASE WHEN first_rank > 1 THEN first_rank - 1 END FROM per)
SELECT 'c' || config AS config, CASE WHEN count(first_rank) = 1 THEN printf('%.3f', avg(first_rank)) ELSE printf('%.3f', avg(first_rank)) || ' (' || printf('%.3f', min(first_rank)::DOUBLE) || '–' || printf('%.3f', max(first_rank)::DOUBLE) || ')' END AS first_rank
FROM rr GROUP BY config HAVING count(first_rank) > 0""")
def run_ranges(spark, sf_dir):
    per = evaluation.score_retrieval(_works(spark, sf_dir), _gold(spark, sf_dir), 6).select("qid", F.concat(F.lit("c"), F.col("qid") % 2).alias("config"), "first_rank")
    earlier = per.withColumn("first_rank", F.when(F.col("first_rank") > 1, F.col("first_rank") - 1))
    return evaluation.run_ranges(per.unionByName(earlier), ("first_rank",)).where("first_rank <> 'n/a'")


@query(r"""WITH m AS (SELECT conv_id, turn, unnest([text, upper(text), text || ' again', text]) AS v, unnest([0, 1, 2, 3]) AS i FROM (SELECT conv_id, turn, trim(regexp_replace(replace(text, 'ß', 'ss'), '\s+', ' ', 'g')) AS text FROM conversations WHERE role = 'user') WHERE text <> '')
SELECT conv_id * 100 + turn AS qid, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(i)) - 1)::INT AS variant, arg_min(v, i) AS text FROM m GROUP BY conv_id, turn, lower(v)""")
def expand_questions(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("qid"), F.trim(F.regexp_replace(F.replace("text", F.lit("ß"), F.lit("ss")), r"\s+", " ")).alias("text"))
    return providers.expand_questions(asked, Echo())


class Echo:
    """A provider for tests and offline use: it rephrases a question by its own words."""

    def complete(self, prompt: str, max_tokens: int) -> str:
        question = prompt.rsplit("Question: ", 1)[-1]
        return f"{question.upper()}\n\n {question} again \n{question}"


#: A dictionary of the shape that names come in, for the driver's tables, which have none of their own.
NAMES = {
    "entry_one": {"latin": ["license", "license terms"], "english": ["licence", "permit"]},
    "entry_two": {"sanskrit": ["Ashvagandha", "Aśvagandhā"], "latin": ["Withania somnifera"], "english": ["winter cherry"]},
}


@query()
def lexicon_tokens(spark, sf_dir):
    names = lexicon.Lexicon(list(NAMES.values()))
    return table(spark, sf_dir, "documents").select("doc_id", names.tokens()(F.col("text")).alias("tokens"))


@query()
def matching_text(spark, sf_dir):
    return glued.with_matching_text(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "bm25_text")


@query()
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.page_text(F.col("html")).alias("text"))
