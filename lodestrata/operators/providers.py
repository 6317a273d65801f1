"""Models behind a provider: embedding, reranking and completion, with retries, pacing, a cache, and what to do on failure.

A provider is any picklable object with the methods it is asked for: embed(texts, kind) gives a vector a text;
rerank(question, texts, top_n) gives (index, score) pairs, best first; complete(prompt, max_tokens) gives a text. Calls
are made by the tasks that hold the rows, in batches, so what limits them is the provider; nothing passes through the
driver. Pacing and throttling hold for each task, and a budget for a whole job is to be divided by its tasks.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import FOLDERS, strip
from lodestrata.sources.stores import Store

# Fixed values that results depend on: texts a call, characters a token, waits and tries.
EMBED_BATCH = 96
CHARS_PER_TOKEN = 4
DOC_TYPES = tuple(dict.fromkeys(FOLDERS.values()))


class QuotaExhausted(RuntimeError):
    """The provider's monthly quota is used up; trying again won't help."""


def is_rate_limit(problem: object) -> bool:
    said = str(problem).lower()
    return any(x in said for x in ("429", "rate limit", "too many requests"))


def is_quota(problem: object) -> bool:
    return is_rate_limit(problem) and any(x in str(problem).lower() for x in ("/ month", "per month", "monthly"))


def estimated_tokens(texts: list[str]) -> int:
    return sum(map(len, texts)) // CHARS_PER_TOKEN + 1


@dataclass
class Retry:
    """Up to tries calls. base doubles from wait to wait; rate_wait, if given, is the wait after a rate limit.

    With only_rate, other failures aren't tried again. An exhausted quota always raises QuotaExhausted.
    """

    tries: int = 6
    base: float = 2.0
    rate_wait: float | None = None
    only_rate: bool = False
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, call: Callable[[], object]):
        for n in range(self.tries):
            try:
                return call()
            except Exception as problem:  # providers raise what they like
                if is_quota(problem):
                    raise QuotaExhausted(f"the provider's monthly quota is used up: {problem}") from problem
                if n == self.tries - 1 or self.only_rate and not is_rate_limit(problem):
                    raise
                self.sleep(self.rate_wait if self.rate_wait is not None and is_rate_limit(problem) else self.base * 2**n)
        raise ValueError("at least one try")


EMBED_RETRY = Retry(6, 2.0, 62.0)
RERANK_RETRY = Retry(6, 6.0, only_rate=True)


@dataclass
class Pace:
    """Calls of a task are 60 / per_minute seconds apart at least; 0: no limit."""

    per_minute: float = 0.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: float | None = None

    def wait(self) -> None:
        if self.per_minute > 0 and self.last is not None and (left := 60 / self.per_minute - (self.clock() - self.last)) > 0:
            self.sleep(left)
        self.last = self.clock()


@dataclass
class Throttle:
    """Tokens of a task in any 60 seconds stay within per_minute, except a call that alone exceeds it; 0: no limit."""

    per_minute: int = 0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    log: deque = field(default_factory=deque)

    def wait(self, tokens: int) -> None:
        if self.per_minute <= 0:
            return
        while True:
            now = self.clock()
            while self.log and now - self.log[0][0] > 60:
                self.log.popleft()
            if not self.log or sum(n for _, n in self.log) + tokens <= self.per_minute:
                break
            self.sleep(max(60.5 - (now - self.log[0][0]), 1.0))
        self.log.append((self.clock(), tokens))


def call_plan(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """key, n, tokens, calls: what embedding the rows of each key would take."""
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), (F.floor(F.sum(F.length(text)) / CHARS_PER_TOKEN) + 1).alias("tokens"), F.ceil(F.count(F.lit(1)) / EMBED_BATCH).alias("calls"))


def usage_window(calls: DataFrame, key: str, at: str, tokens: Column, seconds: int = 60) -> DataFrame:
    """calls with used: the tokens of their key in the seconds up to and with each call."""
    w = W.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return calls.withColumn("used", F.sum(tokens).over(w))


def cached_questions(questions: DataFrame, cache: Store, model: str) -> int:
    """How many questions (text) have a vector in the cache."""
    if not cache.exists():
        return 0
    keys = questions.select(cache_key(model, "search_query", F.col("text")).alias("key"))
    return keys.join(cache.read().select("key").distinct(), "key", "left_semi").count()


def cache_key(model: str, kind: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}|{kind}|"), text), 256)


def contextual_text(text: Column, header: Column) -> Column:
    """What is embedded and reranked: the text below its header, if it has one."""
    return F.concat_ws("\n", F.nullif(header, F.lit("")), text)


def embed(df: DataFrame, text: Column, provider, model: str, kind: str = "search_document", cache: Store | None = None,
          retry: Retry = EMBED_RETRY, tokens_per_minute: int = 0) -> DataFrame:
    """df with its texts' embeddings. Each different text is embedded once, and not at all if the cache has it.

    The cache is a Store of key, embedding; new vectors are added to it. A null or blank text has no embedding.
    """
    keyed = df.withColumn("_key", F.when(F.length(strip(text)) > 0, cache_key(model, kind, text)))
    wanted = keyed.where("_key is not null").groupBy(F.col("_key").alias("key")).agg(F.first(text).alias("text"))
    if cache is not None:
        wanted = cache.missing(wanted, "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        throttle = Throttle(tokens_per_minute)
        for b in batches:
            for at in range(0, len(b), EMBED_BATCH):
                part = b.iloc[at : at + EMBED_BATCH]
                texts = part["text"].tolist()
                throttle.wait(estimated_tokens(texts))
                vectors = retry(lambda: provider.embed(texts, kind))
                yield pd.DataFrame({"key": part["key"].to_numpy(), "embedding": [[float(x) for x in v] for v in vectors]})

    fresh = wanted.mapInPandas(run, "key string, embedding array<double>")
    if cache is not None:
        cache.upsert(fresh, "key")
        fresh = cache.read()
    found = fresh.select(F.col("key").alias("_key"), "embedding")
    return keyed.join(found, "_key", "left").drop("_key")


def completed(df: DataFrame, prompt: Column, provider, max_tokens: int, retry: Retry = Retry(1)) -> DataFrame:
    """df with response, and failure where there is none. A null prompt asks nothing."""
    schema = df.withColumn("prompt", prompt)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said, failed = [], []
            for p in b["prompt"]:
                try:
                    said.append(None if p is None else retry(lambda p=p: provider.complete(p, max_tokens)))
                    failed.append(None)
                except Exception as problem:  # one question's failure isn't another's
                    said.append(None)
                    failed.append(str(problem))
            yield b.assign(response=said, failure=failed)

    fields = ", ".join(f"`{n}` {t}" for n, t in schema.dtypes)
    return schema.mapInPandas(run, f"{fields}, response string, failure string").drop("prompt")


EXPAND = "Give three or four other ways to ask the question below, in words that reference texts on the subject use. One a line, nothing else.\n\nQuestion: "
CLASSIFY = f"Which one of these kinds of source does the question below concern: {', '.join(DOC_TYPES)}? Say none if it concerns several or no certain one. One word.\n\nQuestion: "
HYPOTHESISE = "Write a passage of 120 to 180 words, as a reference text on the subject would have it, that answers the question below. No heading, no preamble.\n\nQuestion: "
ANSWER = "Answer the question from the numbered sources alone, each statement followed by its source's mark, like 【1】. Say so if they don't answer it.\n\n"
JUDGE = "Score the answer against the reference answer from 0 to 10, as JSON with the integers faithfulness, relevance, completeness and a string reasoning.\n\n"


def _asked(intro: str, *parts: Column) -> Column:
    return F.concat(F.lit(intro), *parts)


def expand_questions(questions: DataFrame, provider) -> DataFrame:
    """qid, variant, text: the question itself first, then other phrasings, each once whatever its case; a blank question has none."""
    q = strip(F.col("text"))
    said = completed(questions.select("qid", q.alias("text")).where("text <> ''"), _asked(EXPAND, F.col("text")), provider, 300)
    lines = F.filter(F.transform(F.split(F.coalesce("response", F.lit("")), r"\R"), strip), lambda x: x != "")
    every = F.concat(F.array("text"), lines)
    lower = F.transform(every, F.lower)
    once = F.filter(every, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)
    return said.select("qid", F.posexplode(once).alias("variant", "text"))


def infer_doc_types(questions: DataFrame, provider) -> DataFrame:
    """qid, doc_type: null where the question isn't about one kind of source, or the provider fails."""
    q = strip(F.col("text"))
    said = completed(questions.select("qid", "text"), F.when(q != "", _asked(CLASSIFY, q)), provider, 20)
    label = F.lower(strip(F.col("response")))
    return said.select("qid", F.when(label.isin(*DOC_TYPES), label).alias("doc_type"))


def hypothetical_passages(questions: DataFrame, provider) -> DataFrame:
    """qid, passage: null where there is none."""
    q = strip(F.col("text"))
    said = completed(questions.select("qid", "text"), F.when(q != "", _asked(HYPOTHESISE, q)), provider, 400)
    return said.select("qid", F.nullif(strip(F.col("response")), F.lit("")).alias("passage"))


def generate_answers(asked: DataFrame, provider, max_tokens: int = 1500) -> DataFrame:
    """asked: qid, question, context. Adds answer, and failure where the provider failed."""
    prompt = _asked(ANSWER, F.col("context"), F.lit("\n\nQuestion: "), F.col("question"))
    return completed(asked, prompt, provider, max_tokens).withColumnRenamed("response", "answer")


def judge_scores(response: Column) -> Column:
    """The scores of a judge's response, null unless its JSON has all three as whole numbers."""
    body = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    value = lambda k: F.get_json_object(body, f"$.{k}").try_cast("double").cast("int")
    got = {k: value(k) for k in ("faithfulness", "relevance", "completeness")}
    whole = got["faithfulness"].isNotNull() & got["relevance"].isNotNull() & got["completeness"].isNotNull()
    return F.when(whole, F.struct(*[c.alias(k) for k, c in got.items()], F.coalesce(F.get_json_object(body, "$.reasoning"), F.lit("")).alias("reasoning")))


def judge_answers(answers: DataFrame, provider) -> DataFrame:
    """answers: question, answer, gold_answer. Adds scores, and ok; failure says why there are none."""
    prompt = _asked(JUDGE, F.lit("Question: "), F.col("question"), F.lit("\n\nReference answer: "), F.col("gold_answer"), F.lit("\n\nAnswer: "), F.col("answer"))
    said = completed(answers, prompt, provider, 300).withColumn("scores", judge_scores(F.col("response")))
    why = F.when(F.col("scores").isNull(), F.coalesce("failure", F.concat(F.lit("unparseable response: "), F.substring(F.coalesce("response", F.lit("")), 1, 200))))
    return said.withColumn("failure", why).withColumn("ok", F.col("scores").isNotNull()).drop("response")


def rerank(candidates: DataFrame, provider, top_n: int = 15, retry: Retry | None = RERANK_RETRY, calls_per_minute: float = 0.0) -> DataFrame:
    """candidates: qid, question, id, rank, text. The provider's best top_n, with rerank_score, rank from 1, and skipped.

    Where the provider fails the first top_n stay as they are, without scores; with a retry policy they are marked as
    skipped, and an exhausted quota ends the job. Without one (answering live) every failure is passed over. A question
    has few candidates, so they fit one group.
    """
    kinds = dict(candidates.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        keep = min(top_n, len(pdf))
        pace = Pace(calls_per_minute)
        question, texts = pdf["question"].iloc[0], pdf["text"].fillna("").tolist()

        def call():
            pace.wait()
            return provider.rerank(question, texts, keep)

        try:
            best = (retry or Retry(1))(call)[:keep]
            picked, scores, skipped = [i for i, _ in best], [float(s) for _, s in best], False
        except QuotaExhausted:
            if retry is not None:
                raise
            picked, scores, skipped = list(range(keep)), [None] * keep, False
        except Exception:
            picked, scores, skipped = list(range(keep)), [None] * keep, retry is not None
        out = pdf.iloc[picked]
        return pd.DataFrame({"qid": out["qid"].to_numpy(), "id": out["id"].to_numpy(), "rank": range(1, len(picked) + 1),
                             "rerank_score": pd.Series(scores, dtype="float64"), "skipped": skipped})

    return candidates.groupBy("qid").applyInPandas(run, f"qid {kinds['qid']}, id {kinds['id']}, rank int, rerank_score double, skipped boolean")


class Registry:
    """Providers by name, made on first use and kept; a missing key of the service is the factory's to report."""

    def __init__(self, **factories: Callable[[], object]) -> None:
        self.factories, self.made = factories, {}

    def __getitem__(self, name: str):
        if name not in self.made:
            if name not in self.factories:
                raise KeyError(f"no provider {name!r}")
            self.made[name] = self.factories[name]()
        return self.made[name]
