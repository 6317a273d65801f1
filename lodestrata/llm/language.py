"""Language identification with string kernels.

A text is the set of its byte n-grams, n = 1 to 3, of the lower-cased UTF-8: the blended spectrum by presence, over
the n-grams that the landmarks hold. The kernel of two texts is the cosine of their sets. Landmarks are drawn from the
training texts (Nystrom), and one-versus-rest kernel ridge regression is solved on the Nystrom features. Prediction is
three products of matrices a batch: sets x landmarks, Nystrom map, weights.

Training takes the texts with the smallest hashes of each language, max_train a language and max_chars long at most, or
the shortest texts of a language that has only longer ones; both bounds are parameters, and nothing else is sampled: every document is predicted from its whole text.

Edge cases: a text that is null or without a letter is und with score 0; so are all texts if nothing can be learned; a
null lang isn't learned from; rows that repeat are predicted alike; an empty table gives no rows; other columns are
ignored. A null id is held out or not by the hash of the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.session import table

MAX_TRAIN = 300
MAX_CHARS = 20_000
LANDMARKS = 40
RIDGE = 1e-3
SIZE = 1 << 24


def gram_codes(text: str) -> list[np.ndarray]:
    """Codes below 2**24 of the n-grams, n = 1, 2, 3; shorter ones have leading zeros."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.int32)
    two = (b[:-1] << 8) | b[1:]
    return [b, two, (two[:-1] << 8) | b[2:]]


@dataclass
class Model:
    labels: list[str]
    vocabulary: np.ndarray  # codes
    landmarks: np.ndarray  # landmarks x vocabulary, 0 or 1
    norms: np.ndarray
    weights: np.ndarray  # landmarks x labels, the Nystrom map included

    def table(self) -> np.ndarray:
        index = np.zeros(SIZE, np.int32)
        index[self.vocabulary] = np.arange(1, len(self.vocabulary) + 1)
        return index


def presence(texts: list[str], index: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(texts), width + 1), np.float32)
    for row, t in zip(out, texts, strict=True):
        for codes in gram_codes(t):
            row[index[codes]] = 1.0
    return out[:, 1:]


def kernel(sets: np.ndarray, landmarks: np.ndarray, norms: np.ndarray) -> np.ndarray:
    size = np.sqrt(sets.sum(axis=1, dtype=np.float64))
    return (sets @ landmarks.T).astype(np.float64) / np.maximum(size, 1e-9)[:, None] / norms[None, :]


def fit(texts: list[str], langs: list[str], n_landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """n_landmarks a language, the first of each in the given order."""
    labels = sorted(set(langs))
    if not labels:
        return None
    chosen = [i for label in labels for i in [j for j, x in enumerate(langs) if x == label][:n_landmarks]]
    vocabulary = np.unique(np.concatenate([c for i in chosen for c in gram_codes(texts[i])]))
    model = Model(labels, vocabulary, np.zeros(0), np.zeros(0), np.zeros(0))
    index = model.table()
    marks = presence([texts[i] for i in chosen], index, len(vocabulary))
    norms = np.maximum(np.sqrt(marks.sum(axis=1, dtype=np.float64)), 1e-9)
    values, vectors = np.linalg.eigh(kernel(marks, marks, norms))
    good = values > 1e-8 * values.max()
    to_features = vectors[:, good] / np.sqrt(values[good])
    train = np.concatenate([kernel(presence(texts[i : i + 64], index, len(vocabulary)), marks, norms) for i in range(0, len(texts), 64)]) @ to_features
    targets = np.array([[1.0 if x == label else 0.0 for label in labels] for x in langs])
    weights = np.linalg.solve(train.T @ train + ridge * len(texts) * np.eye(train.shape[1]), train.T @ targets)
    return Model(labels, vocabulary, marks, norms, to_features @ weights)


def predict(model: Model, texts: list[str], index: np.ndarray) -> tuple[list[str], np.ndarray]:
    scores = kernel(presence(texts, index, len(model.vocabulary)), model.landmarks, model.norms) @ model.weights
    best = scores.argmax(axis=1)
    return [model.labels[i] for i in best], np.clip(scores[np.arange(len(best)), best], 0.0, 1.0)


def is_held_out(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_train: int = MAX_TRAIN, max_chars: int = MAX_CHARS) -> Model | None:
    """Two passes: distinct texts by language, then the sample; one more if a language has only texts over max_chars.

    What reaches the driver is max_train texts a language at most.
    """
    text = F.col(text_col).cast("string")
    fit_rows = docs.where(~is_held_out(id_col) & F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(
        text.alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text).alias("order"),
        F.when(F.length(text) > max_chars, F.length(text)).otherwise(0).alias("over"))
    short = F.countDistinct(F.when(F.col("over") == 0, F.col("order"))).alias("n")
    counts = {r["lang"]: r["n"] for r in fit_rows.groupBy("lang").agg(short).collect()}
    # A hash threshold leaves a few times what is wanted of each language; where texts are short of it, all are ranked.
    limits = {k: (4 * max_train / n if n > 8 * max_train else 1.0) for k, n in counts.items() if n}
    wanted = F.lit(False)
    for k, share in limits.items():
        near = F.col("order") <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True)
        wanted = wanted | ((F.col("lang") == k) & (F.col("over") == 0) & near)
    if long := [k for k in counts if k not in limits]:
        sizes = fit_rows.where(F.col("lang").isin(long)).select("lang", "over", "order").distinct()
        nth = F.row_number().over(W.partitionBy("lang").orderBy("over", "order"))
        for r in sizes.withColumn("rank", nth).where(F.col("rank") <= max_train).groupBy("lang").agg(F.max("over").alias("most")).collect():
            wanted = wanted | ((F.col("lang") == r["lang"]) & (F.col("over") <= r["most"]))
    ranked = F.row_number().over(W.partitionBy("lang").orderBy("over", "order", "text"))
    sample = fit_rows.where(wanted).dropDuplicates(["lang", "text"]).withColumn("rank", ranked).where(F.col("rank") <= max_train)
    rows = sorted((r["order"], r["lang"], r["text"]) for r in sample.select("order", "lang", "text").collect())
    return fit([r[2] for r in rows], [r[1] for r in rows])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **kwargs) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row a document."""
    model = train(docs, id_col, text_col, lang_col, **kwargs)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # some megabytes: landmarks x their n-grams

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        index = m.table() if m else None
        for b in batches:
            texts = b["text"].tolist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if m and t is not None and any(map(str.isalpha, t))]
            for at in range(0, len(known), 128):
                part = known[at : at + 128]
                got, score = predict(m, [texts[i] for i in part], index)
                for i, x, y in zip(part, got, score, strict=True):
                    langs[i], scores[i] = x, y
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": langs, "score": scores})

    slim = docs.select(F.col(id_col).cast("string").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = slim.mapInPandas(scored, "doc_id string, held_out boolean, lang_pred string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def op8_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
