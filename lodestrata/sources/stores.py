"""Tables of chunks, vectors and indexes as Parquet, and traces as JSON lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_STORED_TEXT = 4000


def latest_wins(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of both, of each key the new one; of new rows with one key, one."""
    columns = old.columns
    both = old.select(*columns, F.lit(0).alias("_age")).unionByName(new.select(*columns, F.lit(1).alias("_age")))
    order = W.partitionBy(key).orderBy(F.desc("_age"), *[F.col(c) for c in columns if c != key and dict(old.dtypes)[c] != "map"])
    return both.withColumn("_no", F.row_number().over(order)).where("_no = 1").select(*columns)


def latest_by(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the row that is last in order; of equals the largest. Columns come as key, order, the others."""
    rest = [c for c in rows.columns if c != key and c not in order]
    best = rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_m"))
    return best.select(key, "_m.*")


def absent(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't known."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


class Store:
    """A table in a folder. Each version is written whole beside the last; a pointer file says which one counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def exists(self) -> bool:
        fs, path = self._fs()
        return fs.exists(path(f"{self.path}/current"))

    def read(self) -> DataFrame:
        if not self.exists():
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/{self.spark.read.text(f'{self.path}/current').first()[0]}")

    def write(self, df: DataFrame, at_least: int = 0) -> int:
        """Rows written. With fewer than at_least, the old version stays and an error is raised."""
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        n = self.spark.read.parquet(f"{self.path}/{name}").count()
        if n < at_least:
            raise ValueError(f"{n} rows where {at_least} were expected")
        self.spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/current")
        return n

    def upsert(self, new: DataFrame, key: str) -> int:
        return self.write(latest_wins(self.read(), new, key) if self.exists() else new.dropDuplicates([key]))

    def ensure(self, schema: str) -> Store:
        """The store, made empty with that schema if it isn't there."""
        if not self.exists():
            self.write(self.spark.createDataFrame([], schema))
        return self

    def count(self) -> int:
        return self.read().count() if self.exists() else 0

    def promote(self, to: Store, at_least: int = 1) -> int:
        """Copies this version into another store, whose earlier ones stay beside it."""
        return to.write(self.read(), at_least)

    def missing(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose key isn't there yet."""
        return absent(rows, self.read(), key) if self.exists() else rows

    def delete_source(self, source: str) -> int:
        return self.write(self.read().where(~F.col("source").eqNullSafe(F.lit(source))))


def vector_rows(chunks: DataFrame) -> DataFrame:
    """id, vector, metadata of the chunks that have a vector; metadata has their text, cut to what the store takes, and their parent."""
    cut = {"text": F.substring("text", 1, MAX_STORED_TEXT)} if "text" in chunks.columns else {}
    kept = chunks.where("embedding is not null and size(embedding) > 0").withColumns(cut)
    return kept.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector"), stored_metadata(kept, [c for c in kept.columns if c not in ("chunk_id", "embedding")]).alias("metadata"))


def stored_metadata(df: DataFrame, columns: list[str]) -> Column:
    """JSON of numbers, strings, booleans and lists of strings: nulls go, in lists too, and everything else is text."""
    simple = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double")

    def value(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith("array<"):
            inner = (lambda x: x.cast("string")) if kind[6:-1] in simple else F.to_json
            return F.transform(F.filter(c, lambda x: x.isNotNull()), inner).alias(name)
        if kind.startswith(("struct<", "map<")):
            return F.to_json(c).alias(name)
        return (c if kind in simple else c.cast("string")).alias(name)

    kinds = dict(df.dtypes)
    return F.to_json(F.struct(*[value(c, kinds[c]) for c in columns]))


def write_trace(run: DataFrame, questions: DataFrame, path: str) -> None:
    """The run's header, then a line a question in order of id."""
    head = run.select(F.lit("").alias("_id"), F.to_json(F.struct(F.lit("run").alias("type"), *run.columns)).alias("value"))
    lines = questions.select(F.col("id").alias("_id"), F.to_json(F.struct(F.lit("question").alias("type"), *questions.columns)).alias("value"))
    head.unionByName(lines).repartitionByRange(1, "_id").sortWithinPartitions("_id").select("value").write.text(path)


def read_trace(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The questions of a trace. schema: that of a question; ValueError if there is no header."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    kind = F.get_json_object("value", "$.type")
    if lines.where(kind == "run").isEmpty():
        raise ValueError(f"no run in {path}")
    return lines.where(kind == "question").select(F.from_json("value", schema).alias("q")).select("q.*")
