"""Chunks of new page records, as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators import chunking
from lodestrata.sources.stores import Store

RECORDS = "source string, page int, text string"


def stream_chunks(spark: SparkSession, folder: str, store: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Parquet page records of folder to a store of chunks. A batch that runs again changes nothing: chunk ids are the key."""

    def keep(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            Store(spark, store).upsert(chunking.chunk_pages(batch), "chunk_id")

    arriving = spark.readStream.schema(RECORDS).parquet(folder)
    return arriving.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
