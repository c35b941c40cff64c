"""Continuous ingestion and the job worker as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Append what `transform` makes of new Parquet files, once each; ends when no more are there."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def work(spark: SparkSession, jobs: str, schema: str, checkpoint: str, handlers: dict[str, Callable[[DataFrame], None]], every: str | None = None) -> StreamingQuery:
    """Hand new jobs of each kind to its handler, a batch at a time. With `every` the query
    goes on at that interval, else it drains what is there and ends."""

    def batch(part: DataFrame, _: int) -> None:
        part.persist()
        for kind, handler in handlers.items():
            handler(part.where(F.col("kind") == kind))
        part.unpersist()

    writer = spark.readStream.schema(schema).parquet(jobs).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def counts_by_window(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and hour; rows later than `late` are not counted."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
