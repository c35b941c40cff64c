"""Summaries of documents, chunks and pipeline runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprov.functions.watermark import looks_marked, self_verified

STATUSES = ("complete", "pending", "failed", "processing")


def document_summary(docs: DataFrame, chunks: DataFrame, indexes: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents with their chunks counted by embedding status, and their latest index's model."""
    n = [F.count(key).alias("total_chunks"), *[F.count_if(F.col("embedding_status") == s).alias(f"{s}_chunks") for s in STATUSES]]
    own = chunks.groupBy(key).agg(*n)
    model = indexes.groupBy(key).agg(F.max_by("model", F.struct("created_at", "model")).alias("latest_embedding_model"))
    return docs.join(own, key, "left").join(model, key, "left").fillna(0, subset=["total_chunks", *[f"{s}_chunks" for s in STATUSES]])


def watermark_summary(chunks: DataFrame, key: str = "corpus_id", content: str = "content", secret: str | None = None) -> DataFrame:
    """A row a document: whether all of its chunks, and whether any, carry a valid mark of their own document and
    place, and whether all end in something that looks like a mark of this version."""
    told = chunks.select(key, self_verified(F.col(content), F.col("corpus_id"), F.col("sequence"), secret).alias("ok"), looks_marked(F.col(content)).alias("looks"))
    return told.groupBy(key).agg(F.count("*").alias("chunks"), F.bool_and("ok").alias("all_valid"), F.bool_or("ok").alias("any_valid"), F.bool_and("looks").alias("looks_marked"))


def chunk_detail(chunks: DataFrame, docs: DataFrame, key: str = "document_id") -> DataFrame:
    """Chunks with what their document says; the planner broadcasts documents where they are few."""
    return chunks.join(docs.select(key, *[c for c in docs.columns if c not in chunks.columns]), key)


def run_summary(envelopes: DataFrame) -> DataFrame:
    """Envelopes by run, action and who triggered it; nulls form groups too."""
    return envelopes.groupBy("run_id", "action", "triggered_by", "user_id").agg(
        F.min("started_at").alias("first_started_at"), F.max("completed_at").alias("last_completed_at"), F.count("*").alias("envelopes"),
        F.count_if("validation_valid").alias("valid"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("embedded_count"), F.lit(0)).alias("embedded"), F.max("duration_ms").alias("max_duration_ms"),
    )


def pipeline_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(F.col("action").isin("inserted", "updated")).alias("ingested"),
        F.coalesce(F.sum("embedded"), F.lit(0)).cast("long").alias("embedded"), F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
