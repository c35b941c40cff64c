"""Drafts of parsed documents: submitted, then approved or rejected. Each step gives the next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprov.functions.text import sha256, source_name, trimmed

COLUMNS = "id string, source_filename string, source_text string, source_hash string, status string, parsed_markdown string, user_markdown string, reviewer_notes string, document_id string, created_by string"


def submit(drafts: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next drafts, refused): new sources (id, source_filename, source_text, created_by) start as being parsed; those
    whose text is there already, or repeats an earlier id of the batch, are refused."""
    hashed = new.withColumn("source_hash", sha256(F.col("source_text")))
    first = hashed.groupBy("source_hash").agg(F.min("id").alias("first"))
    known = drafts.select("source_hash", F.lit(True).alias("known")).distinct()
    judged = hashed.join(first, "source_hash").join(known, "source_hash", "left").withColumn("fresh", F.col("known").isNull() & (F.col("id") == F.col("first")))
    none = F.lit(None).cast("string")
    rows = judged.where("fresh").select("id", source_name(F.col("source_filename"), F.col("source_hash")).alias("source_filename"), "source_text", "source_hash", F.lit("parsing").alias("status"), *[none.alias(c) for c in ("parsed_markdown", "user_markdown", "reviewer_notes", "document_id")], "created_by")
    reason = F.concat(F.lit("Document already submitted (duplicate source hash: "), F.substring("source_hash", 1, 12), F.lit("...)"))
    return drafts.unionByName(rows), judged.where("not fresh").select("id", reason.alias("error"))


def markdown() -> Column:
    """What a person edited wins over what the model wrote."""
    return F.coalesce("user_markdown", "parsed_markdown")


def approval_error() -> Column:
    """Why a draft can't be approved; null if it can."""
    said = F.concat(F.lit("Draft "), F.col("id"))
    return (
        F.when(F.col("status") == "approved", F.concat(said, F.lit(" is already approved")))
        .when(~F.col("status").isin("parsed", "failed"), F.concat(said, F.lit(" is in status '"), F.col("status"), F.lit("' — only 'parsed' or 'failed' drafts can be approved")))
        .when(F.coalesce(trimmed(markdown()), F.lit("")) == "", F.concat(said, F.lit(" has no parsed markdown")))
    )


def approve(drafts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to ingest, refused) of the drafts asked for: (id, raw) texts for ingestion, and (id, error)."""
    asked = drafts.join(ids.select("id"), "id", "left_semi").withColumn("error", approval_error())
    missing = ids.select("id").join(drafts.select("id"), "id", "left_anti").select("id", F.concat(F.lit("Draft not found: "), "id").alias("error"))
    return asked.where("error is null").select("id", markdown().alias("raw")), asked.where("error is not null").select("id", "error").unionByName(missing)


def approved(drafts: DataFrame, done: DataFrame) -> DataFrame:
    """Drafts whose documents (id, document_id) were ingested are approved."""
    both = drafts.drop("document_id").join(done.select("id", F.col("document_id").alias("__done")), "id", "left").join(drafts.select("id", "document_id"), "id")
    status = F.when(F.col("__done").isNotNull(), "approved").otherwise(F.col("status"))
    return both.withColumn("status", status).withColumn("document_id", F.coalesce("__done", "document_id")).select(*drafts.columns)


def reject(drafts: DataFrame, ids: DataFrame, notes: str = "reviewer_notes") -> DataFrame:
    """The drafts asked for (id, notes) are rejected, whatever their status."""
    both = drafts.join(ids.select("id", F.col(notes).alias("__notes"), F.lit(True).alias("__asked")), "id", "left")
    return both.withColumn("status", F.when(F.col("__asked"), "rejected").otherwise(F.col("status"))).withColumn("reviewer_notes", F.when(F.col("__asked"), F.col("__notes")).otherwise(F.col("reviewer_notes"))).select(*drafts.columns)


def edited(docs: DataFrame, edits: DataFrame, valid: Column) -> DataFrame:
    """Documents (id, status, user_markdown) with a person's texts (id, new_markdown); `valid` says of new_markdown
    whether it can be read as a document, without which an edit changes nothing. An edited document is chunked again."""
    both = docs.join(edits.select("id", "new_markdown").withColumn("__ok", valid), "id", "left")
    ok = F.coalesce("__ok", F.lit(False))
    return both.withColumn("user_markdown", F.when(ok, F.col("new_markdown")).otherwise(F.col("user_markdown"))).withColumn("status", F.when(ok, "edited").otherwise(F.col("status"))).select(*docs.columns)


def without_sessions(sessions: DataFrame, docs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and documents after sessions (session_id) were deleted."""
    return sessions.join(gone, "session_id", "left_anti"), docs.join(gone, "session_id", "left_anti")
