"""Records of what pipelines did: rows of one shape, appended and never changed."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTEMPTS, PAUSE = 2, 0.1
LOG = logging.getLogger("docprov")


@dataclass(frozen=True)
class Context:
    """Who runs what, and under which authority."""

    run_id: str
    triggered_by: str
    action: str
    user_id: str | None = None
    organization_id: str | None = None
    embedding_authority_id: str | None = None
    egress_policy_id: str | None = None
    attestation_run_id: str | None = None


def _row(rows: DataFrame, context: Context, started: Column, completed: Column, own: dict[str, Column]) -> DataFrame:
    text = lambda v: F.lit(v).cast("string")
    columns = {c: text(getattr(context, c)) for c in ("run_id", "triggered_by", "user_id", "action", "organization_id", "embedding_authority_id", "egress_policy_id", "attestation_run_id")}
    empty = {"corpus_id": text(None), "validation": text(None), "ingestion": text(None), "embedding": text(None), "validation_valid": F.lit(None).cast("boolean"), "ingestion_action": text(None), "chunk_count": F.lit(None).cast("long"), "embedded_count": F.lit(None).cast("long"), "error": text(None), "rechunk_meta": text(None)}
    spent = ((F.unix_micros(completed) - F.unix_micros(started)) / 1000).cast("long")
    every = columns | empty | own | {"started_at": started, "completed_at": completed, "duration_ms": spent}
    return rows.select(*[c.alias(name) for name, c in every.items()])


def of_pipeline(results: DataFrame, context: Context, started: Column, completed: Column) -> DataFrame:
    """A record for each result (corpus_id, valid, errors, warnings, document_id, action, chunk_count, embedded, pending,
    old_chunk_count); parts that a result lacks are null."""
    c = F.col
    whole = lambda test, *names: F.when(test.isNotNull(), F.to_json(F.struct("corpus_id", *names)))
    meta = F.when(c("old_chunk_count").isNotNull(), F.to_json(F.struct(F.lit(True).alias("rechunk"), "old_chunk_count", c("chunk_count").alias("new_chunk_count"))))
    own = {
        "corpus_id": c("corpus_id"), "validation": whole(c("valid"), "valid", "errors", "warnings"), "ingestion": whole(c("action"), "document_id", "action", "chunk_count"),
        "embedding": F.when(c("embedded").isNotNull(), F.to_json(F.struct("embedded", "pending"))), "validation_valid": c("valid"), "ingestion_action": c("action"),
        "chunk_count": c("chunk_count").cast("long"), "embedded_count": c("embedded").cast("long"), "rechunk_meta": meta,
    }
    return _row(results, context, started, completed, own)


def of_embedding(results: DataFrame, context: Context, started: Column, completed: Column) -> DataFrame:
    """One record of a batch that was embedded: results (ok)."""
    counts = results.agg(F.count_if("ok").alias("embedded"), F.count_if(~F.col("ok")).alias("pending"))
    return _row(counts, context, started, completed, {"embedding": F.to_json(F.struct("embedded", "pending")), "embedded_count": F.col("embedded")})


def of_error(errors: DataFrame, context: Context, started: Column, completed: Column) -> DataFrame:
    """A record for each failure (corpus_id, error)."""
    return _row(errors, context, started, completed, {"corpus_id": F.col("corpus_id"), "error": F.col("error")})


class AppendOnly:
    """A table that rows are added to, and that offers no way to change or delete them."""

    def __init__(self, path: str, attempts: int = ATTEMPTS, pause: Callable[[float], None] = time.sleep):
        self.path, self.attempts, self.pause = path, attempts, pause

    def append(self, rows: DataFrame) -> bool:
        """Add rows; a failure is tried again once, then logged: what was recorded of must not fail for its record."""
        for n in range(1, self.attempts + 1):
            try:
                rows.write.mode("append").parquet(self.path)
                return True
            except Exception as e:
                if n == self.attempts:
                    LOG.error("failed to write %s after %d attempts: %s", self.path, n, e)
                else:
                    self.pause(PAUSE * n)
        return False


def changed_records(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of an earlier state of an append-only table that a later one lacks: none, if all went well."""
    return before.exceptAll(after)
