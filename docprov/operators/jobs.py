"""A queue of jobs as a table: enqueue, claim, settle, reap, cancel. Each gives the next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEASE, BACKOFF = 300, 10
EXPIRED = "Lease expired after max retries"


def seconds(n: Column) -> Column:
    return F.make_dt_interval(secs=n.cast("decimal(18,6)"))


def enqueue(jobs: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """New jobs (id, kind, payload), pending and visible at once."""
    fresh = new.select("id", "kind", "payload", F.lit("pending").alias("status"), as_of.alias("visible_at"), F.lit(0).alias("retry_count"), F.lit(3).alias("max_retries"), F.lit(None).cast("string").alias("error"))
    return jobs.unionByName(fresh, allowMissingColumns=True)


def claim(jobs: DataFrame, as_of: Column, n: int = 1, lease: int = LEASE) -> DataFrame:
    """The oldest visible pending jobs start; adds `claimed`."""
    due = jobs.where((F.col("status") == "pending") & (F.col("visible_at") <= as_of)).orderBy("id").limit(n).select("id", F.lit(True).alias("claimed"))
    both = jobs.join(F.broadcast(due), "id", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    both = both.withColumn("retry_count", F.col("retry_count") + F.col("claimed").cast("int"))
    both = both.withColumn("visible_at", F.when(F.col("claimed"), as_of + seconds(F.lit(lease))).otherwise(F.col("visible_at")))
    return both.withColumn("status", F.when(F.col("claimed"), "in_progress").otherwise(F.col("status")))


def fail(jobs: DataFrame, failures: DataFrame, as_of: Column) -> DataFrame:
    """Jobs in progress that failed: back to pending after 10 * 2**(retries - 1) seconds, or failed for good."""
    f = failures.select(F.col("id"), F.col("error").alias("new_error"), F.lit(True).alias("hit"))
    both = jobs.join(f, "id", "left")
    hit = F.coalesce(F.col("hit") & (F.col("status") == "in_progress"), F.lit(False))
    spent = F.col("retry_count") >= F.col("max_retries")
    wait = F.lit(BACKOFF) * F.pow(F.lit(2.0), F.greatest(F.col("retry_count") - 1, F.lit(0)))
    both = both.withColumn("visible_at", F.when(hit & ~spent, as_of + seconds(wait)).otherwise(F.col("visible_at")))
    both = both.withColumn("error", F.when(hit, F.col("new_error")).otherwise(F.col("error")))
    return both.withColumn("status", F.when(hit, F.when(spent, "failed").otherwise("pending")).otherwise(F.col("status"))).drop("new_error", "hit")


def complete(jobs: DataFrame, done: DataFrame) -> DataFrame:
    both = jobs.join(done.select("id", F.lit(True).alias("hit")), "id", "left")
    status = F.when(F.coalesce(F.col("hit"), F.lit(False)) & (F.col("status") == "in_progress"), "completed").otherwise(F.col("status"))
    return both.withColumn("status", status).drop("hit")


def heartbeat(jobs: DataFrame, alive: DataFrame, as_of: Column, lease: int = LEASE) -> DataFrame:
    """Running jobs that report get a new lease."""
    both = jobs.join(alive.select("id", F.lit(True).alias("hit")), "id", "left")
    running = F.coalesce(F.col("hit"), F.lit(False)) & (F.col("status") == "in_progress")
    return both.withColumn("visible_at", F.when(running, as_of + seconds(F.lit(lease))).otherwise(F.col("visible_at"))).drop("hit")


def reap(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs whose lease ran out: pending again, or failed once their retries are spent."""
    stale = (F.col("status") == "in_progress") & (F.col("visible_at") < as_of)
    spent = F.col("retry_count") >= F.col("max_retries")
    out = jobs.withColumn("error", F.when(stale & spent, F.lit(EXPIRED)).otherwise(F.col("error")))
    return out.withColumn("status", F.when(stale, F.when(spent, "failed").otherwise("pending")).otherwise(F.col("status")))


def cancel(jobs: DataFrame, document: str, reason: str = "Stopped by user") -> DataFrame:
    """The newest active job of each document in column `document` fails."""
    active = F.col("status").isin("pending", "in_progress")
    newest = jobs.where(active).groupBy(document).agg(F.max("id").alias("newest"))
    both = jobs.join(newest, document, "left")
    hit = F.coalesce(F.col("id") == F.col("newest"), F.lit(False))
    return both.withColumn("error", F.when(hit, F.lit(reason)).otherwise(F.col("error"))).withColumn("status", F.when(hit, "failed").otherwise(F.col("status"))).drop("newest")


def cancelled(docs: DataFrame, jobs: DataFrame, document: str, reason: str = "Stopped by user") -> tuple[DataFrame, DataFrame]:
    """(documents, jobs) after every document with an active job in column `document` was stopped: its newest active
    job fails, and so does the document (id, status, error_message), if it still waits or is being parsed."""
    active = jobs.where(F.col("status").isin("pending", "in_progress")).select(F.col(document).alias("__id")).distinct().withColumn("__hit", F.lit(True))
    both = docs.join(active, F.col("id") == F.col("__id"), "left")
    hit = F.coalesce(F.col("__hit") & F.col("status").isin("pending", "parsing"), F.lit(False))
    both = both.withColumn("error_message", F.when(hit, F.lit(reason)).otherwise(F.col("error_message"))).withColumn("status", F.when(hit, "failed").otherwise(F.col("status")))
    return both.select(*docs.columns), cancel(jobs, document, reason)


def latest(jobs: DataFrame, document: str, key: str = "id") -> DataFrame:
    """The newest job of each document."""
    return jobs.groupBy(document).agg(F.max_by(F.struct(*[c for c in jobs.columns if c != document]), key).alias("x")).select(document, "x.*")
