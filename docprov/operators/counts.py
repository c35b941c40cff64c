"""Counts that are kept, not worked out anew: changes with signs fold into a summary by commits.

A change is a row (document, status, sign): 1 where a chunk came or took a status, -1 where
it went or left it. Changes are added up by document first, whatever their number, and only
the buckets that hold one of these documents are rewritten. Counts never fall below 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprov.operators.views import STATUSES
from docprov.session import stored
from docprov.sources.snapshots import Tables, View

COUNTS = ("total_chunks", *(f"{s}_chunks" for s in STATUSES))


def changes(before: DataFrame, after: DataFrame, key: str = "document_id", chunk: str = "id", status: str = "embedding_status") -> DataFrame:
    """(key, status, sign) of what differs between two states of some chunks; what stays as it was gives no row."""
    a = before.select(F.col(chunk).alias("__chunk"), F.col(key).alias("__key"), F.col(status).alias("__status"), F.lit(-1).alias("sign"))
    b = after.select(F.col(chunk).alias("__chunk"), F.col(key).alias("__key"), F.col(status).alias("__status"), F.lit(1).alias("sign"))
    left = a.unionByName(b).groupBy("__chunk", "__key", "__status").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    return left.select(F.col("__key").alias(key), F.col("__status").alias("status"), "sign")


class Counts:
    """Chunks by document and status, in a table of its own."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "document_id", key_type: str = "string", buckets: int = 16):
        self.tables, self.key = Tables(spark, folder), key
        self.tables.define("counts", f"`{key}` {key_type}, " + ", ".join(f"{c} long" for c in COUNTS), (key,), buckets)

    def apply(self, changed: DataFrame) -> None:
        """Fold changes into the counts; documents without a chunk left go."""
        own = [F.sum("sign").alias(COUNTS[0]), *[F.sum(F.when(F.col("status") == s, F.col("sign")).otherwise(0)).alias(f"{s}_chunks") for s in STATUSES]]
        sums = stored(changed.groupBy(self.key).agg(*own))

        def folded(old: DataFrame) -> DataFrame:
            both = old.unionByName(sums).groupBy(self.key).agg(*[F.greatest(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS])
            return both.where(F.col(COUNTS[0]) > 0)

        def work(view: View) -> None:
            view.merge("counts", sums, folded)

        self.tables.transaction(work)

    def read(self) -> DataFrame:
        return self.tables.read("counts")
