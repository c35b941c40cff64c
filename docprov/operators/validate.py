"""Whether a parsed document may be ingested: errors, warnings, and the fact-check gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE = r"\A\d{4}-\d{2}-\d{2}\z"


def fact_check_error(fact_check: Column, last_verified: Column) -> Column:
    """The first fault of a fact check, or null. Dates are compared as text."""
    f = fact_check
    return (
        F.when(f.isNull(), F.lit("Missing fact_check frontmatter"))
        .when(~f.status.eqNullSafe(F.lit("verified")), F.concat(F.lit('fact_check.status must be "verified" (got "'), F.coalesce(f.status, F.lit("")), F.lit('")')))
        .when(~F.coalesce(f.checked_at.rlike(DATE), F.lit(False)), F.concat(F.lit('fact_check.checked_at must be YYYY-MM-DD (got "'), F.coalesce(f.checked_at, F.lit("")), F.lit('")')))
        .when(F.coalesce(F.trim(f.checked_by), F.lit("")) == "", F.lit("fact_check.checked_by must be a non-empty string"))
        .when(last_verified.rlike(DATE) & (f.checked_at < last_verified), F.concat(F.lit("fact_check.checked_at ("), f.checked_at, F.lit(") must be on/after last_verified ("), last_verified, F.lit(")")))
    )


def validated(docs: DataFrame, chunk_count: str = "chunk_count", changed: str = "changed", require_fact_check: bool = True) -> DataFrame:
    """Adds errors, warnings and valid. The fact check counts for changed documents only."""
    c = F.col
    gate = F.when(c(changed), fact_check_error(c("fact_check"), c("last_verified"))) if require_fact_check else F.lit(None).cast("string")
    errors = F.array_compact(F.array(c("error"), F.when(c(chunk_count) == 0, F.lit("Document has no chunks")), gate))
    warnings = F.array_compact(F.array(*[F.when(F.coalesce(F.size(n), F.lit(0)) == 0, F.lit(f"{n} is empty")) for n in ("frameworks", "industries", "segments")]))
    return docs.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("valid", F.size("errors") == 0)


def integrity(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) chunks: the latter with `fault`; of two chunks with one number or
    title in a document, the later is at fault."""
    from pyspark.sql import Window

    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("sequence", "content_hash"))
    fault = (
        F.when(F.col("sequence") < 0, "sequence below 0")
        .when(~F.col("heading_level").between(1, 6), "heading level out of range")
        .when(F.coalesce(F.col("content"), F.lit("")) == "", "empty content")
        .when(~F.col("content_hash").rlike(r"\A[a-f0-9]{64}\z"), "malformed hash")
        .when(nth("document_id", "sequence") > 1, "repeated sequence")
        .when(nth("document_id", "section_title") > 1, "repeated title")
    )
    judged = chunks.withColumn("fault", fault)
    return judged.where("fault is null").drop("fault"), judged.where("fault is not null")
