"""What a rewritten chunk lost of its source, and what to take from the source instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprov.functions.text import let

MIN_COVERAGE, MIN_LENGTH = 0.82, 0.55


def lexemes(text: Column) -> Column:
    """Distinct lower-case ASCII words of three characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{3,})"), 1))


def coverage(source: Column, other: Column) -> Column:
    """The share of the source's words that the other text has; 1 without words."""
    share = lambda own: F.when(F.size(own) == 0, F.lit(1.0)).otherwise(F.try_divide(F.size(F.array_intersect(own, lexemes(other))).cast("double"), F.size(own)))
    return let(lexemes(source), share)


def audited(rows: DataFrame, source: str = "source_text", other: str = "ai_text") -> DataFrame:
    """Adds coverage_ratio, length_ratio, omission_detected, recovered_text, warnings."""
    length = F.when(F.length(source) == 0, F.lit(1.0)).otherwise(F.try_divide(F.length(other).cast("double"), F.length(source)))
    out = rows.withColumn("coverage_ratio", coverage(F.col(source), F.col(other))).withColumn("length_ratio", length)
    low, short = F.col("coverage_ratio") < MIN_COVERAGE, F.col("length_ratio") < MIN_LENGTH
    warnings = F.array_compact(F.array(F.when(low, F.format_string("coverage_ratio_low:%.4f", "coverage_ratio")), F.when(short, F.format_string("length_ratio_low:%.4f", "length_ratio"))))
    return out.withColumn("omission_detected", low | short).withColumn("recovered_text", F.when(low | short, F.col(source)).otherwise(F.col(other))).withColumn("warnings", warnings)


def rollup(audits: DataFrame, key: str = "document_id") -> DataFrame:
    """A row a document: chunks, omissions, and the recovered text in order. The key has to be a document's: a row
    holds all of its text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "recovered_text"))), lambda x: x.recovered_text), "\n\n")
    return audits.groupBy(key).agg(F.count("*").alias("chunks"), F.count_if("omission_detected").alias("omissions"), text.alias("recovered_text"))


def warning_summary(audits: DataFrame, key: str = "document_id") -> DataFrame:
    """Warnings of the rows with omissions, one at least each, and the first three of all."""
    own = F.filter("warnings", lambda w: F.trim(w) != "")
    # Not by a filter, which would be pushed down and work out the ratios a second time.
    bad = F.col("omission_detected")
    ordered = F.array_sort(F.collect_list(F.when(bad, F.struct("sequence", own.alias("w")))))
    told = audits.groupBy(key).agg(F.sum(F.when(bad, F.greatest(F.size(own), F.lit(1)))).cast("long").alias("warning_count"), F.slice(F.flatten(F.transform(ordered, lambda x: x.w)), 1, 3).alias("preview"))
    return told.where("warning_count is not null")
