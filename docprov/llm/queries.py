"""The queries that apply each operator to its whole table, under fixed contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docprov.llm import annular, html, jaccard, mixing, packing, pii, quality, ranges, secrets, sharding, squares, toxicity, wand
from docprov.llm.common import table
from docprov.llm.sql import SQL
from docprov.session import attach


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_totals(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), with_text=False)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = packing.pieces(docs, with_ids=False)
    return packing.pack(rows, packing.group_count(docs), payload=("ids_crc32", "doc_tokens"))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = secrets.scan(table(spark, sf_dir, "documents"))
    spans = secrets.ordered(F.col("spans"))
    base = F.filter("spans", lambda s: s.kind.isin(*secrets.BASE))
    counts = [_count("spans", k) for k in secrets.BASE]
    return findings.withColumn("spans", spans).select(F.col("path").alias("doc_id"), *counts, F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))

    rank = F.create_map(*[x for k, i in pii.ORDER.items() for x in (F.lit(k), F.lit(i))])

    def by_kind(spans: Column) -> Column:
        return F.array_sort(F.transform(spans, lambda s: F.struct(F.element_at(rank, s.kind).alias("rank"), s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))

    counts = [_count("base_spans", k) for k in pii.KINDS]
    base = secrets.joined(by_kind(F.col("base_spans")))
    every = secrets.joined(by_kind(F.concat("base_spans", "added_spans")))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans"))


def learnable(labels: DataFrame) -> DataFrame:
    """Labels of the rows that may be learned from."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, learnable(table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    out = toxicity.score_texts(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "lang_threshold", "toxic")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return squares.best_fit(table(spark, sf_dir, "documents"), with_ids=False)


def op12_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.search(wand.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_annular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annular.compressed(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_mixing, op2_quality, op3_sharding, op4_packing, op5_secrets, op6_embeddings, op7_pii, op8_toxicity, op9_jaccard, op10_html, op11_squares, op12_wand, op13_annular)
    return {f.__name__: (lambda spark, sf_dir, f=f: f(attach(spark), sf_dir)) for f in named}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
