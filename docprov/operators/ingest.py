"""From raw documents to versions and signed chunks, for all documents at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprov.functions.text import sha256
from docprov.functions.watermark import fault, injected
from docprov.operators import chunk, store, validate
from docprov.operators.frontmatter import parse_documents
from docprov.session import stored

KEY = ("corpus_id", "version", "organization_id")


def parsed(raw: DataFrame) -> DataFrame:
    """Raw texts with their headers and content hash; platform scope unless a column says otherwise."""
    docs = parse_documents(raw).withColumn("content_hash", sha256(F.col("content")))
    return docs if "organization_id" in docs.columns else docs.withColumn("organization_id", F.lit(None).cast("string"))


def checked(docs: DataFrame, existing: DataFrame, require_fact_check: bool = True) -> DataFrame:
    """Documents with `changed`, errors, warnings and valid, against what is there in their scope."""
    n, o = docs.alias("n"), existing.alias("o")
    on = (F.col("n.corpus_id") == F.col("o.corpus_id")) & F.col("n.organization_id").eqNullSafe(F.col("o.organization_id")) & F.col("o.is_active")
    both = n.join(o, on, "left").select("n.*", store.substantive_change("n", "o").alias("changed"))
    sections = F.regexp_count("content", F.lit(r"(?m)^###?[ \t\x0B\f\r]+[^\r\n]+"))
    return validate.validated(both.withColumn("chunk_count", F.coalesce(sections, F.lit(0))), require_fact_check=require_fact_check)


def self_checked(chunks: DataFrame, secret: str | None = None, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(chunks, faults): marked chunks that verify as their own documents', of documents all of whose do; and for each
    other document (key, error) the first fault of its chunks."""
    told = stored(chunks.withColumn("__fault", fault(F.col("content"), F.col("corpus_id"), F.col("sequence"), secret)))
    faults = stored(told.where("__fault is not null").groupBy(key).agg(F.min_by("__fault", "sequence").alias("error")))
    return told.join(faults, key, "left_anti").drop("__fault"), faults


def ingest(raw: DataFrame, existing: DataFrame, require_fact_check: bool = True, secret: str | None = None, rechunk: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, next documents, new chunks). Results say what happened to every document:
    an error, unchanged, updated or inserted. Chunks carry a mark with their document's id, which is verified once it is
    there: a document with a chunk that fails is not taken. With `rechunk` documents are chunked also where nothing
    changed, and count as updated."""
    docs = stored(checked(parsed(raw), existing, require_fact_check))
    good = docs.where("valid").withColumn("document_id", sha256(F.concat_ws("|", "corpus_id", "version", F.coalesce("organization_id", F.lit("platform")))))
    acted = store.upsert_actions(good, existing)
    if rechunk:
        acted = acted.withColumn("action", F.when(F.col("action") == "unchanged", "updated").otherwise(F.col("action")))
    fresh = acted.where("action <> 'unchanged'")
    chunks = chunk.heading_chunks(fresh, "document_id", "content", F.col("title")).join(fresh.select("document_id", "corpus_id", "tier", "frameworks", "industries", "segments", "language"), "document_id")
    chunks = chunks.withColumn("content", injected(F.col("content"), F.col("corpus_id"), F.col("sequence"), F.col("content_hash"), secret)).withColumn("embedding_status", F.lit("pending"))
    chunks, faults = self_checked(chunks, secret)
    taken = acted.join(faults.select("document_id", F.col("error").alias("__fault")), "document_id", "left")
    results = taken.select("corpus_id", "version", F.when(F.col("__fault").isNull(), F.col("action")).otherwise("failed").alias("action"), F.col("__fault").alias("error"))
    results = results.unionByName(docs.where("not valid").select("corpus_id", "version", F.lit("invalid").alias("action"), F.array_join("errors", "; ").alias("error")))
    rows = good.join(faults, "document_id", "left_anti").withColumn("is_active", F.lit(True)).select(*existing.columns)
    return results, store.upserted(rows, existing), chunks
