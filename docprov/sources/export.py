"""What leaves the engine: bundles of files, receipts, CSV, formatted results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprov.functions.text import slug
from docprov.functions.watermark import stripped

READY = ("parsed", "edited", "chunked", "watermarked")


def padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def bundle(docs: DataFrame, chunks: DataFrame, crosswalk: DataFrame | None = None) -> DataFrame:
    """(path, content) of a session's files: documents (position, corpus_id, status, markdown),
    chunks (corpus_id, sequence, section_title, content) of watermarked ones, with and
    without marks, and the crosswalk."""
    ready = docs.where(F.col("status").isin(*READY))
    files = ready.select(F.concat(F.lit("documents/"), padded(F.col("position"), 2), F.lit("-"), "corpus_id", F.lit(".md")).alias("path"), F.col("markdown").alias("content"))
    marked = chunks.join(ready.where("status = 'watermarked'").select("corpus_id"), "corpus_id", "left_semi")
    name = F.concat(F.col("corpus_id"), F.lit("/"), padded(F.col("sequence"), 3), F.lit("-"), slug(F.col("section_title")), F.lit(".md"))
    files = files.unionByName(marked.select(F.concat(F.lit("chunks/"), name).alias("path"), "content"))
    files = files.unionByName(marked.select(F.concat(F.lit("chunks-clean/"), name).alias("path"), stripped(F.col("content")).alias("content")))
    return files if crosswalk is None else files.unionByName(crosswalk.select(F.lit("crosswalk.md").alias("path"), "content"))


def receipt(docs: DataFrame, key: str = "session_id") -> DataFrame:
    """A JSON text a session, its documents in order."""
    own = F.struct("position", "corpus_id", "status", "content_hash")
    return docs.groupBy(key).agg(F.to_json(F.struct(F.first(key).alias("session"), F.count("*").alias("documents"), F.array_sort(F.collect_list(own)).alias("items"))).alias("receipt"))


def failures_csv(rows: DataFrame, path: str) -> None:
    rows.where("attention_reason is not null or stage = 'failed'").write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def formatted(similarity: Column, title: Column, corpus: Column, content: Column, path: Column | None = None) -> Column:
    lines = [F.concat(F.lit("["), F.format_string("%.3f", similarity), F.lit("] "), title), F.concat(F.lit("Corpus: "), corpus)]
    if path is not None:
        lines.append(F.when(F.size(path) > 0, F.concat(F.lit("Path: "), F.array_join(path, " > "))))
    return F.array_join(F.array_compact(F.array(*lines, stripped(content))), "\n")


def write_files(files: DataFrame, folder: str) -> None:
    """Bundle files as text, a folder a path, written by the tasks."""
    files.write.mode("overwrite").partitionBy("path").text(folder)
