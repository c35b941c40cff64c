"""Parsing with a text model: source chunks are cleansed, audited, put together, and become a document.

A text model is a function from (role, text) messages to a text, called by the tasks. What it
said is written out before anything else reads it, so that it is asked once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprov.functions.text import fenced, inferred_title, kebab, sha256, trimmed, word_count
from docprov.functions.watermark import injected
from docprov.operators import audit, chunk
from docprov.operators.embed import with_retries
from docprov.session import stored

TextModel = Callable[[list[tuple[str, str]]], str]
# The size from which documents are put together without a model, tiers, and the texts of headers and lists.
DETERMINISTIC_WORDS = 50_000
TIER, DEFAULT_TIER = r"\Atier_[123]\z", "tier_2"
HEADER = (
    ("tier", None), ("version", "1"), ("frameworks", None), ("industries", None), ("source_url", None), ("source_publisher", None), ("last_verified", None), ("language", "english"),
)
ASSEMBLER = "deterministic-assembler-v1"
# End of the fixed values.


def identity_model(messages: list[tuple[str, str]]) -> str:
    """Says what it was told last: for tests, and to see a chain without a model."""
    return messages[-1][1]


def asked(rows: DataFrame, messages: Column, model: TextModel, keep: list[str], attempts: int = 3) -> DataFrame:
    """`keep` and (said, error): the model's answer to each row's messages, an array of (role, text)."""
    own = rows.select(*keep, messages.alias("__messages"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            said, errors = [], []
            for m in part["__messages"]:
                try:
                    said.append(with_retries(lambda _, m=m: model([(x["role"], x["text"]) for x in m]), [], attempts))
                    errors.append(None)
                except Exception as e:  # the row fails, not the job
                    said.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield part[keep].assign(said=said, error=errors)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return own.mapInPandas(run, f"{kinds}, said string, error string")


def message(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("text"))


def cleansed(docs: DataFrame, model: TextModel, instruction: str, key: str = "document_id", text: str = "source_text") -> DataFrame:
    """(key, sequence, source_text, ai_text, error): each chunk of each source as the model rewrites it."""
    chunks = docs.select(F.col(key), F.posexplode_outer(chunk.source_chunks(F.col(text))).alias("at", "source_text")).where("source_text is not null").select(key, (F.col("at") + 1).alias("sequence"), "source_text")
    said = asked(chunks, F.array(message("system", F.lit(instruction)), message("user", F.col("source_text"))), model, [key, "sequence", "source_text"])
    return said.withColumn("ai_text", fenced(F.coalesce("said", F.lit("")))).drop("said")


def deterministic_markdown(name: Column, text: Column, today: Column, tier: Column | None = None, frameworks: Column | None = None, industries: Column | None = None, publisher: Column | None = None, url: Column | None = None) -> Column:
    """A document with a header made from the source alone."""
    none = F.lit(None).cast("string")
    given = lambda c, other: F.coalesce(F.when(F.trim(none if c is None else c) != "", F.trim(none if c is None else c)), F.lit(other))
    listed = lambda c: F.lit("[]") if c is None else F.concat(F.lit("["), F.array_join(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x != ""), ", "), F.lit("]"))
    title = inferred_title(name, text)
    digest = F.substring(sha256(F.concat(title, F.lit("\n"), text)), 1, 8)
    slug = kebab(title)
    corpus_id = F.concat(F.when(slug == "", F.concat(F.lit("document-"), digest)).otherwise(slug), F.lit("-"), digest, F.lit("-v1"))
    own = none if tier is None else tier
    values = {
        "tier": F.when(own.rlike(TIER), own).otherwise(F.lit(DEFAULT_TIER)), "frameworks": listed(frameworks), "industries": listed(industries),
        "source_url": given(url, "unknown"), "source_publisher": given(publisher, "Unknown"), "last_verified": today,
    }
    lines = [F.lit("---"), F.concat(F.lit("corpus_id: "), corpus_id), F.concat(F.lit("title: "), title)]
    lines += [F.concat(F.lit(f"{c}: "), values[c] if v is None else F.lit(v)) for c, v in HEADER]
    lines += [F.lit("fact_check:\n  status: ai_parsed"), F.concat(F.lit('  checked_at: "'), today, F.lit('"')), F.lit(f"  checked_by: {ASSEMBLER}")]
    lines += [F.lit("sire:\n  subject: compliance\n  included: [regulation, control, requirement]\n  excluded: []\n  relevant: []\n---\n")]
    return F.concat_ws("\n", *lines, chunk.word_sections(text))


def parsed_with_audit(docs: DataFrame, model: TextModel, today: Column, cleanse: str = "Clean this text.", assemble: str = "Write a document with a header.", words: int = DETERMINISTIC_WORDS, key: str = "document_id", keep: Callable[[DataFrame], DataFrame] = stored) -> tuple[DataFrame, DataFrame]:
    """(documents, audits) for docs (key, source_filename, source_text): chunks are cleansed by the model, audited and
    recovered where text was lost; then the model assembles the whole, or from so many words on, a rule. `keep`
    writes down what the model said, so that it is asked once."""
    said = keep(cleansed(docs, model, cleanse, key))
    audits = audit.audited(said)
    whole = audit.rollup(audits, key).join(docs.select(key, "source_filename"), key)
    large = word_count(F.col("recovered_text")) >= words
    whole = whole.withColumn("large", large)
    by_rule = whole.where("large").select(key, "chunks", "omissions", deterministic_markdown(F.col("source_filename"), F.col("recovered_text"), today).alias("parsed_markdown"), F.lit(None).cast("string").alias("error"))
    told = keep(asked(whole.where("not large"), F.array(message("system", F.lit(assemble)), message("user", F.col("recovered_text"))), model, [key, "chunks", "omissions"]))
    by_model = told.select(key, "chunks", "omissions", fenced(F.col("said")).alias("parsed_markdown"), "error")
    status = F.when(F.col("error").isNotNull() | (F.coalesce(trimmed(F.col("parsed_markdown")), F.lit("")) == ""), "failed").otherwise("parsed")
    return by_rule.unionByName(by_model).withColumn("status", status), audits


def crosswalk_message(docs: DataFrame, key: str = "session_id", order: str = "position") -> DataFrame:
    """(key, documents, message): what a model is told of a session's documents (corpus_id, title, tier, frameworks,
    markdown), a numbered list and then each in full. A row holds all texts of a session, which people put together."""
    rows = docs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "corpus_id", "title", "tier", "frameworks", "markdown"))).alias("d"))
    number = lambda i: (i + 1).cast("string")
    line = lambda x, i: F.concat(number(i), F.lit(". **"), x.title, F.lit("** ("), x.corpus_id, F.lit(") — "), x.tier, F.lit(", frameworks: ["), F.array_join(x.frameworks, ", "), F.lit("]"))
    block = lambda x, i: F.concat(F.lit("--- DOCUMENT "), number(i), F.lit(": "), x.corpus_id, F.lit(" ---\n\n"), x.markdown)
    head = F.concat(F.lit("Generate a crosswalk mapping for the following "), F.size("d").cast("string"), F.lit(" corpus documents:"))
    return rows.select(key, F.size("d").alias("documents"), F.concat_ws("\n\n", head, F.array_join(F.transform("d", line), "\n"), F.array_join(F.transform("d", block), "\n\n")).alias("message"))


def crosswalk_ready(docs: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, crosswalk_ready): whether a session has two documents or more that are watermarked and promoted."""
    return docs.groupBy(key).agg((F.count_if((F.col("status") == "watermarked") & F.col("promoted")) >= 2).alias("crosswalk_ready"))


def crosswalks(docs: DataFrame, model: TextModel, prefix: str = "crosswalk-v1-", instruction: str = "Map these documents to each other.", key: str = "session_id", secret: str | None = None, keep: Callable[[DataFrame], DataFrame] = stored) -> tuple[DataFrame, DataFrame]:
    """(crosswalks, chunks) for sessions with at least two promoted and watermarked documents: the model's text, cut at
    headings and marked with the id `prefix` + key. For a user's library pass its rows as watermarked and promoted, the
    user as key and "crosswalk-encyclopedia-" as prefix."""
    good = docs.where((F.col("status") == "watermarked") & F.col("promoted"))
    told = crosswalk_message(good, key).where("documents >= 2")
    said = keep(asked(told, F.array(message("system", F.lit(instruction)), message("user", F.col("message"))), model, [key, "documents"]))
    out = said.select(key, "documents", fenced(F.col("said")).alias("markdown"), "error", F.concat(F.lit(prefix), F.col(key).cast("string")).alias("corpus_id"))
    chunks = chunk.crosswalk_chunks(out.where("error is null"), "corpus_id", "markdown")
    return out, chunks.withColumn("content", injected(F.col("content"), F.col("corpus_id"), F.col("sequence"), F.col("content_hash"), secret))
