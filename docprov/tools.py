"""Two functions for assistants: search the corpus, and verify where a chunk comes from. They answer with text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprov.functions.watermark import verified
from docprov.operators import retrieval
from docprov.operators.embed import Provider, with_retries
from docprov.sources.export import formatted

THRESHOLD, MOST = 0.5, 50
TIERS = ("tier_1", "tier_2", "tier_3")


def search_corpus(chunks: DataFrame, query: str, provider: Provider, frameworks: list[str] | None = None, tier: str | None = None, match_count: int = 10) -> str:
    """The nearest active chunks (id, embedding, section_title, corpus_id, content, heading_path, tier, frameworks)."""
    if not 1 <= match_count <= MOST:
        return f"Error: match_count must be between 1 and {MOST}"
    if tier is not None and tier not in TIERS:
        return f"Error: tier must be one of {', '.join(TIERS)}"
    try:
        vector = with_retries(provider, [query])[0]
        filters = retrieval.Filters({"frameworks": frameworks} if frameworks else {}, {"tier": tier})
        hits = retrieval.semantic(chunks, vector, filters, THRESHOLD, match_count, key="id")
        told = hits.orderBy(F.desc("similarity"), "id").select(formatted(F.col("similarity"), F.col("section_title"), F.col("corpus_id"), F.col("content"), F.col("heading_path")).alias("text")).collect()  # at most MOST
    except Exception as e:
        return f"Search failed: {e}"
    if not told:
        return f'No results found for: "{query}"'
    return f'Found {len(told)} result(s) for: "{query}"\n\n' + "\n\n".join(r.text for r in told)


def verify_provenance(spark: SparkSession, content: str, secret: str | None = None) -> str:
    """What the mark at the end of a chunk says of it."""
    v = spark.createDataFrame([(content,)], "content string").select(verified(F.col("content"), secret).alias("v")).first().v
    if v.valid:
        return f"Valid: {v.corpus_id}, chunk {v.sequence}, {v.version}"
    return f"Invalid: {v.reason}"
