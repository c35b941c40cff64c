"""Filtered vector search, full-text search, and their fusion by reciprocal ranks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprov.functions import gate, vectors
from docprov.operators import fulltext, postings

POOL, RRF_K, NO_RANK = 200, 20, 1000


@dataclass(frozen=True)
class Filters:
    """What to search in; None lets everything pass. Overlap filters also pass rows for all ("*")."""

    overlaps: dict[str, list[str]] = field(default_factory=dict)
    equals: dict[str, object] = field(default_factory=dict)
    among: dict[str, list] = field(default_factory=dict)
    organization: str | None = None

    def column(self, org: str | None = None) -> Column:
        out = F.lit(True)
        for name, values in self.overlaps.items():
            if values is not None:
                out &= F.arrays_overlap(F.col(name), F.array(*[F.lit(v) for v in values])) | F.array_contains(F.col(name), "*")
        for name, value in self.equals.items():
            if value is not None:
                out &= F.col(name) == F.lit(value)
        for name, values in self.among.items():
            if values is not None:
                out &= F.col(name).isin(*values)
        if org:
            scope = F.col(org).isNull()
            out &= scope | (F.col(org) == self.organization) if self.organization is not None else scope
        return out


def checked(count: int, **shares: float) -> int:
    """The number of results, held to 1..100; weights and thresholds must lie in 0..1."""
    for name, value in shares.items():
        if not 0 <= value <= 1:
            raise ValueError(f"{name} must be between 0 and 1")
    return max(1, min(100, count))


def ranked(rows: DataFrame, by: str, rank: str, key: str, most: int = POOL) -> DataFrame:
    """The best `most` rows and their ranks: the limit comes first, so the window sees no more."""
    best = rows.orderBy(F.col(by).desc(), key).limit(most)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(F.col(by).desc(), key)))


def semantic(chunks: DataFrame, query: list[float], filters: Filters = Filters(), threshold: float = 0.7, count: int = 10, key: str = "chunk_id", vector: str = "embedding", digits: int | None = None) -> DataFrame:
    """Chunks by cosine similarity, of rows that are active and embedded where they say so (`is_active`,
    `embedding_status`). Narrow rows are ranked; callers join what else they need."""
    count = checked(count, threshold=threshold)
    if "is_active" in chunks.columns:
        chunks = chunks.where("is_active")
    if "embedding_status" in chunks.columns:
        chunks = chunks.where("embedding_status = 'complete'")
    similarity = vectors.cosine_to(query, F.col(vector))
    found = chunks.where(F.col(vector).isNotNull() & filters.column()).withColumn("similarity", F.round(similarity, digits) if digits else similarity)
    return found.where(F.col("similarity") >= threshold).orderBy(F.col("similarity").desc(), key).limit(count)


def fused(by_vector: DataFrame, by_text: DataFrame, weight: float = 0.7, key: str = "chunk_id") -> DataFrame:
    """A full join of two rankings (at most POOL rows each) and the weighted sum of reciprocal ranks."""
    both = by_vector.join(by_text, key, "full").fillna(0.0, subset=["similarity", "text_score"])
    part = lambda rank: 1.0 / (RRF_K + F.coalesce(F.col(rank), F.lit(NO_RANK)))
    return both.withColumn("combined_score", weight * part("vector_rank") + (1 - weight) * part("text_rank"))


def hybrid(chunks: DataFrame, query: list[float], terms: str | None, filters: Filters = Filters(), weight: float = 0.7, threshold: float = 0.005, count: int = 10, key: str = "chunk_id", vector: str = "embedding", text: str = "content", title: str | None = None, language: Column | None = None, index: postings.Postings | None = None) -> DataFrame:
    """(key, similarity, vector_rank, text_score, text_rank, combined_score); the vector side
    needs an embedding, the text side does not, and scores 0 for what it lacks. `terms` is a
    web-style query; without words in it the text side is empty. With an index of the chunks, no text is read."""
    count = checked(count, weight=weight, threshold=threshold)
    allowed = chunks.where(filters.column())
    near = allowed.where(F.col(vector).isNotNull()).select(key, vectors.cosine_to(query, F.col(vector)).alias("similarity")).where("similarity is not null")
    told = index.search(terms, key, None if filters == Filters() else allowed) if index else fulltext.search(allowed, terms, text, title, language, key)
    out = fused(ranked(near, "similarity", "vector_rank", key), ranked(told, "text_score", "text_rank", key), weight, key)
    return out.where(F.col("combined_score") >= threshold).orderBy(F.col("combined_score").desc(), key).limit(count)


def excluded(rows: DataFrame, content: str = "content", terms: Column | None = None) -> DataFrame:
    """Adds `matches`, the excluded terms found (in order), and `passed`."""
    found = gate.matches(F.col(content), F.col("sire_excluded") if terms is None else terms)
    return rows.withColumn("matches", found).withColumn("passed", F.size("matches") == 0)


def identity_collapse(hits: DataFrame, subject: str = "sire_subject") -> DataFrame:
    """Hits by subject, ranked by their mean similarity."""
    return hits.groupBy(subject).agg(F.count("*").alias("hits"), F.avg("similarity").alias("mean_similarity")).orderBy(F.desc("mean_similarity"), subject)


def suspicious_purge(rows: DataFrame, by: str = "sire_subject") -> DataFrame:
    """Whether the gate purged every hit of a subject."""
    return rows.groupBy(by).agg(F.count("*").alias("hits"), F.count_if(F.col("passed")).alias("passed"), F.count_if(~F.col("passed")).alias("purged")).withColumn("suspicious_purge", (F.col("hits") > 0) & (F.col("passed") == 0))
