"""Functions and views for SQL: `register` makes them for a session.

Scalar and table functions are SQL of their own, so a call is planned with the query around
it: filters on what a table function returns go below it, and of a ranking that ends in
ORDER BY and LIMIT only the best rows of each task are moved. Lexemes come from a table
function in Python, as `fulltext` gives them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from docprov.functions.text import SPACE
from docprov.operators import fulltext, views

WORDS = SPACE.replace(r"[\s", r"[^\s")
NORM = "sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))"

SCALARS = {
    "cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": f"try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), {NORM.format('a')} * {NORM.format('b')})",
    "corpus_word_count(content STRING) RETURNS BIGINT": f"coalesce(regexp_count(content, r'{WORDS}+'), 0)",
    "corpus_token_estimate(content STRING) RETURNS BIGINT": f"CAST(ceil(coalesce(regexp_count(content, r'{WORDS}+'), 0) / 0.75) AS BIGINT)",
    "watermark_signature(corpus_id STRING, sequence BIGINT, content_hash STRING) RETURNS STRING": "substr(sha2(concat_ws('|', corpus_id, CAST(sequence AS STRING), content_hash), 256), 1, 16)",
}

#: Lists overlap, or the row is for all; null filters let everything pass; without an organization only common rows do.
_OVERLAPS = "(filter_{0} IS NULL OR arrays_overlap(c.{0}, filter_{0}) OR array_contains(c.{0}, '*'))"
TABLES = {
    """match_corpus_chunks(query_embedding ARRAY<DOUBLE>, match_threshold DOUBLE DEFAULT 0.7D, filter_industries ARRAY<STRING> DEFAULT NULL, filter_segments ARRAY<STRING> DEFAULT NULL,
filter_tier STRING DEFAULT NULL, filter_frameworks ARRAY<STRING> DEFAULT NULL, filter_corpus_ids ARRAY<STRING> DEFAULT NULL, filter_organization_id STRING DEFAULT NULL)
RETURNS TABLE (id STRING, document_id STRING, corpus_id STRING, section_title STRING, content STRING, tier STRING, frameworks ARRAY<STRING>, similarity DOUBLE)""": f"""SELECT c.id, c.document_id, c.corpus_id, c.section_title, c.content, c.tier, c.frameworks, cosine_similarity(c.embedding, query_embedding)
FROM corpus_chunks c WHERE c.is_active AND c.embedding_status = 'complete' AND c.embedding IS NOT NULL
AND {_OVERLAPS.format("industries")} AND {_OVERLAPS.format("segments")} AND {_OVERLAPS.format("frameworks")}
AND (filter_tier IS NULL OR c.tier = filter_tier) AND (filter_corpus_ids IS NULL OR array_contains(filter_corpus_ids, c.corpus_id))
AND (c.organization_id IS NULL OR c.organization_id = filter_organization_id)
AND cosine_similarity(c.embedding, query_embedding) >= match_threshold""",
}


@udtf(returnType="lexeme string, place int, weight string")
class CorpusLexemes:
    """The weighted places of the lexemes of a title and a content."""

    def eval(self, title: str, content: str, language: str) -> Iterator[tuple[str, int, str]]:
        yield from fulltext.places(title, content, language or "english")


@udtf(returnType="group_no int, phrase_no int, lexeme string, step int, wanted boolean")
class SearchTerms:
    """What a web-style query asks for: groups of phrases, one of which has to be met."""

    def eval(self, query: str) -> Iterator[tuple[int, int, str, int, bool]]:
        for g, group in enumerate(fulltext.websearch(query)):
            for p, phrase in enumerate(group):
                for x, step in zip(phrase.lexemes, phrase.steps, strict=True):
                    yield g, p, x, step, phrase.wanted


def register(spark: SparkSession, chunks: DataFrame, documents: DataFrame | None = None, indexes: DataFrame | None = None, envelopes: DataFrame | None = None) -> list[str]:
    """Make the views and functions; their names. Views of tables that are not given are left out. `chunks` and
    `documents` share document_id; chunks hold what `match_corpus_chunks` filters by."""
    made = {"corpus_chunks": chunks}
    if documents is not None:
        made["corpus_documents"] = documents
        made["corpus_chunks_detail"] = views.chunk_detail(chunks, documents)
        if indexes is not None:
            made["corpus_documents_summary"] = views.document_summary(documents, chunks, indexes)
    if envelopes is not None:
        made["corpus_run_summary"] = views.run_summary(envelopes)
    for name, rows in made.items():
        rows.createOrReplaceTempView(name)
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for head, body in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("corpus_lexemes", CorpusLexemes)
    spark.udtf.register("search_terms", SearchTerms)
    return [*made, *(h.split("(")[0] for h in (*SCALARS, *TABLES)), "corpus_lexemes", "search_terms"]
