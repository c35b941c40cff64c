"""All named queries and their SQL."""

from docprov.plans import document_queries, ingest_queries, search_queries, state_queries  # noqa: F401  they fill the tables below
from docprov.plans.search_queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
