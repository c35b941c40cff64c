"""docprov: provenance-aware document corpora as Spark jobs."""
