"""Functions and views called from SQL."""

import pytest
from pyspark.sql import functions as F

from docprov import sql
from docprov.functions import text, vectors, watermark
from docprov.operators import fulltext, retrieval

CHUNK = "id string, document_id string, corpus_id string, section_title string, content string, tier string, frameworks array<string>, industries array<string>, segments array<string>, organization_id string, embedding array<double>, embedding_status string, is_active boolean, sequence int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = []
    for i in range(40):
        rows.append((f"c{i}", f"d{i % 5}", f"k{i % 5}", "T", f"The policy  number {i}", f"tier_{i % 3}", ["gdpr"] if i % 2 else ["*"], ["law"] if i % 3 else ["finance"], ["all"], None if i % 4 else f"o{i % 8}", [1.0, i / 10.0, -0.5], "complete" if i % 7 else "pending", i % 11 != 0, i))
    path = str(tmp_path_factory.mktemp("sql") / "chunks")
    spark.createDataFrame(rows, CHUNK).write.parquet(path)
    chunks = spark.read.parquet(path)
    documents = spark.createDataFrame([(f"d{i}", f"Title {i}") for i in range(6)], "document_id string, title string")
    indexes = spark.createDataFrame([("d1", "2024-01-01", "old"), ("d1", "2024-02-01", "new")], "document_id string, created_at string, model string")
    envelopes = spark.createDataFrame([("r", "ingest", "cli", None, "2024-01-01", "2024-01-02", True, None, 3, 2, 5)], "run_id string, action string, triggered_by string, user_id string, started_at string, completed_at string, validation_valid boolean, error string, chunk_count long, embedded_count long, duration_ms long")
    names = sql.register(spark, chunks, documents, indexes, envelopes)
    return names, chunks


def test_every_name_can_be_called(spark, tables):
    names, chunks = tables
    assert len(names) == len(set(names)) == 12
    for view in ("corpus_chunks", "corpus_documents", "corpus_chunks_detail", "corpus_documents_summary", "corpus_run_summary"):
        assert spark.sql(f"SELECT * FROM {view}").count() > 0
    got = {r.document_id: (r.total_chunks, r.latest_embedding_model) for r in spark.sql("SELECT * FROM corpus_documents_summary").collect()}
    assert got["d1"] == (8, "new") and got["d5"] == (0, None)


def test_scalars_equal_the_column_functions(spark, tables):
    _, chunks = tables
    told = chunks.select("id", text.word_count(F.col("content")).alias("w"), text.token_estimate(F.col("content")).alias("t"), F.round(vectors.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in (1.0, 2.0, 0.0)])), 9).alias("c"), watermark.signature(F.col("corpus_id"), F.col("sequence"), text.sha256(F.col("content"))).alias("s"))
    got = spark.sql("SELECT id, corpus_word_count(content) AS w, corpus_token_estimate(content) AS t, round(cosine_similarity(embedding, array(1D, 2D, 0D)), 9) AS c, watermark_signature(corpus_id, sequence, sha2(content, 256)) AS s FROM corpus_chunks")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, told.collect()))
    assert spark.sql("SELECT corpus_word_count(NULL), cosine_similarity(array(0D), array(1D))").first()[:] == (0, None)


@pytest.mark.parametrize(
    ("call", "filters"),
    [
        ("array(1D, 1D, 0D), 0.2D", {}),
        ("array(1D, 1D, 0D), 0.2D, filter_frameworks => array('gdpr')", {"overlaps": {"frameworks": ["gdpr"]}}),
        ("array(1D, 1D, 0D), 0.2D, filter_tier => 'tier_1', filter_industries => array('law')", {"overlaps": {"industries": ["law"]}, "equals": {"tier": "tier_1"}}),
        ("array(1D, 1D, 0D), 0.2D, filter_organization_id => 'o4', filter_corpus_ids => array('k1', 'k3', 'k4')", {"among": {"corpus_id": ["k1", "k3", "k4"]}, "organization": "o4"}),
    ],
)
def test_the_table_function_finds_what_semantic_search_finds(spark, tables, call, filters):
    _, chunks = tables
    own = retrieval.Filters(**filters)
    want = retrieval.semantic(chunks.where(own.column("organization_id")), [1.0, 1.0, 0.0], own, 0.2, 6, key="id").select("id", F.round("similarity", 9).alias("s")).collect()
    got = spark.sql(f"SELECT id, round(similarity, 9) AS s FROM match_corpus_chunks({call}) ORDER BY similarity DESC, id LIMIT 6")
    assert list(map(tuple, got.collect())) == list(map(tuple, want)) and want


def test_filters_reach_the_scan_below_the_function(spark, tables):
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = spark.sql("SELECT id, similarity FROM match_corpus_chunks(array(1D, 1D, 0D)) WHERE corpus_id = 'k1' ORDER BY similarity DESC LIMIT 3")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", before)
    scan = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "EqualTo(corpus_id,k1)" in scan and "EqualTo(embedding_status,complete)" in scan and "TakeOrderedAndProject" in plan and "section_title" not in scan.split("ReadSchema")[1]


def test_table_functions_in_python(spark, tables):
    got = spark.sql("SELECT l.* FROM (SELECT 'A Policy' AS t, 'running the red' AS c) x, LATERAL corpus_lexemes(x.t, x.c, 'english') l").collect()
    assert [tuple(r) for r in got] == fulltext.places("A Policy", "running the red", "english")
    got = spark.sql("""SELECT * FROM search_terms('data "privacy policy" OR -tax')""").collect()
    assert [tuple(r) for r in got] == [(0, 0, "data", 0, True), (0, 1, "privaci", 0, True), (0, 1, "polici", 1, True), (1, 0, "tax", 0, False)]
