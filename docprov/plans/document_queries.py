"""More named queries: drafts, parsing, envelopes, slugs, identifiers and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprov.functions import ids, text, vectors
from docprov.operators import access, chunk, drafts, jobs, parse, store, validate, workflow
from docprov.plans.search_queries import query, t
from docprov.plans.state_queries import DOCS, JOBS, ROWS, job_state, state_rows, status_sql, statuses
from docprov.sources import envelopes

DRAFTS = ("parsing", "parsed", "failed", "approved", "rejected")


def draft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    none = F.lit(None).cast("string")
    return t(spark, sf_dir, "documents").select(
        i.cast("string").alias("id"), F.lit("x.txt").alias("source_filename"), F.col("text").alias("source_text"), text.sha256(F.col("text")).alias("source_hash"), statuses(i, DRAFTS).alias("status"),
        F.when(i % 7 != 0, F.col("text")).alias("parsed_markdown"), F.when(i % 4 == 0, F.concat(F.lit("edited "), "text")).alias("user_markdown"), none.alias("reviewer_notes"), none.alias("document_id"), F.lit("u").alias("created_by"),
    )


@query("""WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), f AS (SELECT *, h NOT IN (SELECT h FROM d WHERE doc_id % 3 = 0) AND doc_id::VARCHAR = min(doc_id::VARCHAR) OVER (PARTITION BY h) AS fresh FROM d WHERE doc_id % 3 <> 0)
SELECT doc_id::VARCHAR AS id, 'Document already submitted (duplicate source hash: ' || h[1:12] || '...)' AS error FROM f WHERE NOT fresh""")
def draft_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the documents are drafts; the others are submitted."""
    have = draft_rows(spark, sf_dir)
    new = have.where(F.col("id").cast("long") % 3 != 0).select("id", "source_filename", "source_text", "created_by")
    return drafts.submit(have.where(F.col("id").cast("long") % 3 == 0), new)[1]


@query(f"""WITH d AS (SELECT doc_id, {status_sql('doc_id', DRAFTS)} AS s, CASE WHEN doc_id % 4 = 0 THEN 'edited ' || text WHEN doc_id % 7 <> 0 THEN text END AS md FROM documents)
SELECT CASE WHEN s = 'approved' THEN 'done' WHEN s NOT IN ('parsed', 'failed') THEN s WHEN md IS NULL THEN 'empty' ELSE 'taken' END AS outcome, count(*) AS n, sum(length(md))::BIGINT AS chars FROM d GROUP BY 1""")
def draft_approve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = draft_rows(spark, sf_dir).withColumn("error", drafts.approval_error())
    e = F.col("error")
    outcome = F.when(e.isNull(), "taken").when(e.endswith("already approved"), "done").when(e.endswith("no parsed markdown"), "empty").otherwise(F.regexp_extract(e, "status '([a-z]+)'", 1))
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.sum(F.length(drafts.markdown())).alias("chars"))


@query(f"SELECT CASE WHEN doc_id % 2 = 0 THEN 'rejected' ELSE {status_sql('doc_id', DRAFTS)} END AS status, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS noted FROM documents GROUP BY 1")
def draft_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = draft_rows(spark, sf_dir)
    gone = have.where(F.col("id").cast("long") % 2 == 0).select("id", F.lit("no").alias("reviewer_notes"))
    return drafts.reject(have, gone).groupBy("status").agg(F.count("*").alias("n"), F.count("reviewer_notes").alias("noted"))


TITLE = "upper(source[1]) || lower(source[2:]) || ' Notes'"


@query(f"""WITH d AS (SELECT doc_id, {TITLE} AS title, sha256({TITLE} || chr(10) || text)[1:8] AS h FROM documents),
n AS (SELECT *, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:80] || '-' || h || '-v1' AS corpus_id FROM d)
SELECT doc_id, '---' || chr(10) || 'corpus_id: ' || corpus_id || chr(10) || 'title: ' || title || chr(10) || 'tier: ' || CASE WHEN doc_id % 3 = 0 THEN 'tier_1' ELSE 'tier_2' END || chr(10) || 'version: 1' || chr(10) || 'frameworks: [gdpr, soc2]' || chr(10) || 'industries: []' || chr(10) || 'source_url: unknown' || chr(10) || 'source_publisher: Unknown' || chr(10) || 'last_verified: 2024-05-06' AS head FROM n""")
def deterministic_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of documents put together by rule."""
    tier = F.when(F.col("doc_id") % 3 == 0, "tier_1").otherwise("tier_9")
    made = parse.deterministic_markdown(F.concat("source", F.lit("_notes.MD")), F.col("text"), F.lit("2024-05-06"), tier, F.array(F.lit("gdpr"), F.lit(""), F.lit("soc2")))
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.split(made, "\n"), 1, 10), "\n").alias("head"))


@query("""WITH d AS (SELECT doc_id // 5 AS session_id, row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id) AS n, doc_id, text FROM documents)
SELECT session_id, count(*)::INT AS documents, sha256('Generate a crosswalk mapping for the following ' || count(*) || ' corpus documents:' || chr(10) || chr(10) || string_agg(n || '. **T' || doc_id || '** (c' || doc_id || ') — tier_1, frameworks: [a, b]', chr(10) ORDER BY n) || chr(10) || chr(10)
|| string_agg('--- DOCUMENT ' || n || ': c' || doc_id || ' ---' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY n)) AS message_hash FROM d GROUP BY 1""")
def crosswalk_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of five documents."""
    i = F.col("doc_id")
    docs = t(spark, sf_dir, "documents").select(F.floor(i / 5).alias("session_id"), i.alias("position"), F.concat(F.lit("c"), i.cast("string")).alias("corpus_id"), F.concat(F.lit("T"), i.cast("string")).alias("title"), F.lit("tier_1").alias("tier"), F.array(F.lit("a"), F.lit("b")).alias("frameworks"), F.col("text").alias("markdown"))
    return parse.crosswalk_message(docs).select("session_id", "documents", text.sha256(F.col("message")).alias("message_hash"))


@query("""SELECT user_id % 10 AS run, event_type AS action, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS invalid, sum(event_id % 4)::BIGINT AS chunks, sum(CASE WHEN event_id % 2 = 0 THEN event_id % 5 END)::BIGINT AS embedded, max(event_id % 1000)::BIGINT AS longest,
count(*) FILTER (event_id % 6 = 0) AS rechunked FROM events GROUP BY 1, 2""")
def envelope_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    start = F.col("ts").cast("timestamp")
    results = t(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("run"), F.col("event_type").alias("corpus_id"), (i % 3 != 0).alias("valid"), F.array(F.lit("e")).alias("errors"), F.array(F.lit("w")).alias("warnings"), i.cast("string").alias("document_id"),
        F.lit("inserted").alias("action"), (i % 4).alias("chunk_count"), F.when(i % 2 == 0, i % 5).alias("embedded"), F.lit(0).alias("pending"), F.when(i % 6 == 0, F.lit(1)).alias("old_chunk_count"), start.alias("at"), (i % 1000).alias("ms"),
    )
    done = F.timestamp_micros(F.unix_micros("at") + F.col("ms") * 1000)
    context = envelopes.Context("r", "cli", "ingest")
    rows = envelopes.of_pipeline(results.withColumn("corpus_id", F.concat_ws("|", F.col("run").cast("string"), "corpus_id")), context, F.col("at"), done)
    key = F.split("corpus_id", r"\|")
    return rows.groupBy(F.get(key, F.lit(0)).cast("long").alias("run"), F.get(key, F.lit(1)).alias("action")).agg(
        F.count("*").alias("n"), F.count_if(F.get_json_object("validation", "$.valid") == "false").alias("invalid"), F.sum("chunk_count").alias("chunks"), F.sum(F.get_json_object("embedding", "$.embedded").cast("long")).alias("embedded"),
        F.max("duration_ms").alias("longest"), F.count("rechunk_meta").alias("rechunked"),
    )


@query("""WITH b AS (SELECT p_partkey AS id, regexp_replace(lower(regexp_replace(trim(p_brand), '[^a-zA-Z0-9]+', '-', 'g')), '^-+|-+$', '', 'g') AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM b)
SELECT id, CASE WHEN base LIKE '%1' THEN base || '-' || CASE WHEN n = 1 THEN 1 ELSE n + 1 END WHEN n = 1 THEN base ELSE base || '-' || (n - 1) END AS slug FROM n""")
def slug_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of names that end in 1 are taken, with the number 2 of them."""
    new = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))
    bare = new.where(F.col("name").endswith("1")).select(text.domain_slug(F.col("name")).alias("slug")).distinct()
    return store.slugged(new, bare.unionByName(bare.select(F.concat("slug", F.lit("-2")).alias("slug")))).select("id", "slug")


@query("SELECT o_orderkey AS id, lower(substr(lpad(printf('%x', epoch_ms(o_orderdate::TIMESTAMP)), 12, '0'), 1, 8) || '-' || substr(lpad(printf('%x', epoch_ms(o_orderdate::TIMESTAMP)), 12, '0'), 9, 4) || '-7' || m[14:16] || '-' || (['8', '9', 'a', 'b'])[(instr('0123456789abcdef', m[17:17]) - 1) % 4 + 1] || m[18:20] || '-' || m[21:32]) AS uuid FROM (SELECT *, md5(o_orderkey::VARCHAR) AS m FROM orders)")
def time_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers by time, with random bits from the key so that a rerun gives the same."""
    made = ids.uuid7(F.col("o_orderdate").cast("timestamp"), F.unhex(F.md5(F.col("o_orderkey").cast("string").cast("binary"))))
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), made.alias("uuid"))


@query(ROWS + "SELECT id FROM rows_ WHERE stage = 'watermark'")
def bulk_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages that overlap; in the first, some rows show an older state."""
    rows = state_rows(spark, sf_dir).select("id", "status", "stage")
    older = rows.where("id % 5 = 0").withColumn("status", F.lit("chunked")).withColumn("stage", F.lit("watermark"))
    return workflow.bulk_targets([older, rows], "watermark").select("id")


@query(f"""WITH d AS (SELECT {status_sql('doc_id', DOCS)} AS s, doc_id % 2 = 0 AS p FROM documents)
SELECT 'not_parsed' AS list, count(*) AS n FROM d WHERE s NOT IN ('parsed', 'edited', 'chunked', 'watermarked') UNION ALL SELECT 'not_chunked', count(*) FROM d WHERE s NOT IN ('chunked', 'watermarked')
UNION ALL SELECT 'not_watermarked', count(*) FROM d WHERE s <> 'watermarked' UNION ALL SELECT 'not_promoted', count(*) FROM d WHERE s = 'watermarked' AND NOT p""")
def left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    docs = t(spark, sf_dir, "documents").select(i.alias("id"), statuses(i, DOCS).alias("status"), (i % 2 == 0).alias("promoted"))
    return workflow.left_out(docs).groupBy("list").agg(F.count("*").alias("n"))


@query(f"""WITH j AS (SELECT DISTINCT json_extract_string(props, '$.k') AS k FROM events WHERE {status_sql('event_id', JOBS)} IN ('pending', 'in_progress')), d AS (SELECT doc_id::VARCHAR AS id, {status_sql('doc_id', DOCS)} AS s FROM documents)
SELECT CASE WHEN s IN ('pending', 'parsing') AND id IN (SELECT k FROM j) THEN 'failed' ELSE s END AS status, count(*) AS n, count(*) FILTER (s IN ('pending', 'parsing') AND id IN (SELECT k FROM j)) AS stopped FROM d GROUP BY 1""")
def documents_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    docs = t(spark, sf_dir, "documents").select(i.cast("string").alias("id"), statuses(i, DOCS).alias("status"), F.lit(None).cast("string").alias("error_message"))
    return jobs.cancelled(docs, job_state(spark, sf_dir), "payload")[0].groupBy("status").agg(F.count("*").alias("n"), F.count("error_message").alias("stopped"))


@query("SELECT l_orderkey AS ontology_id, l_linenumber AS id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 5 = 2)")
def member_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as nodes of orders, of customers, of the nations that a user belongs to."""
    nodes = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ontology_id"), F.col("l_linenumber").alias("id"))
    ontologies = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"))
    projects = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("organization_id"))
    members = t(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5).cast("string").alias("user_id"), F.col("n_nationkey").alias("organization_id"), F.lit("member").alias("role"))
    return access.nodes_of(nodes, ontologies, projects, members, access.Principal("2", "member")).select("ontology_id", "id")


@query(f"SELECT o_orderkey AS id, CASE {status_sql('o_orderkey', DOCS)} WHEN 'parsed' THEN 'Chunk Document' WHEN 'edited' THEN 'Chunk Document' WHEN 'chunked' THEN 'Watermark Chunks' WHEN 'watermarked' THEN 'Re-chunk' WHEN 'failed' THEN 'Re-parse' END AS button FROM orders")
def action_buttons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_rows(spark, sf_dir).select("id", "button")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a b.txt' ELSE 'upload-' || sha256(text)[1:8] || '.txt' END AS name FROM documents")
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 3 == 0, F.lit(" a b.txt\t")).when(F.col("doc_id") % 3 == 1, F.lit("  "))
    return t(spark, sf_dir, "documents").select("doc_id", text.source_name(name, text.sha256(F.col("text"))).alias("name"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'Missing fact_check frontmatter' WHEN c_custkey % 7 = 1 THEN 'fact_check.status must be "verified" (got "draft")' WHEN c_custkey % 7 = 2 THEN 'fact_check.checked_at must be YYYY-MM-DD (got "May 2024")'
WHEN c_custkey % 7 = 3 THEN 'fact_check.checked_by must be a non-empty string' WHEN c_custkey % 7 = 4 THEN 'fact_check.checked_at (2024-01-01) must be on/after last_verified (2024-02-01)' END AS error FROM customer""")
def fact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 7
    at = F.when(k == 2, "May 2024").when(k == 4, "2024-01-01").otherwise("2024-03-01")
    check = F.when(k != 0, F.struct(F.when(k == 1, "draft").otherwise("verified").alias("status"), at.alias("checked_at"), F.when(k == 3, " ").otherwise("me").alias("checked_by")))
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), validate.fact_check_error(check, F.lit("2024-02-01")).alias("error"))


@query("""WITH c AS (SELECT o_orderkey % 11 AS k, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END) AS n FROM orders),
f AS (SELECT CASE WHEN k = 0 THEN 'sequence below 0' WHEN k = 1 THEN 'heading level out of range' WHEN k = 2 THEN 'empty content' WHEN k = 3 THEN 'malformed hash' WHEN n > 1 THEN 'repeated title' END AS fault FROM c)
SELECT fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY 1""")
def chunk_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks of their customers, those of one priority under one title."""
    key = F.col("o_orderkey")
    k = key % 11
    chunks = t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("document_id"), F.when(k == 0, -key - 1).otherwise(key).alias("sequence"), F.col("o_orderpriority").alias("section_title"), F.when(k == 1, 9).otherwise(2).alias("heading_level"),
        F.when(k == 2, "").otherwise("text").alias("content"), F.when(k == 3, "zz").otherwise(F.sha2(key.cast("string"), 256)).alias("content_hash"),
    )
    return validate.integrity(chunks)[1].groupBy("fault").agg(F.count("*").alias("n"))


@query("SELECT vec_id, sha256('T' || vec_id || chr(10) || chr(10) || 'body') AS input_hash FROM embeddings")
def embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "embeddings").select("vec_id", vectors.input_text(F.concat(F.lit("T"), F.col("vec_id").cast("string")), F.lit("body")).alias("x"))
    return rows.select("vec_id", text.sha256(F.col("x")).alias("input_hash"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) - 1 AS sequence, sha256(regexp_replace(text, '[\\s]+$', '')) AS content_hash FROM documents")
def rechunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of four documents a group, marked, then stripped, hashed and numbered anew."""
    i = F.col("doc_id")
    chunks = t(spark, sf_dir, "documents").select("doc_id", F.floor(i / 4).alias("g"), (i * 10).alias("sequence"), F.concat("text", F.lit("\n<!-- corpus-watermark:v1:x:1:ab -->")).alias("content"))
    return chunk.rechunked(chunks, "g").select("doc_id", F.col("sequence").cast("long").alias("sequence"), "content_hash")


@query("SELECT DISTINCT l_orderkey AS document_id, l_linenumber AS sequence FROM lineitem WHERE l_linenumber > 2")
def new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are not there yet, each once."""
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("sequence"))
    return store.deduplicated(rows.unionByName(rows), rows.where("sequence <= 2"), ["document_id", "sequence"])
