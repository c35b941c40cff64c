"""More named queries: queues, workflow, dashboards, access, names and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docprov.functions import text
from docprov.operators import access, jobs, parse, store, views, workflow
from docprov.plans.search_queries import AS_OF, as_of, query, t
from docprov.session import shared_folder
from docprov.sources import export
from docprov.streaming import worker


def statuses(key: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (key % len(names) + 1).cast("int"))


def status_sql(key: str, names: tuple[str, ...]) -> str:
    return f"(['{"', '".join(names)}'])[({key} % {len(names)} + 1)::INT]"


CHUNKS = ("pending", "processing", "complete", "failed", "stale")


def embedding_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return t(spark, sf_dir, "orders").select(
        k.alias("id"), statuses(k, CHUNKS).alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), (F.col("o_orderdate") + F.expr("INTERVAL 2 DAY")).cast("timestamp").alias("lease_expires_at"),
        (k % 9 != 0).alias("is_active"), F.concat(F.lit("run"), (k % 4).cast("string")).alias("run_id"), F.lit("auth").alias("authority_id"), F.lit(None).cast("string").alias("error"),
    )


STATE = f"""WITH s AS (SELECT o_orderkey AS id, {status_sql('o_orderkey', CHUNKS)} AS status, o_orderdate AS updated_at, o_orderdate + INTERVAL 2 DAY AS lease_expires_at, o_orderkey % 9 <> 0 AS is_active, 'run' || (o_orderkey % 4) AS run_id FROM orders),
picked AS (SELECT id FROM s WHERE is_active AND (status IN ('pending', 'stale') OR status = 'processing' AND lease_expires_at < TIMESTAMP '{AS_OF}') ORDER BY updated_at, id LIMIT 50)
"""


@query(STATE + "SELECT id, status AS was FROM s WHERE id IN (SELECT id FROM picked)")
def claim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = embedding_state(spark, sf_dir)
    after = store.claim(before, as_of()).where("claimed").select("id")
    return before.join(F.broadcast(after), "id").select("id", F.col("status").alias("was"))


@query(STATE + f"SELECT CASE WHEN s.id IN (SELECT id FROM picked) THEN 'processing' ELSE status END AS status, count(*) AS n, max(CASE WHEN s.id IN (SELECT id FROM picked) THEN TIMESTAMP '{AS_OF}' + INTERVAL 600 SECOND ELSE lease_expires_at END) AS last_lease FROM s GROUP BY 1")
def lease_expired_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.claim(embedding_state(spark, sf_dir), as_of()).groupBy("status").agg(F.count("*").alias("n"), F.max("lease_expires_at").alias("last_lease"))


@query(f"""WITH s AS (SELECT o_orderkey AS id, {status_sql('o_orderkey', CHUNKS)} AS status, o_orderdate + INTERVAL 2 DAY AS lease_expires_at, o_orderkey % 4 AS run FROM orders),
r AS (SELECT *, id % 2 = 0 AS has, id % 3 <> 0 AS ok, CASE WHEN id % 7 = 0 THEN 9 ELSE run END AS r_run FROM s),
a AS (SELECT *, has AND status = 'processing' AND run = r_run AND (lease_expires_at > TIMESTAMP '1995-01-01' OR NOT ok) AS accepted FROM r)
SELECT CASE WHEN accepted THEN CASE WHEN ok THEN 'complete' ELSE 'failed' END ELSE status END AS status, accepted, count(*) AS n FROM a GROUP BY 1, 2""")
def complete_fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = embedding_state(spark, sf_dir)
    results = state.where(F.col("id") % 2 == 0).select("id", F.when(F.col("id") % 7 == 0, "run9").otherwise(F.col("run_id")).alias("run_id"), "authority_id", (F.col("id") % 3 != 0).alias("ok"), F.lit("boom").alias("error"))
    return store.settle(state, results, F.lit("1995-01-01").cast("timestamp")).groupBy("status", "accepted").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey AS request, CASE WHEN s_suppkey % 10 = 0 THEN 'triggered_by must not be empty' WHEN a.n_nationkey IS NULL THEN 'authority not found' WHEN a.n_nationkey % 5 = 0 THEN 'authority is not active' WHEN a.n_regionkey = 1 THEN 'authority environment must be vpc'
WHEN p.r_regionkey IS NULL THEN 'policy not found' WHEN p.r_regionkey = 4 THEN 'policy is not active' WHEN p.r_regionkey = 3 THEN 'policy scope must be vpc' WHEN s_suppkey % 3 = 0 AND o.n_nationkey IS NULL THEN 'organization not found' END AS reason
FROM supplier LEFT JOIN nation a ON a.n_nationkey = s_nationkey + 1 LEFT JOIN region p ON p.r_regionkey = s_suppkey % 7 LEFT JOIN nation o ON o.n_nationkey = s_suppkey % 40""")
def run_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = t(spark, sf_dir, "nation"), F.col("s_suppkey")
    requests = t(spark, sf_dir, "supplier").select(
        k.alias("request"), F.concat(F.lit("run"), k.cast("string")).alias("run_id"), F.when(k % 10 == 0, " ").otherwise("cli").alias("triggered_by"), (F.col("s_nationkey") + 1).cast("long").alias("embedding_authority_id"),
        (k % 7).alias("egress_policy_id"), F.when(k % 3 == 0, k % 40).alias("organization_id"),
    )
    authorities = n.select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") % 5 != 0).alias("is_active"), F.when(F.col("n_regionkey") == 1, "public").otherwise("vpc").alias("environment"))
    policies = t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), (F.col("r_regionkey") != 4).alias("is_active"), F.when(F.col("r_regionkey") == 3, "any").otherwise("vpc").alias("scope"))
    return store.run_gate(requests, authorities, policies, n.select(F.col("n_nationkey").cast("long").alias("id"))).select("request", "reason")


@query("""SELECT o_orderkey AS document_id, count(l_orderkey) AS total_chunks, count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'N') AS processing_chunks, count(*) FILTER (l_returnflag = 'A') AS complete_chunks, count(*) FILTER (l_returnflag = 'R') AS failed_chunks, max(o_orderpriority) AS latest_embedding_model
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def coverage_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "complete").when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "F", "processing").otherwise("pending")
    chunks = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), status.alias("embedding_status"))
    docs = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"))
    indexes = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("model"), F.col("o_orderdate").alias("created_at"))
    return views.document_summary(docs, chunks, indexes).select("document_id", "total_chunks", "processing_chunks", "complete_chunks", "failed_chunks", "latest_embedding_model")


@query("SELECT c_custkey AS document_id, (SELECT o_orderpriority FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderpriority DESC LIMIT 1) AS latest_embedding_model, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS total_chunks FROM customer")
def latest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"))
    indexes = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("model"), F.col("o_orderdate").alias("created_at"))
    chunks = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.lit("pending").alias("embedding_status"))
    return views.document_summary(docs, chunks, indexes).select("document_id", "latest_embedding_model", "total_chunks")


@query("SELECT l_linenumber AS sequence, o_orderpriority AS tier, count(*) AS chunks FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def chunk_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("tier"))
    chunks = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("sequence"))
    return views.chunk_detail(chunks, docs).groupBy("sequence", "tier").agg(F.count("*").alias("chunks"))


@query("""SELECT user_id % 10 AS run_id, event_type AS action, 'cli' AS triggered_by, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 3 END AS user_id, min(ts) AS first_started_at, max(ts) AS last_completed_at, count(*) AS envelopes, count(*) FILTER (event_id % 2 = 0) AS valid, count(*) FILTER (event_id % 5 = 0) AS errors,
coalesce(sum(event_id % 7), 0)::BIGINT AS chunks, coalesce(sum(event_id % 4), 0)::BIGINT AS embedded, max(event_id % 1000) AS max_duration_ms FROM events GROUP BY 1, 2, 3, 4""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    rows = t(spark, sf_dir, "events").select(
        (u % 10).alias("run_id"), F.col("event_type").alias("action"), F.lit("cli").alias("triggered_by"), F.when(u % 3 != 0, u % 3).alias("user_id"), F.col("ts").alias("started_at"), F.col("ts").alias("completed_at"),
        (i % 2 == 0).alias("validation_valid"), F.when(i % 5 == 0, "x").alias("error"), (i % 7).alias("chunk_count"), (i % 4).alias("embedded_count"), (i % 1000).alias("duration_ms"),
    )
    return views.run_summary(rows)


@query("SELECT count(*) AS total, count(*) FILTER (doc_id % 3 <> 0) AS valid, count(*) FILTER (doc_id % 4 < 2) AS ingested, sum(doc_id % 5)::BIGINT AS embedded, count(*) FILTER (doc_id % 3 = 0) AS errors FROM documents")
def pipeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return views.pipeline_summary(t(spark, sf_dir, "documents").select((i % 3 != 0).alias("valid"), statuses(i, ("inserted", "updated", "unchanged", "skipped")).alias("action"), (i % 5).alias("embedded"), F.when(i % 3 == 0, "x").alias("error")))


@query("SELECT (json_extract(props, '$.k'))::INT AS document, max(event_id) AS id, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1")
def latest_job_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("int").alias("document"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return jobs.latest(rows, "document").select("document", "id", "kind")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def snapshot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.skip_repeats(t(spark, sf_dir, "events"), "user_id", "event_type", "event_id").select("user_id", "event_id", "event_type")


NAMES = ("upload.txt", "upload", "upload.md", "report.pdf", "Upload.txt")


@query(f"""WITH d AS (SELECT doc_id AS id, source AS session_id, {status_sql('doc_id', NAMES)} AS f FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY session_id, f ORDER BY id) AS n FROM d)
SELECT id, CASE WHEN regexp_matches(f, '^upload(\\.[A-Za-z0-9]+)?$') AND n > 1 THEN 'upload-' || n || CASE WHEN f = 'upload' THEN '.txt' ELSE f[7:] END ELSE f END AS source_filename FROM n""")
def dup_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("session_id"), statuses(F.col("doc_id"), NAMES).alias("source_filename"), F.lit(0).alias("created_at"))
    return workflow.renamed(docs).select("id", "source_filename")


JOBS = ("pending", "in_progress", "completed", "failed")


def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return t(spark, sf_dir, "events").select(
        i.alias("id"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("payload"), statuses(i, JOBS).alias("status"), F.col("ts").cast("timestamp").alias("visible_at"),
        (i % 5).cast("int").alias("retry_count"), F.lit(3).alias("max_retries"), F.lit(None).cast("string").alias("error"),
    )


J = f"WITH middle AS (SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) AS m FROM events), j AS (SELECT event_id AS id, event_type AS kind, json_extract_string(props, '$.k') AS payload, {status_sql('event_id', JOBS)} AS status, ts AS visible_at, (event_id % 5)::INT AS retry_count FROM events)\n"


def middle(spark: SparkSession, sf_dir: str) -> Column:
    """Halfway between the first and the last event, as the present."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = t(spark, sf_dir, "events").agg(F.min(micros), F.max(micros)).first()
    return F.timestamp_micros(F.lit((ends[0] + ends[1]) // 2))


@query(J + "SELECT id, retry_count + 1 AS retry_count FROM j, middle WHERE status = 'pending' AND visible_at <= m ORDER BY id LIMIT 5")
def job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.claim(job_state(spark, sf_dir), middle(spark, sf_dir), 5).where("claimed").select("id", "retry_count")


@query(J + "SELECT status2 AS status, count(*) AS n, max(CASE WHEN status2 = 'pending' AND status = 'in_progress' THEN wait END) AS longest FROM (SELECT *, CASE WHEN status = 'in_progress' AND id % 3 = 0 THEN CASE WHEN retry_count >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status2, (10 * pow(2, greatest(retry_count - 1, 0)))::BIGINT AS wait FROM j) GROUP BY 1")
def job_fail_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = job_state(spark, sf_dir)
    now = F.lit(AS_OF).cast("timestamp")
    after = jobs.fail(state, state.where(F.col("id") % 3 == 0).select("id", F.lit("boom").alias("error")), now)
    was = state.select("id", F.col("status").alias("was"))
    wait = F.when((F.col("status") == "pending") & (F.col("was") == "in_progress"), F.unix_seconds("visible_at") - F.unix_seconds(now))
    return after.join(was, "id").groupBy("status").agg(F.count("*").alias("n"), F.max(wait).alias("longest"))


@query(J + "SELECT CASE WHEN status = 'in_progress' AND visible_at < m THEN CASE WHEN retry_count >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status, count(*) AS n, count(*) FILTER (status = 'in_progress' AND visible_at < m AND retry_count >= 3) AS expired FROM j, middle GROUP BY 1")
def job_reap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.reap(job_state(spark, sf_dir), middle(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("error") == jobs.EXPIRED).alias("expired"))


@query(J + "SELECT CASE WHEN id IN (SELECT max(id) FROM j WHERE status IN ('pending', 'in_progress') GROUP BY payload) THEN 'failed' ELSE status END AS status, count(*) AS n FROM j GROUP BY 1")
def job_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.cancel(job_state(spark, sf_dir), "payload").groupBy("status").agg(F.count("*").alias("n"))


DOCS = ("pending", "parsing", "parsed", "edited", "chunked", "watermarked", "failed")


def state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    docs = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    docs = docs.select(
        k.alias("id"), F.col("o_custkey").alias("session_id"), F.col("c_name").alias("session_name"), F.concat(F.col("o_orderpriority"), F.lit(".pdf")).alias("source_filename"), F.col("o_orderstatus").alias("title"), F.array("c_mktsegment").alias("frameworks"),
        statuses(k, DOCS).alias("status"), (k % 2 == 0).alias("promoted"), (F.col("o_custkey") % 3 == 0).alias("crosswalk"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.when(k % 14 == 6, " no text ").alias("error_message"), (k % 5 != 0).alias("chunks_marked"),
    )
    return workflow.dashboard_rows(docs, as_of())


ROWS = f"""WITH d AS (SELECT o_orderkey AS id, o_custkey AS session_id, c_name AS session_name, o_orderpriority || '.pdf' AS source_filename, o_orderstatus AS title, c_mktsegment AS framework, {status_sql('o_orderkey', DOCS)} AS status, o_orderkey % 2 = 0 AS promoted, o_custkey % 3 = 0 AS crosswalk,
  o_orderdate AS updated_at, CASE WHEN o_orderkey % 14 = 6 THEN 'no text' ELSE 'Processing failed' END AS err, o_orderkey % 5 <> 0 AS chunks_marked, epoch(TIMESTAMP '{AS_OF}' - o_orderdate) / 3600.0 AS h FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT *, CASE WHEN status = 'failed' THEN 'failed' WHEN status IN ('pending', 'parsing') THEN 'parse' WHEN status IN ('parsed', 'edited') THEN 'chunk' WHEN status = 'chunked' THEN 'watermark' WHEN NOT promoted THEN 'promote' WHEN NOT crosswalk THEN 'crosswalk' ELSE 'ready' END AS stage FROM d),
w AS (SELECT *, stage IN ('parse', 'chunk', 'watermark', 'promote') AND h >= CASE WHEN stage = 'parse' THEN 1 ELSE 24 END AS is_stale, CASE WHEN stage IN ('parse', 'chunk', 'watermark', 'promote') THEN greatest(0, floor(h))::BIGINT ELSE 0 END AS stale_hours FROM s),
rows_ AS (SELECT *, CASE WHEN status = 'failed' THEN err WHEN NOT is_stale THEN NULL WHEN stage = 'parse' THEN 'Parsing appears stalled (' || stale_hours || 'h since update)' WHEN stage = 'chunk' THEN 'Needs chunking (' || stale_hours || 'h pending)' WHEN stage = 'watermark' THEN 'Needs watermarking (' || stale_hours || 'h pending)' WHEN stage = 'promote' THEN 'Watermarked but not promoted (' || stale_hours || 'h pending)' END AS attention_reason FROM w)
"""


@query(ROWS + "SELECT id, stage FROM rows_")
def doc_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_rows(spark, sf_dir).select("id", "stage")


@query(ROWS + "SELECT id, is_stale, stale_hours FROM rows_")
def doc_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_rows(spark, sf_dir).select("id", "is_stale", "stale_hours")


@query(ROWS + "SELECT id, attention_reason FROM rows_ WHERE attention_reason IS NOT NULL")
def attention_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.filtered(state_rows(spark, sf_dir), preset="attention").select("id", "attention_reason")


@query(ROWS + "SELECT id, stage FROM rows_ WHERE contains(lower(source_filename), 'urgent') AND framework = 'BUILDING' ORDER BY stage, updated_at DESC, id LIMIT 20 OFFSET 20")
def dashboard_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = workflow.filtered(state_rows(spark, sf_dir), " Urgent ", framework="BUILDING")
    return workflow.page_of(rows, "stage", False, 2, 20)[0].select("id", "stage")


N = "count(*) AS total, count(*) FILTER (attention_reason IS NOT NULL) AS attention, count(*) FILTER (stage IN ('parse', 'chunk', 'watermark')) AS in_progress, count(*) FILTER (stage IN ('ready', 'crosswalk')) AS ready, count(*) FILTER (stage = 'failed') AS failed, count(*) FILTER (is_stale) AS stale"


@query(ROWS + f"SELECT {N} FROM rows_ WHERE contains(lower(source_filename), 'high')")
def dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.summary(workflow.filtered(state_rows(spark, sf_dir), "high"))


@query(ROWS + f"SELECT c_custkey AS session_id, coalesce(total, 0) AS total, coalesce(attention, 0) AS attention, coalesce(in_progress, 0) AS in_progress, coalesce(ready, 0) AS ready, coalesce(failed, 0) AS failed, coalesce(stale, 0) AS stale FROM customer LEFT JOIN (SELECT session_id, {N} FROM rows_ GROUP BY 1) ON session_id = c_custkey")
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.session_rollup(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id")), state_rows(spark, sf_dir))


@query(ROWS + "SELECT count(*) FILTER (status = 'failed') AS parse_eligible, count(*) FILTER (stage = 'chunk') AS chunk_eligible, count(*) FILTER (stage = 'watermark') AS watermark_eligible, count(*) FILTER (stage = 'ready') AS complete, count(*) FILTER (status = 'failed') AS failed FROM rows_")
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.action_counts(state_rows(spark, sf_dir))


PCT = lambda f: f"floor(100.0 * count(*) FILTER ({f}) / count(*) + 0.5)::BIGINT"
KPI = ROWS + f"""SELECT session_id, {PCT("status IN ('parsed', 'edited', 'chunked', 'watermarked')")} AS parse_accuracy, {PCT("status IN ('chunked', 'watermarked')")} AS chunk_coverage,
{PCT("status = 'watermarked' AND chunks_marked")} AS watermark_integrity, {PCT("status = 'watermarked' AND promoted")} AS promotion_readiness FROM rows_ GROUP BY 1"""


@query(f"SELECT *, floor((parse_accuracy + chunk_coverage + watermark_integrity + promotion_readiness) / 4.0 + 0.5)::BIGINT AS overall FROM ({KPI})")
def quality_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.quality(state_rows(spark, sf_dir)).select("session_id", "parse_accuracy", "chunk_coverage", "watermark_integrity", "promotion_readiness", "overall")


@query(ROWS + """SELECT session_id, count(*) = count(*) FILTER (status IN ('parsed', 'edited', 'chunked', 'watermarked')) AS parse_gate, count(*) = count(*) FILTER (status = 'watermarked') AS watermark_gate,
((count(*) < 2)::INT + (count(*) <> count(*) FILTER (status IN ('parsed', 'edited', 'chunked', 'watermarked')))::INT + (count(*) <> count(*) FILTER (status IN ('chunked', 'watermarked')))::INT + (count(*) <> count(*) FILTER (status = 'watermarked'))::INT
 + (count(*) <> count(*) FILTER (status = 'watermarked' AND promoted))::INT + (count(*) FILTER (status = 'watermarked' AND promoted) < 2)::INT)::INT AS n_blockers,
CASE WHEN bool_or(crosswalk) THEN 5 WHEN bool_and(status = 'watermarked') THEN 4 WHEN bool_or(status = 'watermarked') THEN 3 WHEN bool_or(status = 'chunked') THEN 2 ELSE 1 END AS step FROM rows_ GROUP BY 1""")
def workflow_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.quality(state_rows(spark, sf_dir)).select("session_id", "parse_gate", "watermark_gate", F.size("blockers").alias("n_blockers"), "step")


SESSIONS = ("uploading", "complete", "uploading", "crosswalk_done")


def session_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    created = F.when(k % 2 == 0, F.lit("1995-12-31 23:45:00")).otherwise(F.lit("1995-12-30 00:00:00")).cast("timestamp")
    sessions = t(spark, sf_dir, "customer").select(k.alias("session_id"), statuses(k, SESSIONS).alias("status"), created.alias("created_at"), (k % 5 == 0).alias("has_crosswalk"))
    docs = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), statuses(F.col("o_orderkey"), DOCS).alias("status"))
    return sessions, docs


S = f"""WITH d AS (SELECT o_custkey AS session_id, count(*) FILTER ({status_sql('o_orderkey', DOCS)} IN ('pending', 'parsing')) AS waiting FROM orders GROUP BY 1),
s AS (SELECT c_custkey AS session_id, {status_sql('c_custkey', SESSIONS)} AS status, c_custkey % 2 = 0 AS is_new, c_custkey % 5 = 0 AS cw, waiting FROM customer LEFT JOIN d ON d.session_id = c_custkey)
"""


@query(S + "SELECT session_id, CASE WHEN status = 'uploading' AND waiting IS NOT NULL AND cw THEN 'crosswalk_done' WHEN status = 'uploading' AND waiting = 0 THEN 'complete' ELSE status END AS status FROM s WHERE NOT (status = 'uploading' AND waiting IS NULL AND NOT is_new)")
def reconcile_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.reconciled(*session_state(spark, sf_dir), as_of()).select("session_id", "status")


@query(S + "SELECT count(*) AS deleted FROM s WHERE status = 'uploading' AND waiting IS NULL AND NOT is_new")
def stale_empty_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions, docs = session_state(spark, sf_dir)
    kept = workflow.reconciled(sessions, docs, as_of()).select("session_id")
    return sessions.join(kept, "session_id", "left_anti").agg(F.count("*").alias("deleted"))


@query(f"SELECT CASE WHEN {status_sql('doc_id', DOCS)} <> 'watermarked' THEN 'error: not watermarked' WHEN doc_id % 3 = 0 THEN 'insert' WHEN doc_id % 3 = 1 THEN 'update' ELSE 'error: held by another document' END AS action, count(*) AS n FROM documents GROUP BY 1")
def promote_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    docs = t(spark, sf_dir, "documents")
    library = docs.where(i % 3 != 0).select(F.lit("u").alias("user_id"), F.concat(F.lit("c"), i.cast("string")).alias("corpus_id"), F.when(i % 3 == 1, i).otherwise(-i).alias("source_document_id"))
    candidates = docs.select(F.lit("u").alias("user_id"), F.concat(F.lit("c"), i.cast("string")).alias("corpus_id"), i.alias("document_id"), statuses(i, DOCS).alias("status"))
    return store.promoted(candidates, library).groupBy("action").agg(F.count("*").alias("n"))


@query(f"SELECT source AS session_id, count(*) FILTER ({status_sql('doc_id', DOCS)} = 'watermarked' AND doc_id % 2 = 0) >= 2 AS crosswalk_ready FROM documents GROUP BY 1")
def crosswalk_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), statuses(F.col("doc_id"), DOCS).alias("status"), (F.col("doc_id") % 2 == 0).alias("promoted"))
    return parse.crosswalk_ready(docs)


def org_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    rows = t(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 3 != 0, F.col("c_nationkey").cast("long")).alias("organization_id"), (k % 4 != 0).alias("is_active"))
    members = t(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.lit("u1").alias("user_id"), F.col("n_nationkey").cast("long").alias("organization_id"), F.lit("member").alias("role"))
    return rows, members


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)")
def rls_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.visible(*org_rows(spark, sf_dir), access.Principal("u1", "member")).select("id")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 4 <> 0")
def rls_anonymous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.visible(*org_rows(spark, sf_dir), access.Principal()).select("id")


@query("SELECT s_suppkey, s_name FROM supplier")
def safe_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.safe_sources(t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").alias("connection_config")))


@query("SELECT o_orderkey AS id, o_custkey AS session_id FROM orders WHERE o_custkey % 2 = 0")
def public_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 2 == 0).alias("is_public"))
    docs = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), F.lit("x").alias("source_text"))
    return access.public_documents(docs, sessions).select("id", "session_id")


@query("SELECT c_custkey + 3 AS session_id, CASE WHEN c2.k IS NULL THEN 404 WHEN c2.k % 2 = 0 THEN 403 ELSE 200 END AS code FROM customer LEFT JOIN (SELECT c_custkey AS k FROM customer) c2 ON c2.k = c_custkey + 3")
def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer")
    sessions = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "u2").otherwise("u1").alias("created_by"))
    return access.ownership(c.select((F.col("c_custkey") + 3).alias("session_id")), sessions, access.Principal("u1", "member"))


@query("SELECT doc_id, sha256(text) AS body_hash FROM documents")
def fence_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Here:\n```markdown\n"), "text", F.lit("\n```\nDone")).alias("said"))
    return docs.select("doc_id", text.sha256(text.fenced(F.col("said"))).alias("body_hash"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:80] AS slug FROM part")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", text.kebab(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(source[1]) || lower(source[2:]) || ' Notes' ELSE trim(string_split(text, chr(10))[1])[1:120] END AS title FROM documents")
def infer_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("_notes.MD")))
    return t(spark, sf_dir, "documents").select("doc_id", text.inferred_title(name, F.col("text")).alias("title"))


@query("SELECT lang, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' ELSE lang END AS configuration, count(*) AS n FROM documents GROUP BY 1, 2")
def language_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").groupBy("lang", text.language(F.upper("lang")).alias("configuration")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'org' || doc_id END, 'no-org') || '/' || source || '/' || doc_id || '/' || regexp_replace(string_split(text, chr(10))[1], '[^a-zA-Z0-9._-]', '_', 'g')[1:200] AS path FROM documents")
def storage_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    org = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("org"), i))
    return t(spark, sf_dir, "documents").select("doc_id", text.storage_path(org, F.col("source"), i, F.split("text", "\n")[0]).alias("path"))


@query(f"SELECT 'documents/' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '-c' || doc_id || '.md' AS path, sha256(text) AS content_hash FROM documents WHERE {status_sql('doc_id', DOCS)} IN ('parsed', 'edited', 'chunked', 'watermarked') UNION ALL SELECT p || '/c' || doc_id || '/000-the-title.md', sha256(trim(text, ' ' || chr(10))) FROM documents, (VALUES ('chunks'), ('chunks-clean')) x(p) WHERE {status_sql('doc_id', DOCS)} = 'watermarked'")
def bundle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.concat(F.lit("c"), i.cast("string")).alias("corpus_id")
    rows = t(spark, sf_dir, "documents")
    docs = rows.select(name, (i % 100).alias("position"), statuses(i, DOCS).alias("status"), F.col("text").alias("markdown"))
    chunks = rows.select(name, F.lit(0).alias("sequence"), F.lit("The Title!").alias("section_title"), text.trimmed(F.col("text")).alias("content"))
    return export.bundle(docs, chunks).select("path", text.sha256(F.col("content")).alias("content_hash"))


RECEIPT = f"""'{{"position":' || doc_id || ',"corpus_id":"c' || doc_id || '","status":"' || {status_sql('doc_id', DOCS)} || '","content_hash":"' || sha256(text) || '"}}'"""


@query(f"""SELECT doc_id // 10 AS session_id, '{{"session":' || (doc_id // 10) || ',"documents":' || count(*) || ',"items":[' || string_agg({RECEIPT}, ',' ORDER BY doc_id) || ']}}' AS receipt FROM documents GROUP BY 1""")
def session_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of ten documents."""
    i = F.col("doc_id")
    docs = t(spark, sf_dir, "documents").select(F.floor(i / 10).alias("session_id"), i.alias("position"), F.concat(F.lit("c"), i.cast("string")).alias("corpus_id"), statuses(i, DOCS).alias("status"), text.sha256(F.col("text")).alias("content_hash"))
    return export.receipt(docs)


@query("SELECT DISTINCT p_brand AS facet FROM part UNION SELECT DISTINCT p_type FROM part")
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.facets(t(spark, sf_dir, "part"), "p_brand", "p_type")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream, each once, and counted from what it wrote."""
    import uuid

    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    source = f"{sf_dir}/events.parque[t]"  # as a pattern, a single file will do too
    stream = worker.ingest(spark, source, t(spark, sf_dir, "events").schema, f"{folder}/out", f"{folder}/state", lambda s: s.select("event_id", "event_type"))
    stream.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"))
