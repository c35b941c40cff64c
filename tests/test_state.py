"""Snapshots, leases, queues, workflow, access and streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docprov.operators import access, jobs, store, workflow
from docprov.streaming import worker

DAY1, DAY2, DAY3 = (datetime(2024, 1, d) for d in (1, 2, 3))
DOC = "corpus_id string, version string, organization_id string, content_hash string, title string, is_active boolean"
CHUNK = "id int, status string, updated_at timestamp, lease_expires_at timestamp, is_active boolean, run_id string, authority_id string, error string"


def now():
    return F.lit("2024-01-02 00:00:00").cast("timestamp")


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def test_upsert(spark):
    old = docs(spark, [("a", "1", None, "h1", "t", True), ("b", "1", None, "h1", "t", True), ("c", "1", None, "h1", "t", True), ("c", "1", "org", "h1", "t", True), ("d", "1", None, None, "t", True)])
    new = docs(spark, [("a", "1", None, "h1", "new title", True), ("b", "1", None, "h2", "t", True), ("c", "2", None, "h3", "t", True), ("d", "1", None, "h1", "t", True)])
    assert {r.corpus_id: r.action for r in store.upsert_actions(new, old).collect()} == {"a": "unchanged", "b": "updated", "c": "inserted", "d": "updated"}
    after = {(r.corpus_id, r.version, r.organization_id): (r.content_hash, r.title, r.is_active) for r in store.upserted(new, old).collect()}
    assert after == {("a", "1", None): ("h1", "t", True), ("b", "1", None): ("h2", "t", True), ("c", "1", None): ("h1", "t", False), ("c", "2", None): ("h3", "t", True), ("c", "1", "org"): ("h1", "t", True), ("d", "1", None): ("h1", "t", True)}


def test_replacing_and_deduplicating(spark):
    old = spark.createDataFrame([("d1", 0, "x"), ("d1", 1, "y"), ("d2", 0, "z")], "document_id string, sequence int, v string")
    new = spark.createDataFrame([("d1", 0, "n")], "document_id string, sequence int, v string")
    assert sorted(map(tuple, store.chunk_upsert(new, old).collect())) == [("d1", 0, "n"), ("d1", 1, "y"), ("d2", 0, "z")]
    assert sorted(map(tuple, store.replaced(new, old).collect())) == [("d1", 0, "n"), ("d2", 0, "z")]
    more = spark.createDataFrame([("d1", 9, "a"), ("d3", 1, "b"), ("d3", 1, "b")], "document_id string, sequence int, v string")
    assert [r.document_id for r in store.deduplicated(more, old, ["document_id"]).collect()] == ["d3"]


def test_leases(spark):
    rows = [(1, "pending", DAY3, None, True), (2, "stale", DAY1, None, True), (3, "processing", DAY1, DAY1, True), (4, "processing", DAY1, DAY3, True), (5, "failed", DAY1, None, True), (6, "pending", DAY1, None, False)]
    state = spark.createDataFrame([(*r, "old", "a", "e") for r in rows], CHUNK)
    after = store.claim(state, now(), batch=2, run_id="new", authority="auth")
    got = {r.id: r for r in after.collect()}
    assert {i for i, r in got.items() if r.claimed} == {2, 3}
    assert got[2].run_id == "new" and got[2].lease_expires_at == datetime(2024, 1, 2, 0, 10) and got[2].error is None and got[1].run_id == "old"
    second = store.claim(after.drop("claimed"), now(), batch=9, run_id="more")
    assert {r.id for r in second.collect() if r.claimed} == {1}


def test_fences(spark):
    state = spark.createDataFrame([(i, "processing", DAY1, DAY3 if i < 5 else DAY1, True, "r", "a", None) for i in range(1, 8)], CHUNK)
    results = spark.createDataFrame([(1, "r", "a", True, None), (2, "x", "a", True, None), (3, "r", "x", True, None), (4, "r", "a", False, "e" * 5000), (5, "r", "a", True, None), (6, "r", "a", False, "late")], "id int, run_id string, authority_id string, ok boolean, error string")
    got = {r.id: r for r in store.settle(state, results, now()).collect()}
    assert {i: (r.status, r.accepted) for i, r in got.items()} == {1: ("complete", True), 2: ("processing", False), 3: ("processing", False), 4: ("failed", True), 5: ("processing", False), 6: ("failed", True), 7: ("processing", False)}
    assert len(got[4].error) == 4000 and got[1].lease_expires_at is None and got[7].lease_expires_at == DAY1


def test_run_gate_names_other_bindings(spark):
    requests = spark.createDataFrame([("r1", "cli", "a", "p", None), ("r2", "cli", "a", "p", None), (None, "cli", "a", "p", None)], "run_id string, triggered_by string, embedding_authority_id string, egress_policy_id string, organization_id string")
    authority, policy = spark.createDataFrame([("a", True, "vpc")], "id string, is_active boolean, environment string"), spark.createDataFrame([("p", True, "vpc")], "id string, is_active boolean, scope string")
    runs = spark.createDataFrame([("r1", "cli", "a", "p", None), ("r2", "ui", "a", "p", None)], requests.schema)
    out = {r.run_id: r.reason for r in store.run_gate(requests, authority, policy, spark.createDataFrame([], "id string"), runs).collect()}
    assert out == {"r1": None, "r2": "run exists with other bindings", None: "run_id must not be null"}


JOB = "id long, kind string, payload string, status string, visible_at timestamp, retry_count int, max_retries int, error string"


def queue(spark, rows):
    return spark.createDataFrame([(i, "k", p, s, v, n, 3, None) for i, p, s, v, n in rows], JOB)


def test_queue(spark):
    q = jobs.enqueue(queue(spark, [(1, "d1", "pending", DAY3, 0), (2, "d1", "pending", DAY1, 0)]), spark.createDataFrame([(3, "k", "d2")], "id long, kind string, payload string"), now())
    started = jobs.claim(q, now(), 5)
    assert {r.id for r in started.where("claimed").collect()} == {2, 3}
    after = {r.id: r for r in jobs.fail(started.drop("claimed"), spark.createDataFrame([(2, "boom"), (1, "no")], "id long, error string"), now()).collect()}
    assert (after[2].status, after[2].visible_at, after[2].error) == ("pending", datetime(2024, 1, 2, 0, 0, 10), "boom") and after[1].error is None
    assert {r.id: r.status for r in jobs.complete(started.drop("claimed"), spark.createDataFrame([(3,), (1,)], "id long")).collect()} == {1: "pending", 2: "in_progress", 3: "completed"}
    beat = {r.id: r.visible_at for r in jobs.heartbeat(started.drop("claimed"), spark.createDataFrame([(3,), (1,)], "id long"), now(), 60).collect()}
    assert beat[3] == datetime(2024, 1, 2, 0, 1) and beat[1] == DAY3


def test_backoff_reaping_and_cancelling(spark):
    q = queue(spark, [(1, "a", "in_progress", DAY1, 2), (2, "a", "in_progress", DAY1, 3), (3, "a", "in_progress", DAY3, 3), (4, "b", "pending", DAY1, 0)])
    failed = {r.id: r for r in jobs.fail(q, spark.createDataFrame([(1, "x"), (2, "y")], "id long, error string"), now()).collect()}
    assert (failed[1].status, failed[1].visible_at) == ("pending", datetime(2024, 1, 2, 0, 0, 20)) and failed[2].status == "failed"
    assert {r.id: (r.status, r.error) for r in jobs.reap(q, now()).collect()} == {1: ("pending", None), 2: ("failed", jobs.EXPIRED), 3: ("in_progress", None), 4: ("pending", None)}
    assert {r.id: r.status for r in jobs.cancel(q, "payload").collect()} == {1: "in_progress", 2: "in_progress", 3: "failed", 4: "failed"}
    assert {r.payload: r.id for r in jobs.latest(q, "payload").collect()} == {"a": 3, "b": 4}


def test_pages(spark):
    rows = spark.range(25).select(F.col("id"), (F.col("id") % 3).alias("k"), F.lit(DAY1).alias("updated_at"))
    shown, pager = workflow.page_of(rows, "k", False, page=9, size=5)
    assert pager == {"page": 3, "total": 25, "total_pages": 3, "has_previous": True, "has_next": False} and shown.count() == 5
    assert workflow.page_of(rows.limit(0))[1]["total_pages"] == 1 and workflow.page_numbers(-1, 999) == (1, 200)


def test_state_of_documents(spark):
    rows = [("failed", False, False, DAY1, " bad "), ("failed", False, False, DAY1, None), ("parsing", False, False, DAY1, None), ("parsing", False, False, DAY2, None), ("edited", False, False, DAY1, None), ("watermarked", False, True, DAY1, None), ("watermarked", True, False, DAY1, None), ("watermarked", True, True, DAY1, None)]
    out = workflow.dashboard_rows(spark.createDataFrame(rows, "status string, promoted boolean, crosswalk boolean, updated_at timestamp, error_message string"), now()).collect()
    assert [r.stage for r in out] == ["failed", "failed", "parse", "parse", "chunk", "promote", "crosswalk", "ready"]
    assert [r.attention_reason for r in out] == ["bad", "Processing failed", "Parsing appears stalled (24h since update)", None, "Needs chunking (24h pending)", "Watermarked but not promoted (24h pending)", None, None]
    assert [r.is_stale for r in out] == [False, False, True, False, True, True, False, False]


def test_access(spark):
    rows = spark.createDataFrame([(1, None, True), (2, None, False), (3, "o1", True), (4, "o2", True)], "id int, organization_id string, is_active boolean")
    members = spark.createDataFrame([("u", "o1", "admin"), ("u", "o3", "member")], "user_id string, organization_id string, role string")
    seen = lambda who: {r.id for r in access.visible(rows, members, who).collect()}
    assert seen(access.Principal()) == {1} and seen(access.Principal("u", "member")) == {1, 2, 3} and seen(access.Principal("x", "admin")) == {1, 2, 3, 4} and seen(access.Principal("z", "member")) == {1, 2}
    assert [r[0] for r in access.organizations_of(members, access.Principal("u"), True).collect()] == ["o1"]
    with pytest.raises(PermissionError):
        access.require(access.Principal(), "admin")


def test_streams(spark, tmp_path):
    spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(10)], "id long, kind string").write.parquet(str(tmp_path / "jobs"))
    got: dict[str, list] = {"a": [], "b": []}
    handlers = {k: (lambda df, k=k: got[k].extend(r.id for r in df.collect())) for k in got}
    for _ in range(2):  # a second run finds nothing new
        worker.work(spark, str(tmp_path / "jobs"), "id long, kind string", str(tmp_path / "state"), handlers).awaitTermination()
    assert sorted(got["a"] + got["b"]) == list(range(10)) and sorted(got["b"]) == [0, 3, 6, 9]
    spark.createDataFrame([(99, "b")], "id long, kind string").write.mode("append").parquet(str(tmp_path / "jobs"))
    worker.work(spark, str(tmp_path / "jobs"), "id long, kind string", str(tmp_path / "state"), handlers).awaitTermination()
    assert sorted(got["b"]) == [0, 3, 6, 9, 99]
