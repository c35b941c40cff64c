"""Ingestion, embedding and the command line from end to end."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docprov import cli
from docprov.functions.watermark import verified
from docprov.operators import embed, ingest

HEAD = "---\ncorpus_id: {id}\ntitle: {title}\ntier: tier_1\nversion: {version}\nframeworks: [gdpr]\nlast_verified: 2024-01-01\nfact_check:\n  status: verified\n  checked_at: 2024-02-01\n  checked_by: me\n---\n"
BODY = "## One\n\nThis body is long enough to be taken, with some words {x}.\n\n## Two\n\nmore text"


def doc(i, version="v1", title="T", x="a"):
    return HEAD.format(id=i, version=version, title=title) + BODY.format(x=x)


def run(spark, texts, existing):
    results, documents, chunks = ingest.ingest(spark.createDataFrame([(x,) for x in texts], "raw string"), existing)
    return {r.corpus_id: (r.action, r.error) for r in results.collect()}, spark.createDataFrame(documents.collect(), documents.schema), chunks


def test_versions_and_chunks(spark):
    none = spark.createDataFrame([], cli.DOCUMENTS)
    got, documents, chunks = run(spark, [doc("a"), doc("b"), doc("c").replace("status: verified", "status: draft"), "junk"], none)
    assert got["a"] == ("inserted", None) and got["c"][0] == "invalid" and "fact_check.status" in got["c"][1] and got[None][0] == "invalid"
    assert chunks.count() == 4 and chunks.where(verified(F.col("content")).valid).count() == 4
    got, documents, chunks = run(spark, [doc("a"), doc("b", x="new")], documents)
    assert got == {"a": ("unchanged", None), "b": ("updated", None)} and chunks.count() == 2
    got, documents, _ = run(spark, [doc("a", "v2")], documents)
    assert got == {"a": ("inserted", None)}
    assert {(r.corpus_id, r.version): r.is_active for r in documents.collect()} == {("a", "v1"): False, ("a", "v2"): True, ("b", "v1"): True}


def test_documents_whose_marks_do_not_verify_are_not_taken(spark):
    none = spark.createDataFrame([], cli.DOCUMENTS)
    got, documents, chunks = run(spark, [doc("a"), doc("a:b")], none)
    assert got["a"] == ("inserted", None)
    assert got["a:b"] == ("failed", "Watermark integrity check failed for chunk sequence 0: No watermark found in content")
    assert [r.corpus_id for r in documents.collect()] == ["a"] and {r.corpus_id for r in chunks.collect()} == {"a"}
    marked = chunks.withColumn("sequence", F.col("sequence") + 1)
    kept, faults = ingest.self_checked(marked)
    assert kept.count() == 0 and faults.first().error == "Watermark payload mismatch for chunk sequence 1 (expected corpus_id=a)"


def test_retries():
    calls, pauses = [], []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise embed.Transient("busy")
        return [[1.0]] * len(texts)

    assert embed.with_retries(flaky, ["x"], pause=pauses.append) == [[1.0]] and pauses == [1.0, 2.0]
    with pytest.raises(ValueError):
        embed.with_retries(lambda t: (_ for _ in ()).throw(ValueError("no")), ["x"], pause=pauses.append)


def test_embedding(spark):
    at = datetime(2024, 1, 1)
    rows = [(i, "pending", at, None, True, None, None, None, "T", "text" if i else "bad", None) for i in range(3)]
    state = spark.createDataFrame(rows, "id int, status string, updated_at timestamp, lease_expires_at timestamp, is_active boolean, run_id string, authority_id string, error string, section_title string, content string, embedding array<double>")
    inner = embed.hashing_provider(8)

    def provider(texts):
        return [v[:5] if "bad" in t else v for t, v in zip(texts, inner(texts), strict=True)]

    after, events = embed.embed_pending(state, provider, F.lit("2024-01-02").cast("timestamp"), dimensions=8)
    got = {r.id: r for r in after.collect()}
    assert {i: r.status for i, r in got.items()} == {0: "failed", 1: "complete", 2: "complete"}
    assert got[0].error == "expected 8 dimensions, got 5" and got[0].embedding is None and len(got[1].embedding) == 8 and got[1].embedding == got[2].embedding
    assert sorted(r.status for r in events.collect()) == ["complete", "complete", "failed"]
    again, _ = embed.embed_pending(after.drop("accepted"), provider, F.lit("2024-01-03").cast("timestamp"), dimensions=8)
    assert again.where("accepted").count() == 0


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text(doc("a"))
    store = f"{tmp_path}/store"
    assert cli.main(["validate", "--corpora", f"{tmp_path}/in"], spark) == 0
    assert cli.main(["ingest", "--corpora", f"{tmp_path}/in", "--store", store], spark) == 0
    (tmp_path / "in/a.md").write_text(doc("a", "v2"))
    assert cli.main(["ingest", "--corpora", f"{tmp_path}/in", "--store", store], spark) == 0
    assert cli.main(["verify", "--corpora", f"{store}/chunks"], spark) == 0
    assert cli.Store(spark, store).read("documents").count() == 2
    (tmp_path / "in/b.md").write_text("junk")
    assert cli.main(["validate", "--corpora", f"{tmp_path}/in"], spark) == 1
    assert capsys.readouterr().out.splitlines() == ["inserted 1", "inserted 1", "inserted 1", "valid 4, invalid 0", "inserted 1, invalid 1"]
    with pytest.raises(SystemExit):
        cli.main(["nonsense"], spark)


def test_rechunk_embed_parse_and_approve(spark, tmp_path, capsys):
    """The whole way: ingest and embed, chunk all again, embed what waits, parse a text, approve the draft."""
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / f"in/{name}.md").write_text(doc(name))
    store = f"{tmp_path}/store"
    run = lambda *args, **how: cli.main([*args, "--store", store], spark, **how)
    assert run("ingest_and_embed", "--corpora", f"{tmp_path}/in", "--limit", "3") == 0
    chunks = cli.Store(spark, store).read("chunks")
    assert chunks.count() == 4 and chunks.where("status = 'complete' and size(embedding) = 512").count() == 4  # a batch is tried whole
    assert run("rechunk", "--corpora", f"{tmp_path}/in", "--corpus-id", "a") == 0
    assert {r["status"]: r["count"] for r in cli.Store(spark, store).read("chunks").groupBy("status").count().collect()} == {"pending": 2, "complete": 2}
    assert run("embed_pending", "--dry-run") == 0
    assert run("embed_pending") == 0 and run("embed_pending") == 0
    (tmp_path / "c.md").write_text(doc("c"))
    assert run("ingest_content", "--file", f"{tmp_path}/c.md") == 0
    (tmp_path / "d.txt").write_text(doc("d"))
    assert run("parse", "--file", f"{tmp_path}/d.txt") == 0
    assert run("parse", "--file", f"{tmp_path}/d.txt") == 1  # submitted before
    draft = cli.Store(spark, store).read("drafts").first()
    assert draft.status == "parsed" and draft.source_filename == "d.txt"
    assert run("approve_draft", "--draft-id", draft.id) == 0 and run("approve_draft", "--draft-id", draft.id) == 1
    assert {r.corpus_id for r in cli.Store(spark, store).read("documents").collect()} == set("abcd")
    out = capsys.readouterr().out.splitlines()
    assert out[:3] == ["inserted 2", "complete 4", "updated 1"] and "is already approved" in out[-1]
    assert all(r.duration_ms > 0 for r in spark.read.parquet(f"{store}/envelopes").collect())
    actions = {r.action for r in spark.read.parquet(f"{store}/envelopes").collect()}
    assert actions == {"ingest_and_embed", "rechunk", "embed_pending", "ingest_content", "approve_draft"}
    for bad in (["rechunk"], ["parse", "--store", store], ["approve_draft", "--store", store], ["embed_pending", "--store", store, "--limit", "0"], ["ingest", "--corpora", "x"]):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)
