"""Full-text search, parsing with a model, drafts, envelopes, slugs, identifiers and tools."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from docprov import tools
from docprov.functions import ids
from docprov.functions.watermark import verified
from docprov.operators import drafts, embed, fulltext, jobs, parse, store, workflow
from docprov.sources import envelopes

STEMS = {
    "consistency": "consist", "knackeries": "knackeri", "generously": "generous", "skies": "sky", "running": "run", "hopping": "hop", "national": "nation", "relational": "relat", "conditional": "condit", "happy": "happi", "controlling": "control",
    "requirements": "requir", "policies": "polici", "agreed": "agre", "feudalism": "feudal", "hopefulness": "hope", "communication": "communic", "electrical": "electr", "dying": "die", "adjustment": "adjust", "roll": "roll", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap",
}


def test_stems():
    assert {w: fulltext.stem(w) for w in STEMS} == STEMS
    assert fulltext.lexeme("the", "english") is None and fulltext.lexeme("the", "simple") == "the"


def test_queries_of_the_web_kind():
    asked = fulltext.websearch('data "privacy policy" OR law -tax the')
    assert [[(p.lexemes, p.wanted) for p in g] for g in asked] == [[(("data",), True), (("privaci", "polici"), True)], [(("law",), True), (("tax",), False)]]
    assert fulltext.websearch("") == fulltext.websearch(None) == fulltext.websearch("the -of") == []


def plain_rank(words, wanted, weight=0.4):
    """Every stretch that holds all words, and holds none that does so."""
    places = [i for i, w in enumerate(words) if w in wanted]
    holds = lambda a, b: wanted <= set(words[a : b + 1])
    total = 0.0
    for a in places:
        for b in places:
            if b >= a and holds(a, b) and not holds(a + 1, b) and not holds(a, b - 1):
                inside = sum(w in wanted for w in words[a : b + 1])
                total += weight / (1 + (b - a + 1 - inside))
    return total / (total + 1)


def test_rank_of_covers(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "x", "y", "z"]) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = {r.id: r.text_score for r in fulltext.search(rows, "alpha beta gamma").collect()}
    want = {i: plain_rank(t.split(), {"alpha", "beta", "gamma"}) for i, t in enumerate(texts) if {"alpha", "beta", "gamma"} <= set(t.split())}
    assert got == pytest.approx(want)
    assert fulltext.search(rows, " ").collect() == []


def test_titles_weigh_more_and_stems_match(spark):
    rows = spark.createDataFrame([(1, "Policies", "nothing here"), (2, "x", "The policy holds."), (3, "x", "police"), (4, None, None)], "id int, title string, content string")
    got = {r.id: round(r.text_score, 6) for r in fulltext.search(rows, "policy", title="title").collect()}
    assert got == {1: 0.5, 2: round(0.4 / 1.4, 6)}
    assert [r.lexemes for r in fulltext.vectors(rows, title="title").orderBy("id").collect()][1] == [("x", 1, "A"), ("polici", 3, "B"), ("hold", 4, "B")]


def lossy(messages):
    return "```markdown\nshort\n```" if "lose" in messages[-1][1] else messages[-1][1]


def test_parse_with_audit(spark):
    docs = spark.createDataFrame([("a", "a_file.txt", "Keep these words here."), ("b", "b.txt", "lose these many words of text here"), ("c", "c file.md", "word " * 40), ("d", "d.txt", "boom")], "document_id string, source_filename string, source_text string")

    def model(messages):
        if messages[-1][1] == "boom" and "assemble" in messages[0][1]:
            raise ValueError("no")
        return lossy(messages)

    done, audits = parse.parsed_with_audit(docs, model, F.lit("2024-01-01"), assemble="assemble", words=20)
    got = {r.document_id: r for r in done.collect()}
    assert got["a"].status == "parsed" and got["a"].parsed_markdown == "Keep these words here." and got["a"].omissions == 0
    assert got["b"].omissions == 1 and got["b"].parsed_markdown == "short"  # recovered from the source, then lost by the assembling model
    assert got["c"].parsed_markdown.startswith("---\ncorpus_id: c-file-") and "checked_by: deterministic-assembler-v1" in got["c"].parsed_markdown and "## Section 1" in got["c"].parsed_markdown
    assert got["d"].status == "failed" and "ValueError: no" in got["d"].error
    assert {r.document_id: r.recovered_text for r in audits.collect()}["b"] == "lose these many words of text here"


def test_crosswalks_are_marked(spark):
    docs = spark.createDataFrame([("s", n, f"c{n}", "T", "tier_1", ["x"], "## Part\n\ntext", "watermarked", n > 0) for n in range(3)] + [("t", 0, "c9", "T", "tier_1", ["x"], "m", "watermarked", True)], "session_id string, position int, corpus_id string, title string, tier string, frameworks array<string>, markdown string, status string, promoted boolean")
    out, chunks = parse.crosswalks(docs, parse.identity_model)
    assert [(r.session_id, r.documents, r.corpus_id) for r in out.collect()] == [("s", 2, "crosswalk-v1-s")]
    rows = chunks.select("corpus_id", verified(F.col("content")).alias("v")).collect()
    assert rows and all(r.v.valid and r.v.corpus_id == "crosswalk-v1-s" for r in rows)
    assert {r.session_id: r.crosswalk_ready for r in parse.crosswalk_ready(docs).collect()} == {"s": True, "t": False}


def test_drafts(spark):
    have = spark.createDataFrame([("1", "f", "x", None, "parsed", "md", "own", None, None, "u"), ("2", "f", "y", None, "parsing", None, None, None, None, "u"), ("3", "f", "z", None, "failed", "  ", None, None, None, "u")], drafts.COLUMNS).withColumn("source_hash", F.sha2("source_text", 256))
    state, refused = drafts.submit(have, spark.createDataFrame([("4", None, "new", "u"), ("5", "g", "new", "u"), ("6", "g", "x", "u")], "id string, source_filename string, source_text string, created_by string"))
    assert sorted(r.id for r in state.collect()) == ["1", "2", "3", "4"] and sorted(r.id for r in refused.collect()) == ["5", "6"]
    taken, refused = drafts.approve(have, spark.createDataFrame([(i,) for i in "1239"], "id string"))
    assert [tuple(r) for r in taken.collect()] == [("1", "own")]
    assert {r.id: r.error.split("—")[0].strip() for r in refused.collect()} == {"2": "Draft 2 is in status 'parsing'", "3": "Draft 3 has no parsed markdown", "9": "Draft not found: 9"}
    done = {r.id: (r.status, r.document_id) for r in drafts.approved(have, spark.createDataFrame([("1", "d1")], "id string, document_id string")).collect()}
    assert done["1"] == ("approved", "d1") and done["2"] == ("parsing", None)
    edited = drafts.edited(have, spark.createDataFrame([("1", "good"), ("2", "bad")], "id string, new_markdown string"), F.col("new_markdown") == "good")
    assert {r.id: (r.status, r.user_markdown) for r in edited.collect()} == {"1": ("edited", "good"), "2": ("parsing", None), "3": ("failed", None)}


def test_records_are_only_added(spark, tmp_path):
    context = envelopes.Context("r", "cli", "embed_pending", organization_id="o")
    at, later = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:00:01.5").cast("timestamp")
    one = envelopes.of_embedding(spark.createDataFrame([(True,), (False,), (True,)], "ok boolean"), context, at, later)
    two = envelopes.of_error(spark.createDataFrame([("c", "boom")], "corpus_id string, error string"), context, at, later)
    table = envelopes.AppendOnly(f"{tmp_path}/envelopes")
    assert table.append(one) and table.append(two)
    rows = spark.read.parquet(table.path)
    got = {r.error: r for r in rows.collect()}
    assert got[None].embedded_count == 2 and got[None].embedding == '{"embedded":2,"pending":1}' and got["boom"].corpus_id == "c" and got["boom"].duration_ms == 1500
    assert envelopes.changed_records(one, rows).count() == 0 and not [m for m in dir(table) if m in ("delete", "update", "overwrite")]
    pauses = []
    assert not envelopes.AppendOnly("nofs://x/y", pause=pauses.append).append(one) and pauses == [0.1]


def test_time_ids(spark):
    rows = spark.range(200).select(F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("id")).alias("at")).select("at", ids.uuid7(F.col("at")).alias("u")).collect()
    made = [uuid.UUID(r.u) for r in rows]
    assert all(u.version == 7 and u.variant == uuid.RFC_4122 for u in made) and len(set(made)) == 200
    assert [u.int >> 80 for u in made] == [1_700_000_000_000 + i for i in range(200)]


def test_slugs_skip_what_is_taken(spark):
    rng = random.Random(1)
    for _ in range(3):
        taken = {rng.choice(["a", "a-1", "a-2", "a-4", "b-1", "a-b", "domain"]) for _ in range(5)}
        names = [rng.choice(["A", " a! ", "B", "A b", "---", "a 1"]) for _ in range(12)]
        new = spark.createDataFrame(list(enumerate(names)), "id int, name string")
        got = {r.id: r.slug for r in store.slugged(new, spark.createDataFrame([(s,) for s in sorted(taken)], "slug string")).collect()}
        # Within one base, numbers go up in order of ids and none is taken.


        bases = {}
        for i, n in enumerate(names):
            bases.setdefault(re.sub("[^a-z0-9]+", "-", n.strip().lower()).strip("-") or "domain", []).append(i)
        for base, own in bases.items():
            free = (s for s in [base, *(f"{base}-{k}" for k in range(1, 40))] if s not in taken)
            assert [got[i] for i in own] == [next(free) for _ in own]


def test_cancelled_documents_and_bulk_targets(spark):
    docs = spark.createDataFrame([("a", "parsing", None), ("b", "parsed", None), ("c", "pending", None)], "id string, status string, error_message string")
    queue = spark.createDataFrame([(1, "a", "pending", None), (2, "a", "in_progress", None), (3, "b", "pending", None), (4, "c", "completed", None)], "id int, doc string, status string, error string")
    after, left = jobs.cancelled(docs, queue, "doc")
    assert {r.id: r.status for r in after.collect()} == {"a": "failed", "b": "parsed", "c": "pending"}
    assert {r.id: r.status for r in left.collect()} == {1: "pending", 2: "failed", 3: "failed", 4: "completed"}
    page = lambda rows: spark.createDataFrame(rows, "id int, status string, stage string")
    targets = workflow.bulk_targets([page([(1, "parsed", "chunk"), (2, "parsed", "chunk")]), page([(2, "chunked", "watermark"), (3, "edited", "chunk")])], "chunk")
    assert sorted(r.id for r in targets.collect()) == [1, 3]


def test_tools(spark):
    provider = embed.hashing_provider(16)
    rows = [("1", provider(["data law"])[0], "Law", "c1", "The law.", ["Doc", "Law"], "tier_1", ["gdpr"], True, "complete"), ("2", provider(["fish"])[0], "Fish", "c2", "Fish.", ["Doc"], "tier_2", ["*"], True, "complete"), ("3", provider(["data law"])[0], "Old", "c3", "Old.", ["Doc"], "tier_1", ["gdpr"], False, "complete")]
    chunks = spark.createDataFrame(rows, "id string, embedding array<double>, section_title string, corpus_id string, content string, heading_path array<string>, tier string, frameworks array<string>, is_active boolean, embedding_status string")
    said = tools.search_corpus(chunks, "data law", provider)
    assert said.startswith('Found 1 result(s) for: "data law"\n\n[1.000] Law\nCorpus: c1\nPath: Doc > Law\nThe law.')
    assert tools.search_corpus(chunks, "data law", provider, ["hipaa"]) == 'No results found for: "data law"'
    assert tools.search_corpus(chunks, "x", provider, match_count=51).startswith("Error") and tools.search_corpus(chunks, "x", provider, tier="tier_9").startswith("Error")
    assert tools.search_corpus(chunks, "x", lambda t: [][0]).startswith("Search failed")
    assert tools.verify_provenance(spark, "no mark") == "Invalid: No watermark found in content"
