"""Headers, chunks, cleaning, audits, validation and sources."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docprov.operators import audit, chunk, cleanup, frontmatter, retrieval, validate
from docprov.sources import export, markdown

BODY = "## First\n\nSome text that is long enough to pass the check of the body.\n\n### Deep\n\nmore\n\n## Second\nend"
HEAD = "---\ncorpus_id: a-b\ntitle: 'A: title'\ntier: tier_1\nversion: \"1.0\"\nframeworks: [GDPR, \"HIPAA\", ]\nfact_check:\n  status: verified\n  checked_at: 2024-02-01\n  checked_by: me\nsire:\n  subject: x\n  included:\n    [lost]\n  excluded: [y]\nodd line\n---\n"


def test_headers():
    p = frontmatter.parsed(HEAD + BODY)
    assert p["error"] is None and p["title"] == "A: title" and p["version"] == "1.0" and p["frameworks"] == ["GDPR", "HIPAA"] and p["industries"] == []
    assert p["fact_check"]["checked_by"] == "me" and p["sire"] == {"subject": "x", "included": [], "excluded": ["y"], "relevant": []} and p["license"] is None
    assert frontmatter.parsed((HEAD + BODY).replace("\n", "\r\n"))["error"] is None
    errors = [frontmatter.parsed(x)["error"] for x in (None, "", "no header", HEAD.replace("tier: tier_1\n", "") + BODY, HEAD + "## short", HEAD + "x" * 60)]
    assert [e.split(":")[0].split(" ")[0] for e in errors] == ["missing"] * 3 + ["Missing", "Content", "Content"]


def test_parse_column(spark):
    rows = frontmatter.parse_documents(spark.createDataFrame([(HEAD + BODY,), (None,), ("x",)], "raw string")).collect()
    assert sorted((r.corpus_id or "", r.error or "") for r in rows) == [("", "missing frontmatter delimiters")] * 2 + [("a-b", "")]
    first = frontmatter.first_valid(spark.createDataFrame([(1, "x", HEAD + BODY)], "id int, a string, b string"), "id", [F.col("a"), F.col("b")]).collect()
    assert first[0].markdown == HEAD + BODY


def plain_chunks(body, title):
    """Line by line: the same chunks."""
    out, second = [], None
    now = {"title": title, "level": 2, "path": [title], "lines": []}

    def close():
        content = "\n".join(now["lines"]).strip()
        if content:
            if out and len(content.split()) < 75 and not re.match(r"###?\s+", content):
                out[-1][3] += "\n\n" + content
            else:
                out.append([now["title"], now["level"], now["path"], content])

    for line in body.strip().split("\n"):
        m = re.match(r"(###?)[ \t\x0b\f\r]+([^\r\n]+)", line)
        if m:
            close()
            own = m[2].strip()
            second = own if m[1] == "##" else second
            path = [title, own] if m[1] == "##" or second in (None, title) else [title, second, own]
            now = {"title": own, "level": len(m[1]), "path": path, "lines": [line]}
        else:
            now["lines"].append(line)
    close()
    return [tuple([x[0], x[1], tuple(x[2]), x[3]]) for x in out]


def test_heading_chunks(spark):
    rng = random.Random(3)
    parts = ["## T", "## H{}", "### S{}", "#### not", "text {} here", "", "long " * 80, "##", "  indented {}"]
    bodies = [BODY, "pre\n\n" + BODY, "### only\nx"] + ["\n".join(rng.choice(parts).format(rng.randrange(9)) for _ in range(rng.randrange(1, 14))) for _ in range(120)]
    rows = chunk.heading_chunks(spark.createDataFrame(list(enumerate(bodies)), "doc_id int, body string"), title=F.lit("T")).orderBy("doc_id", "sequence").collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.section_title, r.heading_level, tuple(r.heading_path), r.content))
        assert r.sequence == len(got[r.doc_id]) - 1
    assert got == {i: c for i, b in enumerate(bodies) if (c := plain_chunks(b, "T"))}


def plain_split(text, target, most):
    out, now = [], ""
    for p in [x.strip() for x in re.split(r"\n\s*\n", text) if x.strip()]:
        if len(p) >= most:
            out += [now] * bool(now) + [p[i : i + most] for i in range(0, len(p), most)]
            now = ""
            continue
        both = f"{now}\n\n{p}" if now else p
        if now and (len(both) > most or (len(now) >= target and len(both) > target)):
            out.append(now)
            now = p
        else:
            now = both
    out += [now] * bool(now)
    return out or [text]


def test_source_chunks(spark):
    rng = random.Random(5)
    texts = ["\n\n".join("x" * rng.randrange(1, 120) for _ in range(rng.randrange(0, 12))) for _ in range(100)] + ["", " \n ", "y" * 400]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunk.source_chunks(F.col("t"), 60, 90).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: plain_split(t, 60, 90) for i, t in enumerate(texts)}


def test_word_sections(spark):
    text = "\n\n".join(f"# Start {i} " + "w " * 500 for i in range(5))
    out = spark.range(1).select(chunk.word_sections(F.lit(text)).alias("m"), chunk.word_sections(F.lit(" ")).alias("n")).first()
    assert [x[:19] for x in re.findall(r"^## .*", out.m, re.M)] == ["## Section 1 — Star", "## Section 2 — Star", "## Section 3 — Star"] and out.n.startswith("## Section 1")


def test_cleanup(spark):
    text = "ISO/IEC 27001:2022\nContents  Page\n5.1 Leadership\n12\nScope ........ 7\nISO/IEC 27001:2022\nA n n e x A\r\nISO/IEC 27001:2022\n\n\n\nsee 7. 2"
    r = cleanup.cleaned(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert (r.structural, r.known_noise, r.page_marker, r.table_of_contents, r.repeated_header_footer) == (1, 0, 1, 1, 3)
    assert r.cleaned_text == "5.1 Leadership\nAnnex A\n\nsee 7.2" and r.original_lines == 12


def test_page_rows(spark):
    glyphs = [(1, 1, 0.0, 100.0, 5.0, "Hel"), (1, 1, 5.0, 99.0, 5.0, "lo"), (1, 1, 20.0, 100.5, 5.0, "you"), (1, 1, 0.0, 90.0, 5.0, "next")]
    out = cleanup.page_rows(spark.createDataFrame(glyphs, "doc_id long, page long, x double, y double, width double, str string")).orderBy("row").collect()
    assert [r.line for r in out] == ["Hello you", "next"]


def test_audit(spark):
    src = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mue nue"
    rows = audit.audited(spark.createDataFrame([(src, "alpha beta gamma"), (src, src), ("", ""), ("a b", "")], "source_text string, ai_text string")).collect()
    assert round(rows[0].coverage_ratio, 4) == 0.2308 and rows[0].omission_detected and rows[0].recovered_text == src and rows[0].warnings[0] == "coverage_ratio_low:0.2308"
    assert rows[1].coverage_ratio == 1 and not rows[1].omission_detected and rows[1].warnings == []
    assert not rows[2].omission_detected and rows[3].omission_detected


def test_fusion_scores(spark):
    near = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 128), (3, 0.7, 129)], "chunk_id int, similarity double, vector_rank int")
    told = spark.createDataFrame([(1, 0.9, 1), (4, 0.5, 49), (5, 0.4, 50)], "chunk_id int, text_score double, text_rank int")
    got = {r.chunk_id: round(r.combined_score, 9) for r in retrieval.fused(near, told).collect()}
    assert got == {1: 0.047619048, 2: 0.005023847, 3: 0.004992104, 4: 0.005034101, 5: 0.004971989}


def test_search_parameters():
    assert retrieval.checked(0) == 1 and retrieval.checked(1000) == 100
    with pytest.raises(ValueError, match="weight"):
        retrieval.checked(5, weight=1.5)


def test_gate_edges(spark):
    rows = [("xéphi here", ["phi"]), ("aXb a.b", ["a.b"]), ("aXb", ["a.b"]), ("PHI data", ["x", "phi"]), ("any", []), ("any", None), ("graphics", ["phi"])]
    out = retrieval.excluded(spark.createDataFrame(rows, "content string, sire_excluded array<string>")).collect()
    assert [r.matches for r in out] == [["phi"], ["a.b"], [], ["phi"], [], [], []]
    assert [r.passed for r in out] == [False, False, True, False, True, True, True]


def test_validation(spark):
    good = ("verified", "2024-02-01", "me", None)
    cases = [(good, "2024-01-01", None), (None, "2024-01-01", "Missing"), (("draft", *good[1:]), None, "fact_check.status"), (("verified", "soon", "me", None), None, "fact_check.checked_at must be"), (("verified", "2024-02-01", " ", None), None, "fact_check.checked_by"), (good, "2024-03-01", "fact_check.checked_at (2024-02-01) must be on/after"), (good, "later", None)]
    schema = "fact_check struct<status: string, checked_at: string, checked_by: string, notes: string>, last_verified string, changed boolean, chunk_count int, error string, frameworks array<string>, industries array<string>, segments array<string>"
    docs = spark.createDataFrame([(f, v, True, 1, None, ["a"], [], None) for f, v, _ in cases] + [(None, None, False, 0, None, [], [], [])], schema)
    out = validate.validated(docs).collect()
    for r, (_, _, start) in zip(out, cases, strict=False):
        assert r.valid == (start is None) and (start is None or r.errors[0].startswith(start)) and len(r.warnings) == 2
    assert out[-1].errors == ["Document has no chunks"]


def test_integrity(spark):
    h = "a" * 64
    rows = [("d", 0, "A", 2, "x", h), ("d", 0, "B", 2, "x", "b" * 64), ("d", 1, "A", 2, "x", h), ("d", -1, "C", 2, "x", h), ("d", 2, "D", 9, "x", h), ("d", 3, "E", 2, "", h), ("d", 4, "F", 2, "x", "no")]
    good, bad = validate.integrity(spark.createDataFrame(rows, "document_id string, sequence int, section_title string, heading_level int, content string, content_hash string"))
    assert [(r.sequence, r.section_title) for r in good.collect()] == [(0, "A")] and bad.count() == 6


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.md").write_text(HEAD + BODY)
    (tmp_path / "in/deep/b.md").write_text("broken")
    (tmp_path / "in/AUTHORING.md").write_text("no")
    with zipfile.ZipFile(tmp_path / "in/c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:document>')
    (tmp_path / "in/d.pdf").write_bytes(b"%PDF")
    (tmp_path / "in/e.docx").write_bytes(b"not a zip")
    found = {r.file_path.rsplit("/", 1)[1]: r for r in markdown.corpora(spark, str(tmp_path / "in")).collect()}
    assert set(found) == {"a.md", "b.md"} and found["a.md"].corpus_id == "a-b" and found["b.md"].error
    assert markdown.markdown_files(spark, str(tmp_path / "none")).count() == 0
    up = {r.file_path.rsplit("/", 1)[1]: r for r in markdown.uploads(spark, str(tmp_path / "in"), {"pdf": lambda b: "pdf text"}).collect()}
    assert up["c.docx"].raw == "One\n\nTwo" and up["d.pdf"].raw == "pdf text" and up["e.docx"].error.startswith("BadZipFile") and up["a.md"].raw.startswith("---")
    assert markdown.inline(spark, HEAD + BODY).first().corpus_id == "a-b"


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("f\"1", "why, \"so\"", "chunk"), ("f2", None, "ready"), ("f3", None, "failed")], "name string, attention_reason string, stage string")
    export.failures_csv(rows, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("*.csv")))
    assert '"f""1","why, ""so""","chunk"' in text and "f2" not in text and '"f3"' in text
    line = spark.range(1).select(export.formatted(F.lit(0.12345), F.lit("T"), F.lit("c"), F.lit("body"), F.array(F.lit("a"), F.lit("b"))).alias("x")).first().x
    assert line == "[0.123] T\nCorpus: c\nPath: a > b\nbody"


def test_headers_are_read_as_by_the_plain_function(spark):
    """only headers go to Python, and the rest is told by the plan, to the same results."""
    nl = "\r\n"
    odd = [None, "", "---", "---\n---\n", "---\n\n---\n" + BODY, HEAD + BODY, (HEAD + BODY).replace("\n", nl), HEAD + " \x1c\x85 " + BODY + "　\x1f\n", HEAD + "﻿" + BODY, HEAD + "x" * 60 + "\n## y", HEAD + "x" * 60 + "\r## y", HEAD + "x" * 60 + " ## y", HEAD + "##" + "\x1d" + "x" * 60, HEAD + "## " + "\U0001f600" * 46, HEAD + "## " + "\U0001f600" * 47, " " + HEAD + BODY, HEAD.replace("---\n", "--- \n", 1) + BODY, HEAD + BODY + "\n---\nmore\n---\n", HEAD.rstrip("\n") + BODY]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(odd)], "n int, raw string")
    got = {r.n: r.asDict(recursive=True) for r in frontmatter.parse_documents(rows).collect()}
    for n, x in enumerate(odd):
        assert {k: got[n][k] for k in frontmatter.FIELDS} == frontmatter.parsed(x), n
    plan = frontmatter.parse_documents(rows).select("content", "error")._jdf.queryExecution().executedPlan().toString()
    assert all("run(raw" not in line for line in plan.splitlines() if "ArrowEvalPython" in line)


def test_lines_are_ruled_once_a_document(spark):
    """without the counts, all lines were ruled again for each line."""
    import time

    more = "Email: a@b.c\n12\nI V\nAnnexA\t x\nScope ... 7\n1.2 Some title 33\nall rights reserved\nAll rights reserved\nALL RIGHTS RESERVED\n\n\n\nlast"
    small = cleanup.cleaned(spark.createDataFrame([(1, more), (2, None), (3, "")], "doc_id int, text string"))
    told = {r.doc_id: r for r in small.collect()}
    assert told[1].cleaned_text == "I V\nAnnex A x\n\nlast" and [told[1][r] for r in cleanup.RULES] == [0, 1, 1, 2, 3]
    assert {r.doc_id: r.cleaned_text for r in small.select("doc_id", "cleaned_text").collect()} == {i: r.cleaned_text for i, r in told.items()} and told[3].cleaned_text == ""
    rows = spark.createDataFrame([(1, "\n".join(f"some line of text number {i} here" for i in range(6000)))], "doc_id int, text string")
    start = time.perf_counter()
    assert cleanup.cleaned(rows).select("cleaned_lines").first()[0] == 6000
    assert time.perf_counter() - start < 20


def test_texts_are_split_once_a_document(spark, tmp_path):
    """the text was split again for each part of it, and ratios worked out again for the rows with omissions."""
    import time

    from docprov.plans import search_queries

    for folder, lines in (("long", 30_000), ("short", 12)):
        rows = spark.createDataFrame([(1, "\n".join(f"line number{i} word{i % 7} of text" for i in range(lines)))], "doc_id long, text string")
        rows.coalesce(1).write.parquet(f"{tmp_path}/{folder}-raw")
        (tmp_path / folder).mkdir()
        next((tmp_path / f"{folder}-raw").glob("part-*.parquet")).rename(tmp_path / folder / "documents.parquet")
    start = time.perf_counter()
    assert search_queries.audit_rollup(spark, f"{tmp_path}/long").first().chunks == 6000 and search_queries.audit_warnings(spark, f"{tmp_path}/long").first().warning_count >= 6000
    assert time.perf_counter() - start < 20
    rows = spark.createDataFrame([(1, 0, "one two three", "one"), (1, 1, "one", "one"), (2, 0, "same", "same"), (3, 0, None, "x")], "document_id int, sequence int, source_text string, ai_text string")
    assert [(r.document_id, r.warning_count, len(r.preview)) for r in audit.warning_summary(audit.audited(rows)).collect()] == [(1, 2, 2)]
    plan = audit.warning_summary(audit.audited(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (" not in plan or not any("array_intersect" in line for line in plan.splitlines() if "Filter" in line)


def test_words_are_found_in_one_pass(spark):
    """words were cut out by a replacement, a split and a filter."""
    rows = spark.createDataFrame([("The the ABC ab a1b2 naïve x_y-zzz\tend\n\nÜber 12 123 \u212aelvin",), ("",), ("..",), (None,)], "x string")
    got = rows.select(audit.lexemes(F.col("x")).alias("new"), F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("x"), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.length(w) >= 3)).alias("old"))
    assert all(r.new == r.old for r in got.collect()) and got.first().new[:3] == ["the", "abc", "a1b2"]
    assert "split" not in rows.select(audit.lexemes(F.col("x")).alias("new"))._jdf.queryExecution().optimizedPlan().toString()
