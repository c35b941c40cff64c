"""Marks: fixed values, and what holds of any content."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from docprov.functions import text, watermark

CONTENT = "This is a chunk of compliance content about GDPR Article 5."
HASH = "60d4d6e78b5de4ecd9cc19746492a8b2c046423a4896ab702247ddfa67e98b88"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def mark(content=None, corpus="gdpr-core-v1", sequence=3, secret=None):
    content = F.lit(CONTENT) if content is None else content
    return watermark.injected(content, F.lit(corpus), F.lit(sequence), text.sha256(watermark.stripped(content)), secret)


def test_fixed_values(spark):
    r = one(spark, h=text.sha256(F.lit(CONTENT)), s=watermark.signature(F.lit("gdpr-core-v1"), F.lit(3), F.lit(HASH)), m=watermark.signature(F.lit("gdpr-core-v1"), F.lit(3), F.lit(HASH), "my-secret"))
    assert (r.h, r.s, r.m) == (HASH, "883d95ae4094ddec", "4b7466c6ab7b8338")


@pytest.mark.parametrize("secret", ["k", "my-secret", "x" * 64, "y" * 100, "schlüssel"])
def test_hmac(spark, secret):
    assert one(spark, v=watermark.hmac(secret, F.lit("grüße|1"))).v == hmac.new(secret.encode(), "grüße|1".encode(), hashlib.sha256).hexdigest()


def test_each_part_changes_the_signature(spark):
    base = ("gdpr-core-v1", 3, HASH, None)
    others = [("gdpr-core-v2", 3, HASH, None), ("gdpr-core-v1", 4, HASH, None), ("gdpr-core-v1", 3, "0" * 64, None), ("gdpr-core-v1", 3, HASH, "s"), ("gdpr-core-v1", 3, HASH, "t")]
    signed = {one(spark, v=watermark.signature(F.lit(a), F.lit(b), F.lit(c), d)).v for a, b, c, d in [base, *others]}
    assert len(signed) == 6 and all(len(s) == 16 for s in signed)


def test_round_trip(spark):
    once = mark()
    r = one(spark, once=once, twice=mark(once), bare=watermark.stripped(once), strict=watermark.stripped_strict(once), e=watermark.extracted(once), m=watermark.marked(once), n=watermark.marked(F.lit(CONTENT)))
    assert r.once == r.twice and r.bare == r.strict == CONTENT and r.m and not r.n
    assert (r.e.version, r.e.corpus_id, r.e.sequence) == ("v1", "gdpr-core-v1", 3)
    again = one(spark, v=mark(once, "other", 5)).v
    assert again.count("corpus-watermark") == 1 and ":other:5:" in again


@pytest.mark.parametrize(
    ("change", "secret", "reason"),
    [
        (lambda c: c, None, None),
        (lambda c: F.concat(c, F.lit("  \n ")), None, None),
        (lambda c: F.lit(CONTENT), None, "No watermark found in content"),
        (lambda c: F.concat(c, F.lit("\nmore")), None, "No watermark found in content"),
        (lambda c: F.concat(F.lit("x"), c), None, "Signature mismatch"),
        (lambda c: c, "other", "Signature mismatch"),
        (lambda c: F.replace(c, F.lit(":v1:"), F.lit(":v2:")), None, "Unsupported watermark version: v2"),
    ],
)
def test_verification(spark, change, secret, reason):
    v = one(spark, v=watermark.verified(change(mark()), secret)).v
    assert v.valid == (reason is None) and (reason is None or v.reason.startswith(reason))


def test_secrets_and_odd_contents(spark):
    for content in ("<!-- keep --> a <!-- b -->", "é\U0001f600", "a\n\n## b", "x"):
        for secret in (None, "s"):
            for sequence in (0, 99999):
                assert one(spark, v=watermark.verified(mark(F.lit(content), "c", sequence, secret), secret)).v.valid


@pytest.mark.parametrize(("corpus", "sequence", "content_hash"), [("", 1, HASH), ("a", -1, HASH), ("a", 1, "short"), ("a", 1, HASH.upper())])
def test_bad_parameters_raise(spark, corpus, sequence, content_hash):
    with pytest.raises(Exception, match="invalid watermark parameters"):
        one(spark, v=watermark.signature(F.lit(corpus), F.lit(sequence), F.lit(content_hash)))


def test_text_helpers(spark):
    r = one(
        spark, w=text.word_count(F.lit("a b c﻿d  e")), t=text.token_estimate(F.lit("a b c d")), k=text.kebab(F.lit("  Hello, Wörld! ")), c=text.title_case(F.lit("hello bIG world")),
        n=text.source_name(F.lit("  "), F.lit("abcdef0123")), i=text.inferred_title(F.lit("my_file-name.PDF"), F.lit("x")), j=text.inferred_title(F.lit(None).cast("string"), F.lit("\n  first \nsecond")),
        z=text.inferred_title(F.lit(""), F.lit(" \n ")), f=text.fenced(F.lit("a\n```markdown\nx\n```\ny\n```")), l=text.fenced(F.lit("a\n```markdown\nx\n```\ny\n```"), greedy=False), g=text.language(F.lit("DE")), u=text.language(F.lit("xx")),
        b=text.front_block(F.lit("---\na: b\n---\nrest")), p=text.storage_path(F.lit(None).cast("string"), F.lit("s"), F.lit("d"), F.lit("a b/c.pdf")),
    )
    assert (r.w, r.t, r.k, r.c, r.n, r.i, r.j, r.z) == (5, 6, "hello-w-rld", "Hello Big World", "upload-abcdef01.txt", "My File Name", "first", "Compliance Document")
    assert (r.f, r.l, r.g, r.u, r.b, r.p) == ("x\n```\ny", "x", "german", "xx", "---\na: b\n---", "no-org/s/d/a_b_c.pdf")
