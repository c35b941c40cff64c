"""Provenance marks: a signature of a chunk's content in a trailing comment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docprov.functions.text import let, sha256, trimmed_end

# The mark's format.
VERSION = "v1"
MARK = r"<!--\s*corpus-watermark:(v\d+):([^:]+):(\d+):([a-f0-9]+)\s*-->"
ANY_MARK = r"\n?<!--\s*corpus-watermark:[^\n]*-->"
NAME = "corpus-watermark:"
NONE, UNSUPPORTED, MISMATCH = "No watermark found in content", "Unsupported watermark version: ", "Signature mismatch — content may have been tampered with"
CHECK_FAILED, OTHER_PAYLOAD, NO_REASON = "Watermark integrity check failed for chunk sequence ", "Watermark payload mismatch for chunk sequence ", "verification failed"
# End of the fixed values.
AT_END = r"\s*\z"


def message(corpus_id: Column, sequence: Column, content_hash: Column) -> Column:
    return F.concat_ws("|", corpus_id, sequence.cast("string"), content_hash)


def hmac(secret: str, text: Column) -> Column:
    """HMAC-SHA-256 in hex: two nested hashes over keys padded on the driver."""
    from hashlib import sha256 as digest

    key = secret.encode()
    key = (digest(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(text, "UTF-8")), 256))), 256)


def valid_parameters(corpus_id: Column, sequence: Column, content_hash: Column) -> Column:
    return (F.length(corpus_id) > 0) & (sequence >= 0) & content_hash.rlike(r"\A[a-f0-9]{64}\z")


def signature(corpus_id: Column, sequence: Column, content_hash: Column, secret: str | None = None) -> Column:
    text = message(corpus_id, sequence, content_hash)
    whole = hmac(secret, text) if secret else sha256(text)
    signed = F.substring(whole, 1, 16)
    return F.when(valid_parameters(corpus_id, sequence, content_hash), signed).otherwise(F.raise_error(F.lit("invalid watermark parameters")))


def comment(corpus_id: Column, sequence: Column, signed: Column) -> Column:
    return F.concat(F.lit(f"<!-- corpus-watermark:{VERSION}:"), corpus_id, F.lit(":"), sequence.cast("string"), F.lit(":"), signed, F.lit(" -->"))


def stripped(content: Column) -> Column:
    """Without a trailing mark of any version, and without trailing white space."""
    return trimmed_end(F.when(content.contains(NAME), F.regexp_replace(content, ANY_MARK + AT_END, "")).otherwise(content))


def stripped_strict(content: Column) -> Column:
    """Without a trailing mark, if it is well formed; the rest as it is."""
    return F.regexp_replace(content, rf"\s*{MARK}{AT_END}", "")


def injected(content: Column, corpus_id: Column, sequence: Column, content_hash: Column, secret: str | None = None) -> Column:
    return F.concat(stripped(content), F.lit("\n"), comment(corpus_id, sequence, signature(corpus_id, sequence, content_hash, secret)))


def marked(content: Column) -> Column:
    return content.rlike(MARK + AT_END)


def looks_marked(content: Column) -> Column:
    """Whether a mark of this version stands at the end, whatever its signature: a cheap test."""
    return content.contains(NAME) & content.rlike(MARK.replace(r"v\d+", VERSION) + AT_END)


def extracted(content: Column) -> Column:
    """A struct of version, corpus_id, sequence, signature; null without a mark at the end. The mark is looked for
    once, and what stands between its colons read off."""

    def fields(p: Column) -> Column:
        signed = F.regexp_extract(F.get(p, F.lit(4)), r"\A[a-f0-9]+", 0)
        own = F.struct(F.get(p, F.lit(1)).alias("version"), F.get(p, F.lit(2)).alias("corpus_id"), F.get(p, F.lit(3)).try_cast("long").alias("sequence"), signed.alias("signature"))
        return F.when(F.size(p) == 5, own)

    return let(F.when(content.contains(NAME), F.split(F.regexp_extract(content, MARK + AT_END, 0), ":")), fields)


def verified(content: Column, secret: str | None = None) -> Column:
    """A struct (valid, reason, version, corpus_id, sequence, signature)."""

    def told(mark: Column) -> Column:
        text = message(mark.corpus_id, mark.sequence, sha256(stripped(content)))
        expected = F.substring(hmac(secret, text) if secret else sha256(text), 1, 16)
        reason = F.when(mark.isNull(), F.lit(NONE)).when(mark.version != VERSION, F.concat(F.lit(UNSUPPORTED), mark.version)).when(expected != mark.signature, F.lit(MISMATCH))
        return F.struct(reason.alias("reason"), mark.version.alias("version"), mark.corpus_id.alias("corpus_id"), mark.sequence.alias("sequence"), mark.signature.alias("signature"))

    return let(let(extracted(content), told), lambda x: F.struct(x.reason.isNull().alias("valid"), *[x[c].alias(c) for c in ("reason", "version", "corpus_id", "sequence", "signature")]))


def self_verified(content: Column, corpus_id: Column, sequence: Column, secret: str | None = None) -> Column:
    """Whether a chunk carries a valid mark of its own document and place."""
    return let(verified(content, secret), lambda v: v.valid & v.corpus_id.eqNullSafe(corpus_id) & v.sequence.eqNullSafe(sequence.cast("long")))


def fault(content: Column, corpus_id: Column, sequence: Column, secret: str | None = None) -> Column:
    """Why a chunk that was just marked doesn't verify as its document's; null if it does."""
    at = sequence.cast("string")
    failed = lambda v: F.concat(F.lit(CHECK_FAILED), at, F.lit(": "), F.coalesce(v.reason, F.lit(NO_REASON)))
    other = F.concat(F.lit(OTHER_PAYLOAD), at, F.lit(" (expected corpus_id="), corpus_id, F.lit(")"))
    return let(verified(content, secret), lambda v: F.when(~v.valid, failed(v)).when(~(v.corpus_id.eqNullSafe(corpus_id) & v.sequence.eqNullSafe(sequence.cast("long"))), other))
