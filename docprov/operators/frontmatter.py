"""Metadata headers of Markdown documents, as a typed struct and an error that never throws."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprov.functions import text
from docprov.functions.text import let

SCHEMA = (
    "struct<corpus_id: string, title: string, tier: string, version: string, frameworks: array<string>, industries: array<string>, segments: array<string>, "
    "source_url: string, source_publisher: string, last_verified: string, content_type: string, language: string, "
    "fact_check: struct<status: string, checked_at: string, checked_by: string, notes: string>, "
    "sire: struct<subject: string, included: array<string>, excluded: array<string>, relevant: array<string>>, "
    "license: struct<status: string, notes: string, output_policy: string>, content: string, error: string>"
)
REQUIRED = ("corpus_id", "title", "tier", "version")
HEADER = re.compile(r"\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\Z", re.S)
#: The same for Spark, up to where the body begins; white space as Python strips it; a second-level heading in a body.
FRONT = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85" + "".join(x for x in text.BLANKS if x not in "\t\n\x0b\x0c\r \ufeff")
HEADED = rf"(?:\A|\n)##[{BLANKS}]"
ENTRY = re.compile(r"^(\s*)([A-Za-z_][\w-]*):[ \t]*(.*?)\s*$")
LISTS, NESTED = ("frameworks", "industries", "segments"), {"fact_check": (), "sire": ("included", "excluded", "relevant"), "license": ()}
MIN_BODY = 50


def value_of(raw: str) -> str | list[str]:
    """A list in brackets, or text without its quotes."""
    if raw.startswith("[") and raw.endswith("]"):
        items = (re.sub(r"^[\"']|[\"']$", "", x.strip()) for x in raw[1:-1].split(","))
        return [x for x in items if x]
    if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "\"'":
        return raw[1:-1]
    return raw


def header_of(block: str) -> dict:
    """Keys and values, one level deep by indentation; other lines are passed over, so a
    value on the line below its key is lost."""
    out: dict = {}
    parent = None
    for line in block.splitlines():
        m = ENTRY.match(line)
        if not m:
            continue
        indent, key, raw = m.groups()
        if indent and parent is not None:
            if raw:
                out[parent][key] = value_of(raw)
        elif not indent:
            parent = None if raw else key
            out[key] = value_of(raw) if raw else {}
    return out


FIELDS = ("corpus_id", "title", "tier", "version", "frameworks", "industries", "segments", "source_url", "source_publisher", "last_verified", "content_type", "language", "fact_check", "sire", "license", "content", "error")


def fields_of(head: str | None, size: int, headed: bool) -> dict:
    """The fields of a header and no content, or an error: the first of no delimiters, a missing field, a
    short body, no second-level heading. Of the body only its size and whether it has such a heading are asked for."""
    none = dict.fromkeys(FIELDS)
    if head is None:
        return none | {"error": "missing frontmatter delimiters"}
    found = header_of(head)
    missing = next((k for k in REQUIRED if not found.get(k)), None)
    if missing:
        return none | {"error": f"Missing required frontmatter field: {missing}"}
    if size < MIN_BODY:
        return none | {"error": f"Content is too short: {size} characters"}
    if not headed:
        return none | {"error": "Content has no second-level heading"}
    plain = lambda v: v if isinstance(v, str) else None
    many = lambda v: v if isinstance(v, list) else []
    out = none | {k: plain(found.get(k)) for k in ("corpus_id", "title", "tier", "version", "source_url", "source_publisher", "last_verified")}
    out |= {k: many(found.get(k)) for k in LISTS}
    out |= {"content_type": plain(found.get("content_type")) or "prose", "language": plain(found.get("language")) or "en"}
    for name, lists in NESTED.items():
        own = found.get(name)
        if isinstance(own, dict) and own:
            fields = {"fact_check": ("status", "checked_at", "checked_by", "notes"), "sire": ("subject", *lists), "license": ("status", "notes", "output_policy")}[name]
            out[name] = {f: many(own.get(f)) if f in lists else plain(own.get(f)) for f in fields}
    return out


def parsed(raw: str | None) -> dict:
    """The document's fields, or an error."""
    m = HEADER.match(raw or "")
    if not m:
        return fields_of(None, 0, False)
    body = m[2].strip()
    out = fields_of(m[1], len(body), bool(re.search(r"^##\s", body, re.M)))
    return out if out["error"] else out | {"content": body}


def parse(raw: Column) -> Column:
    """A struct of the document's fields and `error`. Only the header goes to Python; the body stays in the plan."""

    @F.pandas_udf(SCHEMA)
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([fields_of(*x) for x in zip(*part, strict=True)], columns=list(FIELDS))

    front = F.regexp_extract(raw, FRONT, 0)
    head = F.when(front != "", F.regexp_extract(raw, FRONT, 1))
    body = F.btrim(F.substring(raw, F.length(front) + 1, F.lit(2**31 - 1)), F.lit(BLANKS))
    out = run(head, F.coalesce(F.length(body), F.lit(0)), F.coalesce(body.rlike(HEADED), F.lit(False)))
    return let(out, lambda own: own.withField("content", F.when(own.error.isNull(), body)))


def parse_documents(raw: DataFrame, column: str = "raw") -> DataFrame:
    """All columns of `raw` and those of its parsed header."""
    return raw.withColumn("parsed", parse(F.col(column))).select("*", "parsed.*").drop("parsed")


def first_valid(raw: DataFrame, key: str, candidates: list[Column]) -> DataFrame:
    """(key, markdown): of several texts for a row, the first that parses without error."""
    exploded = raw.select(key, F.posexplode(F.array_distinct(F.array_compact(F.array(*candidates)))).alias("at", "markdown"))
    good = exploded.withColumn("error", parse(F.col("markdown")).error).where("error is null")
    return good.groupBy(key).agg(F.min_by("markdown", "at").alias("markdown"))
