"""Secret scans over an incremental ledger of blobs.

A blob is a text, addressed by its SHA-256; a path is a row that holds it. The ledger holds
the (blob, rule version) pairs that were scanned before, with what was found. A scan works
out the pairs that the ledger lacks, scans one copy of each such blob, and joins the
findings of old and new pairs back to every path. Rules carry a version each, so changing
one rule scans all blobs again for that rule alone.

Only hashes and ids are grouped; texts are read where they lie and never shuffled.

Defined results: null text is the empty text; a text without findings has an empty span
list; repeated rows each get their findings; paths may be null and may repeat; an empty
table gives an empty result; other columns are dropped. Positions are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprov.llm.common import hash_filter, map_columns, passes, staged

# The rules' patterns.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
PRIVATE_KEY = re.compile(r"-----(BEGIN|END) (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----")
#: Lines of a key, which may be those of a quoted string with its line feeds spelled out; what may stand around them; what they hold.
KEY_BREAK = re.compile(r"\\[nr]|[\r\n]")
KEY_EDGE = " \t\f\v\"'`,;>|#*\\()[]{}"
KEY_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*: ")
KEY_SHORT = re.compile(r"[A-Za-z0-9+/=_-]+")
KEY_RUN = re.compile(r"[A-Za-z0-9+/=_-]{16,}")
KEY_LEAD = re.compile(r"[A-Za-z0-9+/=_-]{16,}(?:[ \t]+(?:[A-Za-z0-9+/=_-]{16,}|[A-Za-z0-9+/_-]*=+))*(?:[ \t]+[A-Za-z0-9+/=_-]+\Z)?")
WEB_TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
SERVICE_TOKEN = re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", re.A)
STARTS = {"private_key": ("-----BEGIN",), "web_token": ("eyJ",), "service_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "AIza")}
# End of the fixed values.

#: kind: (rule version, in the order in which kinds are listed)
RULES = {"assign": 1, "access": 1, "hex": 1, "private_key": 2, "web_token": 1, "service_token": 1}
BASE = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate(RULES)}
#: Findings of up to so many bytes are sent to all tasks.
SMALL_BYTES = 8_000_000

PAIRS = "array<struct<kind: string, version: int>>"
SPANS = "array<struct<start: int, end: int, kind: string>>"


def find(text: str, kind: str) -> list[tuple[int, int, str]]:
    """The spans of one kind, leftmost first, none overlapping another of its kind."""
    if kind == "assign":
        return [(*m.span(), kind) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6] if "=" in text or ":" in text else []
    if kind == "access":
        return [(*m.span(), kind) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    if kind == "hex":
        # A run is maximal, so a run of 24 is all that has to be looked for.
        return [(*m.span(), kind) for m in LONG_HEX.finditer(text)]
    if not any(p in text for p in STARTS[kind]):
        return []
    if kind == "private_key":
        return [(*s, kind) for s in private_keys(text)]
    rule = {"web_token": WEB_TOKEN, "service_token": SERVICE_TOKEN}[kind]
    return [(*m.span(), kind) for m in rule.finditer(text)]


def private_keys(text: str) -> Iterator[tuple[int, int]]:
    """Keys from their BEGIN line to their END line, or, where that is missing or prose lies
    between, to the end of the lines that look like a key. Linear: what lies between two
    such marks is read once."""
    marks = list(PRIVATE_KEY.finditer(text))
    for i, m in enumerate(marks):
        if m[1] == "END":
            continue
        after = marks[i + 1] if i + 1 < len(marks) else None
        upto = after.start() if after else len(text)
        if after and after[1] == "END" and mostly_key(text, m.end(), upto):
            yield m.start(), after.end()
        else:
            yield m.start(), key_end(text, m.end(), upto)


def key_lines(text: str, at: int, upto: int) -> Iterator[tuple[int, str]]:
    """(start, line) of lines that hold a letter or digit, without what stands around them."""
    while at < upto:
        m = KEY_BREAK.search(text, at, upto)
        line = text[at : m.start() if m else upto].rstrip(KEY_EDGE)
        own = line.lstrip(KEY_EDGE)
        if any(c.isalnum() for c in own):
            yield at + len(line) - len(own), own
        at = m.end() if m else upto


def mostly_key(text: str, at: int, upto: int) -> bool:
    """Whether most characters lie in lines or long runs of a key, or in its headers."""
    key = other = 0
    for _, line in key_lines(text, at, upto):
        own = len(line) if KEY_HEADER.match(line) or KEY_SHORT.fullmatch(line) else sum(len(r[0]) for r in KEY_RUN.finditer(line))
        key += own
        other += len(line) - own
    return key > other


def key_end(text: str, at: int, upto: int) -> int:
    """Where the lines after a BEGIN mark stop to be those of a key. Headers may come before
    the first of them; after a long line a short one may follow, the last."""
    end, first, body = at, True, False
    for start, line in key_lines(text, at, upto):
        lead = KEY_LEAD.match(line) or (KEY_SHORT.fullmatch(line) if body else None)
        if lead:
            end, body = start + lead.end(), True
        if lead.end() < max(16, len(line)) if lead else body or not (first or KEY_HEADER.match(line)):
            break
        first = False
    return end


def unscanned(paths: DataFrame, ledger: DataFrame | None, rules: dict[str, int]) -> DataFrame:
    """(blob, path, rules): a blob that misses rules in the ledger, one path that holds it,
    and the rules to run."""
    blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        return blobs.withColumn("rules", current(rules))
    done = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("done"))
    missing = F.array_except(current(rules), F.coalesce("done", F.array().cast(PAIRS)))
    return blobs.join(done, "blob", "left").select("blob", "path", missing.alias("rules")).where(F.size("rules") > 0)


def current(rules: dict[str, int]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("version")) for k, v in rules.items()])


def of_rules(spans: Column, rules: Column) -> Column:
    """The spans whose kind is among the rules."""
    return F.filter(spans, lambda s: F.exists(rules, lambda r: r.kind == s.kind))


def scan_blobs(docs: DataFrame, todo: DataFrame) -> DataFrame:
    """(blob, spans) of the blobs in `todo` where anything is found. The rows to scan are
    picked where they are read, by a bitmap of bounded size over (blob, path): no text moves.
    A row that the bitmap lets pass by chance is scanned in vain, and dropped below."""
    row = F.xxhash64("blob", "path")
    sent = docs.sparkSession.sparkContext.broadcast(hash_filter(todo.select(row.alias("h"))))
    kinds = [r.kind for r in todo.select(F.explode("rules.kind").alias("kind")).distinct().collect()]  # at most a row a rule

    def run(blobs: list, places: list, texts: list) -> Iterator[dict[str, list]]:
        out: dict[str, list] = {"blob": [], "spans": []}
        for blob, place, text in zip(blobs, places, texts, strict=True):
            if passes(sent.value, place):
                found = [s for kind in kinds for s in find(text, kind)]
                if found:
                    out["blob"].append(blob)
                    out["spans"].append([{"start": a, "end": b, "kind": k} for a, b, k in found])
        yield out

    found = map_columns(docs.select("blob", row.alias("place"), "text"), ["blob", "place", "text"], run, f"blob binary, spans {SPANS}")
    once = found.dropDuplicates(["blob"])
    return once.join(todo.select("blob", "rules"), "blob").select("blob", of_rules(F.col("spans"), F.col("rules")).alias("spans")).where(F.size("spans") > 0)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: dict[str, int] = RULES, path: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): a row (path, blob, spans) for each row of `docs`, and the ledger
    with this scan added: (blob, rules, spans), a row for each scan of a blob. Findings are
    those of the present versions of `rules`, from this scan or an earlier one."""
    versioned = docs.select(F.col(path).alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    versioned = versioned.withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    paths = staged(versioned.select("path", "blob"))
    todo = staged(unscanned(paths, ledger, rules))
    found = staged(scan_blobs(versioned, todo))
    none = F.array().cast(SPANS)
    new = todo.join(found, "blob", "left").select("blob", "rules", F.coalesce("spans", none).alias("spans"))
    full, valid = new, found
    if ledger is not None:
        full = ledger.unionByName(new)
        kept = F.array_intersect("rules", current(rules))
        old = ledger.select("blob", of_rules(F.col("spans"), kept).alias("spans")).where(F.size("spans") > 0)
        valid = old.unionByName(found).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # a row a scan with findings
    findings = paths.join(valid, "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))
    return findings, full


def ordered(spans: Column) -> Column:
    """Spans by start, then by kind as listed."""
    rank = F.create_map(*[x for k, i in ORDER.items() for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.element_at(rank, s.kind).alias("rank"), s.end.alias("end"), s.kind.alias("kind")))
    return F.array_sort(keyed)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[secret]", path: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """`docs` with its columns, every found span of the text replaced by `mark`; null texts
    stay null. `length` names a column to set to the new number of code points."""
    findings, _ = scan(docs, path=path, text=text)
    hits = staged(findings.where(F.size("spans") > 0).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans")).dropDuplicates(["__blob"]))
    size = hits.agg(F.count("*").alias("n"), F.sum(F.size("__spans")).alias("spans")).first()
    few = 64 * (size.n + (size.spans or 0)) <= SMALL_BYTES
    own = docs[text]  # not F.col: that could be read as the new column of the same name
    blob = F.unhex(F.sha2(F.coalesce(own.cast("string"), F.lit("")).cast("binary"), 256))
    both = docs.join(F.broadcast(hits) if few else hits, blob == F.col("__blob"), "left")
    covered = F.array_sort(F.transform("__spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(own, acc.at + 1, F.greatest(s.start - acc.at, F.lit(0)))
        out = F.when(s.start >= acc.at, F.concat(acc.out, before, F.lit(mark))).otherwise(acc.out)
        return F.struct(out.alias("out"), F.greatest(acc.at, s.end).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate(covered, start, step, lambda acc: F.concat(acc.out, F.substring(own, acc.at + 1, F.length(own))))
    new = {text: F.when(F.col("__spans").isNull(), own).otherwise(clean)}
    if length:
        new[length] = F.when(F.col("__spans").isNull(), docs[length]).otherwise(F.length(clean).cast(docs.schema[length].dataType))
    return both.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
