"""Where documents stand: stage, staleness, attention, dashboards, quality, housekeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What is said of a document.
NEXT_ACTION = {"parse": "Wait for parse or retry", "chunk": "Run chunking", "watermark": "Run watermark", "promote": "Promote to Encyclopedia", "crosswalk": "Generate crosswalk", "ready": "Ready", "failed": "Re-parse document"}
ATTENTION = {"parse": ("Parsing appears stalled (", "h since update)"), "chunk": ("Needs chunking (", "h pending)"), "watermark": ("Needs watermarking (", "h pending)"), "promote": ("Watermarked but not promoted (", "h pending)")}
BUTTONS = {"parsed": "Chunk Document", "edited": "Chunk Document", "chunked": "Watermark Chunks", "watermarked": "Re-chunk", "failed": "Re-parse"}
BLOCKERS = ("Need at least 2 documents in this session.", "Complete parse review for all documents.", "Chunk all documents.", "Watermark all documents.", "Promote all watermarked documents to Encyclopedia.", "Need at least 2 promoted + watermarked documents.")
# End of the fixed values.
PARSED, CHUNKED = ("parsed", "edited", "chunked", "watermarked"), ("chunked", "watermarked")


def by_value(column: Column, values: dict) -> Column:
    known = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.element_at(known, column)


def stage(status: Column, promoted: Column, crosswalk: Column) -> Column:
    """`promoted` and `crosswalk` are booleans: whether the document was, and the session has one."""
    at = by_value(status, {"failed": "failed", "pending": "parse", "parsing": "parse", "parsed": "chunk", "edited": "chunk", "chunked": "watermark"})
    last = F.when(~promoted, "promote").when(~crosswalk, "crosswalk").otherwise("ready")
    return F.coalesce(at, F.when(status == "watermarked", last).otherwise("ready"))


def hours_since(updated: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(updated)) / 3.6e9


def stale(status: Column, promoted: Column, updated: Column, as_of: Column) -> Column:
    """After an hour for what is being parsed, a day for what waits for a person."""
    limit = F.when(status.isin("pending", "parsing"), 1).when(status.isin("parsed", "edited", "chunked") | ((status == "watermarked") & ~promoted), 24)
    return F.coalesce(hours_since(updated, as_of) >= limit, F.lit(False))


def stale_hours(status: Column, promoted: Column, updated: Column, as_of: Column) -> Column:
    waits = status.isin("pending", "parsing", "parsed", "edited", "chunked") | ((status == "watermarked") & ~promoted)
    return F.when(waits & updated.isNotNull(), F.greatest(F.lit(0), F.floor(hours_since(updated, as_of)))).otherwise(0).cast("long")


def attention(status: Column, at: Column, is_stale: Column, hours: Column, error: Column) -> Column:
    said = F.coalesce(*[F.when(at == k, F.concat(F.lit(a), hours.cast("string"), F.lit(b))) for k, (a, b) in ATTENTION.items()])
    own = F.trim(error)
    return F.when(status == "failed", F.coalesce(F.when(own != "", own), F.lit("Processing failed"))).when(is_stale, said)


def dashboard_rows(docs: DataFrame, as_of: Column) -> DataFrame:
    """Documents (status, promoted, crosswalk, updated_at, error_message) with their state."""
    c = F.col
    out = docs.withColumn("stage", stage(c("status"), c("promoted"), c("crosswalk")))
    out = out.withColumn("is_stale", stale(c("status"), c("promoted"), c("updated_at"), as_of)).withColumn("stale_hours", stale_hours(c("status"), c("promoted"), c("updated_at"), as_of))
    out = out.withColumn("attention_reason", attention(c("status"), c("stage"), c("is_stale"), c("stale_hours"), c("error_message")))
    return out.withColumn("next_action", by_value(c("stage"), NEXT_ACTION)).withColumn("button", by_value(c("status"), BUTTONS))


def filtered(rows: DataFrame, needle: str | None = None, preset: str = "all", session: str = "all", stage_is: str = "all", framework: str = "all", fields: tuple[str, ...] = ("source_filename", "session_name", "title"), lists: tuple[str, ...] = ("frameworks",)) -> DataFrame:
    """Rows that pass all filters; "all" passes everything."""
    if preset == "attention":
        rows = rows.where("attention_reason is not null")
    elif preset == "failed":
        rows = rows.where(F.col("stage") == "failed")
    elif preset == "stale":
        rows = rows.where("is_stale")
    elif preset == "ready":
        rows = rows.where(F.col("stage").isin("ready", "crosswalk"))
    if session != "all":
        rows = rows.where(F.col("session_id") == session)
    if stage_is != "all":
        rows = rows.where(F.col("stage") == stage_is)
    if framework != "all":
        rows = rows.where(F.array_contains("frameworks", framework))
    if needle and needle.strip():
        low = needle.strip().lower()
        hit = F.lit(False)
        for f in fields:
            hit |= F.coalesce(F.contains(F.lower(F.col(f)), F.lit(low)), F.lit(False))
        for f in lists:
            hit |= F.exists(f, lambda x: F.contains(F.lower(x), F.lit(low)))
        rows = rows.where(hit)
    return rows


def page_numbers(page: int = 1, size: int = 50) -> tuple[int, int]:
    return max(1, page), max(10, min(200, size))


def page_of(rows: DataFrame, sort: str = "updated_at", descending: bool = True, page: int = 1, size: int = 50, key: str = "id") -> tuple[DataFrame, dict]:
    """One page in a total order, and what the pager shows; a page beyond the last is the last."""
    page, size = page_numbers(page, size)
    total = rows.count()
    pages = max(1, -(-total // size))
    page = min(page, pages)
    first = F.col(sort).desc() if descending else F.col(sort).asc()
    shown = rows.orderBy(first, F.col("updated_at").desc(), key).offset((page - 1) * size).limit(size)
    return shown, {"page": page, "total": total, "total_pages": pages, "has_previous": page > 1, "has_next": page < pages}


def counts() -> list[Column]:
    at = F.col("stage")
    return [
        F.count("*").alias("total"), F.count_if(F.col("attention_reason").isNotNull()).alias("attention"), F.count_if(at.isin("parse", "chunk", "watermark")).alias("in_progress"),
        F.count_if(at.isin("ready", "crosswalk")).alias("ready"), F.count_if(at == "failed").alias("failed"), F.count_if("is_stale").alias("stale"),
    ]


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(*counts())


def session_rollup(sessions: DataFrame, rows: DataFrame, key: str = "session_id") -> DataFrame:
    """Counts by session, also for sessions without rows."""
    own = rows.groupBy(key).agg(*counts())
    names = ("total", "attention", "in_progress", "ready", "failed", "stale")
    return sessions.join(own, key, "left").fillna(0, subset=list(names)).orderBy(F.desc("attention"), F.desc("in_progress"), key)


#: How listings are ordered.
LISTINGS = {"sessions": ("created_at", False), "documents": ("sort_order", True), "library": ("created_at", False), "runs": ("started_at", False)}


def listed(rows: DataFrame, what: str, key: str = "id") -> DataFrame:
    """Rows in the order of their listing, ties by key."""
    by, up = LISTINGS[what]
    return rows.orderBy(F.col(by).asc() if up else F.col(by).desc(), key)


def bulk_action(rows: DataFrame) -> Column:
    """The action that a bulk run takes with a row; null for none."""
    return F.when(F.col("status") == "failed", "parse").when(F.col("stage").isin("chunk", "watermark"), F.col("stage"))


def bulk_targets(pages: list[DataFrame], action: str, key: str = "id") -> DataFrame:
    """What a bulk action takes of several pages of results: a document once, as the last page that has it shows it."""
    every = None
    for n, page in enumerate(pages):
        own = page.withColumn("__page", F.lit(n))
        every = own if every is None else every.unionByName(own)
    last = every.groupBy(key).agg(F.max_by(F.struct(*[c for c in every.columns if c != key]), "__page").alias("x"))
    return last.select(key, "x.*").drop("__page").where(bulk_action(last) == action)


def facets(rows: DataFrame, *columns: str) -> DataFrame:
    """The distinct values of some columns, lists or not."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in columns}
    values = F.concat(*[F.col(c) if kinds[c].startswith("array") else F.array(F.col(c)) for c in columns])
    return rows.select(F.explode(values).alias("facet")).where("facet is not null").distinct()


def left_out(docs: DataFrame) -> DataFrame:
    """Documents by what keeps them from the next steps: (list, id) for each list that a document is on."""
    s = F.col("status")
    tests = {"not_parsed": ~s.isin(*PARSED), "not_chunked": ~s.isin(*CHUNKED), "not_watermarked": s != "watermarked", "not_promoted": (s == "watermarked") & ~F.col("promoted")}
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return docs.select(F.explode(names).alias("list"), "id")


def action_counts(rows: DataFrame) -> DataFrame:
    """How many rows each bulk action would take, and those complete and failed."""
    return rows.agg(*[F.count_if(bulk_action(rows) == a).alias(f"{a}_eligible") for a in ("parse", "chunk", "watermark")], F.count_if(F.col("stage") == "ready").alias("complete"), F.count_if(F.col("status") == "failed").alias("failed"))


def percent(n: Column, total: Column) -> Column:
    return F.when(total <= 0, 0).otherwise(F.floor(F.try_divide(n * 100.0, total) + 0.5)).cast("long")


def quality(docs: DataFrame, key: str = "session_id") -> DataFrame:
    """Shares done, gates, blockers and progress by session; needs status, promoted, chunks_marked, crosswalk."""
    s = F.col("status")
    n = docs.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(s.isin(*PARSED)).alias("parsed"), F.count_if(s.isin(*CHUNKED)).alias("chunked"), F.count_if(s == "watermarked").alias("watermarked"),
        F.count_if((s == "watermarked") & F.col("promoted")).alias("promoted"), F.count_if((s == "watermarked") & F.col("chunks_marked")).alias("marked"), F.bool_or(s == "chunked").alias("some_chunked"), F.bool_or("crosswalk").alias("has_crosswalk"),
    )
    t = F.col("total")
    shares = [percent(F.col(a), t).alias(b) for a, b in (("parsed", "parse_accuracy"), ("chunked", "chunk_coverage"), ("marked", "watermark_integrity"), ("promoted", "promotion_readiness"))]
    gates = [((t > 0) & (F.col(c) == t)).alias(f"{g}_gate") for c, g in (("parsed", "parse"), ("chunked", "chunk"), ("watermarked", "watermark"), ("promoted", "promote"))]
    out = n.select("*", *shares, *gates)
    out = out.withColumn("overall", F.floor((F.col("parse_accuracy") + F.col("chunk_coverage") + F.col("watermark_integrity") + F.col("promotion_readiness")) / 4.0 + 0.5).cast("long"))
    tests = (t < 2, ~F.col("parse_gate"), ~F.col("chunk_gate"), ~F.col("watermark_gate"), ~F.col("promote_gate"), F.col("promoted") < 2)
    out = out.withColumn("blockers", F.array_compact(F.array(*[F.when(c, m) for c, m in zip(tests, BLOCKERS, strict=True)])))
    step = F.when(F.col("has_crosswalk"), 5).when(F.col("watermarked") == t, 4).when(F.col("watermarked") > 0, 3).when(F.col("some_chunked"), 2).otherwise(1)
    return out.withColumn("can_generate_crosswalk", F.size("blockers") == 0).withColumn("step", step)


def document_step(status: Column) -> Column:
    return F.coalesce(by_value(status, {"parsed": 1, "edited": 1, "failed": 1, "chunked": 2, "watermarked": 3}), F.lit(0))


def reconciled(sessions: DataFrame, docs: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    """Sessions after housekeeping: empty ones that stayed in uploading go; others in uploading
    move on if they have a crosswalk, or no document that waits."""
    own = docs.groupBy("session_id").agg(F.count_if(F.col("status").isin("pending", "parsing")).alias("waiting"))
    both = sessions.join(own, "session_id", "left")
    stuck = F.col("status") == "uploading"
    old = F.col("created_at") < as_of - F.make_dt_interval(mins=F.lit(minutes))
    both = both.where(~(stuck & F.col("waiting").isNull() & old))
    moved = F.when(stuck & F.col("waiting").isNotNull(), F.when(F.col("has_crosswalk"), "crosswalk_done").when(F.col("waiting") == 0, "complete"))
    return both.withColumn("status", F.coalesce(moved, F.col("status"))).drop("waiting")


def renamed(docs: DataFrame, key: str = "id") -> DataFrame:
    """Documents with numbered names where a session has several plain "upload" files."""
    plain = F.col("source_filename").rlike(r"\Aupload(\.[A-Za-z0-9]+)?\z")
    w = Window.partitionBy("session_id", "source_filename").orderBy("created_at", key)
    end = F.regexp_extract("source_filename", r"(\.[A-Za-z0-9]+)\z", 1)
    n = F.row_number().over(w)
    new = F.concat(F.lit("upload-"), n.cast("string"), F.when(end == "", ".txt").otherwise(end))
    return docs.withColumn("source_filename", F.when(plain & (n > 1), new).otherwise(F.col("source_filename")))
