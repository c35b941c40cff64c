"""Tables that change by snapshots: every operation takes state and gives the next state.

Row updates are joins, never collects; writers replace a snapshot as a whole. Time is an
argument, so a rerun gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprov.functions.text import domain_slug

#: Rows that are sent to all tasks without a thought.
SMALL = 10_000
SCOPE = ("corpus_id", "organization_id")
LIST_FIELDS, FIELDS = ("frameworks", "industries", "segments"), ("version", "content_hash", "tier", "content_type", "source_url", "source_publisher", "last_verified", "title")


def same(a: str, b: str, columns: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def substantive_change(new: str, old: str) -> Column:
    """Whether any of eleven fields differs; lists in any order; a new document has changed."""
    out = F.col(f"{old}.corpus_id").isNull()
    for c in FIELDS:
        out |= ~F.col(f"{new}.{c}").eqNullSafe(F.col(f"{old}.{c}"))
    for c in LIST_FIELDS:
        out |= ~F.array_sort(F.col(f"{new}.{c}")).eqNullSafe(F.array_sort(F.col(f"{old}.{c}")))
    return out


def upsert_actions(incoming: DataFrame, existing: DataFrame, key: tuple[str, ...] = ("corpus_id", "version", "organization_id")) -> DataFrame:
    """The incoming rows with `action`: unchanged (same hash), updated, or inserted."""
    old = existing.select(*[F.col(c).alias(f"__{c}") for c in key], F.col("content_hash").alias("__hash"), F.lit(True).alias("__there"))
    on = F.lit(True)
    for c in key:
        on &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    both = incoming.join(old, on, "left")
    action = F.when(F.col("__there").isNull(), "inserted").when(F.col("content_hash") == F.col("__hash"), "unchanged").otherwise("updated")
    return both.withColumn("action", action).select(*incoming.columns, "action")


def upserted(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """The next snapshot: rows changed are replaced, new ones added, and older active
    versions in the scope of a new one deactivated."""
    acted = upsert_actions(incoming, existing)
    key = ("corpus_id", "version", "organization_id")
    changed = acted.where("action <> 'unchanged'").drop("action")
    fresh = acted.where("action = 'inserted'").select(*[F.col(c).alias(f"__{c}") for c in SCOPE]).distinct()
    on = F.lit(True)
    for c in SCOPE:
        on &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    kept = existing.alias("old").join(changed.alias("new"), same("old", "new", key), "left_anti")
    marked = kept.join(fresh.withColumn("__new", F.lit(True)), on, "left").withColumn("is_active", F.col("is_active") & F.col("__new").isNull())
    return marked.select(*existing.columns).unionByName(changed.withColumn("is_active", F.lit(True)).select(*existing.columns))


def chunk_upsert(new: DataFrame, existing: DataFrame, key: tuple[str, ...] = ("document_id", "sequence")) -> DataFrame:
    return existing.join(new, list(key), "left_anti").unionByName(new)


def replaced(new: DataFrame, existing: DataFrame, key: str = "document_id") -> DataFrame:
    """Delete-then-insert: all rows of a document give way to its new ones."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def deduplicated(new: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key is not there yet, one a key."""
    return new.dropDuplicates(key).join(existing, key, "left_anti")


def claim(chunks: DataFrame, as_of: Column, batch: int = 50, lease_seconds: int = 600, run_id: str = "run", authority: str = "authority") -> DataFrame:
    """The next state after the oldest claimable rows are leased: pending and stale ones, and
    those whose lease ran out. Needs (id, status, updated_at, lease_expires_at, is_active)."""
    free = F.col("status").isin("pending", "stale") | ((F.col("status") == "processing") & (F.col("lease_expires_at") < as_of))
    picked = chunks.where(F.col("is_active") & free).orderBy("updated_at", "id").limit(batch).select("id", F.lit(True).alias("claimed"))
    small = F.broadcast(picked) if batch <= SMALL else picked
    new = chunks.join(small, "id", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    lease = as_of + F.make_dt_interval(secs=F.lit(lease_seconds))
    changes = {"status": F.lit("processing"), "lease_expires_at": lease, "run_id": F.lit(run_id), "authority_id": F.lit(authority), "error": F.lit(None).cast("string")}
    for name, value in changes.items():
        if name in chunks.columns:
            new = new.withColumn(name, F.when(F.col("claimed"), value).otherwise(F.col(name)))
    return new


def settle(chunks: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """The next state after results (id, run_id, authority_id, ok, error) come in. A result
    counts only for a row in processing under the same run and authority; completing also
    needs an unexpired lease. Adds `accepted`."""
    r = results.select(F.col("id"), F.col("run_id").alias("r_run"), F.col("authority_id").alias("r_authority"), F.col("ok").alias("r_ok"), F.col("error").alias("r_error"))
    both = chunks.join(r, "id", "left")
    fence = (F.col("status") == "processing") & F.col("run_id").eqNullSafe(F.col("r_run")) & F.col("authority_id").eqNullSafe(F.col("r_authority"))
    live = F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") > as_of)
    accepted = F.coalesce(F.col("r_ok").isNotNull() & fence & (live | ~F.col("r_ok")), F.lit(False))
    both = both.withColumn("accepted", accepted)
    status = F.when(F.col("accepted"), F.when(F.col("r_ok"), "complete").otherwise("failed")).otherwise(F.col("status"))
    error = F.when(F.col("accepted") & ~F.col("r_ok"), F.substring("r_error", 1, 4000)).when(F.col("accepted"), F.lit(None).cast("string")).otherwise(F.col("error"))
    lease = F.when(~F.col("accepted"), F.col("lease_expires_at"))
    return both.withColumn("error", error).withColumn("lease_expires_at", lease).withColumn("status", status).drop("r_run", "r_authority", "r_ok", "r_error")


def run_gate(requests: DataFrame, authorities: DataFrame, policies: DataFrame, organizations: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Requests to start a run with the first `reason` against it, or null."""
    a = authorities.select(F.col("id").alias("embedding_authority_id"), F.col("is_active").alias("a_active"), F.col("environment").alias("a_env"))
    p = policies.select(F.col("id").alias("egress_policy_id"), F.col("is_active").alias("p_active"), F.col("scope").alias("p_scope"))
    o = organizations.select(F.col("id").alias("organization_id"), F.lit(True).alias("o_there"))
    out = requests.join(a, "embedding_authority_id", "left").join(p, "egress_policy_id", "left").join(o, "organization_id", "left")
    bindings = ("embedding_authority_id", "egress_policy_id", "organization_id", "triggered_by")
    if runs is not None:
        old = runs.select(F.col("run_id"), F.lit(True).alias("r_there"), *[F.col(b).alias(f"r_{b}") for b in bindings])
        out = out.join(old, "run_id", "left")
        differs = F.col("r_there") & ~F.lit(True)
        for b in bindings:
            differs |= F.col("r_there") & ~F.col(b).eqNullSafe(F.col(f"r_{b}"))
    else:
        differs = F.lit(False)
    reason = (
        F.when(F.col("run_id").isNull(), "run_id must not be null")
        .when(F.coalesce(F.trim("triggered_by"), F.lit("")) == "", "triggered_by must not be empty")
        .when(F.col("a_active").isNull(), "authority not found")
        .when(~F.col("a_active"), "authority is not active")
        .when(~F.col("a_env").eqNullSafe(F.lit("vpc")), "authority environment must be vpc")
        .when(F.col("p_active").isNull(), "policy not found")
        .when(~F.col("p_active"), "policy is not active")
        .when(~F.col("p_scope").eqNullSafe(F.lit("vpc")), "policy scope must be vpc")
        .when(F.col("organization_id").isNotNull() & F.col("o_there").isNull(), "organization not found")
        .when(differs, "run exists with other bindings")
    )
    return out.withColumn("reason", reason).select(*requests.columns, "reason")


def slugged(new: DataFrame, taken: DataFrame, name: str = "name", key: str = "id") -> DataFrame:
    """New rows with a `slug`: that of their name, with the least free number behind it where it is taken, by rows there
    (taken: slug) or by rows of the batch before it in order of `key`. Numbers already taken are skipped."""
    base = new.withColumn("__base", domain_slug(F.col(name)))
    n = F.row_number().over(Window.partitionBy("__base").orderBy(key))
    # Numbers of a base that are taken: 0 stands for the bare slug.
    held = taken.select("slug").distinct().withColumn("__cut", F.regexp_extract("slug", r"\A(.*)-([0-9]+)\z", 1)).withColumn("__no", F.regexp_extract("slug", r"\A(.*)-([0-9]+)\z", 2))
    own = held.select(F.col("slug").alias("__base"), F.lit(0).cast("long").alias("__no")).unionByName(held.where("__cut <> ''").select(F.col("__cut").alias("__base"), F.col("__no").try_cast("long").alias("__no")).where("__no > 0"))
    used = own.join(base.select("__base").distinct(), "__base", "left_semi").groupBy("__base").agg(F.array_sort(F.collect_set("__no")).alias("__used"))
    both = base.withColumn("__n", n).join(used, "__base", "left")
    # The n-th number that is not used: n - 1 and one more for each used one up to there.
    number = F.aggregate(F.coalesce("__used", F.array().cast("array<bigint>")), (F.col("__n") - 1).cast("long"), lambda acc, u: F.when(u <= acc, acc + 1).otherwise(acc))
    return both.withColumn("slug", F.when(number == 0, F.col("__base")).otherwise(F.concat("__base", F.lit("-"), number.cast("string")))).select(*new.columns, "slug")


def skip_repeats(snapshots: DataFrame, key: str, hash_column: str, at: str) -> DataFrame:
    """Snapshots whose hash differs from the one before."""
    before = F.lag(hash_column).over(Window.partitionBy(key).orderBy(at))
    return snapshots.withColumn("__before", before).where(~F.col(hash_column).eqNullSafe(F.col("__before"))).drop("__before")


def promoted(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """What promoting watermarked documents does, by (user_id, corpus_id): insert, update, or
    an error where another document holds the place."""
    held = library.select("user_id", "corpus_id", F.col("source_document_id").alias("held_by"))
    both = candidates.join(held, ["user_id", "corpus_id"], "left")
    action = F.when(F.col("status") != "watermarked", "error: not watermarked").when(F.col("held_by").isNull(), "insert").when(F.col("held_by") == F.col("document_id"), "update").otherwise("error: held by another document")
    return both.withColumn("action", action).select(*candidates.columns, "action")
