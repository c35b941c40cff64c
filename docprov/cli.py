"""Command line: validate, ingest, embed, chunk again, parse, approve and verify.

Tables lie in the folder of --store: documents, chunks, drafts and events, which change by atomic commits (a run that
ends half way changes nothing), and envelopes, which are only ever added to.
"""

from __future__ import annotations

import argparse
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docprov.functions.watermark import verified
from docprov.operators import drafts, embed, ingest, parse, store
from docprov.session import stored
from docprov.sources import envelopes, markdown
from docprov.sources.snapshots import Tables, View, is_store

DOCUMENTS = "corpus_id string, version string, organization_id string, content_hash string, title string, tier string, content_type string, source_url string, source_publisher string, last_verified string, frameworks array<string>, industries array<string>, segments array<string>, is_active boolean"
ACTIONS = ("validate", "ingest", "ingest_and_embed", "embed_pending", "rechunk", "ingest_content", "parse", "approve_draft", "verify")
READS_FOLDER = ("validate", "ingest", "ingest_and_embed", "rechunk")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docprov", description=__doc__)
    p.add_argument("action", choices=ACTIONS)
    p.add_argument("--corpora", help="folder of Markdown files, or of chunks as Parquet for verify")
    p.add_argument("--store", help="folder of the tables")
    p.add_argument("--file", help="the text to ingest (ingest_content) or to parse")
    p.add_argument("--draft-id", help="the draft to approve")
    p.add_argument("--corpus-id", help="this corpus only")
    p.add_argument("--limit", type=int, default=50, help="chunks to embed; the last batch may go beyond")
    p.add_argument("--tier", choices=("tier_1", "tier_2", "tier_3"), help="tier of a parsed document")
    p.add_argument("--frameworks", type=lambda s: [x.strip() for x in s.split(",") if x.strip()], default=[], help="frameworks of a parsed document, with commas")
    p.add_argument("--secret", help="sign and verify with this key")
    p.add_argument("--skip-fact-check", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    return p


CHUNKS = "id string, document_id string, corpus_id string, sequence int, section_title string, heading_level int, content string, content_hash string, token_count long, heading_path array<string>, tier string, frameworks array<string>, industries array<string>, segments array<string>, language string, embedding_status string, embedding array<double>, updated_at timestamp, lease_expires_at timestamp, is_active boolean, status string, run_id string, authority_id string, error string"


EVENTS = "chunk_id string, run_id string, embedding_authority_id string, status string, error string, occurred_at timestamp"


class Store(Tables):
    """The tables of one folder, made when they are first asked for."""

    KINDS = {"documents": (DOCUMENTS, ("corpus_id",)), "chunks": (CHUNKS, ("document_id",)), "drafts": (drafts.COLUMNS, ("id",)), "events": (EVENTS, ("chunk_id",))}

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder)
        for name, (schema, key) in self.KINDS.items():
            self.define(name, schema, key)


def _now() -> Column:
    """The time, taken here and now: as an expression it would be read when a record is written."""
    return F.lit(datetime.now(UTC))


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    """New chunks as rows of the chunk table, waiting to be embedded."""
    empty = chunks.sparkSession.createDataFrame([], CHUNKS).schema
    own = {"id": F.concat_ws("-", "document_id", "sequence"), "status": F.lit("pending"), "updated_at": F.current_timestamp(), "is_active": F.lit(True)}
    return chunks.select(*[(own[f.name] if f.name in own else F.col(f.name) if f.name in chunks.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty])


def _ingested(args: argparse.Namespace, tables: Store | None, raw: DataFrame, fact_check: bool, rechunk: bool = False) -> tuple[dict[str, int], DataFrame]:
    if args.corpus_id:
        raw = raw.where(F.col("raw").rlike(rf"(?m)^corpus_id:[ \t]*[\"']?{_literal(args.corpus_id)}[\"']?[ \t]*$"))
    started = _now()
    if args.action == "validate" or args.dry_run or not tables:
        existing = tables.read("documents") if tables else raw.sparkSession.createDataFrame([], DOCUMENTS)
        results, _, _ = ingest.ingest(raw, existing, fact_check, args.secret, rechunk)
        results = stored(results)
        return _counted(results), results

    def work(view: View) -> DataFrame:
        results, documents, chunks = ingest.ingest(raw, view.read("documents"), fact_check, args.secret, rechunk)
        results, new = stored(results), stored(_chunk_rows(chunks))
        view.merge("chunks", new, lambda have: store.replaced(new, have))
        view.replace("documents", documents)
        return results

    results = tables.transaction(work)
    told = results.select("corpus_id", (~F.col("action").isin("invalid", "failed")).alias("valid"), F.array_compact(F.array("error")).alias("errors"), F.array().cast("array<string>").alias("warnings"), F.lit(None).cast("string").alias("document_id"), "action", *[F.lit(None).cast("long").alias(c) for c in ("chunk_count", "embedded", "pending", "old_chunk_count")])
    envelopes.AppendOnly(f"{tables.folder}/envelopes").append(envelopes.of_pipeline(told, envelopes.Context(uuid.uuid4().hex, "cli", args.action), started, _now()))
    return _counted(results), results


def _counted(results: DataFrame) -> dict[str, int]:
    return {r.action: r.n for r in results.groupBy("action").agg(F.count("*").alias("n")).collect()}


def _literal(text: str) -> str:
    return r"\Q" + text.replace(r"\E", "") + r"\E"


def _embedded(args: argparse.Namespace, tables: Store, provider: embed.Provider) -> dict[str, int]:
    run, started = uuid.uuid4().hex, _now()

    def claimed(view: View) -> DataFrame:
        have = view.read("chunks")
        picked = stored(store.claim(have, started, embed.whole_batches(args.limit), run_id=run, authority="authority").where("claimed").drop("claimed"))
        if not args.dry_run:
            view.merge("chunks", picked, lambda old: store.chunk_upsert(picked, old, ("id",)))
        return picked

    # Claimed in one commit, so that no other run embeds the same chunks; settled in a second one, under the same lease.
    picked = tables.transaction(claimed)
    results = stored(embed.embedded(picked, provider))
    events = stored(embed.events_of(results, _now()))
    if not args.dry_run and not events.isEmpty():

        def settled(view: View) -> None:
            view.merge("chunks", picked, lambda old: embed.settled(old, results, _now()))
            view.append("events", events)

        tables.transaction(settled)
        envelopes.AppendOnly(f"{tables.folder}/envelopes").append(envelopes.of_embedding(events.select((F.col("status") == "complete").alias("ok")), envelopes.Context(run, "cli", args.action), started, _now()))
    return {r.status: r["count"] for r in events.groupBy("status").count().collect()}


def _chunks_at(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of a store, of its folder `chunks`, or of plain Parquet files."""
    for store_folder in (folder, folder.rstrip("/").removesuffix("/chunks")):
        if is_store(spark, store_folder):
            return Store(spark, store_folder).read("chunks")
    return spark.read.parquet(folder)


def _say(counts: dict[str, int]) -> None:
    print(", ".join(f"{k} {v}" for k, v in sorted(counts.items())) or "nothing to do")


def main(argv: list[str] | None = None, spark: SparkSession | None = None, provider: embed.Provider | None = None, model: parse.TextModel | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.limit < 1:
        p.error("--limit must be 1 or more")
    if args.action in READS_FOLDER and not args.corpora:
        p.error(f"{args.action} needs --corpora")
    if args.action in ("ingest_content", "parse") and not args.file:
        p.error(f"{args.action} needs --file")
    if args.action == "approve_draft" and not args.draft_id:
        p.error("approve_draft needs --draft-id")
    if args.action not in ("validate", "verify") and not args.store and not args.dry_run:
        p.error(f"{args.action} needs --store")
    spark = spark or SparkSession.builder.appName("docprov").getOrCreate()
    tables = Store(spark, args.store) if args.store else None
    provider, model = provider or embed.hashing_provider(), model or parse.identity_model
    if args.action == "verify":
        chunks = _chunks_at(spark, args.corpora or args.store)
        told = chunks.select(verified(F.col("content"), args.secret).alias("v")).groupBy("v.valid").count()
        by = {r["valid"]: r["count"] for r in told.collect()}
        print(f"valid {by.get(True, 0)}, invalid {by.get(False, 0)}")
        return int(bool(by.get(False)))
    if args.action == "embed_pending":
        _say(_embedded(args, tables, provider))
        return 0
    if args.action in READS_FOLDER:
        counts, _ = _ingested(args, tables, markdown.markdown_files(spark, args.corpora), not args.skip_fact_check, args.action == "rechunk")
        _say(counts)
        if args.action == "ingest_and_embed" and not args.dry_run:
            _say(_embedded(args, tables, provider))
        return int(bool({"invalid", "failed"} & counts.keys()))
    if args.action == "ingest_content":
        counts, _ = _ingested(args, tables, spark.read.text(args.file, wholetext=True).select(F.col("value").alias("raw")), not args.skip_fact_check)
        _say(counts)
        return int(bool({"invalid", "failed"} & counts.keys()))
    have = tables.read("drafts") if tables else spark.createDataFrame([], drafts.COLUMNS)
    if args.action == "parse":
        new = spark.read.text(args.file, wholetext=True).select(F.expr("uuid()").alias("id"), F.lit(args.file.rsplit("/", 1)[-1]).alias("source_filename"), F.col("value").alias("source_text"), F.lit("cli").alias("created_by"))
        new = spark.createDataFrame(new.collect(), new.schema)  # one file
        state, refused = drafts.submit(have, new)
        for r in refused.collect():
            print(r.error)
            return 1
        hints = f"tier {args.tier or 'any'}, frameworks {', '.join(args.frameworks) or 'any'}"
        done, _ = parse.parsed_with_audit(new.withColumnRenamed("id", "document_id"), model, F.date_format(F.current_date(), "yyyy-MM-dd"), assemble=f"Write a document with a header; {hints}.")
        told = done.select(F.col("document_id").alias("id"), F.col("status").alias("__status"), F.col("parsed_markdown").alias("__markdown"))
        state = state.join(told, "id", "left").withColumn("status", F.coalesce("__status", "status")).withColumn("parsed_markdown", F.coalesce("__markdown", "parsed_markdown")).select(*have.columns)
        if tables and not args.dry_run:
            tables.replace("drafts", state)
        row = done.select("document_id", "status").first()
        print(f"draft {row.document_id}: {row.status}")
        return int(row.status != "parsed")
    have = stored(have)
    taken, refused = drafts.approve(have, spark.createDataFrame([(args.draft_id,)], "id string"))
    for r in refused.collect():
        print(r.error)
        return 1
    counts, results = _ingested(args, tables, taken.select("raw"), False)
    _say(counts)
    if {"invalid", "failed"} & counts.keys():
        return 1
    if tables and not args.dry_run:
        corpus = results.select("corpus_id").first().corpus_id
        tables.replace("drafts", drafts.approved(have, spark.createDataFrame([(args.draft_id, corpus)], "id string, document_id string")))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
