"""Embedding of claimed chunks by a provider: a function from a list of texts to vectors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprov.functions.vectors import input_text
from docprov.operators import store
from docprov.session import stored

Provider = Callable[[list[str]], list[list[float]]]
DIMENSIONS, BATCH, ATTEMPTS = 512, 20, 3


class Transient(Exception):
    """A failure worth another attempt."""


def hashing_provider(dimensions: int = DIMENSIONS) -> Provider:
    """Words hashed to signed positions, scaled to length 1: the same on every machine."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dimensions
            for word in text.lower().split():
                h = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % dimensions] += 1.0 if h >> 63 else -1.0
            size = sum(x * x for x in v) ** 0.5
            out.append([x / size for x in v] if size else v)
        return out

    return embed


def with_retries(call: Provider, texts: list[str], attempts: int = ATTEMPTS, pause: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Transient failures are tried again after 1, 2, 4 seconds; others are raised at once."""
    for n in range(attempts):
        try:
            return call(texts)
        except Transient:
            if n == attempts - 1:
                raise
            pause(2.0**n)
    raise AssertionError("no attempts")


def embedded(chunks: DataFrame, provider: Provider, dimensions: int = DIMENSIONS, batch: int = BATCH, attempts: int = ATTEMPTS) -> DataFrame:
    """(id, run_id, authority_id, ok, error, embedding) for claimed chunks (id, section_title,
    content, run_id, authority_id): one result a chunk, whatever the provider does."""
    rows = chunks.select("id", "run_id", "authority_id", input_text(F.col("section_title"), F.col("content")).alias("text"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors: list = []
            errors: list = []
            for at in range(0, len(part), batch):
                texts = part["text"].iloc[at : at + batch].tolist()
                try:
                    got = with_retries(provider, texts, attempts)
                    bad = [None if len(v) == dimensions else f"expected {dimensions} dimensions, got {len(v)}" for v in got]
                except Exception as e:  # the chunk fails, not the job
                    got, bad = [None] * len(texts), [f"{type(e).__name__}: {e}"] * len(texts)
                vectors += [v if b is None else None for v, b in zip(got, bad, strict=True)]
                errors += bad
            yield pd.DataFrame({"id": part["id"], "run_id": part["run_id"], "authority_id": part["authority_id"], "ok": [e is None for e in errors], "error": errors, "embedding": vectors})

    kind = chunks.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, run_id string, authority_id string, ok boolean, error string, embedding array<double>")


def whole_batches(limit: int, batch: int = 50) -> int:
    """A limit of chunks in whole batches: the one in which it is reached is embedded whole."""
    return -(-limit // batch) * batch


def settled(chunks: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """The next state of `chunks` once `results` of the provider came in."""
    state = store.settle(chunks, results.drop("embedding"), as_of)
    done = results.where("ok").select("id", F.col("embedding").alias("__new"))
    state = state.join(done, "id", "left")
    there = F.col("accepted") & F.col("__new").isNotNull()
    if "embedding_status" in chunks.columns:
        state = state.withColumn("embedding_status", F.when(there, "complete").otherwise(F.col("embedding_status")))
    return state.withColumn("embedding", F.when(there, F.col("__new")).otherwise(F.col("embedding"))).drop("__new")


def events_of(results: DataFrame, as_of: Column) -> DataFrame:
    return results.select(F.col("id").alias("chunk_id"), "run_id", F.col("authority_id").alias("embedding_authority_id"), F.when(F.col("ok"), "complete").otherwise("failed").alias("status"), "error", as_of.alias("occurred_at"))


def embed_pending(chunks: DataFrame, provider: Provider, as_of: Column, limit: int = 50, dimensions: int = DIMENSIONS, run_id: str = "run", authority: str = "authority") -> tuple[DataFrame, DataFrame]:
    """(next state, events): claim up to `limit` chunks, embed them in one pass, settle the results."""
    claimed = store.claim(chunks, as_of, limit, run_id=run_id, authority=authority)
    results = stored(embedded(claimed.where("claimed"), provider, dimensions))  # the provider is asked once
    return settled(claimed.drop("claimed"), results, as_of), events_of(results, as_of)


def embed_all(chunks: DataFrame, provider: Provider, as_of: Column, limit: int, batch: int = 50, dimensions: int = DIMENSIONS, run_id: str = "run", authority: str = "authority") -> tuple[DataFrame, DataFrame, int]:
    """(next state, events, chunks tried): as many whole batches as reach `limit` are claimed at once, embedded side by
    side, and settled at once, so that the table is written once whatever the limit."""
    state, events = embed_pending(chunks, provider, as_of, whole_batches(limit, batch), dimensions, run_id, authority)
    events = stored(events)
    return stored(state.drop("accepted")), events, events.count()
