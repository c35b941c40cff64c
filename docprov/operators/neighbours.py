"""Approximate nearest neighbours by cosine: an inverted file of cells with product-quantised codes.

Unit vectors are dealt to the cells of their nearest centroids. A search opens the lists of
the cells nearest to its query and no others, ranks what passes its filters by codes (a byte
for each part of a vector), and compares the best by their vectors, exactly. Centroids and
codebooks are fitted on at most `SAMPLE` vectors, those with the smallest hashes; every
vector is indexed. How many cells a search opens is found on the sample as well: enough for
`RECALL` of the true neighbours of some of its vectors.

The lists are a table of commits, bucketed by cell: appending touches no old file. The exact
way beside it is `retrieval.semantic`.

Vectors that are null, empty, zero or hold null or non-finite components, or of another
length than the sample's, are not indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docprov.functions.vectors import cosine, cosine_to
from docprov.sources.snapshots import Tables, View

SAMPLE, CELLS, ROUNDS, WORDS = 20_000, 1024, 10, 256
#: The share of true neighbours whose cells have to be opened, and the sample's vectors it is measured on.
RECALL, TRIED = 0.98, 200
#: What is compared exactly at least, and rows and queries that meet in one task.
CANDIDATES, BLOCK_ROWS, BLOCK_QUERIES = 200, 65_536, 512


def usable(vector: str) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce((F.size(vector) > 0) & sound, F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) / 2 - x @ centres.T).argmin(1)


def clustered(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of at most k clusters."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[rng.integers(0, len(x), len(empty))]
    return centres


class Codes:
    """What was fitted: centroids, the codebook of each part, and how many cells a search opens."""

    def __init__(self, sample: np.ndarray, cells: int, parts: int, seed: int = 7):
        rng, x = np.random.default_rng(seed), unit(sample)
        self.centres = clustered(x, cells, rng)
        self.cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
        self.books = [clustered(x[:, a:b], WORDS, rng) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.probes = self._probes(x, rng)

    def _probes(self, x: np.ndarray, rng: np.random.Generator) -> int:
        tried = rng.permutation(len(x))[:TRIED]
        near = np.argsort(-(x[tried] @ x.T), axis=1)[:, 1:11]
        order = np.argsort(-(x[tried] @ self.centres.T) + (self.centres * self.centres).sum(1) / 2, axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None], 1)
        own = nearest(x, self.centres)
        if not near.size:
            return 1
        return int(np.quantile(np.take_along_axis(rank, own[near], 1), RECALL)) + 1

    def cells_of(self, q: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort((self.centres * self.centres).sum(1) / 2 - q @ self.centres.T, axis=1)[:, :probes]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([nearest(x[:, a:b], book) for (a, b), book in zip(zip(self.cuts[:-1], self.cuts[1:], strict=True), self.books, strict=True)]).astype(np.uint8)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each part: what each of its codes adds to the similarity with each query."""
        return [q[:, a:b] @ book.T for (a, b), book in zip(zip(self.cuts[:-1], self.cuts[1:], strict=True), self.books, strict=True)]


def similarity(tables: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """(query, row): similarities told from codes."""
    return sum(t[:, codes[:, k]] for k, t in enumerate(tables))


class Neighbours:
    """The index of one table of vectors, in a folder."""

    def __init__(self, rows: DataFrame, folder: str, key: str = "id", vector: str = "embedding", carry: tuple[str, ...] = (), cells: int | None = None, parts: int = 16):
        self.spark: SparkSession = rows.sparkSession
        self.key, self.vector, self.carry = key, vector, carry
        sound = rows.where(usable(vector) & F.col(key).isNotNull())
        sample = sound.select(key, vector).orderBy(F.xxhash64(key), key).limit(SAMPLE).toPandas()[vector]  # the bound on what is fitted on
        longest = sample.map(len).mode()
        self.size = int(longest.iloc[0]) if len(longest) else 0
        kept = [v for v in sample if len(v) == self.size]
        n = sound.count()
        self.codes = Codes(np.array(kept), cells or max(1, min(CELLS, round(math.sqrt(n)))), parts) if kept else None
        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *carry))
        self.kind = f"__cell int, __code binary, {kinds}, __vector array<double>"
        self.tables = Tables(self.spark, folder)
        self.tables.define("lists", self.kind, ("__cell",), 16)
        self.append(rows)

    def append(self, rows: DataFrame) -> None:
        """Index further vectors by what was fitted."""
        if self.codes is None:
            return
        sent = self.spark.sparkContext.broadcast(self.codes)  # its size depends on the parameters and the length of vectors
        own = rows.where(usable(self.vector) & F.col(self.key).isNotNull() & (F.size(self.vector) == self.size))
        own = own.select(self.key, *self.carry, F.transform(self.vector, lambda x: x.cast("double")).alias("__vector"))
        names = [f.name for f in own.schema]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = sent.value
            for batch in batches:
                if batch.num_rows:
                    x = unit(np.array(batch.column(len(names) - 1).to_pylist()))
                    cell, code = pa.array(nearest(x, codes.centres), pa.int32()), pa.array([c.tobytes() for c in codes.encode(x)], pa.binary())
                    yield pa.RecordBatch.from_arrays([cell, code, *batch.columns], names=["__cell", "__code", *names])

        self.tables.append("lists", own.mapInArrow(run, self.kind))

    def _lists(self, view: View, cells: list[int]) -> DataFrame:
        asked = self.spark.createDataFrame([(int(c),) for c in cells], "__cell int")
        return view.read("lists", view.buckets_of("lists", asked)).where(F.col("__cell").isin([int(c) for c in cells]))

    def search(self, query: list[float], count: int = 10, where: Column | None = None, probes: int | None = None, candidates: int = CANDIDATES) -> DataFrame:
        """(key, *carry, similarity) of about the `count` nearest vectors that pass `where` (of the key and what is carried)."""
        kinds = self.tables.read("lists").select(self.key, *self.carry).withColumn("similarity", F.lit(0.0))
        if self.codes is None or len(query) != self.size or not any(query):
            return kinds.limit(0)
        q = unit(np.array([query]))
        lists = self._lists(View(self.tables, self.tables.state()), self.codes.cells_of(q, probes or self.codes.probes)[0].tolist())
        lists = lists if where is None else lists.where(where)
        told = self.codes.tables(q)

        @F.pandas_udf("double")
        def by_code(code: pd.Series) -> pd.Series:
            own = np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1)
            return pd.Series(similarity(told, own)[0] if len(code) else np.zeros(0))

        best = lists.select("__cell", self.key, by_code("__code").alias("__near")).orderBy(F.desc("__near"), self.key).limit(max(count, candidates)).select("__cell", self.key)
        exact = lists.join(F.broadcast(best), ["__cell", self.key], "left_semi").withColumn("similarity", cosine_to([float(v) for v in query], F.col("__vector")))
        return exact.orderBy(F.desc("similarity"), self.key).limit(count).select(self.key, *self.carry, "similarity")

    def search_all(self, queries: DataFrame, count: int = 10, query_key: str = "query", query_vector: str = "embedding", probes: int | None = None, candidates: int = CANDIDATES) -> DataFrame:
        """(query_key, key, similarity, rank) for each query with a usable vector. Lists meet queries in blocks of bounded
        size; only the best of a block by codes leave it."""
        query_kind, key_kind = queries.schema[query_key].dataType.simpleString(), self.tables.read("lists").schema[self.key].dataType.simpleString()
        if self.codes is None:
            return self.spark.createDataFrame([], f"`{query_key}` {query_kind}, `{self.key}` {key_kind}, similarity double, rank int")
        codes, opened = self.codes, probes or self.codes.probes
        sent = self.spark.sparkContext.broadcast(codes)

        @F.pandas_udf("array<int>")
        def cells(vectors: pd.Series) -> pd.Series:
            return pd.Series(sent.value.cells_of(unit(np.array(vectors.tolist())), opened).tolist() if len(vectors) else [], dtype=object)

        asked = queries.where(usable(query_vector) & (F.size(query_vector) == self.size)).select(F.col(query_key).alias("q"), F.transform(query_vector, lambda x: x.cast("double")).alias("v"))
        lists = self.tables.read("lists")
        rows, n = lists.count(), asked.count()
        blocks = max(1, math.ceil(2 * rows / len(codes.centres) / BLOCK_ROWS))
        q_blocks = max(1, math.ceil(2 * n * opened / len(codes.centres) / BLOCK_QUERIES))
        of = lambda column, m: F.pmod(F.xxhash64(column), F.lit(m)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        left = asked.select("q", "v", F.explode(cells("v")).alias("cell"), of("q", q_blocks).alias("qb")).select("*", every(blocks).alias("lb"))
        right = lists.select(F.col("__cell").alias("cell"), F.col(self.key).alias("k"), F.col("__code").alias("code"), of(self.key, blocks).alias("lb")).select("*", every(q_blocks).alias("qb"))
        keep = max(count, candidates)

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({"q": a["q"].slice(0, 0), "k": b["k"].slice(0, 0), "cell": pa.array([], pa.int32()), "near": pa.array([], pa.float64())})
            own = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(b.num_rows, -1)
            near = similarity(sent.value.tables(unit(np.array(a["v"].to_pylist()))), own)
            m = min(keep, near.shape[1])
            at = np.argpartition(-near, m - 1, axis=1)[:, :m]
            row = np.repeat(np.arange(a.num_rows), m)
            return pa.table({"q": a["q"].take(pa.array(row)), "k": b["k"].take(pa.array(at.ravel())), "cell": pa.array(np.full(len(row), a["cell"][0].as_py()), pa.int32()), "near": pa.array(near[row, at.ravel()].astype(np.float64))})

        group = ("cell", "lb", "qb")
        met = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(meet, f"q {query_kind}, k {key_kind}, cell int, near double")
        best = met.withColumn("no", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "k"))).where(F.col("no") <= keep).select("q", "k", "cell")
        vectors = lists.select(F.col("__cell").alias("cell"), F.col(self.key).alias("k"), F.col("__vector").alias("w"))
        exact = best.join(vectors, ["cell", "k"]).join(asked, "q").select("q", "k", cosine(F.col("v"), F.col("w")).alias("similarity"))
        ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "k"))).where(F.col("rank") <= count)
        return ranked.select(F.col("q").alias(query_key), F.col("k").alias(self.key), "similarity", "rank")
