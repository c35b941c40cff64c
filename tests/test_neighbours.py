"""Approximate nearest neighbours against comparing with every vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docprov.operators import neighbours
from docprov.operators.neighbours import Neighbours


def exact(vectors, query, count, allowed=None):
    q = np.array(query) / np.linalg.norm(query)
    scores = {k: float(np.array(v) @ q / np.linalg.norm(v)) for k, v in vectors.items() if allowed is None or k in allowed}
    return [k for k, _ in sorted(scores.items(), key=lambda r: (-r[1], r[0]))[:count]]


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")


@pytest.fixture(scope="module")
def index(given, tmp_path_factory):
    return Neighbours(given, f"file://{tmp_path_factory.mktemp('index')}", "vec_id", carry=("label",))


def test_recall_at_ten_on_the_given_vectors(given, index):
    vectors = {r.vec_id: r.embedding for r in given.collect()}
    queries = given.where("vec_id % 100 = 0")
    found = {}
    for r in index.search_all(queries.select(F.col("vec_id").alias("query"), "embedding")).collect():
        found.setdefault(r["query"], {})[r.vec_id] = r["rank"]
    assert len(found) == queries.count() and all(sorted(x.values()) == list(range(1, 11)) for x in found.values())
    met = sum(len(set(exact(vectors, vectors[q], 10)) & set(x)) for q, x in found.items())
    assert met >= 0.9 * 10 * len(found)
    assert all(x.get(q) == 1 for q, x in found.items())
    assert index.codes.probes < len(index.codes.centres)


def test_filters_apply_inside_the_lists(given, index):
    vectors, labels = {r.vec_id: r.embedding for r in given.collect()}, {r.vec_id: r.label for r in given.collect()}
    got = index.search(vectors[7], 10, F.col("label") == labels[7]).collect()
    assert {r.label for r in got} == {labels[7]} and len(got) == 10 and got[0].vec_id == 7 and got[0].similarity == pytest.approx(1)
    want = exact(vectors, vectors[7], 10, {i for i, x in labels.items() if x == labels[7]})
    assert len({r.vec_id for r in got} & set(want)) >= 8
    assert [r.similarity for r in got] == sorted((r.similarity for r in got), reverse=True)
    every = index.search(vectors[7], 10, probes=len(index.codes.centres), candidates=2000).collect()
    assert [r.vec_id for r in every] == exact(vectors, vectors[7], 10)


def test_clusters_need_few_cells(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    vectors = {int(i): (centres[i % 40] + rng.normal(size=24) * 0.15).tolist() for i in range(4000)}
    rows = spark.createDataFrame(list(vectors.items()), "id long, embedding array<double>")
    own = Neighbours(rows, f"file://{tmp_path}/index", cells=40)
    assert own.codes.probes <= 4
    met = sum(len({r.id for r in own.search(vectors[i]).collect()} & set(exact(vectors, vectors[i], 10))) for i in (0, 111, 2222))
    assert met >= 27


def test_appends_are_found_and_touch_no_old_file(spark, tmp_path):
    rng = np.random.default_rng(3)
    kind = "id long, embedding array<float>, tag string"
    own = Neighbours(spark.createDataFrame([(i, rng.normal(size=8).tolist(), "a") for i in range(200)], kind), f"file://{tmp_path}/index", carry=("tag",), parts=4)
    before = {b: list(f) for b, f in own.tables.state().folders["lists"].items()}
    own.append(spark.createDataFrame([(999, [1.0] * 8, "b"), (1000, None, "b"), (1001, [0.0] * 8, "b"), (1002, [float("nan")] * 8, "b"), (None, [1.0] * 8, "b"), (1003, [1.0] * 7, "b")], kind))
    assert all(own.tables.state().folders["lists"][b][: len(f)] == f for b, f in before.items())
    assert [(r.id, r.tag) for r in own.search([2.0] * 8, 1).collect()] == [(999, "b")]
    assert own.search([0.0] * 8).count() == 0 and own.search([1.0] * 7).count() == 0


def test_empty_tables(spark, tmp_path):
    own = Neighbours(spark.createDataFrame([], "id long, embedding array<float>"), f"file://{tmp_path}/index")
    assert own.search([1.0, 2.0]).count() == 0
    assert own.search_all(spark.createDataFrame([(1, [1.0])], "query long, embedding array<double>")).count() == 0
    one = Neighbours(spark.createDataFrame([(5, [3.0, 4.0])], "id long, embedding array<float>"), f"file://{tmp_path}/one")
    assert [r.id for r in one.search([1.0, 2.0]).collect()] == [5]


def test_parts_and_blocks_cut_work(monkeypatch, spark, tmp_path):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=8).tolist() for i in range(150)}
    rows = spark.createDataFrame(list(vectors.items()), "id long, embedding array<double>")
    own = Neighbours(rows, f"file://{tmp_path}/index", cells=3)
    out = own.search_all(rows.where("id < 9").withColumnRenamed("id", "query"), 5, probes=3, candidates=150).collect()
    got = {q: [r.id for r in sorted(out, key=lambda r: r["rank"]) if r["query"] == q] for q in range(9)}
    assert got == {q: exact(vectors, vectors[q], 5) for q in range(9)}
