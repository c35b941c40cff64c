"""Counts kept by deltas against counting all chunks."""

import random

from pyspark.sql import functions as F

from docprov.operators import views
from docprov.operators.counts import COUNTS, Counts, changes

KIND = "id int, document_id string, embedding_status string"


def test_deltas_equal_the_full_count(spark, tmp_path):
    rng, state = random.Random(8), {}
    own = Counts(spark, f"file://{tmp_path}/counts", buckets=8)
    for step in range(6):
        before = dict(state)
        for i in rng.sample(range(120), 40 if step else 120):
            if i in state and rng.random() < 0.3:
                del state[i]
            else:
                state[i] = (state.get(i, (f"d{i % 17}",))[0], rng.choice([*views.STATUSES, "stale"]))
        frame = lambda rows: spark.createDataFrame([(i, *r) for i, r in rows.items()], KIND)
        own.apply(changes(frame(before), frame(state)))
        full = frame(state).groupBy("document_id").agg(F.count("*").alias("total_chunks"), *[F.count_if(F.col("embedding_status") == s).alias(f"{s}_chunks") for s in views.STATUSES])
        assert sorted(map(tuple, own.read().collect())) == sorted(map(tuple, full.select("document_id", *COUNTS).collect()))


def test_buckets_of_other_documents_are_not_rewritten(spark, tmp_path):
    own = Counts(spark, f"file://{tmp_path}/counts", buckets=8)
    rows = spark.createDataFrame([(i, f"d{i}", "pending") for i in range(50)], KIND)
    none = rows.limit(0)
    own.apply(changes(none, rows))
    before = {b: list(f) for b, f in own.tables.state().folders["counts"].items()}
    own.apply(changes(rows.where("id = 3"), rows.where("id = 3").withColumn("embedding_status", F.lit("complete"))))
    after = own.tables.state().folders["counts"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert own.read().where("document_id = 'd3'").first().complete_chunks == 1
    version = own.tables.state().version
    own.apply(changes(rows, rows))
    assert own.tables.state().version == version
    own.apply(changes(rows.where("id = 3").withColumn("embedding_status", F.lit("complete")), none))
    assert own.read().count() == 49
