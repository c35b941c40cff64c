"""Connected components by alternating large-star and small-star steps.

A step links every node to the least node among its neighbours; large-star does so for
larger neighbours, small-star for smaller ones. Each step is one aggregation and one join
on the node, so a node with very many neighbours is pre-aggregated and its join partition
can be split; no component is ever gathered. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprov.llm.common import staged, unstaged


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges`, a table with columns a and b: component
    is the least node reachable. Loops and repeated edges do no harm."""
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _sum(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        unstaged(last)
        after = _sum(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
