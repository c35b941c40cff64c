"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring of 2**32 positions. A row's key is hashed to a
position; the arc it falls in ends at the next point clockwise, whose shard is its home.
A full shard passes rows on: they continue clockwise to the next shard with room. Only the
number of rows per arc decides how many of them each shard takes, so the walk is done on
the arc table (shards x vnodes entries at most), never on rows; a row then needs only its
rank within its arc.

Ranks come in two steps, so no task sorts more than about the square root of all rows:
arcs are cut into cells of the ring, rows are numbered within cells, and the cells'
counts are summed up within arcs.

Defined results: a row with a null key is placed by its text's checksum instead, so that
many of them spread; rows with equal keys share a position and are ordered by that checksum; null text has size 1 and
checksum 0; repeated rows are placed one by one, each with a slot of its own; an empty
table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docprov.llm.common import staged

RING = 2**32


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in ring order."""
    points: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            points.setdefault(int(hashlib.md5(f"shard {shard} node {v}".encode()).hexdigest()[:8], 16), shard)
    return sorted(points.items())


def quotas(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """How many rows each shard may hold. Without slack they add up to all rows, and any
    two differ by one at most."""
    if slack:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(points: list[tuple[int, int]], arc_rows: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, shard, first rank, rows, first slot): whom each arc's rows go to. In round r
    every arc, in ring order, offers what is left to the r-th distinct shard clockwise."""
    room, left, used = list(room), dict(arc_rows), [0] * len(room)
    order: dict[int, list[int]] = {}
    for arc in arc_rows:
        seen: list[int] = []
        for step in range(len(points)):
            shard = points[(arc + step) % len(points)][1]
            if shard not in seen:
                seen.append(shard)
                if len(seen) == len(room):
                    break
        order[arc] = seen
    out, first = [], dict.fromkeys(arc_rows, 0)
    for r in range(len(room)):
        for arc in sorted(arc_rows):
            if r < len(order[arc]) and left[arc]:
                shard = order[arc][r]
                take = min(left[arc], room[shard])
                if take:
                    out.append((arc, shard, first[arc], take, used[shard]))
                    first[arc] += take
                    left[arc] -= take
                    room[shard] -= take
                    used[shard] += take
    return out


def shard_rows(docs: DataFrame, shards: int = 8, vnodes: int = 128, slack: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns: the key, size (UTF-8 bytes of the text plus 1), text_crc32, arc, shard, slot."""
    spark = docs.sparkSession
    points = ring_points(shards, vnodes)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    check = F.crc32(body.cast("binary"))
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null "), check.cast("string")))
    position = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long")
    # Written once: what follows reads a few numbers a row, and no text.
    keyed = staged(docs.select(F.col(key), (F.octet_length(body).cast("long") + 1).alias("size"), check.alias("text_crc32"), position.alias("position")))
    rows = keyed.count()
    bits = max(0, math.ceil(math.log2(max(1, math.sqrt(rows)))))
    ends = np.array([p for p, _ in points])

    @F.pandas_udf("int")
    def arc_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, at.to_numpy()) % len(ends))

    placed = keyed.withColumn("arc", arc_of("position")).withColumn("cell", F.shiftright("position", 32 - bits) if bits else F.lit(0).cast("long"))
    cells = placed.groupBy("arc", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {r.arc: r.n for r in placed.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # one row an arc
    segments = walk(points, counts, quotas(rows, shards, slack))
    by_arc = spark.createDataFrame(segments, "arc int, shard int, first_rank long, n_rows long, first_slot long")
    by_arc = by_arc.groupBy("arc").agg(F.array_sort(F.collect_list(F.struct("first_rank", "n_rows", "shard", "first_slot"))).alias("segments"))
    ranked = placed.withColumn("in_cell", F.row_number().over(Window.partitionBy("arc", "cell").orderBy("position", key, "text_crc32", "size")) - 1)
    out = ranked.join(cells.select("arc", "cell", "before"), ["arc", "cell"]).join(F.broadcast(by_arc), "arc")
    rank = F.col("before") + F.col("in_cell")
    out = out.withColumn("rank", rank).withColumn("segment", F.element_at(F.filter("segments", lambda s: s.first_rank <= F.col("rank")), -1))
    return out.select(key, "size", "text_crc32", "arc", "segment.shard", (F.col("segment.first_slot") + F.col("rank") - F.col("segment.first_rank")).alias("slot"))
