"""Mixing sources to target weights.

Each source's documents are laid end to end, and this stream of words is cut into blocks
of a fixed length. Output shards draw how many blocks of each source they take from a
multinomial over what the sources still owe, so the totals come out at the targets. A
source's slots are numbered across shards; slot j reads the block that a pseudorandom
permutation of the source's block indexes gives for j, a new permutation for each round
through the source. Blocks and slots meet in a join on (source, block).

Only per-source totals and the shard-by-source counts (n_shards x sources) are on the
driver, which bounds the number of sources (a million of them take half a GB); the table of
sources is broadcast only up to `SMALL_SOURCES` of them. Offsets within a source are summed
in two steps over about the square root of all rows each, so a source that holds a third of
all rows is spread like any other. Slots are made by as many tasks as `TASK_SLOTS` asks for,
and blocks and slots meet in a sort-merge join, as both grow with the words.

Defined results: null text has size 0; documents of size 0 are taken 0 times; a null
source is a source, the last in order; repeated rows are documents of their own (each gets
its own row, also where id and text repeat and other columns differ); an empty table gives
an empty result; other columns are dropped by `mix_totals` and kept by `mixed_documents`.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprov.llm.common import WORD, staged, word_count

WORDS = re.compile(WORD)
#: Slots made by one row, and by one task.
CHUNK, TASK_SLOTS = 4096, 1_000_000
SMALL_SOURCES = 100_000


def targets(sizes: list[int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words wanted of each source: `share` of all words by the weights, repeating; a source
    that would pass `most` times its size stays there and the excess is dealt again."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], dtype=float)
    size = np.array(sizes, dtype=float)
    out, free = np.zeros(len(size)), np.ones(len(size), dtype=bool)
    left = share * size.sum()
    while free.any():
        out[free] = left * w[free] / w[free].sum()
        over = free & (out > most * size)
        if not over.any():
            break
        out[over] = most * size[over]
        left -= out[over].sum()
        free &= ~over
    return out.tolist()


def draw_counts(owed: list[int], n_shards: int, seed: int) -> np.ndarray:
    """(shards x sources) multinomial counts, by what each source still owes; a draw beyond
    what a source owes goes to the others. Columns add up to `owed`."""
    rng = np.random.default_rng(seed)
    left = np.array(owed, dtype=np.int64)
    out = np.zeros((n_shards, len(left)), dtype=np.int64)
    for i in range(n_shards):
        slots = int(left.sum()) // (n_shards - i)
        while slots:
            got = np.minimum(rng.multinomial(slots, left / left.sum()), left)
            out[i] += got
            left -= got
            slots -= int(got.sum())
    return out


def round_key(source_no: np.ndarray | int, round_no: np.ndarray, seed: int) -> np.ndarray:
    """The key of a source's permutation in a round."""
    return (source_no + 1) * 1_000_003 + round_no * 7_919 + seed


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..size-1, or its inverse, applied to each index: a
    four-round Feistel network on the next even number of bits, repeated until it falls below size."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, key = index.astype(np.uint64), key.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)

    def mixed(half_word: np.ndarray, r: int, k: np.ndarray, m: np.ndarray) -> np.ndarray:
        z = (half_word + k) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(32))) & m

    with np.errstate(over="ignore"):
        while todo.any():
            h, m, k = half[todo], mask[todo], key[todo]
            left, right = x[todo] >> h, x[todo] & m
            for r in range(4):
                if inverse:
                    left, right = right ^ mixed(left, 3 - r, k, m), left
                else:
                    left, right = right, left ^ mixed(right, r, k, m)
            x[todo] = (left << h) | right
            todo &= x >= size.astype(np.uint64)
    return x.astype(np.int64)


def with_offsets(docs: DataFrame, rows: int) -> DataFrame:
    """Adds `start`, the words of the same source_no before a document, and `row_key`."""
    buckets = max(1, math.isqrt(rows))
    docs = docs.withColumn("bucket", F.pmod("same", F.lit(buckets)).cast("int"))
    w = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "check", "no")
    local = docs.withColumn("rank", F.row_number().over(w)).withColumn("local", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    sums = docs.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source_no", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    return local.join(sums, ["source_no", "bucket"]).withColumn("start", F.col("local") + F.col("before"))


def block_pieces(docs: DataFrame, block: int) -> DataFrame:
    """A row for each part of a document that lies in one block; documents without words
    keep one row with a null block."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    out = docs.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    lo, hi = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return out.withColumn("piece_start", lo - F.col("start")).withColumn("piece_words", F.coalesce(hi - lo, F.lit(0)))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, a checksum of the text and what tells rows apart, staged: what the mix works on."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.xxhash64(*others) if others else F.lit(0).cast("long")
    own = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("check"), F.xxhash64("doc_id", "text").alias("same"), rest.alias("rest"))
    return staged(own.withColumn("no", F.row_number().over(Window.partitionBy("same").orderBy("doc_id", "rest"))).drop("rest"))


def source_table(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float, block: int, seed: int) -> pd.DataFrame:
    """One row a source, in order of code points with null last: totals, targets, slots."""
    found = [r.asDict() for r in sizes.groupBy("source").agg(F.sum("size").alias("source_size")).collect()]  # one row a source
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    out = pd.DataFrame(found, columns=["source", "source_size"])
    out["source_no"] = range(len(out))
    out["target"] = targets(out["source_size"].tolist(), weights, share, most)
    out["blocks"] = [-(-int(s) // block) for s in out["source_size"]]
    out["slots"] = [slots_for(r.target, int(r.source_size), block, most, int(r.source_no), seed) for r in out.itertuples()]
    return out


def slots_for(target: float, size: int, block: int, most: float, source_no: int, seed: int) -> int:
    """Slots whose words come nearest to the target, within half a block: whole rounds, and
    a part of one that counts the short last block where the permutation puts it."""
    if not size:
        return 0
    blocks = -(-size // block)
    rounds, rest = divmod(target, size)
    if rounds >= most:
        return int(most * blocks)
    key = round_key(source_no, np.array([int(rounds)]), seed)
    place = int(permuted(np.array([blocks - 1]), np.array([blocks]), key, inverse=True)[0])
    short = block * blocks - size
    near = int(rest // block)
    own = min(range(max(0, near - 1), min(blocks, near + 3) + 1), key=lambda k: abs(k * block - short * (place < k) - rest))
    return int(min(rounds * blocks + own, most * blocks))


def mix_plan(docs_sized: DataFrame, weights: tuple[float, ...], share: float, most: float, block: int, n_shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(the table of sources, the slots): a slot is a row (source_no, shard, slot, block)."""
    spark = docs_sized.sparkSession
    sources = source_table(docs_sized, weights, share, most, block, seed)
    counts = draw_counts(sources["slots"].tolist(), n_shards, seed) if len(sources) else np.zeros((0, 0), dtype=np.int64)
    starts = np.cumsum(counts, axis=0) - counts
    plan = [(int(s), i, int(starts[i, s]), int(counts[i, s]), int(sources["blocks"][s])) for i in range(len(counts)) for s in range(counts.shape[1]) if counts[i, s]]
    drawn = spark.createDataFrame(plan, "source_no int, shard int, first long, n long, blocks long")
    # In chunks, dealt to a number of tasks that grows with the slots and that no later step lowers.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(sources["slots"].sum()) // TASK_SLOTS)
    chunks = drawn.select("source_no", "shard", "first", "n", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))).alias("at")).repartition(tasks, "source_no", "shard", "at")
    slots = chunks.select("source_no", "shard", "blocks", F.explode(F.sequence("at", F.least(F.col("at") + CHUNK, "n") - 1)).alias("k"), "first")

    @F.pandas_udf("long")
    def block_of(source_no: pd.Series, j: pd.Series, blocks: pd.Series) -> pd.Series:
        n, j = blocks.to_numpy(), j.to_numpy()
        return pd.Series(permuted(j % n, n, round_key(source_no.to_numpy().astype(np.int64), j // n, seed)))

    slots = slots.select("source_no", "shard", (F.col("first") + F.col("k")).alias("slot"), block_of("source_no", F.col("first") + F.col("k"), "blocks").alias("block"))
    frame = spark.createDataFrame([(int(r.source_no), r.source, int(r.source_size), float(r.target)) for r in sources.itertuples()], "source_no int, source string, source_size long, target double")
    return frame, slots


def _pieces(docs_sized: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    small = sources.limit(SMALL_SOURCES + 1).count() <= SMALL_SOURCES
    joined = docs_sized.withColumnRenamed("source", "own_source").join(F.broadcast(sources) if small else sources, F.col("own_source").eqNullSafe(F.col("source"))).drop("own_source")
    return block_pieces(with_offsets(joined, docs_sized.count()), block)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 128, n_shards: int = 64, seed: int = 17) -> DataFrame:
    """The mix itself: a row for each part of a document in each slot that uses it, as
    (shard, slot, source, block, doc_id, check, no, piece_start, piece_words), in words."""
    sizes = sized(docs)
    sources, slots = mix_plan(sizes, weights, share, most, block, n_shards, seed)
    pieces = _pieces(sizes, sources, block).where("block is not null")
    return slots.hint("merge").join(pieces, ["source_no", "block"]).select("shard", "slot", "source", "block", "doc_id", "check", "no", "piece_start", "piece_words")


def mix_totals(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 128, n_shards: int = 64, seed: int = 17) -> DataFrame:
    """A row for each document: how many of its words the mix takes, repeats counted."""
    sizes = sized(docs)
    sources, slots = mix_plan(sizes, weights, share, most, block, n_shards, seed)
    uses = slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"))
    pieces = _pieces(sizes, sources, block)
    joined = pieces.join(uses.hint("merge"), ["source_no", "block"], "left")
    taken: Column = F.sum(F.col("piece_words") * F.coalesce("uses", F.lit(0))).cast("long")
    out = joined.groupBy("same", "no", "doc_id", "source", "size", "source_size", "target").agg(taken.alias("taken"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 128, n_shards: int = 64, seed: int = 17, length: str | None = None) -> DataFrame:
    """The mix as documents: a row for each round in which the mix uses any of a document,
    with its columns and, where only some blocks are used, the text of these: runs of words
    as they stand, joined by line feeds. `length` names a column to set to the new length."""
    sizes = sized(docs)
    sources, slots = mix_plan(sizes, weights, share, most, block, n_shards, seed)
    uses = slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"))
    used = _pieces(sizes, sources, block).where("block is not null").join(uses.hint("merge"), ["source_no", "block"])
    rounds = used.withColumn("round", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))))
    part = F.struct("piece_start", "piece_words")
    wanted = rounds.groupBy("same", "no", "size", "round").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    # A document taken whole keeps its text as it is.
    whole = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + p.piece_words) == F.col("size")
    wanted = wanted.select(F.col("same").alias("__same"), F.col("no").alias("__no"), F.when(~whole, F.col("parts")).alias("__parts"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    same = Window.partitionBy("__same").orderBy("doc_id", "__rest")
    one = docs.withColumn("__same", F.xxhash64("doc_id", "text")).withColumn("__rest", F.xxhash64(*others) if others else F.lit(0)).withColumn("__no", F.row_number().over(same))
    both = one.join(wanted, ["__same", "__no"])

    @F.pandas_udf("string")
    def cut(texts: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([t if p is None else words_of(t, [(x["piece_start"], x["piece_words"]) for x in p]) for t, p in zip(texts, parts, strict=True)], dtype=object)

    text = F.when(F.col("__parts").isNull(), F.col("text")).otherwise(cut("text", "__parts"))
    both = both.withColumn("text", text)
    if length:
        both = both.withColumn(length, F.when(F.col("__parts").isNull(), F.col(length)).otherwise(F.length("text").cast(docs.schema[length].dataType)))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns])


def words_of(text: str, parts: list[tuple[int, int]]) -> str:
    """The words at some ranges of a text, neighbouring ranges as one run."""
    runs: list[list[int]] = []
    for start, n in parts:
        if runs and runs[-1][1] == start:
            runs[-1][1] = start + n
        else:
            runs.append([start, start + n])
    spans = [m.span() for m in WORDS.finditer(text)]
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs)
