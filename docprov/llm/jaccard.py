"""N-gram Jaccard join with adaptive multi-match prefixes.

Texts become sets of hashed word shingles; equal sets are one class. All sets are ordered
alike, rare shingles first, by a sketch that counts the shingles of all documents in a
table of fixed size. If two sets reach the threshold, then for any l the first
n - ceil(t n) + l shingles of both share at least l. Each class chooses its own l by what
candidates would cost: a longer prefix is more to send, but pairs then have to share more
of it. Two classes are candidates if they share as many prefix shingles as the smaller of
their l. Prefix shingles that too many classes hold are not paired up; their holders count
as candidates of each other.

Candidates are joined to groups, and each group compares its sets whole and exactly;
groups larger than `block` are compared block against block. A set is compared with those
that no link joins to it yet: near copies of each other, however many, take about one
comparison each. In small groups all pairs are compared, some thousands of shingles at a
time and in an order in which those of the same sets lie together; what that keeps in memory
is one number a pair of sets, however long the texts are. So every class's text moves
twice (or once more a block), no pairs of copies are made, and no link that a component
needs is lost.

Shingles are compared by 64-bit hashes.

Defined results: a text with fewer words than a shingle is one shingle; null texts and
texts without words have empty sets, link with nothing and are components of their own;
rows with a null id get a null component and link with nothing; rows that repeat an id each
appear and are told apart by their sets, so that an id may stand in several components; an
empty table gives an empty result; other columns are dropped by `near_duplicates` and kept by
`without_duplicates`, which keeps of each component a row with the least id and, of rows
alike in id and set, the one whose text comes first.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docprov.llm.common import by_group, hash_filter, passing, staged, unstaged
from docprov.llm.components import connected_components

#: Counters of the sketch: 4 MB when sent to the tasks, as logarithms of one byte.
SKETCH = 1 << 22
#: Counters a row while sketches are added up.
SKETCH_PART = 1 << 14
#: Prefix shingles held by more classes are not paired up.
LONG_LIST = 128
#: Sets compared in one task's group.
BLOCK = 1024
#: Sets of a group whose pairs are all compared at once, and those that are compared pair by pair; larger groups leave out
#: pairs that links join already.
FEW, PAIRED = 32, 4
#: Classes with more than one of so many rows are joined apart.
HOT = 1000
#: What a class may require to be shared, and how many list entries a comparison costs.
CHOICES, COMPARISON = (1, 2, 4, 8, 16), 16.0
#: Shingles that are compared at a time.
COLUMNS = 4096

#: Bytes of text whose words are taken apart together, but for a single text; shingles that are mixed together.
TEXT_BYTES, MIXED = 1 << 17, 1 << 14
#: Bytes of a word with random numbers of their own; longer words are hashed apart.
PLACES = 64
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.where((np.arange(256) >= ord("A")) & (np.arange(256) <= ord("Z")), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
#: By place and byte; 0 for white space, which ends a word.
NUMBERS = np.where(SPACE, np.uint64(0), np.frombuffer(hashlib.shake_128(b"words").digest(PLACES * 256 * 8), "<u8").reshape(PLACES, 256)).ravel()
#: What a level of the sketch stands for.
HELD_BY = np.exp2(np.arange(256) / 12.0)

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class Shingles:
    """Hashed shingle sets of texts. A word's hash is the exclusive or of fixed random numbers, one for each place and
    byte; beyond the places of the table it is another. So many texts are taken at once, without an object a word."""

    def __init__(self, width: int = 5):
        self.width = width

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes. Words are split at ASCII white space, A-Z lower-cased."""
        return next(self.each(pa.array([text], pa.string())))

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The set of each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, held = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        held = np.frombuffer(held or b"", np.uint8)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + TEXT_BYTES, "right")) - 1)
            yield from self._sets(held[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
            a = b

    def _words(self, held: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word, and how many words lie before each text and the end."""
        space = SPACE[held]
        begins, stops = ~space, ~space
        begins[1:] &= space[:-1]
        stops[:-1] &= space[1:]
        inner = ends[:-1][ends[:-1] < len(held)]
        begins[inner] = ~space[inner]
        inner = ends[1:][ends[1:] > 0] - 1
        stops[inner] = ~space[inner]
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
        lengths = np.flatnonzero(stops) + 1 - starts
        low = LOWER[held[starts[0] :]]
        place = np.arange(starts[0], len(held), dtype=np.int32) - np.repeat(starts.astype(np.int32), np.diff(starts, append=len(held)))
        own = np.bitwise_xor.reduceat(NUMBERS[np.minimum(place, PLACES - 1) << 8 | low], starts - starts[0])
        for i in np.flatnonzero(lengths > PLACES):
            own[i] = xxhash.xxh64_intdigest(low[starts[i] - starts[0] :][: lengths[i]].tobytes())
        return own, np.searchsorted(starts, ends)

    def _sets(self, held: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        own, cuts = self._words(held, ends)
        mixed = self._mixed(own, self.width)
        for a, b in itertools.pairwise(cuts.tolist()):
            # Fewer words than a shingle are one.
            found = mixed[a : b - self.width + 1] if b - a >= self.width else self._mixed(own[a:b], b - a) if b > a else own[:0]
            found.sort()
            new = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=new[1:])
            yield found[new]

    @staticmethod
    def _mixed(own: np.ndarray, width: int) -> np.ndarray:
        out = np.full(max(0, len(own) - width + 1), (width * 0x2545F4914F6CDD1D) % 2**64, dtype=np.uint64)
        for a in range(0, len(out), MIXED):  # few at a time, so that they stay near the core
            part = out[a : a + MIXED]
            for k in range(width):
                part ^= own[a + k : a + k + len(part)]
                part *= ODD[k % len(ODD)]
                part ^= part >> np.uint64(31)
        return out


def _quantised(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.round(12 * np.log2(1 + counts))).astype(np.uint8)


def sketch(docs: DataFrame, width: int, text: str) -> np.ndarray:
    """Logarithms of how many documents hold a shingle that falls in a counter. Each task
    counts its own rows first, so what is shuffled is a table a task at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shingles = np.zeros(SKETCH, dtype=np.int32), Shingles(width)
        held, size = [], 0
        for found in itertools.chain.from_iterable(shingles.each(batch.column(0)) for batch in batches):
            held.append((found & np.uint64(SKETCH - 1)).astype(np.int64))
            size += len(found)
            if size >= SKETCH:
                own += np.bincount(np.concatenate(held), minlength=SKETCH).astype(np.int32)
                held, size = [], 0
        if held:
            own += np.bincount(np.concatenate(held), minlength=SKETCH).astype(np.int32)
        for part in range(SKETCH // SKETCH_PART):
            values = own[part * SKETCH_PART : (part + 1) * SKETCH_PART]
            if values.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(values.tobytes(), 1)], pa.binary())], names=["part", "counts"])

    def add(tables: Iterator[pa.Table]) -> Iterator[dict[str, list]]:
        total, part = np.zeros(SKETCH_PART, dtype=np.int64), None
        for t in tables:
            for p, counts in zip(t["part"].to_pylist(), t["counts"].to_pylist(), strict=True):
                total += np.frombuffer(zlib.decompress(counts), dtype=np.int32)
                part = p
        yield {"part": [part], "counts": [_quantised(total).tobytes()]}

    parts = by_group(docs.select(F.col(text).cast("string")).mapInArrow(count, "part int, counts binary"), ["part"], [], add, "part int, counts binary")
    out = np.zeros(SKETCH, dtype=np.uint8)
    for r in parts.collect():  # SKETCH bytes in all
        out[r.part * SKETCH_PART : (r.part + 1) * SKETCH_PART] = np.frombuffer(r.counts, dtype=np.uint8)
    return out


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with one that reaches the threshold."""
    return -(-percent * n // 100)


def prefix(own: np.ndarray, levels: np.ndarray, usual: float, percent: int) -> tuple[np.ndarray, int]:
    """The chosen prefix of a set and how much of it has to be shared."""
    n = len(own)
    level = levels[(own & np.uint64(SKETCH - 1)).astype(np.int64)]
    order = np.argsort(level, kind="stable")  # the set is sorted itself
    least = needed(n, percent)
    first = n - least
    # How many others a shingle would bring in, beyond what a counter holds by chance.
    others = np.cumsum(np.maximum(0.0, HELD_BY[level[order]] - 2 - usual))
    best, price = 1, np.inf
    for shared in CHOICES:
        if shared > least:
            break
        size = first + shared
        entries = others[size - 1]
        cost = size + entries + COMPARISON * entries / shared
        if cost < price:
            best, price = shared, cost
    return own[order[: first + best]], best


def _lists(docs: DataFrame, levels: np.ndarray, width: int, percent: int, key: str, text: str) -> DataFrame:
    """(key, n, class_key, shared, prefix) for each row with words and a key."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)  # SKETCH bytes
    usual = float(np.exp2(levels.astype(float).mean() / 12) - 1) * 2
    usual = 0.0 if usual < 2 else usual

    kind = T._parse_datatype_string(f"`{key}` {docs.schema[key].dataType.simpleString()}, n long, class_key binary, shared int, prefix array<long>")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            sizes, classes, least, prefixes = [], [], [], []
            for own in shingles.each(batch.column(1)):
                at, shared = prefix(own, sent.value, usual, percent) if len(own) else (own, 0)
                sizes.append(len(own))
                classes.append(xxhash.xxh128_digest(own.tobytes()) if len(own) else None)
                least.append(shared)
                prefixes.append(at.view(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))
            columns = [batch.column(0), sizes, classes, least, lists]
            yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c, f.type)).cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, kind)


#: What is sent of each prefix entry, and entries a bucket of shingles has, about.
ENTRY = {"token": "<u8", "cls": "<i8", "n": "<i4", "place": "<i4", "shared": "<i4"}
BUCKET = 1 << 19


def _dealt(buckets: int):  # noqa: ANN202
    """Prefix entries by bucket of their shingle: for each batch of classes a row a bucket, with the values of a column in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n, shared, prefixes = (batch.column(c) for c in ("cls", "n", "shared", "prefix"))
            lengths, token = prefixes.value_lengths().to_numpy(), prefixes.flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            place = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            bucket = (token >> np.uint64(32)) % np.uint64(buckets)  # the bits below tell the place in the sketch, by which prefixes were chosen
            order = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.uint64), kind="stable")
            own, starts = np.unique(bucket[order], return_index=True)
            ends = np.append(starts, len(order))
            held = {"token": token, "cls": cls.to_numpy()[row], "n": n.to_numpy()[row], "place": place, "shared": shared.to_numpy()[row]}
            columns = [pa.array(own.astype(np.int64))]
            for name, kind in ENTRY.items():
                values = held[name][order].astype(kind)
                columns.append(pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)]))
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", *ENTRY])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket the entries whose shingle another class has, too."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, group in itertools.groupby(rows, key=lambda row: row[0]):
        token, cls, n, place, shared = (np.frombuffer(b"".join(parts), kind) for parts, kind in zip(list(zip(*group, strict=True))[1:], ENTRY.values(), strict=True))
        order = np.argsort(token)
        own = token[order]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        times = np.diff(starts, append=len(own))
        least = np.minimum.reduceat(cls[order], starts)
        kept = order[np.repeat(times > 1, times)]
        times, least = times[times > 1], least[times > 1]
        columns = [token[kept].view(np.int64), cls[kept], n[kept].astype(np.int64), shared[kept], place[kept], np.repeat(times, times), np.repeat(least, times)]
        yield from pa.Table.from_arrays([pa.array(c) for c in columns], names=["token", "cls", "n", "shared", "place", "holders", "least"]).to_batches(max_chunksize=1 << 16)


def shared_lists(reps: DataFrame) -> DataFrame:
    """(token, cls, n, shared, place, holders, least): the prefix entries of classes (cls, n, shared,
    prefix) whose shingle another class has in its prefix too. Entries move by bucket of their shingle, many in
    one value; a bucket is in memory at once, and shingles are dealt to more of them the more there are."""
    entries = reps.agg(F.sum(F.size("prefix"))).first()[0] or 0
    buckets = max(1, entries // BUCKET)
    columns = "bucket long, " + ", ".join(f"{name} binary" for name in ENTRY)
    dealt = reps.select("cls", "n", "shared", "prefix").mapInArrow(_dealt(buckets), columns).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_shared, "token long, cls long, n long, shared int, place int, holders long, least long")


def candidates(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs of classes that have to be compared, and a tie from every holder of a
    long list to its least holder. What two sets share beyond the last prefix shingle that
    both hold is no more than what either has after it; pairs that can't reach the
    threshold even so are none."""
    short = lists.where(F.col("holders") <= LONG_LIST)
    x = short.select("token", F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("s_a"), F.col("place").alias("at_a"))
    y = short.select("token", F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("s_b"), F.col("place").alias("at_b"))
    close = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    pairs = x.join(y, "token").where((F.col("a") < F.col("b")) & close)
    left = lambda side: F.first(f"n_{side}") - 1 - F.max(f"at_{side}")
    met = pairs.groupBy("a", "b").agg(F.count("*").alias("met"), F.min(F.least("s_a", "s_b")).alias("least_met"), F.least(left("a"), left("b")).alias("left"), F.first(F.col("n_a") + F.col("n_b")).alias("both"))
    # Holders of a long list are tied together whatever they share of it.
    ties = lists.where((F.col("holders") > LONG_LIST) & (F.col("cls") != F.col("least"))).select(F.col("least").alias("a"), F.col("cls").alias("b")).distinct()
    # A pair that also met in a long list may share more than was counted; the ties stand for it.
    return met.where((F.col("met") >= F.col("least_met")) & ((100 + percent) * (F.col("met") + F.col("left")) >= percent * F.col("both"))).select("a", "b").unionByName(ties)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each set shares with each one after it."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), len(sets)), np.int32)
    if len(sets) <= PAIRED:
        for i, j in itertools.combinations(range(len(sets)), 2):
            out[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = times[at] > 1
    owner, column = np.repeat(np.arange(len(sets)), sizes)[use], (np.cumsum(times > 1) - 1)[at[use]]
    # Columns in the order of their first holders: what the same sets hold lies together.
    first = np.full(int((times > 1).sum()), len(sets))
    np.minimum.at(first, column, owner)
    place = np.empty(len(first), np.int64)
    place[np.argsort(first, kind="stable")] = np.arange(len(first))
    column = place[column]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    cuts = np.searchsorted(column, np.arange(0, len(first) + COLUMNS, COLUMNS))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        some, row = np.unique(owner[a:b], return_inverse=True)
        col = column[a:b] % COLUMNS
        bits = np.zeros((len(some), COLUMNS // 64), np.uint64)
        np.bitwise_or.at(bits, (row, col >> 6), np.uint64(1) << (col & 63).astype(np.uint64))
        for i in range(len(some) - 1):
            out[some[i], some[i + 1 :]] += np.bitwise_count(bits[i + 1 :] & bits[i]).sum(1, dtype=np.int32)
    return out


def _alternating(block: np.ndarray) -> np.ndarray:
    """Places of two blocks in turn, so that either's first is compared early."""
    rank = np.empty(len(block), np.int64)
    for own in np.unique(block):
        rank[block == own] = np.arange(np.count_nonzero(block == own))
    return np.argsort(rank, kind="stable")


def forest(sets: list[np.ndarray], percent: int, roots: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, int]:
    """For each set the first one that links reach from it, and how many pairs were compared; `roots` has those known before. Of several blocks only pairs
    across them are compared. A set is compared with those alone that no link reaches from it yet, so that k near copies
    of each other take about k comparisons and not their square."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = times[at] > 1
    column = (np.cumsum(times > 1) - 1)[at[use]].astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(use)])[np.concatenate([[0], np.cumsum(sizes)])]
    held = np.zeros(int((times > 1).sum()), bool)
    roots, left, pairs = roots.copy(), np.ones(len(sets), bool), 0
    cross = len(np.unique(block)) > 1
    for i in _alternating(block):
        left[i] = False
        open_ = left & (roots != roots[i]) & (100 * sizes >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes)
        if cross:
            open_ &= block != block[i]
        others = np.flatnonzero(open_)
        if not len(others):
            continue
        pairs += len(others)
        own = column[ends[i] : ends[i + 1]]
        held[own] = True
        some = column if 2 * len(others) > len(sets) else np.concatenate([column[ends[j] : ends[j + 1]] for j in others])
        met = np.concatenate([[0], np.cumsum(held[some])])
        if some is column:
            met = met[ends[others + 1]] - met[ends[others]]
        else:
            met = np.diff(met[np.concatenate([[0], np.cumsum(ends[others + 1] - ends[others])])])
        held[own] = False
        joined = np.unique(np.append(roots[others[(100 + percent) * met >= percent * (sizes[i] + sizes[others])]], roots[i]))
        if len(joined) > 1:
            roots[np.isin(roots, joined)] = joined[0]
    return roots, pairs


def _compare(words: int, percent: int):  # noqa: ANN202
    def run(tables: Iterator[pa.Table]) -> Iterator[dict[str, list]]:
        group = pa.concat_tables(list(tables))
        if len(group) < 2:
            return
        nodes, block = group["node"].to_numpy(), group["block"].to_numpy()
        shingles = Shingles(words)
        sets = [own for chunk in group["text"].chunks for own in shingles.each(chunk)]
        _, first, same = np.unique(nodes, return_index=True, return_inverse=True)
        roots = first[same]
        if len(sets) > FEW:
            roots, _ = forest(sets, percent, roots, block)
        else:
            sizes, met = np.array([len(s) for s in sets]), overlaps(sets)
            cross = group["left"][0].as_py() != group["right"][0].as_py()
            for i in range(len(sets) - 1):
                linked = (100 + percent) * met[i, i + 1 :].astype(np.int64) >= percent * (sizes[i] + sizes[i + 1 :])
                if cross:
                    linked &= block[i + 1 :] != block[i]
                joined = np.unique(np.append(roots[i + 1 :][linked], roots[i]))
                if len(joined) > 1:
                    roots[np.isin(roots, joined)] = joined[0]
        moved = np.flatnonzero(roots != np.arange(len(nodes)))
        whole = group["blocks"][0].as_py() == 1
        yield {"a": nodes[roots[moved]].tolist(), "b": nodes[moved].tolist(), "whole": [whole] * len(moved)}

    return run


def links(docs: DataFrame, groups: DataFrame, width: int, percent: int, key: str, text: str, block: int = BLOCK) -> DataFrame:
    """(a, b, whole): links that span each component within a group of classes (node, component, least, class_key); `whole`
    if the group was compared in one piece, so that a is the least of its component."""
    sent = docs.sparkSession.sparkContext.broadcast(hash_filter(groups.select(F.xxhash64("least").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, shingles = sent.value, Shingles(width)
        for batch in batches:
            some = batch.filter(pa.array(passing(wanted, batch.column(1).to_numpy())))
            own_keys = [xxhash.xxh128_digest(own.tobytes()) for own in shingles.each(some.column(2))]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(own_keys, pa.binary()), some.column(2)], names=["key", "own_key", "text"])

    place = F.xxhash64(F.col(key).cast("long")).alias("place")
    # Texts move, not sets: a text takes less than half of its shingles' hashes.
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), place, F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, own_key binary, text string")
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = groups.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    there = texts.join(own, (F.col("key") == F.col("least")) & (F.col("own_key") == F.col("class_key")))
    dealt = there.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "blocks", "block", "node", "text")
    return by_group(dealt, ["component", "left", "right"], ["node"], _compare(width, percent), "a long, b long, whole boolean")


def components(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): `rows` has (key, n, class_key) for each row; `classes` has (class_key, copies, component, first):
    how many rows share a set, the least id of its component, and whether it is the component's first class."""
    levels = sketch(docs, width, text)
    wide = staged(_lists(docs, levels, width, percent, key, text))
    rows = staged(wide.select(key, "n", "class_key"))
    sets = rows.where(F.col("class_key").isNotNull() & F.col(key).isNotNull())
    # Numbered once they are written: an id may be the least of several sets.
    counted = staged(sets.groupBy("class_key").agg(F.min(F.col(key).cast("long")).alias("least"), F.count("*").alias("copies")))
    classes = staged(counted.withColumn("cls", F.monotonically_increasing_id()))
    unstaged(counted)
    one = wide.select(F.col(key).cast("long").alias("least"), F.col("class_key").alias("own_key"), "n", "shared", "prefix")
    # Staged, as both the counts and the lists start from it.
    reps = staged(one.join(classes, "least").where(F.col("own_key") == F.col("class_key")).select("cls", "n", "shared", "prefix"))
    unstaged(wide)
    lists = staged(shared_lists(reps))
    unstaged(reps)
    tied = connected_components(candidates(lists, percent))
    groups = staged(tied.join(classes.select(F.col("cls").alias("node"), "least", "class_key"), "node"))
    unstaged(lists)
    found = staged(links(docs, groups, width, percent, key, text))
    unstaged(groups)
    done = found.where("whole").select(F.col("b").alias("cls"), F.col("a").alias("root"))
    rest = connected_components(found.where("not whole").select("a", "b")).where("node <> component")
    moved = done.unionByName(rest.select(F.col("node").alias("cls"), F.col("component").alias("root")))
    members = staged(moved.unionByName(moved.select(F.col("root").alias("cls"), "root").distinct()).join(classes, "cls"))
    firsts = members.groupBy("root").agg(F.min(F.struct("least", "class_key")).alias("head"))
    told = members.join(firsts, "root").select("cls", F.col("head.least").alias("component"), (F.col("head.class_key") == F.col("class_key")).alias("first"))
    named = staged(classes.join(told, "cls", "left").select("class_key", "copies", F.coalesce("component", "least").alias("component"), F.coalesce("first", F.lit(True)).alias("first")))
    unstaged(classes, found, members)
    return rows, named


def with_component(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """`rows` with the component of their class. Classes that hold more than one row in `HOT` are fewer than that, and
    are sent to all tasks, so that their rows need not meet in one; the others are joined by class."""
    total = rows.count()
    hot = classes.where(F.col("copies") * HOT > total).select("class_key", "component")
    common = rows.join(F.broadcast(hot), "class_key")
    others = rows.join(F.broadcast(hot.select("class_key")), "class_key", "left_anti").join(classes.where(F.col("copies") * HOT <= total).select("class_key", "component"), "class_key", "left")
    return common.unionByName(others)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for each row."""
    out = with_component(*components(docs, width, percent, key, text))
    ids = F.col(key).cast("long")
    return out.select(key, F.col("n").alias("n_shingles"), F.coalesce(F.when(ids.isNotNull(), F.col("component")), ids).alias("component_id"))


def class_of(width: int):  # noqa: ANN201
    """A column function: the class of a text, null for a text without words."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        shingles = Shingles(width)
        sets = [shingles.of(t) for t in texts]
        return pd.Series([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], dtype=object)

    return of


def without_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that come first in their component. Rows without an id stay, and of
    rows without words that repeat an id one does."""
    rows, classes = components(docs, width, percent, key, text)
    ids = docs.where(F.col(key).isNotNull())
    keyed = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("__id"), F.col("class_key").alias("__class"))
    heads = classes.where("first").select(F.col("component").alias("__id"), F.col("class_key").alias("__class"))
    bare = keyed.where("__class is null").select("__id", "__class").distinct()
    heads = staged(heads.unionByName(bare))
    repeated = staged(keyed.groupBy("__id").agg(F.count("*").alias("n")).where("n > 1").select("__id"))
    same_id = F.col(key).cast("long") == F.col("__id")
    plain = ids.join(repeated, same_id, "left_anti").join(heads.select("__id").distinct(), same_id, "left_semi")
    # Of ids that repeat, each row's own set tells.
    odd = ids.join(repeated, same_id, "left_semi").withColumn("__own", class_of(width)(F.col(text).cast("string")))
    odd = odd.join(heads, same_id & F.col("__own").eqNullSafe(F.col("__class")), "left_semi")
    order = F.struct(F.coalesce(F.col(text).cast("string"), F.lit("")), F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != text])))
    odd = odd.groupBy(F.col(key).alias("__k"), "__own").agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), order).alias("__row")).select("__row.*")
    return plain.unionByName(odd).unionByName(docs.where(F.col(key).isNull()))
