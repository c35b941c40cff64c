"""Ranked lexical search over shards of documents, by variable-block-max WAND.

Index. Documents are gathered into shards where they are read; a shard holds at most `SHARD`
documents and is a set of posting lists, one a term: the documents that hold it, in order,
with their impacts (what an occurrence pattern adds to a score, but for the weight of the
term). Lists are cut into blocks of varying length, each with its largest impact. Where to
cut is found by dynamic programming, which minimises the sum over all postings of what their
block's maximum overstates, plus a price for each block. The price is set by bisection on a
sample of the shard's lists so that blocks hold about `MEAN` postings; blocks have at most
`WIDEST`, and lists are cut every `SEGMENT` postings beforehand, so that all segments of a
shard run through the recurrence together.

Search. Each shard is searched alone, exactly. A block bounds what its term can add to the
documents between its first and its last posting, or, of terms that less than one in `RARE`
documents holds, to just those that hold it; at each document, the blocks of all the query's
terms that reach it add up to a bound of its score, which is WAND's pivot test for all
documents at once. Some documents of the highest bounds are scored first, from the
blocks that reach over them; the lowest score among the best of these is the threshold that
bounds have to reach from then on, and the documents whose bounds do are scored. Blocks that
lie where no bound does are never opened. The best of all shards are merged by one ranking.

Scores are whole numbers: see `weight` and `impacts`. Frequencies of terms, the numbers of
documents and of terms are those of the whole table.

Queries are taken in blocks of at most `QUERIES` rows and about `QUERY_BYTES` of text; one
block, with the weights of its terms, is what is sent to all tasks at a time.

Defined results: null and empty texts, and those without a term, are found by no query and
not counted; queries without a term, or none of whose terms occurs, give no rows; rows that
repeat an id are documents, or queries, of their own; among equal scores ids ascend, null
ones last; texts of any length are read whole; an empty table gives an empty result; other
columns are dropped.
"""

from __future__ import annotations

import itertools
import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docprov.llm.common import by_group, map_columns, staged

# Documents and occurrences of terms at which a shard is closed; local numbers of documents fit 16 bits.
SHARD, TERMS = 8192, 1 << 21
SEGMENT, WIDEST, MEAN, SHORT = 512, 48, 16, 8
RARE = 32
QUERIES, QUERY_BYTES = 1024, 4_000_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same over UTF-8, where all bytes of other characters lie beyond ASCII.
TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")
K1, LEAST, SLOPE = 20, 50, 50  # saturation, and the two parts of a document's length norm


def terms(text: bytes | None) -> list[bytes]:
    return TERM_BYTES.findall(text.lower()) if text else []  # lower() of bytes changes A-Z only


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, documents: int, words: int) -> np.ndarray:
    m = 100 - LEAST + (SLOPE * length * documents) // words
    return (1_000_000_000 * tf) // (1000 * tf + K1 * m)


def cuts(x: np.ndarray, lengths: np.ndarray, price: float) -> np.ndarray:
    """Whether a block begins at each place of rows of values, padded on the right: the blocks that minimise
    sum(maximum - value) + price * blocks over each row."""
    rows, n = x.shape
    width = min(WIDEST, n)
    best = np.full((rows, n + 1), np.inf)
    best[:, 0] = 0
    total = np.concatenate([np.zeros((rows, 1)), np.cumsum(x, axis=1)], axis=1)
    largest = np.zeros((rows, width))  # of the last k + 1 values
    back = np.zeros((rows, n), np.int16)
    size = np.arange(1, width + 1)
    for j in range(n):
        largest[:, 1:] = largest[:, :-1]
        largest[:, 0] = 0
        np.maximum(largest, x[:, j : j + 1], out=largest)
        w = min(width, j + 1)
        before = slice(j - w + 1, j + 1)
        cost = largest[:, :w] * size[:w] + (best[:, before] + total[:, before])[:, ::-1]
        k = cost.argmin(axis=1)
        back[:, j] = k
        best[:, j + 1] = cost[np.arange(rows), k] - total[:, j + 1] + price
    begins = np.zeros((rows, n), bool)
    at, row = lengths - 1, np.arange(rows)
    while len(row):
        at = at - back[row, at]
        begins[row, at] = True
        more = at > 0
        row, at = row[more], at[more] - 1
    return begins


def _segments(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pieces that long lists are cut into."""
    parts = -(-counts // SEGMENT)
    no = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(starts, parts) + no * SEGMENT
    return begin, np.minimum(SEGMENT, np.repeat(starts + counts, parts) - begin)


def blocks(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a block begins at each posting of a shard, whose lists lie one after the other."""
    begins = np.zeros(len(values), bool)
    begins[starts] = True
    long = counts > SHORT
    begin, size = _segments(starts[long], counts[long])
    if not len(begin):
        return begins
    order = np.argsort(size, kind="stable")
    begin, size = begin[order], size[order]

    def padded(some: np.ndarray) -> np.ndarray:
        width = int(size[some].max())
        at = begin[some][:, None] + np.arange(width)
        inside = np.arange(width) < size[some][:, None]
        return np.where(inside, values[np.minimum(at, len(values) - 1)], 0).astype(np.float64)

    sample = np.unique(np.linspace(0, len(begin) - 1, 64).astype(int))
    tried, low, high = padded(sample), 0.0, float(values.max()) * WIDEST
    for _ in range(12):
        price = (low + high) / 2
        few = cuts(tried, size[sample], price).sum() * MEAN <= size[sample].sum()
        low, high = (low, price) if few else (price, high)
    at = 0
    while at < len(begin):
        # As many segments of like lengths as make a small table.
        upto = at + max(1, (1 << 17) // int(size[min(len(size) - 1, at + 1023)]))
        some = np.arange(at, min(upto, len(begin)))
        found = cuts(padded(some), size[some], high)
        row, col = np.nonzero(found)
        begins[begin[some][row] + col] = True
        at = upto
    return begins


class Vocabulary(dict):
    """Terms by number, in the order in which they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = no = len(self)
        return no


class Shard:
    """Documents gathered so far: each term once, and a number an occurrence."""

    def __init__(self) -> None:
        self.keys: list = []
        self.lengths: list[int] = []
        self.vocabulary = Vocabulary()
        self.numbers = array("i")

    def add(self, key: object, own: list[bytes]) -> None:
        self.keys.append(key)
        self.lengths.append(len(own))
        self.numbers.extend(map(self.vocabulary.__getitem__, own))

    def lists(self, documents: int, words: int, at: int = 20_000) -> Iterator[list[pa.Array]]:
        """(term, docs, impacts, begins, maxima, keys) as columns, some rows at a time: one that holds the keys in order, then the lists by term. A list is
        its documents, their impacts, the blocks' first places in it and their largest impacts, all as packed numbers."""
        keys = self.keys
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] if keys[i] is not None else 0))
        none = pa.array([None], pa.binary())
        yield [none] * 5 + [pa.array([[keys[i] for i in order]])]
        names = sorted(self.vocabulary)
        place = np.zeros(len(names), np.int64)
        place[[self.vocabulary[t] for t in names]] = np.arange(len(names))
        local = np.zeros(len(keys), np.int64)
        local[order] = np.arange(len(keys))
        lengths = np.array(self.lengths, np.int64)
        # One number an occurrence: by term, then by document.
        pairs, counts = np.unique(place[np.frombuffer(self.numbers, np.int32)] * len(keys) + np.repeat(local, lengths), return_counts=True)
        number, local = np.divmod(pairs, len(keys))
        value = impacts(counts, lengths[order][local], documents, words).astype("<u4")
        local = local.astype("<u2")
        sizes = np.bincount(number, minlength=len(names))
        starts = np.cumsum(sizes) - sizes
        begins = np.flatnonzero(blocks(value, starts, sizes))
        maxima = np.maximum.reduceat(value, begins).astype("<u4")
        first = np.searchsorted(begins, starts)
        n_blocks = np.diff(np.append(first, len(begins)))
        within = (begins - np.repeat(starts, n_blocks)).astype("<u4")
        first, starts = np.append(first, len(begins)), np.append(starts, len(local))
        for a in range(0, len(names), at):
            b = min(a + at, len(names))
            columns = [_packed(x, offsets[a : b + 1]) for x, offsets in ((local, starts), (value, starts), (within, first), (maxima, first))]
            yield [pa.array(names[a:b], pa.binary()), *columns, pa.nulls(b - a)]


def _packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Stretches of numbers as binary values."""
    own = values[offsets[0] : offsets[-1]]
    places = ((offsets - offsets[0]) * own.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(own))])


@dataclass(frozen=True)
class Index:
    """Posting lists by shard, and the number of documents with a term and of all their terms."""

    rows: DataFrame
    documents: int
    words: int


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_rows: int = SHARD) -> Index:
    """Index every document of a table; the lists are written to the shared folder."""
    texts = docs.select(F.col(key), F.col(text).cast("string").cast("binary").alias("text"))

    def counted(found: list) -> Iterator[dict[str, list]]:
        own = [len(terms(t)) for t in found]
        yield {"documents": [sum(n > 0 for n in own)], "words": [sum(own)]}

    seen = map_columns(texts, ["text"], counted, "documents long, words long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "words")]).first()
    documents, words = seen.documents, seen.words
    if not 0 < shard_rows <= 65536:
        raise ValueError("a shard holds 1 to 65536 documents")
    kind = T._parse_datatype_string(f"shard long, term binary, docs binary, impacts binary, begins binary, maxima binary, keys array<{docs.schema[key].dataType.simpleString()}>")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 32

        def written(own: Shard) -> Iterator[pa.RecordBatch]:
            for columns in own.lists(documents, words):
                rows = len(columns[0])
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([pa.array(np.full(rows, no)), *columns], arrow, strict=True)], schema=arrow)

        own = Shard()
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if found := terms(t.as_py()):
                    own.add(k, found)
                    if len(own.keys) >= shard_rows or len(own.numbers) >= TERMS:
                        yield from written(own)
                        own, no = Shard(), no + 1
        if own.keys:
            yield from written(own)

    return Index(staged(texts.mapInArrow(run, kind)), documents, words)


def best(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], weights: list[int], size: int, most: int, opened: list | None = None) -> list[tuple[int, int]]:
    """(local number, score) of the `most` best documents of a shard, scores above 0; `lists` are the documents,
    impacts, first places and largest impacts of each term. `opened` gets the postings read and those there are."""
    begins, ends, bound, factor, at = [], [], [], [], 0
    for (docs, _, first, largest), w in zip(lists, weights, strict=True):
        if len(docs) * RARE <= size:  # each posting alone, under its block's maximum
            first, largest = np.arange(len(docs)), np.repeat(largest, np.diff(np.append(first, len(docs)).astype(np.int64)))
        begins.append(first.astype(np.int64) + at)
        at += len(docs)
        ends.append(np.append(begins[-1][1:], at))
        bound.append(largest.astype(np.int64) * w)
        factor.append(np.full(len(first), w, np.int64))
    begin, end, bound, factor = np.concatenate(begins), np.concatenate(ends), np.concatenate(bound), np.concatenate(factor)
    docs, values = np.concatenate([x[0] for x in lists]), np.concatenate([x[1] for x in lists]).astype(np.int64)
    low, high = docs[begin].astype(np.int64), docs[end - 1].astype(np.int64)
    upper = np.zeros(size + 1, np.int64)
    np.add.at(upper, low, bound)
    np.subtract.at(upper, high + 1, bound)
    upper = np.cumsum(upper)[:size]
    score, open_ = np.zeros(size, np.int64), upper > 0
    threshold, take = 1, 2 * most
    while True:
        left = np.flatnonzero(open_ & (upper >= threshold))
        if not len(left):
            break
        if len(left) > take:
            left = left[np.argpartition(-upper[left], take)[:take]]
        asked = np.zeros(size, bool)
        asked[left] = True
        open_[left] = False
        reach = np.concatenate([[0], np.cumsum(asked)])
        need = np.flatnonzero(reach[high + 1] > reach[low])
        n = end[need] - begin[need]
        place = np.arange(n.sum()) + np.repeat(begin[need] - (np.cumsum(n) - n), n)
        inside = asked[docs[place]]
        place = place[inside]
        np.add.at(score, docs[place], values[place] * np.repeat(factor[need], n)[inside])
        if opened is not None:
            opened.append((int(n.sum()), len(docs)))
        got = score[score > 0]
        if len(got) >= most:
            threshold = max(threshold, int(np.partition(got, len(got) - most)[len(got) - most]))
        take = size
    top = np.flatnonzero(score >= threshold)
    top = top[np.lexsort((top, -score[top]))][:most]
    return [(int(i), int(score[i])) for i in top]


def _query_blocks(queries: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """The queries, some at a time: (key, distinct terms)."""
    block, size = [], 0
    for k, t in queries.select(F.col(key), F.col(text).cast("string").cast("binary")).toLocalIterator():
        block.append((k, sorted(set(terms(bytes(t) if t is not None else None)))))
        size += len(t or b"")
        if len(block) >= QUERIES or size >= QUERY_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(own: Index, queries: DataFrame, most: int = 50, query_key: str = "item_id", query_text: str = "text", key: str = "doc_id") -> DataFrame:
    """(query_key, rank, key, score): the `most` best documents for each row of `queries`."""
    spark = own.rows.sparkSession
    ids = own.rows.schema["keys"].dataType.elementType
    asked_kind = queries.schema[query_key].dataType
    schema = f"query long, asked {asked_kind.simpleString()}, key {ids.simpleString()}, score long"
    out = spark.createDataFrame([], schema)
    before = 0
    for block in _query_blocks(queries, query_key, query_text):
        names = sorted({t for _, own_terms in block for t in own_terms})
        wanted = F.broadcast(spark.createDataFrame([(bytearray(t),) for t in names], "term binary"))  # at most about QUERY_BYTES
        lists = own.rows.where("term is not null").join(wanted, "term", "left_semi")
        df = {bytes(r.term): r.df for r in lists.groupBy("term").agg(F.sum(F.octet_length("docs") / 2).cast("long").alias("df")).collect()}
        weights = {t: weight(own.documents, n) for t, n in df.items()}
        asked = [(before + no, k, [t for t in own_terms if t in df]) for no, (k, own_terms) in enumerate(block)]
        before += len(block)

        def run(tables: Iterator[pa.Table], asked: list = asked, weights: dict = weights) -> Iterator[dict[str, list]]:
            keys, held = [], {}
            for t in tables:
                if t["term"][0].as_py() is None:
                    keys, t = t["keys"][0].as_py(), t.slice(1)
                parts = [[np.frombuffer(v.as_buffer(), kind) for v in t[c]] for c, kind in (("docs", "<u2"), ("impacts", "<u4"), ("begins", "<u4"), ("maxima", "<u4"))]
                held.update(zip(t["term"].to_pylist(), zip(*parts, strict=True), strict=True))
            for no, item, names in asked:
                here = [x for x in names if x in held]
                if here:
                    found = best([held[x] for x in here], [weights[x] for x in here], len(keys), most)
                    yield {"query": [no] * len(found), "asked": [item] * len(found), "key": [keys[i] for i, _ in found], "score": [s for _, s in found]}

        rows = own.rows.where("term is null").unionByName(lists)
        out = out.unionByName(by_group(rows, ["shard"], ["term"], run, schema))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("key").asc_nulls_last())))
    return ranked.where(F.col("rank") <= most).select(F.col("asked").alias(query_key), "rank", F.col("key").alias(key), "score")
