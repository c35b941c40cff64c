"""What several operators of this subpackage share."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docprov import session

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """Where this application's staged tables lie, in the folder that driver and executors share."""
    return f"{session.shared_folder(spark)}/staged-{spark.sparkContext.applicationId}"


#: What is staged and not deleted yet.
LIVE: set[str] = set()


def staged(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it again: a cut in the lineage that
    outlives any executor. Unlike a cache it takes no executor memory."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    LIVE.add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    LIVE.difference_update([p for p in LIVE if p.startswith(path)])


def unstaged(*frames: DataFrame) -> None:
    """Delete staged tables once what was made of them is staged itself."""
    for df in frames:
        _delete(df.sparkSession, df.staged_at)


def staged_alone(spark: SparkSession, made: Callable[[], DataFrame]) -> DataFrame:
    """The staged result of `made`, and nothing else of what was staged on the way to it."""
    before = set(LIVE)
    out = staged(made())
    for path in LIVE - before - {out.staged_at}:
        _delete(spark, path)
    return out


def clear_staged(spark: SparkSession) -> None:
    """Delete all that operators staged in this application: what their lazy results still read, too. To be called
    when those are written."""
    _delete(spark, shared_folder(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return session.spread(out) if name == "documents" else out  # whole texts: a small table may lie in one row group


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def map_columns(df: DataFrame, columns: list[str], fn: Callable[..., Iterator[dict[str, list]]], schema: T.StructType | str) -> DataFrame:
    """Apply `fn(*lists)` to each Arrow batch of `columns`, one Python list a column with
    None for null; `fn` yields dicts of lists, which become rows of `schema`."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in fn(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def by_group(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[Iterator[pa.Table]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """Deal rows out by `keys`, sort them by keys and `order` within partitions, and apply
    `fn` to each group, given as an iterator of tables so that a group need not fit in memory."""
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            own = [part[k].to_numpy() for k in keys]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in own], axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, part.num_rows], strict=True):
                yield tuple(c[a] for c in own), part.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[str, list] = {f.name: [] for f in arrow}
        for _, group in itertools.groupby(parts(batches), key=lambda p: p[0]):
            tables = (t for _, t in group)
            for out in fn(tables):
                for name, values in out.items():
                    pending[name].extend(values)
                if len(pending[arrow[0].name]) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(pending[f.name], f.type) for f in arrow], schema=arrow)
                    pending = {f.name: [] for f in arrow}
        yield pa.RecordBatch.from_arrays([pa.array(pending[f.name], f.type) for f in arrow], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)


#: Bits of a filter for each of its hashes, and its least and most bits (64 MB): with more hashes than
#: that is made for, more rows pass by chance, which costs time and loses nothing.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 29


def hash_filter(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the hashes in column h, as 64-bit words; its size goes by their number, up to a bound."""
    bits = LEAST_BITS
    n = hashes.count()
    while bits < BITS_EACH * n and bits < MOST_BITS:
        bits *= 2
    at = hashes.select(F.expr(f"h & {bits - 1}").alias("at"))
    words = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("bit"))
    out = np.zeros(bits // 64, dtype=np.int64)
    for part in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # at most a row a word, a partition at a time
        out[part.word] = part.bits
    return out


def passes(bitmap: np.ndarray, h: int) -> bool:
    at = h & (64 * len(bitmap) - 1)
    return bool(bitmap[at >> 6] >> (at & 63) & 1)


def passing(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of many hashes pass."""
    at = hashes & (64 * len(bitmap) - 1)
    return (bitmap[at >> 6] >> (at & 63) & 1).astype(bool)
