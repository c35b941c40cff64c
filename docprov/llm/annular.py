"""Compression of vectors to codes of codebook entries, found by annular norm pruning.

Components become integers floor(scale * x); a vector is cut into equal parts, and each part
position has a codebook of its own. An entry whose norm is off by more than the distance to
the best entry so far can't be nearer, by the triangle inequality. So entries are sorted by
norm once; a part starts at the entry of the nearest norm, binary search over the norms
finds the interval (the annulus around the origin) that its distance still allows, ends
included, and only entries in it are compared, in exact integers, outwards, while the
interval shrinks with each better one.

Codebooks start as the first vectors by id and move to the means of their parts for some
rounds. A round is one pass over the staged integers: each batch adds up what it assigns, so
that only sums by (part, entry, position) are shuffled and gathered, as many as there are
integers in the codebooks, whatever the number of vectors or labels.

Defined results: vectors that are null, empty or hold null or non-finite components are
dropped, and so are those of another length than the vector of the least id, or all if that
length can't be cut into equal parts; rows that repeat an id are compressed one by one, ties
among the first go to the lesser components, null ids come last; null labels are one label;
with fewer vectors than entries the codebooks hold as many as there are; integers beyond
2^40 in size are taken as 2^40, and errors beyond a long as the largest long; an empty table
gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprov.llm.common import map_columns, staged

MOST, LARGEST = float(1 << 40), (1 << 63) - 1


@dataclass(frozen=True)
class Shape:
    scale: int = 4096
    parts: int = 8
    entries: int = 16
    rounds: int = 6


def exact(x: np.ndarray) -> np.ndarray:
    """The integers in a form whose squared distances don't overflow: longs, or Python's own."""
    x = np.asarray(x)
    most = int(np.abs(x).max()) if x.size else 0
    return x.astype(np.int64) if 4 * most * most * max(1, x.shape[-1]) < 1 << 62 else x.astype(object)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1).astype(np.float64))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, squared distance) of each row, ties to the lower index; and how many distances
    were worked out."""
    both = exact(np.concatenate([x, entries]))
    x, entries = both[: len(x)], both[len(x) :]
    order = np.argsort(norms(entries), kind="stable")
    by_norm, size, own = norms(entries)[order], len(entries), norms(x)
    slack = 1e-9 * (own + by_norm[-1]) + 1e-9  # norms are rounded

    def squared(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        gap = x[rows] - entries[order[at]]
        return (gap * gap).sum(axis=1)

    def allowed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        reach = np.sqrt(best[rows].astype(np.float64)) + slack[rows]
        return np.searchsorted(by_norm, own[rows] - reach, "left"), np.searchsorted(by_norm, own[rows] + reach, "right")

    every = np.arange(len(x))
    right = np.searchsorted(by_norm, own).clip(0, size - 1)
    left = (right - 1).clip(0)
    start = np.where(np.abs(by_norm[left] - own) < np.abs(by_norm[right] - own), left, right)
    best, index, met = squared(every, start), order[start], len(x)
    low, high = allowed(every)
    for step in range(1, size):
        for at in (start - step, start + step):
            rows = np.flatnonzero((at >= low) & (at < high))
            if len(rows):
                new, no = squared(rows, at[rows]), order[at[rows]]
                met += len(rows)
                better = (new < best[rows]) | ((new == best[rows]) & (no < index[rows]))
                won = rows[better.astype(bool)]
                best[won], index[won] = new[better.astype(bool)], no[better.astype(bool)]
                low[won], high[won] = allowed(won)
        if not ((start - step > low) | (start + step < high - 1)).any():
            break
    return index, best, met


def integers(vector: str, scale: int) -> Column:
    one = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(MOST)), F.lit(-MOST)))
    return F.transform(vector, one)


def usable(vector: str) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & sound, F.lit(False))


def prepared(rows: DataFrame, shape: Shape = Shape(), key: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(staged rows of key, label, q; the first codebooks by part)."""
    tag = F.col(label) if label else F.lit(None).cast("string")
    q = staged(rows.where(usable(vector)).select(F.col(key).alias("key"), tag.alias("tag"), integers(vector, shape.scale).alias("q")))
    order = (F.col("key").asc_nulls_last(), F.col("q"))
    first = q.orderBy(*order).select("q").limit(1).collect()
    n = len(first[0].q) if first else 0
    if n == 0 or n % shape.parts:
        return q.where(F.lit(False)), []
    q = q.where(F.size("q") == n)
    least = np.array([r.q for r in q.orderBy(*order).limit(shape.entries).select("q").collect()], dtype=np.int64)
    return q, np.split(least, shape.parts, axis=1)


def learned(q: DataFrame, books: list[np.ndarray], shape: Shape = Shape()) -> list[np.ndarray]:
    """The codebooks after all rounds."""
    for _ in range(shape.rounds if books else 0):

        def sums(vectors: list, books: list[np.ndarray] = books) -> Iterator[dict[str, list]]:
            out: dict[str, list] = {c: [] for c in ("part", "entry", "at", "n", "total")}
            for part, (x, book) in enumerate(zip(np.split(np.array(vectors, dtype=np.int64), len(books), axis=1), books, strict=True) if vectors else ()):
                index, *_ = nearest(x, book)
                for e in np.unique(index):
                    own = x[index == e]
                    for at, total in enumerate(own.sum(axis=0).tolist()):  # at most 2^40 times the rows of a batch
                        for c, v in zip(out, (part, int(e), at, len(own), total), strict=True):
                            out[c].append(v)
            yield out

        found = map_columns(q, ["q"], sums, "part int, entry int, at int, n long, total long")
        moved = [b.copy() for b in books]
        for r in found.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
            moved[r.part][r.entry, r.at] = int(r.total) // r.n
        books = moved
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encoded(q: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(key, tag, indexes, error): each vector's entries by part and the squared distance to them."""

    def run(keys: list, tags: list, vectors: list) -> Iterator[dict[str, list]]:
        if not vectors:
            return
        found = [nearest(x, b) for x, b in zip(np.split(np.array(vectors, dtype=np.int64), len(books), axis=1), books, strict=True)]
        errors = [min(sum(map(int, e)), LARGEST) for e in zip(*(best for _, best, _ in found), strict=True)]
        yield {"key": keys, "tag": tags, "indexes": np.column_stack([i for i, *_ in found]).astype(np.int32).tolist(), "error": errors}

    kinds = {c: q.schema[c].dataType.simpleString() for c in ("key", "tag")}
    return map_columns(q, ["key", "tag", "q"], run, f"key {kinds['key']}, tag {kinds['tag']}, indexes array<int>, error long")


def compressed(rows: DataFrame, shape: Shape = Shape(), key: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256): codes as two hex digits a part, and the errors summed over
    equal labels. `prepared`, `learned` and `encoded` give the codebooks themselves."""
    q, books = prepared(rows, shape, key, vector, label)
    books = learned(q, books, shape)
    found = staged(encoded(q, books))
    largest = F.lit(LARGEST).cast("decimal(38,0)")
    by_tag = found.groupBy("tag").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), largest).cast("long").alias("label_error"))
    code = F.array_join(F.transform("indexes", lambda i: F.lower(F.lpad(F.hex(i.cast("long")), 2, "0"))), "")
    out = found.alias("f").join(by_tag.alias("t"), F.col("f.tag").eqNullSafe(F.col("t.tag")))
    return out.select(F.col("key").alias(key), code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
