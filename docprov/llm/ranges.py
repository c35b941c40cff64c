"""Exact metric range join of vectors, and near duplicates by it.

On unit vectors, cosine and distance tell the same: a cosine of at least c is a distance
of at most r = sqrt(2 - 2c). Each label's vectors are partitioned by pivots of their own: a
vector belongs to the cell of its nearest pivot. By the triangle inequality, a vector within
r of one whose nearest pivot is p lies at most 2r further from p than from its own pivot;
and, as the distance is Euclidean, no further than r beyond the plane between the two pivots,
which is never the looser bound. Cells are in order: a vector is also sent to those cells
before its own that this bound allows, so every pair meets in just one cell, that of the
earlier of its two vectors, and cells join independently.

Cells of many vectors are partitioned again, by pivots found among them, as long as that
saves comparisons; one that can't be parted so (vectors spread evenly in many dimensions, or
near copies of each other) is cut into blocks, each of which meets the blocks from it on.
Pivots come from about `SAMPLE` vectors of a cell, those with the smallest hashes: the two
points along the direction of the widest spread, or the centres of 4, 8 or 16 clusters,
whichever promises the least work. Which they are changes the cost only.

Vectors equal in every component form one class (told by two 64-bit hashes) and are compared once.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and vectors with a null label, link with nothing and are components of their own; vectors
of different lengths do not link; a null id gives a null component; rows that repeat an id
with the same vector count as linked vectors; an empty table gives an empty result; other
columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprov.llm.common import by_group, staged, unstaged
from docprov.llm.components import connected_components

#: Vectors of a cell that is partitioned again, natives of a block, and partners compared at a time.
CELL, BLOCK, STREAM = 8192, 8192, 512
#: Vectors of a cell that its pivots are chosen from, and rounds of clustering.
SAMPLE, ROUNDS = 512, 6
#: Comparisons that cost as much as sending a vector to one more cell, and the part of the work that a further partition has to save.
SENDING, SAVING = 2000.0, 0.1
#: Bytes of pivots that are sent to all tasks; beyond them, vectors of a cell that one share holds.
SMALL_BYTES, SHARE = 32_000_000, 65536
PLACE = ["label_no", "size", "cell"]
COLUMNS = [*PLACE, "native", "cls", "copies", "v"]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = np.asarray(x, dtype=np.float64)
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector: str) -> Column:
    """Whether a vector can link at all."""
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)


def keyed(vectors: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(key, label_no, h1, h2, v): v is null for vectors that link with nothing. A label is told by a hash."""
    sound = usable(vector) & F.col(key).isNotNull() & F.col(label).isNotNull()
    kind = vectors.schema[vector].dataType
    v = F.col(vector) if kind.simpleString() in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    hashes = F.xxhash64(v), F.xxhash64(F.lit("second"), v)
    return vectors.select(F.col(key).alias("id"), F.xxhash64(F.col(label).cast("string")).alias("label_no"), hashes[0].alias("h1"), hashes[1].alias("h2"), F.when(sound, v).alias("v"))


def classes_of(rows: DataFrame) -> DataFrame:
    """(label_no, h1, h2, size, cls, copies, v): usable vectors, equal ones as one, under their least id."""
    least = rows.where("v is not null").groupBy("label_no", "h1", "h2")
    return least.agg(F.min(F.col("id").cast("long")).alias("cls"), F.count("*").alias("copies"), F.first("v").alias("v")).withColumn("size", F.size("v"))


def bounds(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector, and how far it lies from the plane between that and every pivot."""
    square = np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1))
    own = square.argmin(1)
    near = square[np.arange(len(x)), own][:, None]
    gap = np.sqrt(np.maximum(0, ((pivots[own][:, None, :] - pivots) ** 2).sum(2)))
    return own, np.divide(square - near, 2 * gap, out=np.zeros_like(square), where=gap > 0)


def sends(x: np.ndarray, pivots: np.ndarray, reach: float, native: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own cell, whether sent to each cell): natives go to their own cell and, of those that may
    hold partners, to the ones before it; vectors that only visit go to all that may."""
    own, plane = bounds(x, pivots)
    sent = plane <= reach
    sent &= ~native[:, None] | (np.arange(len(pivots)) < own[:, None])
    sent[np.arange(len(x)), own] = True
    return own, sent


def work(x: np.ndarray, pivots: np.ndarray, reach: float, n: int) -> float:
    """Comparisons for each pair of n vectors like the sample, with what is sent counted in."""
    own, sent = sends(x, pivots, reach, np.ones(len(x), dtype=bool))
    native = np.bincount(own, minlength=len(pivots)) / len(x)
    visiting = sent.mean(0) - native
    return float((native * (native / 2 + visiting)).sum() + SENDING * visiting.sum() / n)


def clustered(x: np.ndarray, k: int) -> np.ndarray:
    """Centres of k clusters; they start at vectors far from each other."""
    first = int(((x - x.mean(0)) ** 2).sum(1).argmax())
    chosen, far = [first], ((x - x[first]) ** 2).sum(1)
    while len(chosen) < k:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    centres = x[chosen]
    for _ in range(ROUNDS):
        own = bounds(x, centres)[0]
        centres = np.stack([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(k)])
    return centres


def pivots_of(x: np.ndarray, n: int, reach: float, needed: bool) -> np.ndarray | None:
    """The pivots for a cell of n vectors, by a sample of them; None if none save enough and none are `needed`."""
    middle = x.mean(0)
    _, spread, directions = np.linalg.svd(x - middle, full_matrices=False)
    if len(x) < 2 or spread[0] < 1e-12:
        return None
    step = directions[0] * spread[0] / np.sqrt(len(x))
    tries = [np.stack([middle - step, middle + step]), *(clustered(x, k) for k in (4, 8, 16) if 8 * k <= len(x))]
    costs = [work(x, p, reach, n) for p in tries]
    best = int(np.argmin(costs))
    return tries[best] if needed or costs[best] < (1 - SAVING) * 0.5 else None


def cell_pivots(rows: DataFrame, least: int, reach: float, needed: bool) -> DataFrame:
    """(label_no, size, cell, pivots) for cells of `least` natives or more: pivots as bytes of doubles."""
    natives = rows.where("native")
    large = natives.groupBy(*PLACE).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    taken = F.pmod(F.xxhash64("cls", F.lit("pivot")), F.lit(1 << 30)) * F.col("n") < F.lit(SAMPLE * (1 << 30))
    sample = natives.select(*PLACE, "cls", "v").join(large, PLACE).where(taken)

    def choose(group: pa.Table) -> pa.Table:
        group = group.sort_by("cls")
        found = pivots_of(unit(matrix(group["v"])), group["n"][0].as_py(), reach, needed)
        out = group.slice(0, int(found is not None)).select([*PLACE, "n"])
        return out.append_column("pivots", pa.array([found.tobytes()] if found is not None else [], pa.binary()))

    return sample.groupBy(*PLACE).applyInArrow(choose, "label_no long, size int, cell string, n long, pivots binary")


def matrix(column: pa.ChunkedArray | pa.ListArray) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _parted(batch: pa.RecordBatch | pa.Table, pivots: np.ndarray, reach: float):  # noqa: ANN202
    """Vectors of one cell, each once for every cell below it that it is sent to."""
    x, native = unit(matrix(batch.column("v"))), batch.column("native").to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch["native"].to_numpy()
    own, sent = sends(x, pivots, reach, native)
    i, cell = np.nonzero(sent)
    out = batch.take(pa.array(i))
    names = [f"{old}.{c}" for old, c in zip(out.column("cell").to_pylist(), cell.tolist(), strict=True)]
    new = {"cell": pa.array(names, pa.string()), "native": pa.array(native[i] & (cell == own[i]))}
    return type(batch).from_arrays([new.get(f.name, out.column(f.name)) for f in batch.schema], schema=batch.schema)


def partitioned(rows: DataFrame, pivots: DataFrame, reach: float) -> DataFrame:
    """Every vector in the cells below its present one that it is sent to; vectors of cells without pivots stay.
    Pivots of up to `SMALL_BYTES` in all go to every task; more of them travel with their cells, at the
    head of each of the shares of bounded size that a cell is dealt out in."""
    rows = rows.select(*COLUMNS)
    if (pivots.agg(F.sum(F.octet_length("pivots"))).first()[0] or 0) <= SMALL_BYTES:
        known = {tuple(r[c] for c in PLACE): r.pivots for r in pivots.collect()}  # of a checked size
        sent = rows.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = batch.select(PLACE).to_pylist()
                codes: dict[tuple, list[int]] = {}
                for i, place in enumerate(places):
                    codes.setdefault(tuple(place.values()), []).append(i)
                for place, at in codes.items():
                    own, raw = batch.take(pa.array(at)), sent.value.get(place)
                    yield own if raw is None else _parted(own, np.frombuffer(raw).reshape(-1, place[1]), reach)

        return rows.mapInArrow(run, rows.schema)
    shares = pivots.select(*PLACE, F.ceil(F.col("n") / SHARE).cast("int").alias("shares"))
    dealt = rows.join(shares, PLACE, "left")
    share = F.pmod(F.xxhash64("cls"), F.col("shares")).cast("int").alias("share")
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("native", "cls", "copies", "v")]
    heads = pivots.join(shares, PLACE).select(*PLACE, *none, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role"), "pivots")
    body = dealt.where("shares is not null").select(*COLUMNS, share, F.lit(1).alias("role"), F.lit(None).cast("binary").alias("pivots"))

    def follow(tables: Iterator[pa.Table]) -> Iterator[dict[str, list]]:
        own = None
        for t in tables:
            if own is None:
                own, t = np.frombuffer(t["pivots"][0].as_py()), t.slice(1)
            if len(t):
                out = _parted(t.select(COLUMNS), own.reshape(-1, t["size"][0].as_py()), reach)
                yield {c: out[c].to_pylist() if c != "v" else list(matrix(out[c])) for c in COLUMNS}

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in COLUMNS)
    return dealt.where("shares is null").select(*COLUMNS).unionByName(by_group(body.unionByName(heads), [*PLACE, "share"], ["role"], follow, kinds))


def cells(classes: DataFrame, reach: float) -> DataFrame:
    """(label_no, size, cell, native, cls, copies, v), staged: each vector in its own cell, and in the earlier ones where
    it may have partners. Every label is partitioned at least once; each level is one pass over the vectors."""
    rows = classes.select("label_no", "size", F.lit("0").alias("cell"), F.lit(True).alias("native"), "cls", "copies", "v")
    before, least, needed = None, 2, True
    while True:
        pivots = staged(cell_pivots(rows, least, reach, needed))
        if pivots.isEmpty():
            unstaged(pivots)
            break
        now = staged(partitioned(rows, pivots, reach))
        if before is not None:
            unstaged(before)
        unstaged(pivots)
        rows = before = now
        least, needed = CELL, False
    return before if before is not None else staged(rows)


class _Block:
    """The natives of one block: how many vectors each is linked with, and which natives
    are known to be of one component."""

    def __init__(self, cosine: float, v: np.ndarray, ids: np.ndarray, copies: np.ndarray):
        self.cosine, self.all, self.no, self.n = cosine, v, ids, copies
        self.links, self.part = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))

    def together(self, places: np.ndarray) -> None:
        parts = np.unique(self.part[places])
        for other in parts[1:]:
            self.part[self.part == other] = parts[0]

    def within(self) -> None:
        """Compare the natives with each other, each pair once."""
        for at in range(0, len(self.no), STREAM):
            upto = min(len(self.no), at + STREAM)
            hit = self.all[at:] @ self.all[at:upto].T >= self.cosine
            hit &= np.arange(at, len(self.no))[:, None] > np.arange(at, upto)
            self.links[at:] += hit @ self.n[at:upto]
            self.links[at:upto] += hit.T @ self.n[at:]
            for j in np.flatnonzero(hit.any(0)):
                self.together(np.append(at + np.flatnonzero(hit[:, j]), at + j))

    def visit(self, v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Compare with vectors that are not natives: (their places, copies linked with, a native linked with) of those that link."""
        hit = self.all @ v.T >= self.cosine
        self.links += hit @ n
        met = np.flatnonzero(hit.any(0))
        for j in met:
            self.together(np.flatnonzero(hit[:, j]))
        return met, self.n @ hit[:, met], hit[:, met].argmax(0) if len(met) else met


def _join(cosine: float):  # noqa: ANN202
    def run(tables: Iterator[pa.Table]) -> Iterator[dict[str, list]]:
        natives: list[tuple] = []
        block: _Block | None = None
        for t in tables:  # natives come first
            ids, copies, native = t["cls"].to_numpy(), t["copies"].to_numpy(), t["role"].to_numpy() == 0
            v = matrix(t["v"])
            if native.any():
                natives.append((v[native], ids[native], copies[native]))
            if native.all():
                continue
            if not natives:  # no native falls in this block
                return
            block = block or _Block(cosine, *_whole(natives))
            others, names, n = unit(v[~native]), ids[~native], copies[~native]
            for at in range(0, len(others), STREAM):
                met, links, with_ = block.visit(others[at : at + STREAM], n[at : at + STREAM])
                yield {"a": names[at + met].tolist(), "b": block.no[with_].tolist(), "n_links": links.tolist()}
        block = block or _Block(cosine, *_whole(natives))
        block.within()
        some = np.flatnonzero((block.links > 0) | (block.part != np.arange(len(block.no))))
        yield {"a": block.no[some].tolist(), "b": block.no[block.part[some]].tolist(), "n_links": block.links[some].tolist()}

    return run


def _whole(natives: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v, ids, copies = (np.concatenate([x[i] for x in natives]) for i in range(3))
    return unit(v), ids, copies


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) for each row; links are within a label only."""
    rows = keyed(vectors, key, label, vector)
    classes = staged(classes_of(rows))
    # A hair more than the radius, so that rounding costs nothing but a little replication.
    spread = cells(classes, float(np.sqrt(2 - 2 * cosine)) + 1e-6)
    blocks = spread.where("native").groupBy(*PLACE).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = spread.join(blocks, PLACE).withColumn("home", F.when(F.col("native"), F.pmod(F.xxhash64("cls"), F.col("blocks"))).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("home", F.col("blocks") - 1))))
    role = F.when(F.col("home") == F.col("block"), 0).otherwise(1)
    dealt = dealt.select(*PLACE, "block", role.alias("role"), "cls", "copies", "v")
    found = staged(by_group(dealt, [*PLACE, "block"], ["role", "cls"], _join(cosine), "a long, b long, n_links long"))
    unstaged(spread)
    parts = connected_components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "cls")
    counts = found.groupBy(F.col("a").alias("cls")).agg(F.sum("n_links").alias("n_links"))
    known = classes.select("label_no", "h1", "h2", "cls", "copies").join(counts, "cls", "left").join(parts, "cls", "left")
    known = known.select("label_no", "h1", "h2", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    sound = F.when(F.col("v").isNotNull(), F.col("label_no")).alias("label_no")
    out = rows.select("id", sound, "h1", "h2").join(known, ["label_no", "h1", "h2"], "left")
    ids = F.col("id").cast("long")
    component = F.coalesce(F.when(ids.isNotNull(), F.col("component")), ids)
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == ids, F.lit(False)).alias("kept"))
