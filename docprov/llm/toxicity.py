"""Convolutional text classifier for toxicity, trained in numpy.

Words become embeddings: the sum of hashed vectors of the whole word and of its first
letters, so that inflected forms of one stem meet. Filters of several widths slide over
the words, each keeps its largest values (`TOP` of them: one such word may be chance, some
are not), and a logistic layer reads these. One dimension of
the embeddings starts at the evidence of the training rows, as is known to help where rows
are few: a lower bound of the log odds that a text with such a word is labelled 1; the
first filter starts by reading it. Training takes a bounded, deterministic sample of the
labelled rows (`max_toxic` and `max_clean` of them, those with the smallest hashes, and
`max_bytes` of text); scoring takes every word of every text.

Each third of the sample is scored by a model trained on the other two; these scores say how
many passes (at least one) to train and calibrate the model trained on all of it: the score is shifted so
that the best common threshold lies at `cut`, and thresholds by language are set where the
rows of that language allow it. Language never enters a score.

Defined results: null and empty texts get the score of a text without words; a text whose
label is null, or that has conflicting labels, is not trained on; without rows of both
labels every score is 0; repeated rows score alike; an empty table gives an empty result;
`score_texts` drops other columns, `without_toxic` keeps all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprov.llm.common import staged, unstaged

TOKEN = re.compile(r"\w+")
BUCKETS, DIM, WIDTHS, FILTERS, TOP = 1 << 16, 12, (1, 2, 3), 8, 5
#: Empty words behind a text: windows that start within a text or at the first `TOP` of these are its own.
GAP = TOP + max(WIDTHS)
PREFIXES = (3, 4, 5, 7)
#: Where a logit is cut off, and the words scored at a time.
STEEP, BATCH_WORDS = 30.0, 1 << 15
#: Parts of the sample for calibration, texts a step, and by how many standard errors the evidence is lowered.
FOLDS, BATCH, CAUTION = 3, 32, 1.64
#: False alarms that a miss counts as where thresholds are set: left-out scores run low for stems seen in other thirds only.
MISSED = 2


@dataclass
class Model:
    """`columns` holds, per bucket, the embedding times each slice of each filter, by width and position."""

    columns: np.ndarray | None = None
    biases: dict[int, np.ndarray] = field(default_factory=dict)
    out: np.ndarray | None = None
    bias: float = 0.0
    shift: float = 0.0
    cut: float = 0.7
    by_lang: dict[str, float] = field(default_factory=dict)


def bucket_of(word: str) -> list[int]:
    """The buckets of a word: of itself and of its first letters; 0 is kept for no word."""
    return [crc32(word.encode(), 1) % (BUCKETS - 1) + 1, *(crc32(word[:k].encode()) % (BUCKETS - 1) + 1 for k in PREFIXES)]


def word_buckets(texts: list[str]) -> list[np.ndarray]:
    """A row of buckets for each word of each text."""
    known: dict[str, list[int]] = {}
    out = []
    for t in texts:
        words = TOKEN.findall(t.lower())
        for w in words:
            if w not in known:
                known[w] = bucket_of(w)
        out.append(np.array([known[w] for w in words], dtype=np.int32).reshape(-1, 1 + len(PREFIXES)))
    return out


def evidence(ids: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket: a lower bound of its log odds for label 1, not below 0, and how many texts hold it."""
    seen = np.zeros((2, BUCKETS))
    for own, label in zip(ids, y, strict=True):
        seen[int(label), np.unique(own)] += 1
    n = np.bincount(y.astype(int), minlength=2)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    error = np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    return np.where(seen[1] > 0, np.maximum(0, odds - CAUTION * error), 0), seen.sum(0)


class Network:
    """The layers while they are trained."""

    def __init__(self, ids: list[np.ndarray], y: np.ndarray, rng: np.random.Generator):
        odds, texts = evidence(ids, y)
        self.common = texts >= 3  # what few texts have only invites learning by heart
        self.table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32) * self.common[:, None]
        self.table[:, 0] = odds
        self.table[0] = 0
        self.conv = {w: rng.normal(0, np.sqrt(2 / (w * DIM)), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.biases = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.02, (TOP, len(WIDTHS), FILTERS)).astype(np.float32)
        first = WIDTHS[0]
        self.conv[first][:, :, 0], self.conv[first][0, 0, 0], self.out[:, 0, 0] = 0, 1, 0.5
        self.bias, self.state = -1.0, {}

    def model(self, cut: float) -> Model:
        columns = np.concatenate([self.table @ self.conv[w][j] for w in WIDTHS for j in range(w)], axis=1)
        return Model(columns, {w: b.copy() for w, b in self.biases.items()}, self.out.copy(), self.bias, cut=cut)

    def _move(self, name: object, value: np.ndarray, grad: np.ndarray, rate: float) -> None:
        m = self.state.setdefault(name, np.zeros_like(value))
        m *= 0.9
        m += 0.1 * grad * grad
        value -= rate * grad / (np.sqrt(m) + 1e-4)

    def pools(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(buckets, embeddings, largest values, where their windows start) of texts laid end to end with empty
        words between; the last two by text, place among the largest, width and filter."""
        gap = np.zeros((GAP, 1 + len(PREFIXES)), np.int32)
        flat = np.concatenate([part for own in ids for part in (own, gap)])
        ends = np.cumsum([len(own) + GAP for own in ids])
        x = self.table[flat].sum(1)
        z = np.stack([sum(x[j : len(x) - max(WIDTHS) + 1 + j] @ self.conv[w][j] for j in range(w)) + self.biases[w] for w in WIDTHS], axis=1)
        tops = []
        for end, own in zip(ends, ids, strict=True):
            a = end - len(own) - GAP
            tops.append(a + np.argpartition(z[a : a + len(own) + TOP], len(own), axis=0)[len(own) :])
        top = np.stack(tops)
        pool = np.take_along_axis(z[None], top.reshape(1, -1, len(WIDTHS), FILTERS), 1).reshape(top.shape)
        order = np.argsort(pool, axis=1)
        return flat, x, np.maximum(np.take_along_axis(pool, order, 1), 0), np.take_along_axis(top, order, 1)

    def logits(self, ids: list[np.ndarray]) -> np.ndarray:
        parts = [np.tensordot(self.pools(ids[at : at + 64])[2], self.out, 3) for at in range(0, len(ids), 64)]
        return np.concatenate(parts) + self.bias

    def step(self, ids: list[np.ndarray], y: np.ndarray, rate: float, rng: np.random.Generator) -> None:
        """One step on some texts."""
        flat, x, pool, top = self.pools(ids)
        drop = (rng.random(pool.shape) > 0.2) / 0.8
        hidden = pool * drop
        p = 1 / (1 + np.exp(-np.clip(np.tensordot(hidden, self.out, 3) + self.bias, -STEEP, STEEP)))
        d = ((p - y) / len(ids)).astype(np.float32)
        g_pool = (d[:, None, None, None] * self.out * drop * (pool > 0)).astype(np.float32)
        rows, values = [], []
        for k, w in enumerate(WIDTHS):
            g = g_pool[:, :, k]
            g_conv = np.zeros_like(self.conv[w])
            for j in range(w):
                at = top[:, :, k] + j
                g_conv[j] = np.einsum("btfd,btf->df", x[at], g)
                push = self.conv[w][j].T[None, None] * g[..., None]
                rows.append(flat[at].reshape(-1))
                values.append(np.repeat(push.reshape(-1, DIM), flat.shape[1], axis=0))
            self._move(("c", w), self.conv[w], g_conv, rate)
            self._move(("b", w), self.biases[w], g.sum((0, 1)), rate)
        self._move("out", self.out, (np.tensordot(d, hidden, 1) + 1e-4 * self.out).astype(np.float32), rate)
        self.bias -= rate * float(d.sum()) * 10
        touched, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        g = np.zeros((len(touched), DIM), np.float32)
        np.add.at(g, inverse, np.concatenate(values))
        g[~self.common[touched]] = 0
        m = self.state.setdefault("t", np.zeros((BUCKETS, DIM), np.float32))
        m[touched] = 0.9 * m[touched] + 0.1 * g * g
        self.table[touched] -= rate * g / (np.sqrt(m[touched]) + 1e-4)
        self.table[0] = 0


def passes(ids: list[np.ndarray], y: np.ndarray, epochs: int, seed: int) -> Iterator[Network]:
    """The network before training and after each pass: as many rows of either label, drawn again where one is rare."""
    rng = np.random.default_rng(seed)
    network = Network(ids, y, rng)
    yield network
    ones, zeros = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = max(len(ones), min(len(zeros), 2 * len(ones)))
    for epoch in range(epochs):
        order = np.concatenate([rng.choice(ones, n), rng.permutation(zeros)[:n]])
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            network.step([ids[i] for i in batch], y[batch], 0.003 if epoch < epochs * 2 / 3 else 0.001, rng)
        yield network


def fit(texts: list[str], labels: list[int], langs: list[str], cut: float = 0.7, epochs: int = 3, seed: int = 5) -> Model:
    """Train on all rows, for as many passes as do best on the thirds left out (one at least), and calibrate by these."""
    y = np.array(labels, dtype=np.float32)
    if len(set(labels)) < 2:
        return Model(cut=cut)
    ids = word_buckets(texts)
    # Rows of each label are dealt out in the order of their texts' checksums, equal texts together.
    checks = np.array([crc32(t.encode()) for t in texts])
    fold = np.zeros(len(texts), dtype=int)
    for value in (0, 1):
        own = np.flatnonzero(y == value)
        fold[own] = np.unique(checks[own], return_inverse=True)[1] % FOLDS
    logits, loss = np.zeros((epochs + 1, len(texts))), np.zeros(epochs + 1)
    folds = [k for k in range(FOLDS) if len(set(y[fold != k])) == 2 and (fold == k).any()]
    for k in folds:
        held, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        for epoch, network in enumerate(passes([ids[i] for i in rest], y[rest], epochs, seed + k)):
            logits[epoch, held] = network.logits([ids[i] for i in held])
    scored = np.isin(fold, folds)
    if not scored.any():  # a single row of a label
        scored[:] = True
        for epoch, network in enumerate(passes(ids, y, epochs, seed)):
            logits[epoch] = network.logits(ids)
    for epoch in range(epochs + 1):
        z, own = logits[epoch, scored], y[scored]
        z = np.clip(z - _best_cut(z, own), -STEEP, STEEP)
        weight = np.where(own == 1, 1 / max(1, own.sum()), 1 / max(1, (1 - own).sum()))
        loss[epoch] = (weight * np.logaddexp(0, np.where(own == 1, -z, z))).sum()
    best = 1 + int(loss[1:].argmin())
    network = next(n for epoch, n in enumerate(passes(ids, y, epochs, seed)) if epoch == best)
    model = network.model(cut)
    _calibrate(model, logits[best, scored], y[scored], [x for x, s in zip(langs, scored, strict=True) if s])
    return model


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the least cost of errors, in the middle of its gap."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(MISSED * y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    best = np.flatnonzero(errors == errors.min())
    gaps = np.diff(np.concatenate([[z[0] - 2], z, [z[-1] + 2]]))[best]
    return float(edges[best[gaps.argmax()]])


def _calibrate(model: Model, z: np.ndarray, y: np.ndarray, langs: list[str]) -> None:
    target = np.log(model.cut / (1 - model.cut))
    model.shift = target - _best_cut(z, y)
    score = 1 / (1 + np.exp(-np.clip(z + model.shift, -STEEP, STEEP)))
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if y[own].sum() >= 10 and (1 - y[own]).sum() >= 10:
            best = _best_cut(score[own], y[own])
            errors = lambda t: int(((score[own] >= t) != y[own]).sum())  # noqa: B023, E731
            model.by_lang[lang] = min(max(best, 0.05), 0.95) if errors(best) < errors(model.cut) else model.cut


class Scorer:
    """Scores texts with a table of what each word seen adds to every filter, so a text
    costs one row of the table a word."""

    def __init__(self, model: Model, most: int = 150_000):
        self.model, self.most = model, most
        self.columns = sum(WIDTHS) * FILTERS
        self.known: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        # Row 0 is the empty word between texts, so that no window spans two.
        self.table = np.zeros((1024, self.columns), np.float32)

    def _rows(self, text: str) -> list[int]:
        known = self.known
        words = TOKEN.findall(text.lower())
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            first = len(known) + 1
            while first + len(new) > len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            stems = self.stems
            for stem in [x for x in {w[:k] for w in new for k in PREFIXES} if x not in stems]:
                stems[stem] = crc32(stem.encode()) % (BUCKETS - 1) + 1
            whole = np.fromiter((crc32(w.encode(), 1) for w in new), np.int64, len(new)) % (BUCKETS - 1) + 1
            buckets = np.stack([whole, *(np.fromiter((stems[w[:k]] for w in new), np.int64, len(new)) for k in PREFIXES)], axis=1)
            own = self.table[first : first + len(new)]
            np.take(self.model.columns, buckets[:, 0], axis=0, out=own)
            for c in range(1, buckets.shape[1]):
                own += self.model.columns[buckets[:, c]]
            known.update(zip(new, range(first, first + len(new))))
        return [known[w] for w in words]

    def logits(self, texts: list[str]) -> np.ndarray:
        """A logit a text; texts are laid end to end, a bounded number of words at a time.
        A longer text goes in pieces, and the largest values of all of them count."""
        if self.model.out is None:
            return np.full(len(texts), -STEEP)
        pooled = np.full((len(texts), TOP, FILTERS * len(WIDTHS)), -np.inf, np.float32)
        gap, flat = [0] * GAP, []
        pieces: list[tuple[int, int, int]] = []  # (text, its first window, the first beyond its last)
        for i, text in enumerate(texts):
            if len(self.known) > self.most:
                self._pool(pooled, flat, pieces)
                self.known.clear()
                self.stems.clear()
            rows = self._rows(text)
            for at in range(0, max(1, len(rows)), BATCH_WORDS):
                own = min(BATCH_WORDS, len(rows) - at)
                last = at + own == len(rows)
                pieces.append((i, len(flat), len(flat) + own + TOP * last))
                flat += rows[at : at + own] + gap if last else rows[at : at + own + max(WIDTHS)]
                if len(flat) >= BATCH_WORDS:
                    self._pool(pooled, flat, pieces)
        self._pool(pooled, flat, pieces)
        # Row by row, so that a score doesn't depend on what else is in its batch.
        weights = self.model.out.reshape(TOP, -1)
        return np.round((np.maximum(pooled, 0) * weights).sum((1, 2), dtype=np.float64) + self.model.bias, 6)

    def _pool(self, pooled: np.ndarray, flat: list[int], pieces: list[tuple[int, int, int]]) -> None:
        """Keep the largest values of the windows of each piece."""
        if not pieces:
            return
        own, column = self.table[np.array(flat)], 0
        n = len(own) - max(WIDTHS) + 1
        z = np.empty((n, FILTERS * len(WIDTHS)), np.float32)
        for k, w in enumerate(WIDTHS):
            part = z[:, k * FILTERS : (k + 1) * FILTERS]
            part[:] = own[:n, column : column + FILTERS] + self.model.biases[w]
            for j in range(1, w):
                part += own[j : j + n, column + j * FILTERS : column + (j + 1) * FILTERS]
            column += w * FILTERS
        for i, a, b in pieces:
            top = z[a:b]
            if b - a > TOP:
                top = np.partition(top, b - a - TOP, axis=0)[-TOP:]
            pooled[i] = np.sort(np.concatenate([pooled[i], top]), axis=0)[-TOP:]
        flat.clear()
        pieces.clear()

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.model.out is None:
            return np.zeros(len(texts))
        z = self.logits([t or "" for t in texts])
        return 1 / (1 + np.exp(-np.clip(z.astype(float) + self.model.shift, -STEEP, STEEP)))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 1000, max_clean: int = 4000, max_bytes: int = 64_000_000, cut: float = 0.7, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> Model:
    """A model from at most `max_toxic` rows labelled 1 and `max_clean` labelled 0, those whose keys hash lowest,
    whose texts take `max_bytes` in all: beyond that, rows are left out. The keys are picked first, so only the
    texts of these rows are read out."""
    agreed = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
    there = agreed.join(docs.select(key), key, "left_semi").select(key, "label")
    picked = [there.where(F.col("label") == value).orderBy(F.xxhash64(key), key).limit(n) for value, n in ((0, max_clean), (1, max_toxic))]  # the bound on what is trained on
    few = staged(picked[0].unionByName(picked[1]))
    body = F.col(text).cast("string")
    sizes = docs.select(key, F.octet_length(body).alias("bytes")).join(F.broadcast(few), key).groupBy(key).agg(F.max("bytes").alias("bytes"), F.max("label").alias("label"))
    # Rows of label 1 first; a window over few rows.
    before = Window.orderBy(F.desc("label"), F.xxhash64(key), key).rowsBetween(Window.unboundedPreceding, 0)
    fitting = few.join(sizes.withColumn("upto", F.sum(F.coalesce("bytes", F.lit(0))).over(before)).where(F.col("upto") <= max_bytes).select(key), key)
    rows = docs.select(F.col(key), body.alias("text"), F.col(lang).cast("string").alias("lang")).join(F.broadcast(fitting), key)
    sample = rows.groupBy(key).agg(F.min("text").alias("text"), F.min("lang").alias("lang"), F.min("label").alias("label")).toPandas().sort_values(key)
    unstaged(few)
    return fit([t or "" for t in sample["text"]], [int(v) for v in sample["label"]], sample["lang"].tolist(), cut)


def scored(model: Model, text: Column) -> Column:
    """The score of a text column."""
    sent = _sent(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for part in parts:
            yield pd.Series(scorer.scores(part.tolist()))

    return score(text.cast("string"))


def _sent(model: Model):  # noqa: ANN202
    """The model as a broadcast variable: its size depends on the parameters above alone (13 MB)."""
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext.broadcast(model)


def threshold(model: Model, lang: Column) -> Column:
    """The threshold for a row's language; `cut` where none was calibrated."""
    known = [x for k, v in sorted(model.by_lang.items()) for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*known), lang), F.lit(model.cut)) if known else F.lit(model.cut)


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, score, lang_threshold, toxic): `toxic` is the verdict by language."""
    out = docs.select(F.col(key), scored(model, F.col(text)).alias("score"), threshold(model, F.col(lang).cast("string")).alias("lang_threshold"))
    return out.withColumn("toxic", F.col("score") >= F.col("lang_threshold"))


def without_toxic(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of `docs`, with all their columns, that are not judged toxic."""
    return docs.where(scored(model, F.col(text)) < threshold(model, F.col(lang).cast("string")))
