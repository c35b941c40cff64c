"""Sum-of-squares packing, ranked lexical search, and vector code compression."""

import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docprov.llm import annular, queries, squares, wand
from docprov.llm.common import table
from docprov.llm.sql import SQL
from tests.compare import connection, difference
from tests.llm.cases import ROWS, empty, frame

SMALL = "/root/testdata/sf0.001"


# Sum-of-squares packing


@pytest.fixture(scope="module")
def truth():
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: [*own.encode(text or "", add_special_tokens=False).ids, 0]


ODD = [
    "", " ", "don't DON'T 'tis o'clock", "a<|endoftext|>b <|startoftext|>", "x_y __ 1st 2.5 ½ ² Ⅷ", "Straße ŉ İstanbul ǅ ª µ", "café ́x é́", "語 日本語。", "Σας ΣΑΣ", "a b c\x1cd\x85e",
    "(hello) [World]! {x}~ ~~~ ... -- `code`", "a/b:c;d e-mail@x.org", "\x00\x01 a\x00b", "😀 a😀b", "ﬁ Ǆ ǆ", "|a| <b> a|", "z" * 300,
]


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_tokenizer(truth, text):
    assert squares.tokenizer()(text).tolist() == truth(text)


def test_ids_of_every_plain_letter_and_mark(truth):
    letters = [chr(c) for c in range(0x21, 0x250)]
    for text in [*(f"x{c}y" for c in letters), *(f"{c}word" for c in letters), *(f"WORD{c}" for c in letters), *(f".{c}," for c in letters)]:
        assert squares.tokenizer()(text).tolist() == truth(text), text


def test_remembered_runs_are_bounded(monkeypatch):
    monkeypatch.setattr(squares, "REMEMBERED", 10)
    own = squares.Ids(public_tokenizers.path("word_bpe_49k.json"))
    for i in range(20):
        own(" ".join(f"w{chr(97 + i)}{chr(97 + k)}" for k in range(8)))
        assert len(own.runs) <= 18 and len(own.words) <= 19


def slowest(lengths, capacity):
    """The same rule, with every sum of squares worked out anew."""
    gaps, used, left = [], 0, sum(lengths)
    for s in sorted(lengths, reverse=True):
        def squared(g, s=s):
            after = list(gaps)
            if g is not None:
                after.remove(g)
            after.append((capacity if g is None else g) - s)
            return sum(n * n for gap, n in Counter(after).items() if gap)

        fits = sorted({g for g in gaps if g >= s})
        room = sum(gaps)
        pick = min(fits, key=lambda g: (squared(g), g)) if fits else None
        if pick is None or (left > room and squared(None) < squared(pick)):
            used, pick = used + 1, None
        else:
            gaps.remove(pick)
        if (pick or capacity) - s:
            gaps.append((pick or capacity) - s)
        left -= s
    return used, sorted(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_each_place_has_the_least_sum_of_squares(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 41, 150)
    sequence, offset = squares.assign(lengths, 40)
    fill = defaultdict(list)
    for s, o, n in zip(sequence, offset, lengths, strict=True):
        fill[s].append((o, n))
    for placed in fill.values():
        at = 0
        for o, n in sorted(placed):
            assert o == at
            at += n
        assert at <= 40
    used, gaps = slowest(lengths.tolist(), 40)
    assert len(fill) == used
    assert sorted(g for g in (40 - sum(n for _, n in x) for x in fill.values()) if g) == gaps


def check_pieces(rows, docs, truth, capacity):
    """docs: (id, text) in any order, repeats included."""
    want = Counter()
    for key, text in docs:
        ids = np.array(truth(text), "<u4")
        for no, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[key, no, at, len(part), crc32(part.tobytes())] += 1
    assert Counter((r[0], r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_the_registered_packing_row_by_row(spark, truth):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    rows = queries.op11_squares(spark, SMALL).collect()
    used = check_pieces(rows, docs, truth, squares.CAPACITY)
    assert used <= 1.02 * math.ceil(sum(r.length for r in rows) / squares.CAPACITY) + 1


def test_odd_rows_are_packed_and_groups_are_bounded(spark, truth):
    rows = [*ROWS, *[(None, "", None, None)] * 40, *[(7, "same text", "en", "a")] * 40]
    out = squares.pack(squares.pieces(frame(spark, rows), 64), 64, payload=("ids_crc32", "ids"), group_rows=16).collect()
    groups = Counter(r.sequence_id >> 32 for r in out)
    assert len(groups) > 4 and max(groups.values()) < 0.2 * len(out)
    assert all(len(r.ids) == r.length and crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)
    whole = squares.best_fit(frame(spark, rows), with_ids=False).collect()
    check_pieces(whole, [(i, t) for i, t, *_ in rows], truth, squares.CAPACITY)
    assert squares.best_fit(empty(spark)).count() == 0


# Ranked lexical search


def found_plainly(docs, items, most=50):
    """Rows (item, rank, doc, score) by the contract's formulas, one document after the other."""
    upper = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    own = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in upper.findall(t or "")]
    held = [(k, Counter(own(t))) for k, t in docs]
    held = [(k, c, sum(c.values())) for k, c in held if c]
    n_docs, words = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for k, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(own(text)) if t in c)
            if s > 0:
                scores.append((-s, k is None, k or 0, k))
        for rank, (s, _, _, k) in enumerate(sorted(scores)[:most], 1):
            out[item, rank, k, -s] += 1
    return out


def test_the_registered_search_equals_its_sql(spark):
    assert difference(queries.op12_wand(spark, SMALL), connection(SMALL), SQL["op12_wand"]) == ""


@pytest.mark.parametrize("shard_rows", [1, 3, 64])
def test_search_document_by_document(spark, shard_rows):
    rng = np.random.default_rng(shard_rows)
    words = ["The", "the", "naïve", "E1", "x", "straße", "語", "Ünder", "a_b", *[f"t{i}" for i in range(40)]]
    docs = [(int(i) if i % 17 else None, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(90)]
    docs += [(3, "the the naïve"), (3, "the the naïve"), (200, None), (201, ""), (202, "--- !!"), (203, "t1 " * 3000)]
    items = [(1, "The NAÏVE naïve t1"), (2, "nowhere"), (3, None), (4, ""), (1, "t3 t4 t5 t6"), (None, "the x e1"), (6, " ".join(words))]
    corpus = spark.createDataFrame([(i, t, 5, "s") for i, t in docs], "doc_id long, text string, score int, shard string").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = wand.search(wand.index(corpus, shard_rows=shard_rows), asked, most=5)
    assert Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == found_plainly(docs, items, 5)


def test_search_of_empty_tables(spark):
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert wand.search(wand.index(empty(spark)), asked).count() == 0
    assert wand.search(wand.index(frame(spark)), asked.limit(0)).count() == 0


def test_queries_are_taken_in_blocks(spark, monkeypatch):
    docs, items = [(i, f"w{i % 7} w{i % 3}") for i in range(30)], [(i, f"w{i}") for i in range(9)]
    monkeypatch.setattr(wand, "QUERIES", 4)
    corpus, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = wand.search(wand.index(corpus), asked, most=3)
    assert Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == found_plainly(docs, items, 3)


@pytest.mark.parametrize("seed", range(4))
def test_block_boundaries_cost_least(seed):
    rng = np.random.default_rng(seed)
    x, price = rng.integers(1, 100, 24).astype(float), 40.0
    least = [0.0]
    for j in range(1, len(x) + 1):
        least.append(min(least[i] + x[i:j].max() * (j - i) - x[i:j].sum() + price for i in range(j)))
    padded = np.zeros((2, 30))
    padded[0, :24], padded[1, :7] = x, x[:7]
    for row, n in zip(wand.cuts(padded, np.array([24, 7]), price), (24, 7), strict=True):
        begin = np.flatnonzero(row[:n])
        cost = sum(x[a:b].max() * (b - a) - x[a:b].sum() + price for a, b in zip(begin, [*begin[1:], n], strict=True))
        assert begin[0] == 0 and not row[n:].any() and cost == pytest.approx(least[n])


def test_blocks_are_of_varying_length_and_about_the_mean():
    rng = np.random.default_rng(0)
    counts = np.array([3, 900, 40, 2000, 8, 9])
    values = np.where(rng.random(counts.sum()) < 0.05, 90_000, 20_000) + rng.integers(0, 5000, counts.sum())
    starts = np.cumsum(counts) - counts
    begins = np.flatnonzero(wand.blocks(values, starts, counts))
    assert set(starts) <= set(begins)
    sizes = np.diff(np.append(begins, counts.sum()))
    assert sizes.max() <= wand.WIDEST and len(set(sizes)) > 5 and 8 <= sizes.mean() <= 2 * wand.MEAN


def test_search_skips_blocks_and_finds_the_best():
    rng = np.random.default_rng(1)
    size, lists, weights = 8192, [], [900, 2000, 9000]
    full = np.zeros(size, np.int64)
    for density, w in zip((0.9, 0.3, 0.004), weights, strict=True):
        docs = np.flatnonzero(rng.random(size) < density)
        told = (docs // 512) % 5 == 2  # stretches of documents that say more of it
        values = np.where(told, rng.integers(500_000, 900_000, len(docs)), rng.integers(50_000, 100_000, len(docs)))
        begins = np.flatnonzero(wand.blocks(values, np.array([0]), np.array([len(docs)])))
        lists.append((docs, values, begins, np.maximum.reduceat(values, begins)))
        full[docs] += w * values
    opened = []
    got = wand.best(lists, weights, size, 10, opened)
    order = np.lexsort((np.arange(size), -full))[:10]
    assert got == [(int(i), int(full[i])) for i in order]
    assert sum(n for n, _ in opened) < 0.6 * opened[0][1]


# Vector code compression


def compressed_plainly(rows, scale=4096, parts=8, entries=16, rounds=6):
    """(id, code, error) by comparing everything with everything, in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    n = len(kept[0][1])
    kept = [(i, q) for i, q in kept if len(q) == n]
    d, books = n // parts, []
    cut = lambda q, p: q[p * d : (p + 1) * d]
    books = [[cut(q, p) for _, q in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda q, p: min(range(len(books[p])), key=lambda e: (far(cut(q, p), books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = defaultdict(list)
            for _, q in kept:
                groups[near(q, p)].append(cut(q, p))
            new.append([[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if groups[e] else books[p][e] for e in range(len(books[p]))])
        books = new
    return Counter((i, "".join(f"{near(q, p):02x}" for p in range(parts)), sum(far(cut(q, p), books[p][near(q, p)]) for p in range(parts))) for i, q in kept)


def test_the_registered_compression_equals_its_sql(spark):
    assert difference(queries.op13_annular(spark, SMALL), connection(SMALL), SQL["op13_annular"]) == ""


def test_nearest_is_exact_and_prunes():
    rng = np.random.default_rng(0)
    for spread in (3, 400, 1 << 33):
        book = rng.integers(-spread, spread, (16, 8)) * rng.integers(1, 9, (16, 1))
        book[5] = book[3]
        x = np.concatenate([rng.integers(-2 * spread, 2 * spread, (300, 8)), book, np.zeros((1, 8), np.int64)])
        index, distance, met = annular.nearest(x, book)
        every = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(2)
        assert index.tolist() == every.argmin(1).tolist() and distance.tolist() == every.min(1).tolist()
        assert met < 16 * len(x)


VECTORS = "vec_id long, embedding array<double>, label string, error string, code int, key int, q string"


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i % 37), rng.normal(0, 0.2, 16).tolist(), "a" if i % 3 else None) for i in range(60)]
    rows += [(None, [0.5] * 16, "b"), (1, None, "a"), (2, [], "a"), (3, [float("nan")] * 16, "a"), (4, [None, *[0.1] * 15], "a"), (5, [float("inf")] * 16, "a"), (100, [0.0] * 16, "b"), (101, [0.1] * 8, "b")]
    rows += [rows[0], rows[0]]
    out = annular.compressed(spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], VECTORS).repartition(3)).collect()
    assert Counter((r.vec_id, r.code, r.error) for r in out) == compressed_plainly([r[:2] for r in rows])
    assert len({r.codebooks_sha256 for r in out}) == 1
    assert len({r.label_error for r in out}) == 3 and sum({r.label_error for r in out}) == sum(r.error for r in out)


def test_few_empty_and_uneven_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    few = [(3, [0.25] * 8, 1), (1, [-0.5] * 8, None)]
    assert Counter((r.vec_id, r.code, r.error) for r in annular.compressed(spark.createDataFrame(few, kind)).collect()) == compressed_plainly([r[:2] for r in few])
    assert annular.compressed(spark.createDataFrame([], kind)).count() == 0
    assert annular.compressed(spark.createDataFrame([(1, [0.5] * 9, 1)], kind)).count() == 0
    huge = annular.compressed(spark.createDataFrame([(i, [float(i) * 1e30] * 8, 1) for i in range(20)], kind)).collect()
    assert len(huge) == 20 and all(0 <= r.error <= annular.LARGEST for r in huge)
