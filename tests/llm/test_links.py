"""Connected components, the Jaccard join and the range join."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docprov.llm import jaccard, ranges
from docprov.llm.common import table
from docprov.llm.components import connected_components
from tests.llm.cases import ROWS, components, empty, frame, near_groups


@pytest.mark.parametrize("kind", ["path", "star", "random", "loops"])
def test_components(spark, kind):
    rng = random.Random(kind)
    n = 60
    edges = {
        "path": [(i, i + 1) for i in range(n - 1)],
        "star": [(n - 1, i) for i in range(n - 1)],
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(45)],
        "loops": [(3, 3), (5, 5)],
    }[kind]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components(n, edges)
    assert got == {i: want[i] for a, b in edges if a != b for i in (a, b)}


def check_near(docs, **how):
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id is not None), key=lambda r: r[0])
    sizes, groups = near_groups(rows)
    got = [tuple(r) for r in jaccard.near_duplicates(docs, **how).collect() if r.doc_id is not None]
    assert Counter(got) == Counter((i, n, c) for (i, _), n, c in zip(rows, sizes, groups, strict=True))


def test_near_duplicates(spark, sf):
    check_near(table(spark, sf, "documents"))
    check_near(frame(spark, [r for r in ROWS if r[0] != 10]))
    null = [r for r in jaccard.near_duplicates(frame(spark)).collect() if r.doc_id is None]
    assert [(r.n_shingles, r.component_id) for r in null] == [(1, None)]
    assert jaccard.near_duplicates(empty(spark)).collect() == []


def test_thresholds_are_exact(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(base), "en", "a")]
    # Sets of prefixes: n-4 shingles of 396; 317 of 396 reach 80 %, 316 do not.
    rows += [(2, " ".join(base[:321]), "en", "a"), (3, " ".join(base[:320]), "en", "a"), (4, " ".join(base).upper(), "en", "a")]
    check_near(frame(spark, rows))


def edited(rng, base, n):
    words = list(base)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("long_list", "block"), [(128, 1024), (4, 7)])
def test_large_groups_and_shared_passages(spark, monkeypatch, long_list, block):
    """Near copies of two texts, copies of one, and a passage in many unlike documents; with
    small limits, long lists and groups of many blocks carry it."""
    monkeypatch.setattr(jaccard, "LONG_LIST", long_list)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard.links, "__defaults__", (block,))
    rng = random.Random(4)
    words = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    one, two, passage = words(120), words(60), words(60)
    texts = [edited(rng, one, rng.randrange(6)) for _ in range(60)] + [edited(rng, two, rng.randrange(4)) for _ in range(30)]
    texts += [" ".join(one)] * 20 + [" ".join(words(30) + passage + words(30)) for _ in range(40)]
    rng.shuffle(texts)
    check_near(frame(spark, [(100 + i, t, "en", "a") for i, t in enumerate(texts)]))


def test_prefixes_never_miss(monkeypatch):
    """Whatever lengths two sets choose, a pair that reaches 80 % shares enough."""
    rng = np.random.default_rng(2)
    levels = rng.integers(13, 140, jaccard.SKETCH).astype(np.uint8)
    for _ in range(200):
        n = int(rng.integers(1, 90))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = a.copy()
        swap = rng.permutation(len(b))[: int(rng.integers(0, max(1, len(b) // 9) + 1))]
        b[swap] = rng.integers(0, 2**63, len(swap), dtype=np.uint64)
        b = np.unique(b)
        met = len(np.intersect1d(a, b))
        if 100 * met >= 80 * (len(a) + len(b) - met):
            (x, i), (y, j) = (jaccard.prefix(s, levels, float(rng.integers(0, 2000)), 80) for s in (a, b))
            assert len(np.intersect1d(x, y)) >= min(i, j)


def test_without_duplicates(spark, sf):
    for docs in (table(spark, sf, "documents"), frame(spark)):
        out = jaccard.without_duplicates(docs)
        assert out.columns == docs.columns
        firsts = {r.component_id for r in jaccard.near_duplicates(docs).collect()}
        assert Counter(r.doc_id for r in out.collect()) == Counter(firsts)


def test_ids_that_repeat_with_other_texts_lose_nothing(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    near_d = d + " more"
    rows = [(1, c, "en", "a"), (4, a, "en", "a"), (4, b, "en", "a"), (5, b, "en", "b"), (4, near_d, "en", "c"), (9, d, "en", "c"), (4, "", "en", "a"), (4, None, "en", "a"), (4, a, "en", "z")]
    docs = frame(spark, rows)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect())
    assert got == Counter({(1, 36, 1): 1, (4, 36, 4): 3, (5, 36, 4): 1, (4, 37, 4): 1, (9, 36, 4): 1, (4, 0, 4): 2})
    kept = Counter((r.doc_id, r.text or "") for r in jaccard.without_duplicates(docs).collect())
    assert kept == Counter({(1, c): 1, (4, a): 1, (4, b): 1, (4, near_d): 1, (4, ""): 1})


@pytest.mark.parametrize("columns", [64, 4096])
def test_overlaps_are_exact_and_small(monkeypatch, columns):
    monkeypatch.setattr(jaccard, "COLUMNS", columns)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 900, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(1, 900)), replace=False), rng.integers(0, 2**63, 50, dtype=np.uint64)])) for _ in range(30)]
    sets += [np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))] * 2
    met = jaccard.overlaps(sets)
    assert all(met[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(len(sets)) for j in range(i + 1, len(sets)))


def test_words_are_hashed_as_they_are_split():
    """Many texts at once: white space of all kinds, texts that begin and end anywhere, words longer than the table."""
    rng = random.Random(6)
    spaces = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  "]
    words = ["a", "A", "ab", "é", "É", "\x1c", "\x85x", "\xa0", "w" * 63, "w" * 64, "w" * 65, "W" * 65, "v" * 65 + "a", "v" * 65 + "b", "\0", "a\0"]
    texts = [None, "", " ", "\n\n", "a", " a", "a "] + ["".join(rng.choice(words) + rng.choice(spaces) for _ in range(rng.randrange(14))).strip(rng.choice(spaces)) for _ in range(400)]
    sets = list(jaccard.Shingles().each(pa.array(texts).slice(1)))
    hashes = {}
    for text, own in zip(texts[1:], sets, strict=True):
        found = text.encode().lower().split()
        width = min(5, len(found))
        want = {tuple(found[i : i + width]) for i in range(len(found) - width + 1)} if found else set()
        assert len(own) == len(want) and (own[1:] > own[:-1]).all()
        assert np.array_equal(own, jaccard.Shingles().of(text))
        hashes.setdefault(frozenset(want), own.tobytes())
        assert hashes[frozenset(want)] == own.tobytes()
    assert len(set(hashes.values())) == len(hashes)


@pytest.mark.parametrize("blocks", [1, 2])
def test_near_copies_of_each_other_are_not_all_compared(blocks):
    """The same components as all pairs give, from about one comparison a set and stranger."""
    rng = np.random.default_rng(8)
    for k in (60, 240):
        base = rng.integers(0, 2**63, 100, dtype=np.uint64)
        sets = []
        for _ in range(k):
            own = base.copy()
            own[rng.permutation(100)[:4]] = rng.integers(0, 2**63, 4, dtype=np.uint64)
            sets.append(np.unique(own))
        sets.append(np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64)))
        block = np.arange(k + 1) % blocks
        roots, pairs = jaccard.forest(sets, 80, np.arange(k + 1), block)
        assert roots.tolist() == [0] * k + [k]
        assert pairs <= 3 * k


def test_lists_hold_what_several_prefixes_hold(spark, monkeypatch):
    """However few entries a bucket takes."""
    rng = np.random.default_rng(9)
    rows = [(i, 50 + i, 1 + i % 3, [int(x) for x in np.unique(rng.integers(-(2**62), 2**62, 6))] + [int(x) for x in rng.choice(60, 5, replace=False)]) for i in range(80)]
    holders = Counter(x for *_, prefix in rows for x in prefix)
    least = {x: min(r[0] for r in rows if x in r[3]) for x in holders}
    want = Counter((x, c, n, s, at, holders[x], least[x]) for c, n, s, prefix in rows for at, x in enumerate(prefix) if holders[x] > 1)
    reps = spark.createDataFrame(rows, "cls long, n long, shared int, prefix array<long>").repartition(3)
    for bucket in (16, jaccard.BUCKET):
        monkeypatch.setattr(jaccard, "BUCKET", bucket)
        got = jaccard.shared_lists(reps).select("token", "cls", "n", "shared", "place", "holders", "least")
        assert Counter(map(tuple, got.collect())) == want
    assert jaccard.shared_lists(reps.where("cls < 0")).collect() == []


def plain_links(rows, cosine=0.98):
    unit = {}
    for i, (_, label, v) in enumerate(rows):
        if label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x = np.array(v, dtype=float)
            unit[i] = x / np.linalg.norm(x)
    edges = [(i, j) for i in unit for j in unit if j < i and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine]
    degree = Counter(x for e in edges for x in e)
    part = components(len(rows), edges)
    return Counter((r[0], degree[i], rows[part[i]][0], rows[part[i]][0] == r[0]) for i, r in enumerate(rows))


def vectors(spark, rows):
    return spark.createDataFrame([(i, label, v, 1, "x") for i, label, v in rows], "vec_id long, label int, embedding array<float>, n_links int, cell string").repartition(3)


def clustered_vectors():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 6))
    rows = []
    for i in range(200):
        v = centres[rng.integers(12)] + rng.normal(size=6) * rng.choice([0.05, 0.15, 0.4])
        rows.append((i, int(rng.integers(2)), np.float32(v * rng.choice([1, 3])).tolist()))
    return rows + [(200 + i, 0, rows[3][2]) for i in range(15)]


@pytest.mark.parametrize("small", [0, 32_000_000])
def test_range_join(spark, monkeypatch, small):
    """Cells of cells, blocks of cells, and pivots that go to all tasks or along with the vectors."""
    for name, value in {"CELL": 20, "SAMPLE": 40, "BLOCK": 5, "STREAM": 3, "SENDING": 0.0, "SAVING": 0.01, "SMALL_BYTES": small, "SHARE": 16}.items():
        monkeypatch.setattr(ranges, name, value)
    rows = clustered_vectors()
    assert sum(n for (_, n, _, _), k in plain_links(rows).items()) > 100
    assert Counter(map(tuple, ranges.near_duplicates(vectors(spark, rows)).collect())) == plain_links(rows)
    spread = ranges.cells(ranges.classes_of(ranges.keyed(vectors(spark, rows), "vec_id", "label", "embedding")), 0.2)
    depth = [r.cell.count(".") for r in spread.collect()]
    assert max(depth) >= 2 and min(depth) >= 1


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_pivots_partition_the_table(spark, sf_dir):
    """At least 8 cells, each with vectors of its own, and every vector in fewer than two on average."""
    classes = ranges.classes_of(ranges.keyed(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")).cache()
    spread = ranges.cells(classes, 0.2 + 1e-6).cache()
    assert spread.where("native").select(*ranges.PLACE).distinct().count() >= 8
    assert spread.where("native").count() == classes.count()
    assert spread.count() < 2 * classes.count()


def test_clusters_part_without_loss(spark):
    """Vectors in clusters apart from each other: hardly one is sent to a second cell."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    rows = [(i, 1, np.float32(centres[i % 40] + rng.normal(size=24) * 0.04).tolist()) for i in range(800)]
    spread = ranges.cells(ranges.classes_of(ranges.keyed(vectors(spark, rows), "vec_id", "label", "embedding")), 0.2)
    assert spread.select("cell").distinct().count() > 2 and spread.count() < 1.3 * len(rows)
    assert Counter(map(tuple, ranges.near_duplicates(vectors(spark, rows)).collect())) == plain_links(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, None), (1, 1, []), (2, 1, [0.0, 0.0]), (3, 1, [1.0, None]), (4, 1, [nan, 1.0]), (5, 1, [inf, 1.0]), (6, None, [1.0, 1.0]), (7, 1, [1.0, 1.0]), (8, 1, [2.0, 2.0]), (9, 2, [1.0, 1.0]), (10, 1, [1.0, 1.0, 0.0]), (11, 1, [-0.0, 3.0]), (12, 1, [0.0, 3.0]), (13, 1, [1e30, 1e30]), (14, 1, [1e-30, 1e-30]), (None, 1, [1.0, 1.0]), (15, 1, [3.0, 1.0]), (15, 1, [3.0, 1.0])]
    out = ranges.near_duplicates(vectors(spark, rows)).collect()
    assert Counter(tuple(r) for r in out if r.vec_id is not None) == plain_links([r for r in rows if r[0] is not None])
    assert [(r.n_links, r.component_id, r.kept) for r in out if r.vec_id is None] == [(0, None, False)]
    assert ranges.near_duplicates(vectors(spark, rows).limit(0)).collect() == []


def test_embeddings(spark, sf):
    rows = [(r.vec_id, r.label, r.embedding) for r in table(spark, sf, "embeddings").orderBy("vec_id").collect()]
    assert Counter(map(tuple, ranges.near_duplicates(table(spark, sf, "embeddings")).collect())) == plain_links(rows)
