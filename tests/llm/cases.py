"""Small tables that hold the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LINES = "The quick brown fox jumps over the lazy dog near the river bank today.\n"
#: Null and empty texts, white space, ties, repeated rows, near copies, a very long text, a null id and source.
ROWS = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n", None, None),
    (4, LINES * 3, "en", "a"),
    (4, LINES * 3, "en", "a"),
    (5, LINES * 3, "en", "b"),
    (6, "one two three", "en", "b"),
    (7, "one two three", "de", None),
    (8, " ".join(f"w{i}" for i in range(30)), "en", "a"),
    (9, " ".join(f"w{i}" for i in range(31)), "en", "b"),
    (10, "long " + " ".join(f"x{i % 977}y{i}" for i in range(60_000)), "fr", "c"),
    (11, "z" * 200_000, "fr", "c"),
    (None, "no id here", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, shard double, kept string"


def frame(spark, rows=ROWS):
    """The rows as documents, with columns whose names clash with what operators add."""
    return spark.createDataFrame([(i, t, g, s, len(t or ""), 7, "x", 0.5, "?") for i, t, g, s in rows], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(n, edges):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_groups(rows):
    """(shingles, component) by row, rows being (id, text) in order of their ids."""
    sets = [shingles(t) for _, t in rows]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return [len(s) for s in sets], [rows[i][0] for i in components(len(sets), edges)]
