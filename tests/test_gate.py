"""The exclusion gate against one pattern a term."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docprov.functions import gate
from docprov.operators import retrieval

EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def plain(text, terms):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    return [t for t in terms or [] if t is not None and text and re.search(EDGE + re.escape(fold(t)) + EDGE, low)]


CASES = [
    ("That is all", ["that", "IS", "al"]), ("thatched that_x that-y", ["that"]), ("a.b c++ .net x.net", ["c++", ".net", "a.b", "net"]), ("Äpfel äpfel É", ["äpfel", "É", "é", "pfel"]),
    ("über x", ["über", "ber", "x"]), ("", ["a", ""]), (None, ["a"]), ("abc", None), ("abc", []), ("...", [""]), ("a", ["", None, "a", "A", "a"]), ("he she hers", ["he", "hers", "she", "her"]), ("İstanbul K", ["istanbul", "k", "K"]), ("x" * 50_000, ["x" * 50_000, "x"]),
]


@pytest.mark.parametrize(("text", "terms"), CASES)
def test_terms_are_found_as_patterns_find_them(text, terms):
    assert gate.finder(tuple(terms or []))(text) == plain(text, terms)


def test_lists_of_a_thousand_terms_by_row(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 6))).strip() or "a"
    lists = [[word() for _ in range(1000)] for _ in range(3)] + [None, []]
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 80))) if i % 9 else None, lists[i % 5]) for i in range(60)]
    docs = spark.createDataFrame(rows, "id int, content string, sire_excluded array<string>")
    out = {r.id: (r.matches, r.passed) for r in retrieval.excluded(docs).collect()}
    assert out == {i: (plain(t, x), not plain(t, x)) for i, t, x in rows}


def test_texts_are_scanned_once(spark):
    docs = spark.range(5).select("id", F.lit("that is").alias("content"), F.array(F.lit("that")).alias("sire_excluded"))
    for kept in ("passed", "not passed"):
        plan = retrieval.excluded(docs).where(kept)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
