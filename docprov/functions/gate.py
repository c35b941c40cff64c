"""The exclusion gate: a row passes unless its content names a term it must exclude.

Terms are found as whole words of ASCII letters, digits and underscores, whatever the case
of A to Z. All terms of a row are looked for in one pass over its text, by an automaton that
is made once for each list of terms a task meets; `matches` does so for Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_CHARACTER = re.compile(r"[A-Za-z0-9_]")
#: Automata a task keeps.
KEPT = 64


def _lowered(text: str) -> str:
    """A to Z in lower case, all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _edge(text: str, at: int) -> bool:
    """Whether a word begins or ends just before a place."""
    before = at > 0 and WORD_CHARACTER.match(text[at - 1]) is not None
    return before != (at < len(text) and WORD_CHARACTER.match(text[at]) is not None)


@lru_cache(maxsize=KEPT)
def finder(terms: tuple[str | None, ...]) -> Callable[[str | None], list[str]]:
    """A function from a text to the terms found in it, in the order of the list."""
    import ahocorasick

    automaton, by_word = ahocorasick.Automaton(), {}
    for no, t in enumerate(terms):
        if t:
            by_word.setdefault(_lowered(t), []).append(no)
    for word, places in by_word.items():
        automaton.add_word(word, (len(word), places))
    if by_word:
        automaton.make_automaton()
    bare = [no for no, t in enumerate(terms) if t == ""]

    def find(text: str | None) -> list[str]:
        if not text:
            return []
        found: set[int] = set()
        if by_word:
            low = _lowered(text)
            for end, (size, places) in automaton.iter(low):
                if places[0] not in found and _edge(low, end + 1 - size) and _edge(low, end + 1):
                    found.update(places)
                    if len(found) == sum(map(len, by_word.values())):
                        break
        if bare and WORD_CHARACTER.search(text):  # an empty term stands at any edge of a word
            found.update(bare)
        return [terms[no] for no in sorted(found)]

    return find


@F.pandas_udf(T.ArrayType(T.StringType()))
def _matches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for content, terms in batches:
        yield pd.Series([finder(tuple(own))(text) if own is not None else [] for text, own in zip(content, terms, strict=True)], dtype=object)


#: Not to be worked out again where a filter on it could be pushed below.
_once = _matches.asNondeterministic()


def matches(content: Column, terms: Column) -> Column:
    """The terms found as whole words, in their order, whatever their case; empty if none or null."""
    return _once(content, terms)


def first_match(content: Column, terms: Column) -> Column:
    return F.get(matches(content, terms), F.lit(0))
