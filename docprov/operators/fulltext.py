"""Full-text search: weighted lexeme positions, web-style queries, matching and cover-density rank.

Lexemes come from lower-cased words by the row's language: stop words go but keep their
place, English words lose their endings by the Porter2 algorithm, German, French and Spanish
ones by those of `stems`, words of other languages stay as they are. Titles weigh A,
contents B; contents follow titles in the count of places. A query is read as English
whatever the row's language, unless it says otherwise. Rows are narrowed by a test that
needs no lexemes before words are taken apart, and only the places of the query's lexemes
leave the Python workers.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprov.functions import stems

# English stop words, endings and exceptions of the Porter2 algorithm, weights of A and B, the last place counted.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by "
    "for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
BEGINNINGS = ("gener", "commun", "arsen")
DOUBLES, LI = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
KEPT = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
WEIGHT_A, WEIGHT_B, LAST_PLACE = 1.0, 0.4, 16383
# End of the fixed values.
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
VOWELS = "aeiouy"
AFTER, VOWEL, TWO = re.compile(f"[{VOWELS}][^{VOWELS}]"), re.compile(f"[{VOWELS}]"), re.compile(f"[{VOWELS}].")
SHORT = re.compile(rf"(?:^[{VOWELS}][^{VOWELS}]|[^{VOWELS}][{VOWELS}][^{VOWELS}wxY])\Z")
CONSONANT_Y, POSSESSIVE = re.compile(r"(?<=[aeiouy])y|\Ay"), re.compile(r"'(?:s'?)?\Z")
#: Endings of each step, the longest first.
ENDINGS1, ENDINGS2, ENDINGS3, ENDINGS4 = (tuple(sorted(x, key=len, reverse=True)) for x in (("eedly", "ingly", "edly", "eed", "ing", "ed"), (*STEP2, "ogi", "li"), (*STEP3, "ative"), (*STEP4, "ion")))
#: Ends one of which every word has that a step may change, but for those with an apostrophe.
CHANGED = tuple(e for own in [{"s", "ies", "ied", "y", "e", "ll", *ENDINGS1, *ENDINGS2, *ENDINGS3, *ENDINGS4}] for e in sorted(own) if not any(e != x and e.endswith(x) for x in own))
#: Places that a worker holds before it hands them on, but for a single row.
HELD = 1 << 16


def _after(word: str, start: int) -> int:
    """Where the part begins that follows the first consonant behind a vowel."""
    m = AFTER.search(word, start)
    return m.end() if m else len(word)


def _ending(word: str, endings: tuple[str, ...]) -> str:
    """The longest ending of a word."""
    return next(e for e in endings if word.endswith(e)) if word.endswith(endings) else ""


def _short(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    return bool(SHORT.search(word))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The Porter2 stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    if not word.endswith(CHANGED) and "'" not in word:
        return word
    w = CONSONANT_Y.sub("Y", word.lstrip("'")) if "y" in word else word.lstrip("'")
    w = POSSESSIVE.sub("", w) if "'" in w else w
    first = next(len(p) for p in BEGINNINGS if w.startswith(p)) if w.startswith(BEGINNINGS) else _after(w, 0)
    second = _after(w, first)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and TWO.search(w[:-1]):
        w = w[:-1]
    if w in KEPT:
        return w
    ending = _ending(w, ENDINGS1)
    if ending in ("eedly", "eed"):
        w = w[: -len(ending)] + "ee" if len(w) - len(ending) >= first else w
    elif ending and VOWEL.search(w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif _short(w) and first >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    ending = _ending(w, ENDINGS2)
    if ending and len(w) - len(ending) >= first:
        base = w[: -len(ending)]
        if ending == "ogi":
            w = base + "og" if base.endswith("l") else w
        elif ending == "li":
            w = base if base and base[-1] in LI else w
        else:
            w = base + STEP2[ending]
    ending = _ending(w, ENDINGS3)
    if ending and len(w) - len(ending) >= first:
        if ending != "ative":
            w = w[: -len(ending)] + STEP3[ending]
        elif len(w) - len(ending) >= second:
            w = w[: -len(ending)]
    ending = _ending(w, ENDINGS4)
    if ending and len(w) - len(ending) >= second and (ending != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(ending)]
    if w.endswith("e"):
        at = len(w) - 1
        w = w[:-1] if at >= second or (at >= first and not _short(w[:-1])) else w
    elif w.endswith("l") and len(w) - 1 >= second and w.endswith("ll"):
        w = w[:-1]
    return w.lower()


def lexeme(word: str, language: str) -> str | None:
    """The lexeme of a lower-case word; None for a stop word."""
    if language == "english":
        return None if word in STOP else stem(word)
    if language in stems.STEMMERS:
        return None if word in stems.STOP[language] else stems.STEMMERS[language](word)
    return word


def places(title: str | None, content: str | None, language: str) -> list[tuple[str, int, str]]:
    """(lexeme, place, weight) of title and content; places of the content follow those of the title's last lexeme."""
    out, before = [], 0
    for text, weight in ((title, "A"), (content, "B")):
        last = before
        for n, m in enumerate(WORD.finditer((text or "").lower()), 1):
            own = lexeme(m[0], language)
            if own is not None:
                last = min(before + n, LAST_PLACE)
                out.append((own, last, weight))
        before = last
    return out


@dataclass(frozen=True)
class Phrase:
    """Lexemes that have to follow each other, each so many places after the first."""

    lexemes: tuple[str, ...]
    steps: tuple[int, ...]
    wanted: bool = True


def websearch(query: str | None, language: str = "english") -> list[list[Phrase]]:
    """Groups of phrases: a text matches if it meets all phrases of some group. Quotes hold a phrase, a hyphen in
    front excludes, OR parts groups; everything else is and. Without lexemes there is no group, and no text matches."""
    groups: list[list[Phrase]] = [[]]
    for sign, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query or ""):
        if plain.lower() == "or" and not sign:
            groups.append([])
            continue
        found = [(lexeme(m[0], language), n) for n, m in enumerate(WORD.finditer((quoted or plain).lower()))]
        kept = [(x, n) for x, n in found if x is not None]
        if kept:
            groups[-1].append(Phrase(tuple(x for x, _ in kept), tuple(n - kept[0][1] for _, n in kept), sign != "-"))
    return [g for g in groups if g]


Places = dict[str, list[tuple[int, float]]]


def _starts(own: Places, phrase: Phrase) -> list[int]:
    """Places where a phrase begins."""
    at = [{p for p, _ in own.get(x, ())} for x in phrase.lexemes]
    return sorted(p for p in at[0] if all(p + d in places for d, places in zip(phrase.steps, at, strict=True)))


def matches(own: Places, query: list[list[Phrase]]) -> bool:
    """Whether places by lexeme satisfy the query."""
    return any(all(bool(_starts(own, p)) == p.wanted for p in group) for group in query)


def rank(own: Places, query: list[list[Phrase]]) -> float:
    """Cover density: each shortest stretch that satisfies the query adds the mean weight of the query's lexemes in it
    (harmonic), divided by one more than the other words in it; r becomes r / (r + 1). Linear in the places."""
    words = {x for g in query for p in g if p.wanted for x in p.lexemes}
    # Entries of one place count once, under the first of their lexemes.
    entries = {place: weight for place, _, weight in sorted(((place, x, weight) for x in words for place, weight in own.get(x, ())), reverse=True)}
    at = sorted(entries)
    groups = [[(starts, p.steps[-1]) for p in g if p.wanted for starts in (_starts(own, p),)] for g in query if any(p.wanted for p in g)]
    # Where the first stretch ends that begins at each place or after it: all phrases of some group lie in it.
    ends, after = [0] * len(at), [[len(starts) for starts, _ in g] for g in groups]
    for i in range(len(at) - 1, -1, -1):
        best = math.inf
        for group, next_ in zip(groups, after, strict=True):
            end = 0
            for k, (starts, length) in enumerate(group):
                while next_[k] and starts[next_[k] - 1] >= at[i]:
                    next_[k] -= 1
                end = max(end, starts[next_[k]] + length if next_[k] < len(starts) else math.inf)
            best = min(best, end)
        ends[i] = best
    inverse = [0.0, *itertools.accumulate(1 / entries[p] for p in at)]
    total, i, j = 0.0, 0, 0
    while i < len(at) and ends[i] < math.inf:
        j = max(j, i)
        while at[j] < ends[i]:
            j += 1
        while i < j and ends[i + 1] <= at[j]:
            i += 1
        inside = j - i + 1
        total += inside / (inverse[j + 1] - inverse[i]) / (1 + (at[j] - at[i]) - (inside - 1))
        i += 1
    return total / (total + 1)


@lru_cache(maxsize=10_000)
def beginnings(own: str) -> tuple[str, ...]:
    """Letters with one of which every word of a lexeme begins: a stem keeps the beginning of its words, but for a last i
    from a y, and for the words that have stems of their own."""
    return tuple(dict.fromkeys([own[: max(1, min(3, len(own) - 1))], *(w for w, x in SPECIAL.items() if x == own)]))


def may_match(text: Column, query: list[list[Phrase]], language: str = "english") -> Column:
    """Whether a text may match, told without lexemes: of English queries only, as other stems change letters within."""
    low, out = F.lower(text), F.lit(language != "english")
    for group in query:
        own = F.lit(True)
        for phrase in group:
            for x in phrase.lexemes if phrase.wanted else ():
                own &= functools.reduce(Column.__or__, [F.contains(low, F.lit(b)) for b in beginnings(x)])
        out |= own
    return out


def vectors(rows: DataFrame, content: str = "content", title: str | None = None, language: Column | None = None, key: str = "id") -> DataFrame:
    """(key, lexemes): the weighted places of each row's lexemes, an array of (lexeme, place, weight)."""
    own = rows.select(F.col(key), (F.col(title) if title else F.lit(None)).cast("string").alias("title"), F.col(content).cast("string").alias("content"), (F.lit("english") if language is None else language).alias("language"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, words, at, weights, first = [0], [], [], [], 0

            def written(upto: int) -> pa.RecordBatch:
                inner = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(at, pa.int32()), pa.array(weights, pa.string())], ["lexeme", "place", "weight"])
                return pa.RecordBatch.from_arrays([batch.column(0).slice(first, upto - first), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)], names=[key, "lexemes"])  # noqa: B023

            for n in range(batch.num_rows):
                for x, place, weight in places(*(c[n].as_py() for c in batch.columns[1:])):
                    words.append(x)
                    at.append(place)
                    weights.append(weight)
                ends.append(len(words))
                if len(words) >= HELD:
                    yield written(n + 1)
                    ends, words, at, weights, first = [0], [], [], [], n + 1
            if first < batch.num_rows:
                yield written(batch.num_rows)

    return own.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, lexemes array<struct<lexeme: string, place: int, weight: string>>")


def search(rows: DataFrame, query: str | None, content: str = "content", title: str | None = None, language: Column | None = None, key: str = "id", query_language: str = "english") -> DataFrame:
    """(key, text_score) of the rows that match a web-style query; none for a blank one."""
    asked = websearch(query, query_language)
    kind = rows.schema[key].dataType.simpleString()
    body = F.concat_ws("\n", *[F.col(c).cast("string") for c in (title, content) if c])
    own = rows.select(F.col(key), (F.col(title) if title else F.lit(None)).cast("string").alias("title"), F.col(content).cast("string").alias("content"), (F.lit("english") if language is None else language).alias("language"), may_match(body, asked, query_language).alias("may")).where("may")
    wanted = {x for g in asked for p in g for x in p.lexemes}
    weights = {"A": WEIGHT_A, "B": WEIGHT_B}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            keys, scores = [], []
            for k, a, b, c in zip(part[key], part["title"], part["content"], part["language"], strict=True):
                at: dict[str, list[tuple[int, float]]] = {}
                for x, n, w in places(a, b, c):
                    if x in wanted:
                        at.setdefault(x, []).append((n, weights[w]))
                if matches(at, asked):
                    keys.append(k)
                    scores.append(rank(at, asked))
            yield pd.DataFrame({key: keys, "text_score": scores})

    return own.drop("may").mapInPandas(run, f"`{key}` {kind}, text_score double")
