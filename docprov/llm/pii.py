"""Personal data behind disguises, with spans in the source text.

Identifiers are looked for twice: in the text as it is, and in a normalised copy. The copy
comes from a chain of transducers: one drops invisible characters, one maps look-alike letters and
digits to ASCII, one turns runs of spelled digits into digits, and one at/dot disguises into
"@" and ".". Every step records which source characters it consumed, so a
span of the copy maps back to the source exactly. Spans found in the copy are added to
those found in the text, unless they lie within one of them: a disguise in the middle of
an identifier leaves a part that the text's own patterns match, and the whole counts too.
A bare word "at" before undisguised dots ("we met at example.com") is no address.

Defined results: null is the empty text; texts without identifiers have no spans; repeated
rows are scanned alike; work is linear in the length, also for long runs of digits or
letters; an empty table gives an empty result; other columns are dropped. Positions are
code points, ends exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame

from docprov.llm.common import map_columns

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
ANY_DIGIT = re.compile(r"[0-9]")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Look-alikes, spelled digits, and words for the signs of an address.
LOOKALIKE = dict(zip("аеорсухѕіјԁһԛԝвкмнтАВЕКМНОРСТУХЅІЈαοινρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxsijdhqwbkmhtABEKMHOPCTYXSIJaoivptuxABEZHIKMNOPTYX", strict=True))
SIGNS = {"＠": "@", "﹫": "@", "．": ".", "․": ".", "。": ".", "＋": "+", "－": "-", "‐": "-", "‑": "-", "‒": "-", "–": "-", "（": "(", "）": ")", " ": " ", " ": " ", " ": " ", "　": " "}
INVISIBLE = "­​‌‍⁠﻿"
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT, DOT = r"at|arroba|arobase|klammeraffe", r"dot|punkt|point|punto"
COMMON = {"un", "oh", "null"}  # ordinary words too
# End of the fixed values.
DOT_WORDS = set(DOT.split("|"))
TO_SPACE = {ord(c): " " for c in ".,-()[]{}<>"}
# Letters and decimal digits that stand for one of ASCII: by their compatibility form, or by their value.
COMPATIBLE = {c: f for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) in ("Lu", "Ll") and (f := unicodedata.normalize("NFKC", chr(c))).isascii() and len(f) == 1}
DECIMAL = {c: str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd"}
FOLD = COMPATIBLE | DECIMAL | {ord(a): b for a, b in (LOOKALIKE | SIGNS).items()}
HIDDEN = re.compile(f"[{INVISIBLE}]")
_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
_ONE = rf"(?:{_WORD}|[0-9])"
SPELLED = re.compile(rf"(?<![^\W_])(?P<plus>plus[\x20-]+)?(?P<run>{_ONE}(?:[\x20.,-]{{1,3}}{_ONE}){{5,}})(?![^\W_])", re.I)
UNIT = re.compile(_WORD, re.I)
OPEN, CLOSE = r"[\[({<]", r"[\])}>]"
BRACKET_AT = rf"\x20{{0,2}}{OPEN}\x20?(?:{AT}|@)\x20?{CLOSE}\x20{{0,2}}"
BRACKET_DOT = rf"\x20{{0,2}}{OPEN}\x20?(?:{DOT}|\.)\x20?{CLOSE}\x20{{0,2}}"
PLAIN_AT, PLAIN_DOT = rf"\x20(?:{AT})\x20", rf"\x20(?:{DOT})\x20"
_LABEL = r"[A-Za-z0-9-]+"
#: What follows an address's local part: an "at" in any form and labels. A bare word "at" counts only with a disguised dot after it.
TAIL = re.compile(rf"(?:(?P<at>{BRACKET_AT}|@)|(?P<bare>{PLAIN_AT}))(?P<labels>{_LABEL}(?:(?:{BRACKET_DOT}|{PLAIN_DOT}|\.){_LABEL})+)", re.I)
DOTS = re.compile(rf"{BRACKET_DOT}|{PLAIN_DOT}", re.I)
NAME_DOT = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?:{BRACKET_DOT}|{PLAIN_DOT})(?=[A-Za-z0-9._%+-]+(?:{BRACKET_AT}|@|{PLAIN_AT}))", re.I)
IP_DOT = re.compile(rf"(?<=[0-9])(?:{BRACKET_DOT}|{PLAIN_DOT})(?=[0-9])", re.I)
HINT = re.compile(rf"{OPEN}\x20?(?:{AT}|@|{DOT}|\.)\x20?{CLOSE}|\x20(?:{DOT})\x20", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each "@" so that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", at + 1)


def detect(text: str) -> list[tuple[int, int, str]]:
    """Identifiers in a text as it stands."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if not ANY_DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p) <= 3 or len(p.lstrip("0")) <= 3 for p in m.groups()) and all(int(p[-3:]) <= 255 for p in m.groups()):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((*m.span(), "phone"))
    return out


class Mapped:
    """A text with, for each piece, where it came from: pieces copied character by
    character, or replaced as a whole."""

    def __init__(self, text: str):
        self.text, self.starts, self.pieces = text, [0], [(0, len(text), False)]

    def replaced(self, edits: list[tuple[int, int, str]]) -> "Mapped":
        """With spans of the present text, in order and apart, replaced."""
        if not edits:
            return self
        out, at, parts, new = Mapped(""), 0, [], []
        for a, b, s in [*edits, (len(self.text), len(self.text), "")]:
            for lo, hi, src, whole in self._cut(at, a):
                new.append((lo, hi, src, whole))
            parts.append(self.text[at:a])
            if b > a:
                new.append((a, a + len(s), (self.source(a, b)), True))
                parts.append(s)
            at = b
        out.text, out.starts, out.pieces, length = "".join(parts), [], [], 0
        for lo, hi, (sa, sb), whole in new:
            if hi > lo:
                out.starts.append(length)
                out.pieces.append((sa, sb, whole))
                length += hi - lo
        return out

    def _cut(self, a: int, b: int) -> Iterator[tuple[int, int, tuple[int, int], bool]]:
        i = bisect_right(self.starts, a) - 1
        while a < b:
            upto = min(b, self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text))
            sa, sb, whole = self.pieces[i]
            off = a - self.starts[i]
            yield a, upto, ((sa, sb) if whole else (sa + off, sa + off + upto - a)), whole
            a, i = upto, i + 1

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source span of a span of this text."""
        spans = [s for _, _, s, _ in self._cut(a, b)]
        return spans[0][0], spans[-1][1]


def digits_of(run: str) -> str:
    return re.sub(r"[^0-9]", "", UNIT.sub(lambda m: DIGITS[m[0].lower()], run))


def normalised(text: str) -> Mapped | None:
    """The transduced copy; None where no disguise was found."""
    out = Mapped(text)
    if not text.isascii():
        out = out.replaced([(*m.span(), "") for m in HIDDEN.finditer(text)])
        folded = out.text.translate(FOLD)  # one character for one
        if folded != out.text:
            out.text = folded
    words = set(out.text.lower().translate(TO_SPACE).split())  # cheap; the patterns below run where these say that they may match
    spelled = words & DIGITS.keys()
    if spelled and (len(spelled) > 1 or "plus" in words or not spelled <= COMMON):
        out = out.replaced([(*m.span(), "+" * bool(m["plus"]) + digits_of(m["run"])) for m in SPELLED.finditer(out.text) if m["plus"] or UNIT.search(m["run"])])
    if (words & DOT_WORDS or any(c in out.text for c in "[({<")) and HINT.search(out.text):
        edits = [(*m.span(), ".") for m in IP_DOT.finditer(out.text)] + [(*m.span(), ".") for m in NAME_DOT.finditer(out.text)]
        for m in TAIL.finditer(out.text):
            dots = list(DOTS.finditer(m["labels"]))
            if m["bare"] and not dots:
                continue
            edits += [(*m.span("at" if m["at"] else "bare"), "@")] + [(m.start("labels") + d.start(), m.start("labels") + d.end(), ".") for d in dots]
        apart: list[tuple[int, int, str]] = []
        for e in sorted(edits):
            if not apart or e[0] >= apart[-1][1]:
                apart.append(e)
        out = out.replaced(apart)
    return None if out.text == text else out


def identifiers(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(spans of the text as it is, spans added by the normalised copy)."""
    base = detect(text)
    copy = normalised(text)
    added: list[tuple[int, int, str]] = []
    if copy is not None:
        taken = sorted((a, b) for a, b, _ in base)
        starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        for a, b, kind in detect(copy.text):
            lo, hi = copy.source(a, b)
            i = bisect_right(starts, lo)
            if i == 0 or reach[i - 1] < hi:  # in no span of the text
                added.append((lo, hi, kind))
    return base, sorted(set(added))


SPANS = "array<struct<start: int, end: int, kind: string>>"


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base_spans, added_spans) for each row."""
    row = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]

    def run(keys: list, texts: list) -> Iterator[dict[str, list]]:
        found = [identifiers(t or "") for t in texts]
        yield {key: keys, "base_spans": [row(b) for b, _ in found], "added_spans": [row(a) for _, a in found]}

    return map_columns(docs, [key, text], run, f"`{key}` {docs.schema[key].dataType.simpleString()}, base_spans {SPANS}, added_spans {SPANS}")


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with every identifier replaced by its kind in angle brackets."""

    def run(keys: list, texts: list) -> Iterator[dict[str, list]]:
        yield {key: keys, text: [None if t is None else mask(t) for t in texts]}

    return map_columns(docs, [key, text], run, f"`{key}` {docs.schema[key].dataType.simpleString()}, `{text}` string")


def mask(text: str) -> str:
    base, added = identifiers(text)
    out, at = [], 0
    for a, b, kind in sorted(base + added):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]
