"""Web pages as Markdown, as a source of documents.

A page is read tag by tag; what is open (quotes, lists and their items, tables) tells how the
next block of text is led in. Text in parts that show none (scripts, styles, the head) goes.

Defined results: null and empty pages, and those without visible text, give an error instead
of a text; broken nesting closes what a browser would close; a table in a table's cell
becomes text of that cell; pages are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMPTY = "No extractable text found on page"
SILENT = {"head", "script", "style", "noscript", "template", "title", "svg", "math", "iframe", "object", "select", "textarea", "button"}
ALONE = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
HEADINGS = {f"h{n}": "#" * n for n in range(1, 7)}
BLOCKS = {*HEADINGS, "p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "form", "fieldset", "figure", "figcaption", "address", "details", "summary", "dl", "dt", "dd", "ul", "ol", "li", "blockquote", "pre", "table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "body", "html", "hr"}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "del": "~~", "s": "~~"}


class Page(HTMLParser):
    """A page on its way to Markdown."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, bool]] = []  # text, and whether it stands right below the one before
        self.open: list[str] = []
        self.text: list[str] = []
        self.lists: list[list] = []  # kind and number of each open list; an item not written yet has its mark pending
        self.pending: str | None = None
        self.links: list[tuple[str, int]] = []
        self.rows: list[list[str]] | None = None
        self.tables = 0

    # Blocks

    def _lead(self) -> tuple[str, str]:
        """What goes before the first line of a block, and before the others."""
        first = rest = ""
        for tag in self.open:
            if tag == "blockquote":
                first, rest = first + "> ", rest + "> "
            elif tag == "li":
                first, rest = first + "   ", rest + "   "
        if self.pending is not None:
            first = first[:-3] + f"{self.pending:<3}"
        return first, rest

    def _flush(self, mark: str = "") -> None:
        raw = "".join(self.text)
        self.text, self.links = [], []
        lines = raw.split("\n") if "pre" in self.open else [" ".join(x.split()) for x in raw.split("\0")]
        if "pre" not in self.open:
            lines = [x for x in lines if x]
        if not any(x.strip() for x in lines):
            return
        if self.rows is not None:
            if self.rows and self.rows[-1]:
                self.rows[-1][-1] = " ".join(filter(None, [self.rows[-1][-1], " ".join(x.strip() for x in lines).replace("|", "\\|")]))
            return
        if "pre" in self.open:
            while lines and not lines[0].strip():
                lines.pop(0)
            while lines and not lines[-1].strip():
                lines.pop()
            lines = ["```", *lines, "```"]
        elif mark:
            lines = [f"{mark} {' '.join(lines)}"]
        self._emit(lines)

    def _emit(self, lines: list[str]) -> None:
        first, rest = self._lead()
        tight = self.pending is not None
        self.pending = None
        self.blocks.append(("\n".join((first if n == 0 else rest) + x for n, x in enumerate(lines)).rstrip(), tight))

    def _table(self) -> None:
        rows, self.rows = [r for r in self.rows or [] if any(r)], None
        if rows:
            width = max(map(len, rows))
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            self._emit([lines[0], "|" + " --- |" * width, *lines[1:]])

    # Tags

    def _close(self, tag: str) -> None:
        """Close an element and all that was opened in it."""
        while self.open:
            own = self.open[-1]
            if own in BLOCKS:
                self._flush(HEADINGS.get(own, ""))
            elif own in MARKS and "pre" not in self.open:
                self.text.append(MARKS[own])
            self.open.pop()
            if own in ("ul", "ol") and self.lists:
                self.lists.pop()
            if own == "li":
                self.pending = None
            if own == "table":
                self.tables -= 1
                if not self.tables:
                    self._table()
            if own == tag:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = dict(attrs)
        if tag in ALONE:
            if tag == "br":
                self.text.append("\n" if "pre" in self.open else "\0")
            elif tag == "hr":
                self._flush()
                self._emit(["---"])
            elif tag == "img" and own.get("alt") and not SILENT & set(self.open):
                self.text.append(f"![{own['alt']}]({own.get('src') or ''})")
            return
        if tag in BLOCKS:
            for mark in [x for x in reversed(self.open) if x in MARKS and self.open.index(x) > self.open.index(self._last_block())] if self._last_block() else []:
                self._close(mark)
            if "p" in self.open and self._within("p"):
                self._close("p")
            for same in ("li", "tr", "td", "th", "dt", "dd"):
                if tag == same and self._within(same):
                    self._close(same)
            if tag in ("td", "th"):
                for other in ("td", "th"):
                    if self._within(other):
                        self._close(other)
            if tag not in HEADINGS or not any(h in self.open for h in HEADINGS):
                self._flush(next((HEADINGS[h] for h in reversed(self.open) if h in HEADINGS), ""))
        self.open.append(tag)
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            self.pending = f"{self.lists[-1][1]}." if self.lists and self.lists[-1][0] == "ol" else "-"
        elif tag == "table":
            self.tables += 1
            if self.tables == 1:
                self.rows = []
        elif tag == "tr" and self.tables == 1:
            self.rows.append([])
        elif tag in ("td", "th") and self.tables == 1 and self.rows is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")
        elif tag == "a":
            self.links.append((own.get("href") or "", len(self.text)))
        elif tag in MARKS and "pre" not in self.open:
            self.text.append(MARKS[tag])

    def _last_block(self) -> str:
        return next((x for x in reversed(self.open) if x in BLOCKS), "")

    def _within(self, tag: str) -> bool:
        """Whether an element is open that nothing stands around of what holds others of its kind."""
        for own in reversed(self.open):
            if own == tag:
                return True
            if own in ("ul", "ol", "table", "blockquote", "td", "th") and not (own in ("td", "th") and tag == "tr"):
                return False
        return False

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        if tag == "a" and self.links:
            href, at = self.links.pop()
            inner = " ".join("".join(self.text[at:]).replace("\0", " ").split())
            if inner and href:
                self.text[at:] = [f"[{inner}]({href})"]
        if tag in MARKS and any(x in BLOCKS for x in self.open[len(self.open) - self.open[::-1].index(tag) :]):
            return
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if not SILENT & set(self.open):
            self.text.append(data)

    def done(self) -> str:
        self.close()
        while self.open:
            self._close(self.open[-1])
        self._flush()
        out = ""
        for text, tight in self.blocks:
            out += ("" if not out else "\n" if tight else "\n\n") + text
        return re.sub(r"(\*\*|~~)\s*\1", "", out)


#: An ampersand that begins no character reference with a semicolon.
BARE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)")


def to_markdown(html: str | None, bare_references: bool = True) -> str | None:
    """Markdown of all visible text; None without any. Browsers read some references that lack their semicolon (`&amp`);
    without `bare_references` these stay as they are written."""
    page = Page()
    page.feed((html or "") if bare_references else BARE.sub("&amp;", html or ""))
    return page.done() or None


def documents(pages: DataFrame, key: str = "page_id", html: str = "html", bare_references: bool = True) -> DataFrame:
    """(key, markdown, error) for each page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            told = [to_markdown(h, bare_references) for h in part["html"]]
            yield pd.DataFrame({key: part[key], "markdown": told, "error": [EMPTY if m is None else None for m in told]})

    return pages.select(key, F.col(html).cast("string").alias("html")).mapInPandas(run, f"`{key}` {kind}, markdown string, error string")
