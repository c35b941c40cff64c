"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree; each node a row of features: its tag and attribute tokens, depth,
the density of text, links and tags in its subtree, and where it stands among its
siblings. Boosted trees, trained in numpy on generated pages of many layouts, give each
block the odds of being main text. Decoding runs from the root down and takes, for every
node, the better of "keep all below", "drop all below" and "let the children decide", so
no kept block lies under a dropped ancestor and none is dropped under a kept one.

Defined results: null and empty html give an empty text; broken nesting is closed as
browsers do for common tags; a page without blocks gives its loose text, if judged main;
repeated rows are extracted alike; pages of any length are read whole, in time linear in
their length; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
from pyspark.sql import DataFrame

from docprov.llm.common import map_columns

# What HTML's tags do.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "select", "option", "button"}
UNPARSED = {"script", "style", "textarea", "title", "iframe"}
SILENT = RAW | {"head", "audio", "video", "map"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FOREIGN = {"svg", "math"}
WRAPS = {"div", "section", "span", "center", "font"}
SCOPES = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "aside", "nav", "body", "html", "blockquote"}
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "dl", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "nav", "header", "footer", "aside", "form", "a", "body", "html", "span", "b")
TOKENS = ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "copyright", "sidebar", "side", "widget", "related", "recommended", "cookie", "consent", "notice", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "login", "search", "form", "comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "share", "social", "toolbar", "pagination", "pager", "tags", "meta", "article", "content", "post", "entry", "story", "main", "body", "text", "page")
# End of the fixed values.
#: One comment, one tag or one run of text at a time. Quotes count only right after "=", and an unquoted value ends at white space.
VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)"""
PIECE = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]|(?>=\s*{VALUE}?))*+)>|<[!?/][^>]*>|(?P<text>[^<]+|<(?![A-Za-z/!?]))", re.S)
ATTR = re.compile(rf"([^\s=/]+)(?:\s*=\s*({VALUE}))?")
TELLING = re.compile("class|id|role", re.I)
PART = re.compile(r"[A-Za-z]+")
TAG_NO, TOKEN_NO = {t: i for i, t in enumerate(TAGS)}, {t: i for i, t in enumerate(TOKENS)}
GOOD = {"article", "content", "post", "entry", "story", "main", "body", "text", "page"}


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset
    order: int


class Page:
    """Nodes in page order, the root first, and blocks of text: (node, raw text)."""

    def __init__(self, html: str):
        self.nodes = [Node("#root", -1, 0, frozenset(), 0)]
        self.blocks: list[tuple[int, str, bool]] = []
        self._open, self._text, self._links, self._link_depth, self._silent = [0], [], 0, 0, 0
        # Positions in _open: by tag, of scopes, of elements that are not inline, of drawings and formulas.
        self._at: dict[str, list[int]] = {}
        self._scopes, self._solid, self._foreign = [0], [0], []
        self.link_chars: list[int] = []
        self._read(html)

    def _flush(self) -> None:
        raw = "".join(self._text)
        text = " ".join(raw.split())
        if text:
            self.blocks.append((self._block(), text, False))
            self.link_chars.append(min(self._links, len(text)))
        self._text, self._links = [], 0

    def _block(self) -> int:
        """The innermost open element that is a block."""
        return self._open[self._solid[-1]]

    def _close(self, upto: int) -> None:
        """Close all open elements from position `upto` on."""
        for no in self._open[upto:]:
            tag = self.nodes[no].tag
            self._link_depth -= tag == "a"
            self._silent -= tag in SILENT
            self._at[tag].pop()
        if self._solid[-1] >= upto:
            self._flush()
        for places in (self._scopes, self._solid):
            while places[-1] >= upto:
                places.pop()
        while self._foreign and self._foreign[-1] >= upto:
            # What a drawing or formula is made of says nothing of the page; no text lies in it.
            del self.nodes[self._open[self._foreign.pop()] + 1 :]
        del self._open[upto:]

    def _start(self, tag: str, attrs: str) -> None:
        nodes = self.nodes
        if tag in ENDS_P or tag in ENDS:
            ends = ENDS.get(tag, {"p"})
            at = max((self._at[t][-1] for t in ends if self._at.get(t)), default=0)
            if at > self._scopes[-1]:
                self._close(at)
        if tag not in INLINE:
            self._flush()
        if tag in VOID:
            if tag == "br":
                self._text.append(" ")
            return
        # What names the whole document (a theme's classes on its body) says nothing of a part.
        tokens = frozenset() if tag in ("body", "html") else frozenset(w for m in ATTR.finditer(attrs) if m[2] and m[1].lower() in ("class", "id", "role") for w in _parts(m[2])) if "=" in attrs and TELLING.search(attrs) else frozenset()
        parent = self._open[-1]
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, tokens, len(self.blocks)))
        place = len(self._open)
        self._open.append(len(nodes) - 1)
        self._at.setdefault(tag, []).append(place)
        if tag not in INLINE:
            self._solid.append(place)
        if tag in SCOPES:
            self._scopes.append(place)
        if tag in FOREIGN:
            self._foreign.append(place)
        self._link_depth += tag == "a"
        self._silent += tag in SILENT

    def _end(self, tag: str) -> None:
        places = self._at.get(tag)
        if places and not (tag in INLINE and self._scopes[-1] > places[-1]):
            self._close(places[-1])

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = PIECE.match(html, at)
            if m is None:  # an unclosed tag: the rest is not text
                break
            at = m.end()
            if m["text"] is not None:
                if not self._silent:
                    text = unescape(m["text"]) if "&" in m["text"] else m["text"]
                    self._text.append(text)
                    if self._link_depth:
                        self._links += len(text.strip())
            elif m["tag"]:
                tag = m["tag"].lower()
                # Only drawings and formulas have elements without content; "/" on inline ones is taken so too.
                alone = m["attrs"].endswith("/") and (tag in INLINE or tag in FOREIGN or bool(self._foreign))
                if m["end"]:
                    self._end(tag)
                elif tag in UNPARSED and not alone:
                    close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                    at = close.end() if close else n
                else:
                    self._start(tag, m["attrs"])
                    if alone and tag not in VOID:
                        self._end(tag)
        self._close(1)
        self._flush()


def _parts(value: str) -> list[str]:
    return [w for w in re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower().replace("'", "").replace('"', "").replace("_", "-").replace("-", " ").split() for w in PART.findall(w)]


def wrappers(page: Page) -> list[bool]:
    """Whether each node is a nameless element that holds one other and no text of its own."""
    kids, own = [0] * len(page.nodes), [False] * len(page.nodes)
    for x in page.nodes[1:]:
        kids[x.parent] += 1
    for no, _, _ in page.blocks:
        own[no] = True
    return [x.tag in WRAPS and not x.tokens and k == 1 and not t for x, k, t in zip(page.nodes, kids, own, strict=True)]


ABOVE = {"nav": 3, "footer": 3, "aside": 3, "form": 3, "header": 2, "article": 1, "main": 1}
#: A named part that holds more of the page's text than this is told apart from a narrow one: it may be a frame around all.
WIDE = 0.5


def features(page: Page) -> np.ndarray:
    """A row a node. Subtree sums come from one pass from the last node to the first, what lies above from one back.
    Elements that only wrap one other count neither as depth nor as tags."""
    nodes, n = page.nodes, len(page.nodes)
    chars, links, blocks, commas, under, kids, place, inside = ([0] * n for _ in range(8))
    for (no, text, _), linked in zip(page.blocks, page.link_chars, strict=True):
        chars[no] += len(text)
        links[no] += linked
        blocks[no] += 1
        commas[no] += text.count(",") + text.count(".")
    own, parent, wraps = list(chars), [x.parent for x in nodes], wrappers(page)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        blocks[p] += blocks[i]
        commas[p] += commas[i]
        under[p] += under[i] + (not wraps[i])
    tag, token = [TAG_NO.get(x.tag, len(TAGS)) for x in nodes], [-1] * n
    bad, good, bad_above, bad_around, good_above, tag_above, depth = ([0] * n for _ in range(7))
    share, limit = [2.0] * n, WIDE * chars[0]
    for i, x in enumerate(nodes):
        if x.tokens:
            known = x.tokens & TOKEN_NO.keys()
            good[i] = len(known & GOOD)
            bad[i] = len(known) - good[i]
            # The first of the telling names, else the last of the others.
            token[i] = min((TOKEN_NO[t] for t in known - GOOD), default=max((TOKEN_NO[t] for t in known), default=-1))
        if i:
            p = parent[i]
            place[i] = kids[p]
            kids[p] += 1
            depth[i] = depth[p] + (not wraps[i])
            narrow = chars[p] <= limit
            bad_above[i] = bad_above[p] + bad[p] * narrow
            bad_around[i] = bad_around[p] + bad[p] * (not narrow)
            good_above[i] = good_above[p] + good[p]
            kind = ABOVE.get(nodes[p].tag, 0)
            kind = 1 if kind == 2 and inside[p] else kind if kind == 1 or narrow else 0
            tag_above[i] = max(kind, tag_above[p])
            inside[i] = inside[p] or ABOVE.get(nodes[p].tag, 0) == 1
            share[i] = share[p]
        if bad[i]:
            share[i] = chars[i] / max(chars[0], 1)
    up = np.maximum(np.array(parent), 0)
    chars_, kids_, under_, token_, tag_, place_ = (np.array(v, dtype=float) for v in (chars, kids, under, token, tag, place))
    safe, kin = np.maximum(chars_, 1), np.maximum(kids_[up], 1)
    return np.column_stack([
        tag_, token_, bad, good, bad_above, bad_around, good_above, tag_above, [ABOVE.get(x.tag, 0) > 1 for x in nodes], inside, share,
        depth, np.log1p(chars_), np.array(links) / safe, np.log1p(under_), chars_ / (under_ + 1), np.array(commas) / safe,
        chars_ / safe[0], chars_ / np.maximum(chars_[up], 1), np.log1p(own), place_, place_ / kin, kin, kids_, np.log1p(blocks), tag_[up],
        token_[up], np.array([x.order for x in nodes]) / max(1, len(page.blocks)),
    ])


@dataclass
class Trees:
    """Boosted trees of one depth: split features and thresholds by level, leaf values."""

    column: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for column, cut, leaf in zip(self.column, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (x[rows, column[at]] > cut[at])
            out += leaf[at - len(column)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32) -> Trees:
    """Logistic gradient boosting on binned features, second-order gains."""
    cuts = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, bins + 1)[1:-1])) for c in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(cuts[c], x[:, c], side="left") for c in range(x.shape[1])])
    base = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    z, inner = np.full(len(y), base), 2**depth - 1
    columns, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        column, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            split = np.full(width, bins + 1)
            for c in range(x.shape[1]):
                cell = (at - first) * (bins + 1) + binned[:, c]
                gs = np.bincount(cell, g, width * (bins + 1)).reshape(width, -1)
                hs = np.bincount(cell, h, width * (bins + 1)).reshape(width, -1)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                ga, ha = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                gain = gain[:, : len(cuts[c])]
                if not gain.shape[1]:
                    continue
                top = gain.argmax(1)
                value = gain[range(width), top]
                new = value > best + 1e-9
                best[new] = value[new]
                column[first : first + width][new] = c
                split[new] = top[new]
                cut[first : first + width][new] = cuts[c][top[new]]
            right = binned[np.arange(len(y)), column[at]] > split[at - first]
            at = 2 * at + 1 + right
        leaf_no = at - inner
        leaf = rate * np.bincount(leaf_no, g, 2**depth) / (np.bincount(leaf_no, h, 2**depth) + 1)
        z += leaf[leaf_no]
        columns.append(column)
        thresholds.append(cut)
        leaves.append(leaf)
    return Trees(np.array(columns), np.array(thresholds), np.array(leaves), base)


DROP, KEEP, MIXED = 0, 1, 2


def decode(page: Page, logit: np.ndarray) -> list[bool]:
    """Whether each block is kept. A node's gain from keeping is the sum over its own text
    of the odds for it, weighted by its length; the best of all, nothing and by-child wins,
    with a small price for letting children decide."""
    n, odds, wraps = len(page.nodes), np.clip(logit, -6, 6).tolist(), wrappers(page)
    keep, own, children = [0] * n, [0.0] * n, [0.0] * n
    for no, text, _ in page.blocks:
        own[no] += math.sqrt(len(text)) * odds[no]
    total = list(own)
    for i in range(n - 1, -1, -1):
        if (total[i] or children[i]) and not wraps[i]:
            total[i] += 4 * odds[i]
        mixed = children[i] + max(own[i], 0.0) - 0.5
        best = max(total[i], 0.0, mixed)
        keep[i] = KEEP if 0 < total[i] >= best else (DROP if mixed < best or mixed <= 0 else MIXED)
        if i:
            p = page.nodes[i].parent
            total[p] += total[i]
            children[p] += best
    state = keep[:1] + [MIXED] * (n - 1)
    for i in range(1, n):
        above = state[page.nodes[i].parent]
        state[i] = keep[i] if above == MIXED else above
    return [state[no] == KEEP or (state[no] == MIXED and own[no] > 0) for no, _, _ in page.blocks]


_MODEL: dict[int, Trees] = {}


def trained(pages: int = 600, seed: int = 11) -> Trees:
    """Trees for generated pages; made once a process."""
    from docprov.llm.html_layouts import labelled_pages

    if seed not in _MODEL:
        xs, ys = [], []
        for html, main in labelled_pages(pages, seed):
            page = Page(html)
            y = np.full(len(page.nodes), np.nan)
            # A node is main if most text below it is.
            good, all_ = np.zeros(len(page.nodes)), np.zeros(len(page.nodes))
            for no, text, _ in page.blocks:
                all_[no] += len(text)
                good[no] += len(text) * main(text)
            for i in range(len(page.nodes) - 1, 0, -1):
                p = page.nodes[i].parent
                good[p] += good[i]
                all_[p] += all_[i]
            some = all_ > 0
            y[some] = good[some] / all_[some] > 0.9
            xs.append(features(page)[some])
            ys.append(y[some])
        _MODEL[seed] = boost(np.concatenate(xs), np.concatenate(ys))
    return _MODEL[seed]


def main_text(html: str | None, model: Trees) -> str:
    return main_texts([html], model)[0]


def main_texts(htmls: list[str | None], model: Trees) -> list[str]:
    pages = [Page(h or "") for h in htmls]
    rows = [features(p) for p in pages]
    logits = model.logit(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for page, own in zip(pages, rows, strict=True):
        kept = decode(page, logits[at : at + len(own)])
        at += len(own)
        out.append(" ".join(text for (_, text, _), k in zip(page.blocks, kept, strict=True) if k))
    return out


def extract(pages: DataFrame, model: Trees | None = None, key: str = "page_id", html: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, *carry, text, n_chars) for each page."""
    trees = model or trained()
    keys = [key, *carry]

    def run(*columns: list) -> Iterator[dict[str, list]]:
        texts: list[str] = []
        for at in range(0, len(columns[-1]), 128):
            texts += main_texts(columns[-1][at : at + 128], trees)
        yield dict(zip(keys, columns, strict=False)) | {"text": texts, "n_chars": [len(t) for t in texts]}

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keys)
    return map_columns(pages, [*keys, html], run, f"{kinds}, text string, n_chars long")
