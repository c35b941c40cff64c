"""Generated pages of many layouts, with which blocks are main text, to train on."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html import escape

import numpy as np

# How sites name their parts.
MAIN_NAMES = ("content", "post", "entry-content", "article-body", "post-content", "story", "main-content", "text", "page-content", "articleBody", "entry")
PARTS = {
    "ad": ("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner", "adBox"),
    "menu": ("nav", "menu", "navbar", "main-menu", "breadcrumb", "topnav", "navigation"),
    "header": ("header", "masthead", "site-header", "top-banner", "page-header"),
    "footer": ("footer", "site-footer", "copyright", "footer-links", "bottom"),
    "side": ("sidebar", "aside", "side", "widget", "related", "recommended", "most-read"),
    "notice": ("cookie-notice", "cookie", "consent", "gdpr-banner", "notice", "alert", "popup"),
    "form": ("newsletter", "subscribe", "search-form", "login", "signup"),
    "comments": ("comments", "comment-list", "discussion", "respond", "replies", "reader-comments", "comment"),
    "share": ("share", "social", "toolbar", "tags", "pagination", "post-meta"),
}
#: Names that tell of a part while their element holds the whole page or the article.
FRAMES = ("has-{}", "with-{}", "no-{}", "{}-left", "{}-right", "{}-open", "{}-enabled", "content-{}-wrap", "layout-{}", "{}-layout", "is-{}-visible", "category-{}", "{}-page", "page-with-{}", "{}")
SYLLABLES = ("an", "er", "ti", "on", "re", "le", "es", "ou", "st", "be", "ch", "en", "mi", "que", "ung", "ing", "to", "ra", "é", "ü", "ñ", "ai", "ed", "ly", "of", "sh")
# End of the fixed values.


class Writer:
    def __init__(self, rng: np.random.Generator):
        self.rng, self.main = rng, set()
        self.tail = ["", "", "", "%%%", "!!", "|"][rng.integers(6)] if rng.random() < 0.4 else ""

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def one(self, of: tuple) -> str:
        return of[self.rng.integers(len(of))]

    def words(self, n: int) -> list[str]:
        out = ["".join(SYLLABLES[i] for i in self.rng.integers(len(SYLLABLES), size=self.rng.integers(1, 5))) for _ in range(n)]
        return [w + self.tail for w in out] if self.tail else out

    def text(self, least: int, most: int) -> str:
        n = int(np.exp(self.rng.uniform(np.log(least), np.log(most))))
        words = self.words(n)
        for i in range(0, n, max(1, int(self.rng.integers(4, 16)))):
            words[i] = words[i].capitalize()
            if i:
                words[i - 1] += self.one((".", ".", ",", "."))
        return escape(" ".join(words), quote=False) + ("." if self.chance(0.9) else "")

    def sign(self, name: str, tag: str = "") -> str:
        kind = self.one(("class", "class", "id"))
        return f'{tag or "div"} {kind}="{name}"'

    def frame(self) -> str:
        """A name that holds a part's word, beside others."""
        own = [self.one(FRAMES).format(self.one(PARTS[self.one(tuple(PARTS))])) for _ in range(int(self.rng.integers(1, 3)))]
        own += [self.one(MAIN_NAMES + ("wrapper", "page", "container", "site", "row", "inner", "theme-light", "clearfix"))] * self.chance(0.5)
        return " ".join(own[:: -1 if self.chance(0.5) else 1])

    def links(self, n: int, tag: str = "li") -> str:
        rows = "".join(f'<{tag}><a href="/x">{" ".join(self.words(int(self.rng.integers(1, 4))))}</a></{tag}>' for _ in range(n))
        return f"<ul>{rows}</ul>" if tag == "li" else rows

    def wrapped(self, kind: str, semantic: str, inner: str) -> str:
        """A part in its HTML tag, in a named div, or in both."""
        way = self.rng.integers(3) if semantic else 1
        open_tag = (semantic, self.sign(self.one(PARTS[kind])), self.sign(self.one(PARTS[kind]), semantic))[way]
        return f"<{open_tag}>{inner}</{open_tag.split()[0]}>"

    def paragraphs(self, n: int) -> str:
        return "".join(f"<p>{self.text(1, 60)}</p>" for _ in range(n))

    def part(self, kind: str) -> str:
        n = int(self.rng.integers(2, 9))
        if kind == "ad":
            return self.wrapped(kind, "", self.text(2, 30) if self.chance(0.7) else self.paragraphs(1) + self.links(1, "span"))
        if kind == "menu":
            return self.wrapped(kind, "nav", self.links(n) if self.chance(0.8) else self.links(n, "span"))
        if kind == "header":
            return self.wrapped(kind, "header", (f"<h1>{self.text(1, 5)}</h1>" if self.chance(0.4) else f"<a href='/'>{self.text(1, 3)}</a>") + (f"<p>{self.text(2, 10)}</p>" if self.chance(0.4) else "") + (self.links(n) if self.chance(0.4) else ""))
        if kind == "footer":
            return self.wrapped(kind, "footer", f"&copy; {self.text(1, 4)} &middot; {self.text(2, 20)}" if self.chance(0.6) else f"<p>{self.text(3, 30)}</p>" + self.links(n))
        if kind == "side":
            return self.wrapped(kind, "aside", f"<h3>{self.text(1, 4)}</h3>" + (self.links(n) if self.chance(0.6) else self.paragraphs(2)))
        if kind == "notice":
            return self.wrapped(kind, "", f"<p>{self.text(4, 40)}</p>" + ("<button>ok</button>" if self.chance(0.6) else ""))
        if kind == "form":
            return self.wrapped(kind, "form", f"<label>{self.text(1, 4)}</label><input name='q'>" + (f"<p>{self.text(3, 20)}</p>" if self.chance(0.5) else ""))
        if kind == "comments":
            rows = "".join(f'<{self.sign("comment")}><b>{self.text(1, 2)}</b><p>{self.text(2, 60)}</p></div>' for _ in range(int(self.rng.integers(1, 6))))
            return self.wrapped(kind, "section", f"<h3>{self.text(1, 3)}</h3>" + rows)
        return self.wrapped(kind, "", self.links(3, "span"))

    def dated(self) -> str:
        return f"<p>{self.text(1, 12)}</p>" if self.chance(0.3) else ""

    def listed(self) -> str:
        """Lists and folded blocks, short ones too."""
        n, way = int(self.rng.integers(1, 7)), self.rng.integers(6)
        if way == 0:
            return "<ol>" + "".join(f"<li>{self.text(1, 25)}</li>" for _ in range(n)) + "</ol>"
        if way == 1:
            return "<dl>" + "".join(f"<dt>{self.text(1, 3)}</dt><dd>{self.text(1, 25)}</dd>" for _ in range(n)) + "</dl>"
        if way == 2:
            return f"<details><summary>{self.text(1, 5)}</summary>" + "".join(f"<p>{self.text(1, 40)}</p>" for _ in range(n)) + "</details>"
        if way == 3:
            return "".join(f'<p><a href="/{i}">{self.text(1, 25)}</a></p>' for i in range(n))
        if way == 4:
            return "<ul>" + "".join(f'<li><a href="/{i}">{self.text(2, 12)}</a></li>' for i in range(n)) + "</ul>"
        return f"<figure><img src=x><figcaption>{self.text(1, 20)}</figcaption></figure><pre>{self.text(3, 40)}</pre>"

    def article(self) -> str:
        from docprov.llm.html import Page

        blocks = []
        if self.chance(0.8):
            head = f"<h1>{self.text(1, 12)}</h1>"
            blocks.append(f"<header>{head}{self.dated()}</header>" if self.chance(0.25) else head)
        for _ in range(int(np.exp(self.rng.uniform(0, 3)))):
            way = self.rng.random()
            if way < 0.58:
                blocks.append(f"<p>{self.text(1, 120)}</p>")
            elif way < 0.68:
                blocks.append(self.listed())
            elif way < 0.76:
                blocks.append(f"<p><b>{self.text(1, 80)}<br>")
            elif way < 0.82:
                blocks.append(f"<h2>{self.text(1, 6)}</h2>")
            elif way < 0.88:
                blocks.append("<ul>" + "".join(f"<li>{self.text(1, 20)}</li>" for _ in range(3)) + "</ul>")
            elif way < 0.92:
                blocks.append(f"<blockquote>{self.text(3, 40)}</blockquote>")
            elif way < 0.95:
                blocks.append(f"<table><tr><td>{self.text(1, 3)}</td><td>{self.text(1, 3)}</td></tr></table>")
            else:
                blocks.append(f'<p>{self.text(3, 30)} <a href="/y">{self.text(1, 4)}</a> {self.text(2, 20)}</p>')
        self.main |= {t for _, t, _ in Page("".join(blocks)).blocks}
        inside = [self.part(k) for k in ("ad", "share", "form", "side", "notice") if self.chance(0.08)]
        for p in inside:
            blocks.insert(int(self.rng.integers(1, len(blocks) + 1)), p)
        if self.chance(0.12):
            blocks.append(f"<footer>{self.text(1, 20)}</footer>" if self.chance(0.5) else self.part("footer"))
        if self.chance(0.15):
            blocks.append(self.part("comments"))
        return "".join(blocks)

    def bare(self) -> str:
        """A page that is hardly more than text."""
        from docprov.llm.html import Page

        body = self.one(("{}", "<body>{}</body>", "<html><body>{}", "<p>{}", "<pre>{}</pre>", "<div>{}</div>")).format("<br>".join(self.text(5, 120) for _ in range(int(self.rng.integers(1, 4)))))
        self.main |= {t for _, t, _ in Page(body).blocks}
        return body

    def page(self) -> str:
        if self.chance(0.04):
            return self.bare()
        body = self.article()
        way = self.rng.random()
        name = self.one(MAIN_NAMES)
        if self.chance(0.25):
            name = f"{name} {self.frame()}" if self.chance(0.7) else self.frame()
        if way < 0.45:
            body = f"<article>{body}</article>" if self.chance(0.6) else f"<{self.sign(name, 'article')}>{body}</article>"
        elif way < 0.6:
            body = f"<main>{body}</main>" if self.chance(0.5) else f"<main><article>{body}</article></main>"
        elif way < 0.9:
            body = f"<{self.sign(name)}>{body}</div>"
        else:
            body = f"<div>{body}</div>"
        if self.chance(0.2):
            body = f"<{self.sign(self.frame())}>{body}</div>"
        if self.chance(0.05):
            body = f'<form method="post">{body}</form>'
        before = [self.part(k) for k in ("notice", "header", "menu", "ad", "form") if self.chance(0.45)]
        after = [self.part(k) for k in ("share", "comments", "side", "ad", "form", "menu", "footer") if self.chance(0.4)]
        if self.chance(0.25):
            body = f"<div>{body}{self.part('side')}</div>"
            if self.chance(0.4):
                body = f"<{self.sign(self.frame())}>{body}</div>"
        inner = "".join(before) + body + "".join(after)
        if self.chance(0.08):
            inner = f'<form action="/" {self.one(("id", "class"))}="{self.one(("form1", "aspnetForm", "page-form", "search"))}">{inner}</form>'
        if self.chance(0.3):
            inner = f'<div {self.one(("id", "class"))}="{self.one(("wrapper", "page", "container", "site"))}">{inner}</div>'
        if self.chance(0.25):
            inner = f"<{self.sign(self.frame())}>{inner}</div>"
        end = "</body></html>" if self.chance(0.9) else ""
        return f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{inner}{end}"


def labelled_pages(n: int, seed: int) -> Iterator[tuple[str, Callable[[str], bool]]]:
    rng = np.random.default_rng(seed)
    for _ in range(n):
        writer = Writer(rng)
        html = writer.page()
        yield html, writer.main.__contains__
