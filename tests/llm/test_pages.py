"""Main text of pages whose wrappers carry misleading names, and of layouts that the training pages can't have."""

import random

import pyarrow.parquet as pq
import pytest

from docprov.llm import html

P = "<p>The bridge over the river was closed on Monday, the council said, after engineers found cracks in two of its pillars.</p>"
NAV = '<nav><a href="/">Home</a> <a href="/n">News</a></nav>'
FOOT = "<footer>&copy; 2020 Example. All rights reserved.</footer>"


@pytest.fixture(scope="module")
def trees():
    return html.trained()


@pytest.fixture(scope="module")
def given(trees):
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    return pages, html.main_texts(pages, trees)


@pytest.mark.parametrize("names", ["has-sidebar", "comments-open", "search-enabled", "menu-open no-ads", "cookie-notice-active", "page-template footer-fixed", "single-post with-sidebar sidebar-left", "newsletter popup-visible"])
def test_classes_of_the_body_change_nothing(trees, given, names):
    pages, texts = given
    assert html.main_texts([p.replace("<body>", f'<body class="{names}">') for p in pages], trees) == texts


@pytest.mark.parametrize("frame", ['div class="content-sidebar-wrap"', 'div id="page" class="sidebar-left"', 'form action="/"', 'div class="has-sidebar"', 'div id="comments-page"', 'div class="layout-menu-left search-enabled"'])
@pytest.mark.parametrize("around", ["article", "body"])
def test_frames_change_nothing(trees, given, frame, around):
    pages, texts = given
    end = f"</{frame.split()[0]}>"
    swap = (("<article>", f"<{frame}><article>"), ("</article>", f"</article>{end}")) if around == "article" else (("<body>", f"<body><{frame}>"), ("</body>", f"{end}</body>"))
    got = html.main_texts([p.replace(*swap[0]).replace(*swap[1]) for p in pages], trees)
    assert sum(a == b for a, b in zip(got, texts, strict=True)) >= 0.99 * len(pages)


def test_classes_of_the_article_change_nothing(trees, given):
    pages, texts = given
    got = html.main_texts([p.replace("<article>", '<article class="post category-ads">') for p in pages], trees)
    assert sum(a == b for a, b in zip(got, texts, strict=True)) >= 0.99 * len(pages)


@pytest.mark.parametrize(
    ("page", "kept", "dropped"),
    [
        ("Just a text without any tag. It goes on, for two sentences.", ["Just a text", "two sentences."], []),
        (f"{NAV}<article><h1>Guides</h1>{P * 2}" + "".join(f'<p><a href="/{i}">The guide number {i} to bridges</a></p>' for i in range(6)) + f"{P}</article>{FOOT}", [f"guide number {i}" for i in range(6)], ["Home", "rights"]),
        (f"{NAV}<article><h1>How to</h1>{P}<ol><li>Open the door.</li><li>Go in.</li></ol>{P}</article>{FOOT}", ["Open the door.", "Go in."], ["Home", "rights"]),
        (f"{NAV}<article><h1>Terms</h1>{P}<dl><dt>Pier</dt><dd>A pillar.</dd><dt>Deck</dt><dd>The road.</dd></dl></article>{FOOT}", ["Pier", "A pillar.", "Deck", "The road."], ["Home", "rights"]),
        (f"{NAV}<article><h1>Why</h1>{P}<details><summary>More</summary><p>There is more to tell of it.</p></details>{P}</article>{FOOT}", ["More", "There is more"], ["Home", "rights"]),
        (f"{NAV}<article><header><h1>The closed bridge</h1></header>{P * 3}<footer>Posted in news</footer></article>{FOOT}", ["The closed bridge"], ["Posted in", "Home"]),
        (f'<form id="form1">{NAV}<div id="content"><h1>Title here</h1>{P * 3}</div>{FOOT}</form>', ["Title here", "cracks"], ["Home", "rights"]),
        (f'<div class="content-sidebar-wrap">{NAV}<main class="content"><article class="post"><h1>Title here</h1>{P * 4}</article></main><aside class="sidebar"><h3>Related</h3><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></aside></div>{FOOT}', ["Title here", "cracks"], ["Related", "One", "rights"]),
        (f'<div id="page" class="comments-open">{NAV}<div class="post"><h1>Title here</h1>{P * 4}</div><div id="comments"><h3>3 comments</h3><div class="comment"><p>I disagree with this wholly, said nobody.</p></div></div></div>{FOOT}', ["Title here", "cracks"], ["disagree", "Home"]),
        (f'{NAV}<form><article><h1>Title here</h1>{P * 2}</article></form><form class="search"><label>Find</label><p>Type what you want to find here.</p></form>{FOOT}', ["cracks"], ["Type what", "Home"]),
    ],
)
def test_parts_of_articles_stay_and_others_go(trees, page, kept, dropped):
    text = html.main_text(page, trees)
    assert [k for k in kept if k not in text] == [] and [d for d in dropped if d in text] == []


def layouts(n):
    """(html, texts of the article): prose of plain words in the shapes of common site builders."""
    rng = random.Random(5)
    words = "the council bridge river engineers closed traffic report morning pillars water city plan opened after two before weeks budget was is of and in on a for repair north side".split()

    def prose(a, b):
        out = " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))
        return out.capitalize() + "."

    for _ in range(n):
        main = [prose(3, 8), *[prose(12, 60) for _ in range(rng.randint(3, 9))]]
        body = [f"<h1 class='entry-title'>{main[0]}</h1>", *[rng.choice(("<p>{}</p>", "<p>{}</p>", "<p class='wp-block-paragraph'>{}</p>", "<p><span>{}</span></p>", "<blockquote><p>{}</p></blockquote>")).format(t) for t in main[1:]]]
        side = "".join(f"<li><a href='/p{i}'>{prose(2, 5)}</a></li>" for i in range(rng.randint(3, 7)))
        nav = "".join(f"<li class='menu-item'><a href='/{w}'>{w}</a></li>" for w in rng.sample(words, 5))
        comments = "".join(f"<li class='comment depth-1'><cite>{rng.choice(words)}</cite><p>{prose(4, 25)}</p></li>" for _ in range(rng.randint(1, 4)))
        shape, inner = rng.randrange(4), "".join(body)
        if shape == 0:
            page = f"<body class='single single-post has-sidebar wp-embed-responsive'><div id='page' class='site'><header id='masthead' class='site-header'><p class='site-title'><a href='/'>{prose(1, 3)}</a></p><nav><ul>{nav}</ul></nav></header><div id='content' class='site-content'><main><article id='post-7' class='post type-post category-ads tag-menu'><div class='entry-content'>{inner}</div></article><section id='comments' class='comments-area'><h2>{prose(2, 4)}</h2><ol>{comments}</ol></section></main><aside class='widget-area sidebar'><h3>{prose(1, 3)}</h3><ul>{side}</ul></aside></div><footer class='site-footer'>{prose(3, 8)}</footer></div></body>"
        elif shape == 1:
            page = f"<body class='page-sidebar-left'><form method='post' id='aspnetForm'><div class='top-nav'><ul>{nav}</ul></div><table class='layout'><tr><td class='sidebar'><ul>{side}</ul></td><td class='main-content'>{inner}</td></tr></table><div class='footer'>{prose(3, 8)}</div></form></body>"
        elif shape == 2:
            page = f"<body class='theme-dark cookie-bar-visible'><div class='cookie-bar'><p>{prose(8, 20)}</p><button>OK</button></div><div class='page-with-menu'><div class='menu'><ul>{nav}</ul></div><div class='story-body'>{inner}<div class='ad-slot'>{prose(4, 10)}</div></div><div class='related'><ul>{side}</ul></div></div></body>"
        else:
            page = f"<body><div class='sidebar-wrapper no-footer'><nav><ul>{nav}</ul></nav><article>{inner}</article><div class='newsletter'><p>{prose(5, 12)}</p><input></div></div><footer><p>{prose(3, 8)}</p></footer></body>"
        yield f"<!DOCTYPE html><html><head><title>t</title></head>{page}</html>", set(main)


def test_layouts_of_another_make(trees):
    right = total = 0
    for page, main in layouts(200):
        own = html.Page(page)
        kept = html.decode(own, trees.logit(html.features(own)))
        right += sum(k == (t in main) for k, (_, t, _) in zip(kept, own.blocks, strict=True))
        total += len(kept)
    assert right >= 0.98 * total
