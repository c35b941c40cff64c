"""Web pages as Markdown."""

import re
from html import unescape

import pytest

from docprov.sources import web

CASES = [
    ("<h1>A  b</h1><p>One <b>two</b> <i>three</i>.<p>Four<br>five", "# A b\n\nOne **two** *three*.\n\nFour\nfive"),
    ("<ul><li>a<li>b<ol><li>c</li><li>d</ol></li><li><p>e</p><p>f</p></ul>", "-  a\n-  b\n   1. c\n   2. d\n-  e\n\n   f"),
    ("<table><tr><th>x<th>y<tr><td>1<td>a|b</table>", "| x | y |\n| --- | --- |\n| 1 | a\\|b |"),
    ("<table><tr><td>out<table><tr><td>in</td></tr></table></td><td>z</td></tr></table>", "| out in | z |\n| --- | --- |"),
    ("<blockquote><p>q</p><ul><li>r</ul></blockquote>s", "> q\n> -  r\n\ns"),
    ("<pre>a\n  b\n</pre><p>use <code>x()</code>", "```\na\n  b\n```\n\nuse `x()`"),
    ('<p><a href="/u">link <b>me</b></a> &amp; <a>none</a><img alt="pic" src="p.png">', "[link **me**](/u) & none![pic](p.png)"),
    ("<head><title>t</title></head><script>var a='<p>x</p>'</script><style>p{}</style>seen", "seen"),
    ("<div>a<div>b</b></i></div></section>c", "a\n\nb\n\nc"),
    ("<h2>Head<p>text", "## Head\n\ntext"),
    ("a<hr>b", "a\n\n---\n\nb"),
]


@pytest.mark.parametrize(("html", "markdown"), CASES)
def test_shapes(html, markdown):
    assert web.to_markdown(html) == markdown


@pytest.mark.parametrize("html", [None, "", "  ", "<script>x</script>", "<p> </p><ul><li></ul>"])
def test_pages_without_text(html):
    assert web.to_markdown(html) is None


def test_deep_and_broken_pages_end():
    assert web.to_markdown("<div>" * 500 + "deep" + "</p>" * 500) == "deep"
    assert "x" in web.to_markdown("<ul><li>" * 60 + "x")
    assert web.to_markdown("<b>" * 300 + "y")


def test_all_visible_words_of_the_given_pages_stay(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    told = {r.page_id: r for r in web.documents(pages).collect()}
    words = lambda s: re.findall(r"\w+", s)
    for r in pages.collect():
        bare = re.sub(r"<head>.*?</head>|<script.*?</script>|<!--.*?-->", " ", r.html, flags=re.S)
        markdown = re.sub(r"\]\([^)]*\)", "]", told[r.page_id].markdown)
        assert words(markdown.replace("_", " ")) == words(unescape(re.sub(r"<[^>]+>", " ", bare)).replace("_", " ")) and told[r.page_id].error is None


def test_references_without_a_semicolon(spark):
    """a heading that ends in `&amp` without its semicolon."""
    html = "<h1>a&amp;&amp</h1><p>b &ampc &lt;x &#38; &#38 &unknown; <a href='/u?a=1'>d</a><script>if (a&&b) {}</script>"
    assert web.to_markdown(html) == "# a&&\n\nb &c <x & & &unknown; [d](/u?a=1)"
    assert web.to_markdown(html, bare_references=False) == "# a&&amp\n\nb &ampc <x & &#38 &unknown; [d](/u?a=1)"


def test_the_query_agrees_with_its_sql_on_such_pages(spark, tmp_path):
    from docprov.plans.ingest_queries import page_markdown
    from docprov.plans.search_queries import SQL
    from tests.compare import connection, difference

    pages = [(1, "<html><head><title>t&amp</title></head><body><h1>One &amp;&amp</h1><p>two &nbsp; three &amp</p><a href=\"/x\">l</a></body></html>")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/raw")
    next((tmp_path / "raw").glob("part-*.parquet")).rename(tmp_path / "pages.parquet")
    assert difference(page_markdown(spark, f"{tmp_path}"), connection(f"{tmp_path}"), SQL["page_markdown"]) == ""
