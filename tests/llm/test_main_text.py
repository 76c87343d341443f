"""Main text extraction on hand-made pages and, without article marks, on the given ones."""

import re
from html import unescape

import pytest

from tallyframe.llm.main_text import extract_main_text

LONG = "This is the first part of a story that was told by the sea, and it is not yet at its end. "
PAGE = """<!DOCTYPE html><html><head><title>The title of it</title><style>p{}</style></head>
<body class="has-sidebar no-header"><header><h2>The Daily</h2><p>%(long)s%(long)s%(long)s</p></header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies and you have to accept that. %(long)s</div>
<article><header class="article-header"><h1>On <b>the</b> sea&nbsp;&amp; land</h1></header>
<p>%(long)s%(long)s
<p>Short.</p>
<div class="ad">%(long)s</div>
<p>Two<br>lines, and   a <a href="x">link</a>.</p><script>var t="</p><p>no";</script>
<form><p>%(long)s</p><select><option>no</select></form>
<p hidden>%(long)s</p>
<ul><li>first<li>second</ul>
<section id="comments"><article><p>%(long)s</p></article></section>
<p>The end &lt;here&gt; &#233;&#x41;</p></article>
<aside>%(long)s%(long)s%(long)s</aside><footer>&copy; all of it</footer></body></html>""" % {"long": LONG}


def extract(spark, *pages):
    rows = list(enumerate(pages))
    df = spark.createDataFrame(rows, "page_id long, html string")
    return [r for r in extract_main_text(df).orderBy("page_id").collect()]


def test_article_without_clutter(spark):
    (row,) = extract(spark, PAGE)
    assert row.text.split("\n") == [
        "On the sea & land",
        (LONG + LONG).strip(),
        "Short.",
        "Two lines, and a link.",
        "first",
        "second",
        "The end <here> éA",
    ]
    assert (row.n_chars, row.n_kept) == (len(row.text), 7)


def test_blocks_inherit_from_neighbours_without_an_article(spark):
    page = (
        "<div><a href=x>Home</a> <a href=y>News</a></div><div>Sign in here</div><h2>The head</h2>"
        + f"<div>{LONG * 3}</div><div>Short inside.</div><div>{LONG * 3}</div><div>Mail us</div>"
        + "<div>All rights</div><div><a href=z>Top</a></div>"
    )
    (row,) = extract(spark, page)
    kept = row.text.split("\n")
    assert kept == ["The head", (LONG * 3).strip(), "Short inside.", (LONG * 3).strip(), "Mail us"]


def test_edges(spark):
    deep = "<div>" * 3000 + "<article><p>" + LONG + "</article>" + "</b></div>" * 5000
    huge = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    cut = "<article><h1>Head &am</h1><p>" + LONG + "tail &amp"
    rows = extract(spark, None, "", "<p>", "tiny", deep, huge, cut, "<article><p>a</p><p class='x", "<<b> 3 < 4")
    assert [r.text for r in rows[:4]] == ["", "", "", "tiny"]
    assert rows[4].text == LONG.strip()
    assert rows[5].n_kept == 20_000 and rows[5].n_chars == len(rows[5].text)
    assert rows[6].text == f"Head &am\n{LONG}tail &"
    assert rows[7].text == "a" and "3 < 4" in rows[8].text


def test_columns_rows_and_empty_table(spark):
    schema = "page_id long, url string, html string, TEXT string, n_chars string, __html int"
    rows = [(1, "u", "<p>x</p>", "old", "old", 7)] * 2 + [(None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    found = extract_main_text(df)
    assert found.select("text", "n_chars", "__html").count() == 3
    assert sorted((r.page_id or 0, r.text) for r in found.collect()) == [(0, ""), (1, "x"), (1, "x")]
    assert extract_main_text(df.limit(0)).collect() == []


def test_invalid_bytes(spark):
    df = spark.sql("select 1L as page_id, cast(X'3C703E61FF623C2F703E' as string) as html")
    assert extract_main_text(df).first().text == "a�b"


@pytest.mark.parametrize("wrapper,least", [("article", 1.0), ("div", 0.8)])
def test_given_pages(spark, wrapper, least):
    """Whole on the given pages; without the article mark, most characters by text rules alone."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    expected = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S).group(1)
        cut = [re.sub(r"</?b>", "", b).replace("<br>", " ") for b in re.split(r"</?(?:p|h1)>", body)]
        expected[r.page_id] = [t for t in (" ".join(unescape(b).split()) for b in cut) if t]
    renamed = pages.selectExpr(
        "page_id", f"replace(replace(html, '<article', '<{wrapper}'), '</article', '</{wrapper}') as html"
    )
    right = total = 0
    for r in extract_main_text(renamed).collect():
        kept = r.text.split("\n") if r.text else []
        if least == 1.0:
            assert kept == expected[r.page_id]
        right += sum(len(b) for b in kept if b in expected[r.page_id])
        total += max(sum(map(len, kept)), sum(map(len, expected[r.page_id])))
    assert right >= least * total
