import pytest

from odarel.llm.html import blocks, extract, extract_pages, parse, votes

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">A</a></li></ul></nav><header class="site-header"><h1>Site</h1></header><div id="cookie-banner">We use cookies</div>
<div class="wrap with-sidebar"><div class="sidebar"><p>Side text that is long enough to be taken for a paragraph</p></div>
<div class="post-content-12"><h2>Title &amp; more</h2><p><b>First para <a href="x">link</a> text.<br><p>Second&nbsp;para<ul><li>one<li>two</ul>
<table><tr><td>a<td>b</table><pre>x
y</pre><form><label>Name</label><input></form><div class="ad">Buy</div><div class="comments"><p>A reader says something rather long here, too</p></div></div></div>
<footer>&copy; someone</footer>"""
WANT = ["Title & more", "First para link text.", "Second para", "one", "two", "a", "b", "x y"]


def test_extract():
    path = votes(PAGE)[0][0]
    assert path.endswith("div.post-content")
    assert extract(PAGE, path).split("\n\n") == WANT == extract(PAGE, None).split("\n\n")
    assert extract(PAGE, "#>html>body>div.nowhere").split("\n\n") == WANT


@pytest.mark.parametrize(
    "html,want",
    [
        ("", ""),
        ("just text", "just text"),
        ("<p>a &lt; b &#233; &#x4e2d; &bogus; &am", "a < b é 中 &bogus; &am"),
        ("<article><p>one<p>two</article><footer>f</footer>", "one\n\ntwo"),
        ("<article>loose <i>text</i><p>para</p>tail</article>", "loose text\n\npara\n\ntail"),
        ("<main><p>x<!-- no <p>y</p> --></p></main>", "x"),
        ("<article><p>open <b>bold<p>next</article>", "open bold\n\nnext"),
        ("<article><p>a<script>if (1<2) {}</script>b</p></article>", "ab"),
        ("<div class='related'><article><p>Only here</p></article></div>", "Only here"),
        ("<script>never closed <p>x", ""),
        ("<p>cut <a hre", "cut"),
        ("<nav>only a menu</nav>", ""),
    ],
)
def test_cases(html, want):
    assert extract(html, None) == want


def test_host_consensus(spark):
    # on its own the odd page would take its long quote; the host's other pages know better
    normal = "<div class='a1'><div class='story'><p>{0}</p><p>{0} again</p></div></div><div class='box'><div><p>{1}</p></div></div>"
    rows = [(i, f"http://H.example/{i}", normal.format(f"Story {i} " * 20, "hint")) for i in range(5)]
    rows.append((9, "http://h.example:80/9", normal.format("Short story", "A very long box " * 30)))
    df = spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, path int")
    got = {r["page_id"]: r for r in extract_pages(df).collect()}
    assert got[9]["text"] == "Short story\n\nShort story again" and got[9]["n_chars"] == len(got[9]["text"])
    assert "hint" not in got[0]["text"]


def test_odd_rows(spark):
    rows = [(1, None, PAGE), (2, "not a url", PAGE), (3, "http://a.example/", None), (4, "http://a.example/", ""), (None, "http://a.example/", PAGE), (5, "http://a.example/", PAGE), (5, "http://a.example/", PAGE), (6, "http://a.example/", "<p>" + "word " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = extract_pages(df).collect()
    assert len(got) == 8
    assert all(r["text"].split("\n\n") == WANT for r in got if r["page_id"] in (1, 2, 5, None))
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in got if r["page_id"] in (3, 4))
    assert extract_pages(df.filter("false")).count() == 0


def test_deep_nesting():
    assert blocks(parse("<div>" * 3000 + "<p>deep</p>")) == ["deep"]
    page = "<div class='a'>" * 100_000 + "<p>deep</p>" + "</b>" * 100_000 + "<i>x</i>" * 20_000
    assert extract(page, votes(page)[0][0]) == "deep\n\n" + "x" * 20_000


def test_several_templates(spark):
    # the winner is a path without a class, of which pages of the other template have a little, too
    wide = "<html><body><div><p>{0}</p><p>{0} again</p></div></body></html>"
    other = "<html><body><div><p>hint</p></div><section class='s'><div class='story'><p>{0}</p><p>{0} again</p></div></section></body></html>"
    rows = [(i, "http://a.example/", (other if i % 10 == 0 else wide).format(f"Story {i} " * 40)) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{('Story %d ' % i * 40).strip()}\n\n{'Story %d ' % i * 40}again" for i in range(30)}


@pytest.mark.parametrize(
    "html",
    [
        "<script " * 130_000,
        "<script>" * 130_000,
        "<a href=\"x>" * 90_001,
        "<a \">\" " * 150_001 + "'",
        "<!-- " * 200_000,
        "</script" * 120_000 + ">",
        "<header>" * 120_000,
        "<b>x" * 250_000,
        "<div class='a'>x" * 60_000,
    ],
)
def test_odd_megabytes_take_linear_time(html):
    import time

    start = time.perf_counter()
    extract(html, votes(html)[0][0] if votes(html) else None)
    assert time.perf_counter() - start < 30


def test_quotes_and_brackets():
    assert extract("<p title='a>b'>one</p><p title=\"x>y\">two", None) == "one\n\ntwo"
    assert extract("<p>one<p title=\">two <b>three</b>", None) == "one\n\ntwo three"
    assert extract("<p>1 < 2 and 3 > 2</p><? php ?></ ><!doctype x>end", None) == "1 < 2 and 3 > 2\n\nend"
