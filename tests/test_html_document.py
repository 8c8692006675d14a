from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docframe.sources import html_document as hd

REPORT = """<!DOCTYPE html>
<html><head><title>Quarterly &amp; Report</title>
<style>/* .x{display:none} */ .gone, p#secret { display : none } @media print { .also{visibility:hidden} } b{font-weight:normal} .i{font-style:italic} div p{display:none} a:hover{display:none}</style>
<script>var a = "<p>no</p>";</script></head>
<body><h1>Quarterly <em>Report</em></h1>
<p>Revenue grew by <strong>12%</strong> across <a href='/r?a=1&amp;b=2'>all <i>regions</i></a>.
<p class=i>slanted <b>plain</b> text<p class="Gone other">payload</p><p id="secret">by id</p><span class="also">in media</span><p style="color:#fff; background:white">white</p>
<div hidden><p>inner <span>deep</span></p></div><p>seen</p>
<table><caption>Growth by region</caption><thead><tr><th>Region</th><th colspan="2">Growth</th></tr></thead>
<tr><td rowspan=2>EMEA<td>8%<td>9%</tr><tr><td>10%<td>11%<tr><td>APAC</td>junk<td>17%</td><td><ul><li>x</ul></td></tr></table>
<ol start="3"><li>Hiring is on plan</li><li><input type="checkbox" checked> Churn is down
<ul><li>Enterprise<li><input type=checkbox>Small<ol><li>third level</li></ol></li></ul></li>between</ol>
<blockquote><p>Best <br> quarter.</p></blockquote><pre>
 a = 1
   b</pre><hr>tail & 1 < 2"""


@pytest.fixture(scope="module")
def page(spark):
    pages = spark.createDataFrame([(1, REPORT, "x", "y"), (2, None, "x", "y"), (3, "", "x", "y"), (4, "no tags at all", "x", "y"), (5, "<li>stray</li></ul></p><td>cell <b>bold<p>next", "x", "y"), (6, "<div " + "a='>' " * 300 + ">" + "<b>" * 500 + "deep" + "y " * 100_000, "x", "y")], "page_id long, html string, text string, tag string")
    return hd.nodes(pages)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_blocks_in_order(page):
    got = rows(hd.blocks(page).filter("page_id = 1").orderBy("block"), "kind", "level", "text", "hidden")
    assert got[:9] == [
        ("heading", 1, "Quarterly Report", False), ("paragraph", 0, "Revenue grew by 12% across all regions.", False), ("paragraph", 0, "slanted plain text", False), ("paragraph", 0, "payload", True), ("paragraph", 0, "by id", True),
        ("paragraph", 0, "in media", True), ("paragraph", 0, "white", True), ("paragraph", 0, "inner deep", True), ("paragraph", 0, "seen", False),
    ]
    assert got[-3:] == [("quote", 0, "Best\nquarter.", False), ("code", 0, " a = 1\n   b", False), ("paragraph", 0, "tail & 1 < 2", False)]
    assert not [x for x in got if "junk" in x[2] or "between" in x[2]]


def test_cells_have_spans_headers_and_columns(page):
    got = rows(hd.cells(page).orderBy("row", "col"), "row", "col", "row_span", "col_span", "is_header", "caption", "text")
    cap = "Growth by region"
    assert got == [
        (0, 0, 1, 1, True, cap, "Region"), (0, 1, 1, 2, True, cap, "Growth"), (1, 0, 2, 1, False, cap, "EMEA"), (1, 1, 1, 1, False, cap, "8%"), (1, 2, 1, 1, False, cap, "9%"),
        (2, 1, 1, 1, False, cap, "10%"), (2, 2, 1, 1, False, cap, "11%"), (3, 0, 1, 1, False, cap, "APAC"), (3, 1, 1, 1, False, cap, "17%"), (3, 2, 1, 1, False, cap, "x"),
    ]


def test_lists_nest_and_number(page):
    got = rows(hd.list_items(page).filter("page_id = 1 and depth > 0").orderBy("item"), "depth", "ordered", "number", "checked", "text")
    assert got == [(1, False, 1, None, "x"), (1, True, 3, None, "Hiring is on plan"), (1, True, 4, True, "Churn is down"), (2, False, 1, None, "Enterprise"), (2, False, 2, False, "Small"), (3, True, 1, None, "third level")]
    items = hd.list_items(page).filter("page_id = 1").collect()
    by_item = {r["item"]: r for r in items}
    assert {by_item[r["parent_item"]]["text"] for r in items if r["depth"] > 1} == {"Churn is down", "Small"}


def test_styles_cascade(page):
    got = {r["text"].strip(): r for r in hd.runs(page).filter("page_id = 1").collect()}
    assert got["12%"]["bold"] and got["regions"]["italic"] and got["regions"]["href"] == "/r?a=1&b=2" and got["all"]["href"] == "/r?a=1&b=2"
    assert got["slanted"]["italic"] and got["plain"]["italic"] and not got["plain"]["bold"] and got["Report"]["italic"] and not got["seen"]["hidden"]


def test_hidden_text_is_whole(page):
    assert sorted(r[0] for r in rows(hd.hidden_text(page), "text")) == ["by id", "in media", "inner deep", "payload", "white"]


def test_title_and_odd_pages(page):
    assert rows(hd.title(page), "page_id", "title") == [(1, "Quarterly & Report")]
    got = rows(hd.blocks(page).filter("page_id > 1").orderBy("page_id", "block"), "page_id", "kind", F.length("text").alias("n"), F.substring("text", 1, 14).alias("t"))
    assert got == [(4, "paragraph", 14, "no tags at all"), (5, "list_item", 5, "stray"), (5, "cell", 9, "cell bold"), (5, "cell", 4, "next"), (6, "paragraph", 200_003, "deepy y y y y ")]
    assert not rows(hd.runs(page).filter("page_id = 5 and text = 'next'"), "bold")[0][0]


def test_no_pages(spark):
    none = hd.nodes(spark.createDataFrame([], "page_id long, html string"))
    for table in (hd.blocks(none), hd.cells(none), hd.list_items(none), hd.hidden_text(none), hd.title(none)):
        assert table.count() == 0


def test_columns_by_definition():
    """Every place is covered once, each cell as far left as the places before it in its row allow."""
    table = [(0, 2, 1), (0, 1, 3), (1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 3, 1)]
    assert hd._columns(table) == [0, 2, 0, 1, 0, 0]


def test_references_need_their_semicolon(spark):
    """A cut reference stays as written, in both readers of pages, as in the reference's own decoder."""
    from docframe.sources import readers

    pages = spark.createDataFrame([(1, "<h1>a &amp; b&amp</h1><p>&copyright; &copy; &#65 &#66; &lt&nope; &amp;lt;</p>")], "page_id long, html string")
    want = ["a & b&amp", "&copyright; © &#65 B &lt&nope; &lt;"]
    assert [r["text"] for r in readers.html_blocks(pages, "html", "page_id").orderBy("block").collect()] == want
    assert [r["text"] for r in hd.blocks(hd.nodes(pages)).orderBy("block").collect()] == want


def test_lists_and_cells_follow_tokens_once(spark):
    pages = spark.createDataFrame([(1, "<ul><li>a<ol><li>b</ol></ul><table><caption>c</caption><tr><td>d<td>e</table>")], "page_id long, html string")
    for found in (hd.list_items(hd.nodes(pages)), hd.cells(hd.nodes(pages))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and "MapInPandas" not in plan  # tokens are read from where they were written
        assert found.count() == 2
