from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest

from docframe.llm import html_tree

PAGES = "page_id long, url string, html string"


def page(i, body, host="a.example"):
    return (i, f"https://{host}/{i}", f"<html><body>{body}</body></html>")


def texts(spark, rows, **options):
    return {r["page_id"]: r["text"] for r in html_tree.extract_main_text(spark.createDataFrame(rows, PAGES), **options).collect()}


def test_menus_and_notices_go_without_the_names(spark):
    menu = '<div class="x1"><ul>' + "".join(f'<li><a href="/{k}">Part {k}</a></li>' for k in range(5)) + "</ul></div>"
    rows = [page(i, f'{menu}<div class="x2"><p>We use files on your machine</p></div><div class="x3"><p>story {i} begins</p><p>and {i * 7} ends with a <a href="/">link</a></p></div>') for i in range(20)]
    rows += [page(100, menu + "<p>alone on its host</p>", "b.example")]
    got = texts(spark, rows, prior=1.0)
    assert got[3] == "story 3 begins\nand 21 ends with a link"
    assert got[100] == "alone on its host"  # a menu is known by its links, even on one page


def test_few_pages_are_weak_evidence(spark):
    body = '<div class="x2"><p>The same words</p></div><p>story {}</p>'
    assert texts(spark, [page(i, body.format(i)) for i in range(3)], prior=1.0)[1] == "The same words\nstory 1"
    assert texts(spark, [page(i, body.format(i)) for i in range(30)], prior=1.0)[1] == "story 1"


def test_names_are_no_prior_inside_an_article(spark):
    body = '<nav>menu</nav><article><h1 id="share">T</h1><div class="search-results"><p>found</p></div><p id="share">to share</p><section class="notice">read</section><div class="comments"><p>reader</p></div><span class="ad">buy</span> end</article>'
    assert texts(spark, [page(1, body)])[1] == "T\nfound\nto share\nread\nend"


def test_depth_and_length_have_no_limit(spark):
    deep = "<div>" * 300 + "<script>var x=1</script><nav>menu</nav><p>one</p><p>two</p>" + "</div>" * 300
    mixed = "<div><section>" * 400 + "<p>in</p><nav>menu</nav>" + "</section></div>" * 400
    article = "<div><article>" + "<div>" * 300 + "</div>" * 300 + "<p>tail</p></article></div><p>after</p>"
    long = "<p>" + "word " * 400_000 + "</p><nav>x</nav>"
    got = texts(spark, [page(1, deep), page(2, mixed, "b.example"), page(3, article, "c.example"), page(4, long, "d.example")])
    assert (got[1], got[2], got[3]) == ("one\ntwo", "in", "tail")
    assert len(got[4]) == 5 * 400_000 - 1


def test_rules_on_the_given_pages_and_other_columns(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("*", "url AS host", "html AS text", "1 AS salt", "2 AS low", "page_id AS page")
    rules = html_tree.site_rules(html_tree.parse_pages(rows)).collect()
    assert rules and all(r["low"] for r in rules)
    assert html_tree.extract_main_text(rows).columns == ["page_id", "url", "text", "n_chars"]


@pytest.mark.parametrize("url,host", [("//cdn.example/x", "cdn.example"), ("http://[::1]/", "::1"), (" https://A.example/", "a.example"), ("http://u@v@host/x", "host"), ("http://[bad", ""), (None, "")])
def test_one_host_of_a_page(url, host):
    assert html_tree.host_of(url) == host


def test_importance_by_its_definition(spark):
    rows = [page(i, f'<div class="m"><a>menu</a> {i % 2}</div><div class="ad">buy {i}</div>' + "<h2>a</h2><p>x</p>" * (i % 3) + f"<p>text {i // 2}</p>", "h.example") for i in range(6)] + [page(7, "<p>only</p>", "o.example")]
    rows.append((99, *rows[0][1:]))  # a copy
    got = {(r["host"], r["node"]): r["importance"] for r in html_tree.importance(html_tree.parse_pages(spark.createDataFrame(rows, PAGES))).collect()}
    want = {}
    for host in ("h.example", "o.example"):
        trees = [html_tree.PageTree(h) for h in {r[2] for r in rows if r[1].startswith(f"https://{host}/")}]
        scale = math.log(len(trees) + html_tree.EVIDENCE)
        under, shapes = defaultdict(list), defaultdict(Counter)
        by_page = defaultdict(lambda: defaultdict(Counter))
        for k, tree in enumerate(trees):
            for branch, _, _, text, _ in tree.blocks:
                by_page[branch[0]][text][k] += 1
            for (node, shape), n in tree.shapes.items():
                shapes[node][shape] += n
        entropy = lambda c: -sum(n / c.total() * math.log(n / c.total()) for n in c.values())
        for tree in trees:
            for branch, _, _, text, linked in tree.blocks:
                for node in branch[:-1]:  # without the root
                    under[node].append((len(text), (len(text) - linked) * (1 - entropy(by_page[branch[0]][text]) / scale)))
        for node, parts in under.items():
            content = max(0, sum(b for _, b in parts) / sum(a for a, _ in parts))
            damp = html_tree.DAMP ** len(shapes[node])
            want[host, node] = (html_tree.PRIOR if node & 1 else 1) * ((1 - damp) * min(1, entropy(shapes[node]) / scale) + damp * content)
    assert got.keys() == want.keys()
    assert got == pytest.approx(want)
