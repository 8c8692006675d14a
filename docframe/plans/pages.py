"""Registered queries over pages read as documents, each with the SQL that gives the same rows.

The given pages have one flat list, no table and no hidden text; where a query is about more, Spark rewrites each whole page first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docframe.plans.catalog import table
from docframe.registry import query
from docframe.sources import html_document as hd


def _clean(text: str) -> str:
    """SQL for a run's text: the references that occur in pages, white space as one blank, trimmed."""
    for name, sign in (("&quot;", "chr(34)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")):
        text = f"replace({text}, '{name}', {sign})"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def _pages(spark: SparkSession, sf_dir: str, *swaps: tuple[str, str]) -> DataFrame:
    html: Column = F.col("html")
    for old, new in swaps:
        html = F.replace(html, F.lit(old), F.lit(new))
    return table(spark, sf_dir, "pages").select("page_id", html.alias("html"))


@query(f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS place, CASE WHEN tag LIKE 'h_' THEN 'heading' WHEN tag = 'li' THEN 'list_item' ELSE 'paragraph' END AS kind, text FROM (
  SELECT page_id, i, lower(regexp_extract(part, '^<(/?[a-zA-Z0-9]+)', 1)) AS tag, {_clean("regexp_replace(part, '<[^>]*>', '', 'g')")} AS text FROM (
    SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (
      SELECT page_id, regexp_extract_all(regexp_replace(regexp_extract(html, '(?s)</head>(.*)', 1), '(?s)<!--.*?-->', '', 'g'), '</?(?:body|html|nav|ul|li|div|article|h1|p|footer)(?:\\s[^>]*)?>(?:[^<]|</?(?:a|b|br)(?:\\s[^>]*)?>)*') AS parts FROM pages)))
WHERE text <> ''
""")
def html_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks of each page with their kinds, in order."""
    found = hd.blocks(hd.nodes(_pages(spark, sf_dir)))
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    return found.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("block")) - 1).alias("place"), "kind", text.alias("text"))


ITEMS_SQL = "SELECT page_id, unnest(items) AS item, generate_subscripts(items, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li>(?:[^<]|</?a(?:\\s[^>]*)?>)*</li>') AS items FROM pages)"


@query(f"""
WITH items AS (SELECT page_id, i, {_clean("regexp_replace(item, '<[^>]*>', '', 'g')")} AS text FROM ({ITEMS_SQL}))
SELECT page_id, 1 AS depth, false AS ordered, CAST(i AS BIGINT) AS number, 'top' AS text, CAST(NULL AS VARCHAR) AS parent FROM items
UNION ALL SELECT page_id, 2, true, CAST(7 AS BIGINT), text, 'top' FROM items
""")
def html_nested_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's menu as a list of two levels, and the item that each inner list lies in."""
    found = hd.list_items(hd.nodes(_pages(spark, sf_dir, ("<li>", '<li>top<ol start="7"><li>'), ("</li>", "</ol>"))))
    parents = found.select("page_id", F.col("item").alias("parent_item"), F.col("text").alias("parent"))
    return found.join(parents, ["page_id", "parent_item"], "left").select("page_id", "depth", "ordered", "number", "text", "parent")


@query(f"""
WITH items AS (SELECT page_id, i, {_clean("regexp_replace(item, '<[^>]*>', '', 'g')")} AS text FROM ({ITEMS_SQL}))
SELECT page_id, CAST(2 * i - 2 + r AS INTEGER) AS "row", col, row_span, col_span, th AS is_header, 'Menu' AS caption, CASE WHEN th OR r = 0 AND col = 0 THEN label ELSE text END AS text FROM (
  SELECT page_id, i, 1 AS r, 0 AS col, 2 AS row_span, 1 AS col_span, false AS th, 'link' AS label, text FROM items
  UNION ALL SELECT page_id, i, 1, 1, 1, 2, false, '', text FROM items UNION ALL SELECT page_id, i, 2, 1, 1, 1, false, '', 'left' FROM items UNION ALL SELECT page_id, i, 2, 2, 1, 1, false, '', 'right' FROM items) x
WHERE col > 0
UNION ALL SELECT page_id, CAST(2 * i - 1 AS INTEGER), 0, 2, 1, false, 'Menu', 'link' FROM items
UNION ALL SELECT DISTINCT page_id, 0, 0, 1, 3, true, 'Menu', 'Head' FROM items
""")
def html_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's menu as a table with a header, cells that reach over rows and columns, and unclosed rows."""
    swaps = (("<ul>", '<table><caption> Menu</caption><tr><th colspan="3">Head'), ("</ul>", "</table>"), ("<li>", '<tr><td rowspan="2">link<td colspan="2">'), ("</li>", "<tr><td>left</td><td>right</td>"))
    return hd.cells(hd.nodes(_pages(spark, sf_dir, *swaps))).select("page_id", "row", "col", "row_span", "col_span", "is_header", "caption", "text")


@query(f"""
SELECT page_id, {_clean("regexp_extract(html, '<div class=.ad.>([^<]*)</div>', 1)")} AS text FROM pages WHERE html LIKE '%<div class="ad">%'
UNION ALL SELECT page_id, {_clean("regexp_extract(html, '<footer>([^<]*)</footer>', 1)")} FROM pages WHERE html LIKE '%<footer>%'
""")
def html_rule_hidden_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that a rule of the page's own style element hides: by class, and by tag inside of an at-rule."""
    found = hd.hidden_text(hd.nodes(_pages(spark, sf_dir, ("p{margin:0}", "/* { */ div.AD, .none { Display : none } @media screen { footer{visibility:hidden} } nav a{display:none}"))))
    return found.select("page_id", "text")


@query(f"""
SELECT page_id, regexp_extract(run, 'href="([^"]*)"', 1) AS href, {_clean("regexp_extract(run, '>([^<]*)<', 1)")} AS text, true AS bold, false AS italic FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS run FROM pages)
UNION ALL SELECT page_id, NULL, {_clean("regexp_extract(run, '>([^<]*)<', 1)")}, false, true FROM (SELECT page_id, unnest(regexp_extract_all(html, '<b>[^<]*<')) AS run FROM pages)
""")
def html_styled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that are bold or italic by the page's rules, which override the tag, and where they link to."""
    found = hd.runs(hd.nodes(_pages(spark, sf_dir, ("p{margin:0}", "b{font-weight:400;font-style:italic} a{font-weight:700}"))))
    return found.filter("(bold or italic) and text <> '\n'").select("page_id", "href", F.trim("text").alias("text"), "bold", "italic")
