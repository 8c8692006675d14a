"""Registered queries of what is told about documents, each with the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions import text as tx
from docframe.operators import edit_log, layout, search
from docframe.operators import projections as pj
from docframe.plans.catalog import CHUNK_SQL, FRAGMENT_SQL, OPS_SQL, _chunks, _fragments, _lines, _ops, table
from docframe.registry import query
from docframe.sources import readers

LINES_SQL = "WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block FROM documents) "


@query("SELECT doc_id, CAST(1 AS BIGINT) AS sections, count(*) AS blocks, CAST(0 AS BIGINT) AS headings, count(*) AS paragraphs, CAST(0 AS BIGINT) AS items, CAST(0 AS BIGINT) AS tables FROM (SELECT doc_id, unnest(string_split_regex(text, '\\n\\s*\\n')) AS b FROM documents) WHERE trim(b, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY doc_id")
def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pj.counts(readers.text_blocks(table(spark, sf_dir, "documents")).withColumn("section", F.lit(0)))


@query(FRAGMENT_SQL + "SELECT doc_id, count(DISTINCT page_number) AS pages FROM fragments GROUP BY doc_id")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pj.page_counts(_fragments(spark, sf_dir)[0])


@query("""
SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS title, CAST(strlen(text) AS BIGINT) AS file_size, CAST(length(text) AS BIGINT) AS chars,
  CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents
""")
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pj.metadata(table(spark, sf_dir, "documents"))


@query("""
SELECT doc_id, kind, value FROM (
  SELECT doc_id, 'doi' AS kind, concat('10.1234/x.', doc_id) AS value FROM documents UNION ALL SELECT doc_id, 'arxiv', concat('2101.', lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0')) FROM documents
  UNION ALL SELECT doc_id, 'pmid', CAST(doc_id + 1 AS VARCHAR) FROM documents)
""")
def document_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in a line about each document."""
    number = F.col("doc_id").cast("string")
    line = F.concat(F.lit("See doi:10.1234/x."), number, F.lit(", arXiv:2101."), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"), F.lit("; PMID: "), (F.col("doc_id") + 1).cast("string"), F.lit(" and again 10.1234/x."), number, F.lit("."))
    return pj.identifiers(table(spark, sf_dir, "documents").select("doc_id", line.alias("text")))


@query(CHUNK_SQL + """
, refs AS (SELECT doc_id, chunk_id, unnest([chunk_id % 4 + 1, 9]) AS number FROM chunks)
SELECT doc_id, chunk_id, CAST(number AS BIGINT) AS number, CASE WHEN number <= 3 THEN concat('Entry ', number, ' of ', doc_id) END AS title FROM refs
""")
def cited_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations at each chunk's end, found in its document's bibliography of three entries."""
    found = _chunks(spark, sf_dir).select("doc_id", "chunk_id", F.concat(F.regexp_replace("content", r"[\[\]]", " "), F.lit(" ["), (F.col("chunk_id") % 4 + 1).cast("string"), F.lit(", 9]")).alias("content"))
    entries = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("number")).withColumn("title", F.concat(F.lit("Entry "), F.col("number").cast("string"), F.lit(" of "), F.col("doc_id").cast("string")))
    return pj.citations(found, entries)


RUNS_SQL = LINES_SQL + ", runs AS (SELECT doc_id, block, text, CASE WHEN (doc_id + block) % 53 = 0 THEN 1.0 WHEN block % 2 = 0 THEN NULL ELSE 12.0 END AS size, (doc_id + block) % 71 = 0 AS hidden FROM lines) "


@query(RUNS_SQL + "SELECT doc_id, 1 AS page_number, CAST(block AS INTEGER) AS block, trim(text, ' ') AS text FROM runs WHERE (hidden OR coalesce(size <= 1, false)) AND trim(text, ' ') <> ''")
def hidden_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as runs, some hidden and some too small to be read."""
    at = F.col("doc_id") + F.col("block")
    runs = _lines(spark, sf_dir).select("doc_id", "section", "block", F.lit(0).alias("run"), "text", F.when(at % 53 == 0, 1.0).when(F.col("block") % 2 == 0, F.lit(None)).otherwise(12.0).alias("size"), (at % 71 == 0).alias("hidden"))
    return pj.scan_semantic(pj.flag_unreadable(runs)).select("doc_id", "page_number", "block", "text")


@query("""
WITH f AS (SELECT doc_id, length(text) AS chars, length(text) - length(replace(text, '|', '')) AS tables, length(text) - length(replace(text, '#', '')) AS figures, length(text) - length(replace(text, '=', '')) AS equations, CASE WHEN contains(text, chr(10)) THEN 2 ELSE 1 END AS kinds FROM documents),
s AS (SELECT doc_id, CASE WHEN chars > 100000 THEN 3 WHEN chars > 50000 THEN 2 WHEN chars > 20000 THEN 1 ELSE 0 END + least(tables, 3) + least(figures, 2) + least(equations, 2) + least(kinds, 3) AS score FROM f)
SELECT doc_id, CASE WHEN score >= 8 THEN 'High' WHEN score >= 4 THEN 'Medium' ELSE 'Low' END AS complexity FROM s
""")
def length_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    facts = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"), uses("|").alias("tables"), uses("#").alias("figures"), uses("=").alias("equations"), F.when(F.col("text").contains("\n"), 2).otherwise(1).alias("kinds"))
    return pj.length_complexity(facts)


@query("SELECT event_type AS operation, count(value) AS calls, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def operation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pj.metrics(table(spark, sf_dir, "events"), "event_type", "value")


COMPARE_SQL = FRAGMENT_SQL + """
, old AS (SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY frag_idx) AS text FROM fragments WHERE NOT (doc_id % 5 = 0 AND page_number = 1) GROUP BY doc_id, page_number),
fresh AS (SELECT doc_id, page_number, CASE WHEN doc_id % 3 = 0 THEN concat(string_agg(text, chr(10) ORDER BY frag_idx), ' revised') ELSE string_agg(text, chr(10) ORDER BY frag_idx) END AS text FROM fragments WHERE NOT (doc_id % 7 = 0 AND page_number = 2) GROUP BY doc_id, page_number),
both_ AS (SELECT coalesce(o.doc_id, f.doc_id) AS doc_id, coalesce(o.page_number, f.page_number) AS page_number, o.text AS a, f.text AS b FROM old o FULL JOIN fresh f ON f.doc_id = o.doc_id AND f.page_number = o.page_number),
words AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(a), '\\s+'), lambda w: w <> '')) AS wa, list_distinct(list_filter(string_split_regex(lower(b), '\\s+'), lambda w: w <> '')) AS wb FROM both_),
compared AS (SELECT doc_id, page_number, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN a = b THEN 'same' ELSE 'modified' END AS state,
  round(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 WHEN len(list_distinct(list_concat(wa, wb))) = 0 THEN 1.0 ELSE len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) END, 4) AS similarity FROM words)
"""


@query(COMPARE_SQL + "SELECT doc_id, page_number, state, CAST(similarity AS DOUBLE) AS similarity FROM compared")
def compared_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two revisions of each document's pages: some pages added, some removed, some with a word more."""
    fragments, _ = _fragments(spark, sf_dir)
    parts = F.sort_array(F.collect_list(F.struct("frag_idx", "text")))
    pages = fragments.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    old = pages.filter("NOT (doc_id % 5 = 0 AND page_number = 1)")
    new = pages.filter("NOT (doc_id % 7 = 0 AND page_number = 2)").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" revised"))).otherwise(F.col("text")))
    return pj.compare_pages(old, new)


@query(COMPARE_SQL + "SELECT doc_id, CAST(round(avg(similarity), 6) AS DOUBLE) AS overall_similarity, count(*) FILTER (state = 'same') AS same, count(*) FILTER (state = 'modified') AS modified, count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'removed') AS removed FROM compared GROUP BY doc_id")
def compared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pj.compare_documents(compared_pages(spark, sf_dir))


@query(OPS_SQL + "SELECT doc_id, counter, actor, op, content FROM ops WHERE doc_id % 2 = 1 OR counter > 3 OR (counter = 3 AND actor > 1)")
def operations_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edits after (3, 1) of every other document, all of the others."""
    ops = _ops(spark, sf_dir)
    marks = ops.filter("doc_id % 2 = 0").select("doc_id").distinct().select("doc_id", F.lit(3).alias("counter"), F.lit(1).alias("actor"))
    return pj.operations_since(ops, marks).select("doc_id", "counter", "actor", "op", "content")


@query(FRAGMENT_SQL + "SELECT doc_id, page_number, CAST(greatest(4.0, font_size) AS DOUBLE) AS median FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY font_size, frag_idx) AS r, count(*) OVER (PARTITION BY doc_id, page_number) AS n FROM fragments) WHERE r = n // 2 + 1")
def median_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pj.median_font(_fragments(spark, sf_dir)[0])


@query(FRAGMENT_SQL + """
, captioned AS (SELECT doc_id, page_number, frag_idx, CASE WHEN frag_idx % 7 = 3 THEN concat('Table ', frag_idx, ': ', text) ELSE text END AS text FROM fragments)
SELECT doc_id, page_number, frag_idx, CAST(sum(CASE WHEN regexp_matches(trim(text), '^(?i)(figure|fig\\.|fig|chart|table)\\s*\\d') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY frag_idx) AS BIGINT) AS part FROM captioned
""")
def caption_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh line of a page opened by a caption."""
    rows = _fragments(spark, sf_dir)[0].withColumn("text", F.when(F.col("frag_idx") % 7 == 3, F.concat(F.lit("Table "), F.col("frag_idx").cast("string"), F.lit(": "), F.col("text"))).otherwise(F.col("text")))
    return pj.caption_splits(rows).select("doc_id", "page_number", F.col("frag_idx").cast("int").alias("frag_idx"), "part")


@query(LINES_SQL + """
, marked AS (SELECT doc_id, block, CASE WHEN block % 5 = 1 THEN '-' WHEN block % 5 = 2 THEN CASE WHEN length(text) % 2 = 0 THEN '-' ELSE '1' END WHEN NOT regexp_matches(trim(text), '^([•◦▪‣·–*-]|\\d{1,3}[.)])\\s*\\S') THEN '' WHEN regexp_matches(trim(text), '^\\d') THEN '1' ELSE '-' END AS marker FROM lines WHERE NOT (block % 5 IN (1, 2) AND trim(text) = '')),
started AS (SELECT *, marker <> '' AND coalesce(lag(marker) OVER (PARTITION BY doc_id ORDER BY block), '') <> marker AS begins FROM marked)
SELECT doc_id, CAST(block AS INTEGER) AS block, CASE WHEN marker <> '' THEN sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block) END AS list FROM started
""")
def list_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, two of each five as items: the first with a bullet, the second with a bullet or a number."""
    rows = _lines(spark, sf_dir).filter("NOT (block % 5 IN (1, 2) AND trim(text) = '')")
    marker = F.when((F.col("block") % 5 == 2) & (F.length("text") % 2 == 1), "12. ").otherwise("• ")
    rows = rows.withColumn("text", F.when((F.col("block") % 5).isin(1, 2), F.concat(marker, F.col("text"))).otherwise(F.col("text")))
    return pj.list_groups(rows.select("doc_id", "block", "text")).select("doc_id", "block", "list")


ORDER_CELLS_SQL = """
WITH cells AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS row, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_linestatus END AS text FROM lineitem),
size AS (SELECT doc_id, max(row) AS last FROM cells WHERE text <> '' GROUP BY doc_id),
grid AS (SELECT s.doc_id, CAST(r AS INTEGER) AS row, CASE WHEN r = 0 THEN ['line', 'mode'] ELSE [CASE WHEN c.text <> '' THEN CAST(r AS VARCHAR) ELSE '' END, coalesce(c.text, '')] END AS cells
  FROM (SELECT doc_id, unnest(range(0, last + 1)) AS r FROM size) s LEFT JOIN (SELECT doc_id, row, max(text) AS text FROM cells GROUP BY doc_id, row) c ON c.doc_id = s.doc_id AND c.row = s.r)
"""


def _order_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as tables: a header, and a row for each line; every third is empty."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("row")).agg(F.max("l_linestatus").alias("mode")).filter("row % 3 <> 0")
    head = lines.select("doc_id").distinct().select("doc_id", F.lit(0).alias("row"), F.array(F.lit("line"), F.lit("mode")).alias("x"))
    body = lines.select("doc_id", "row", F.array(F.col("row").cast("string"), F.col("mode")).alias("x"))
    cells = head.unionByName(body).select("doc_id", "row", F.posexplode("x").alias("col", "text"))
    return pj.square_grid(cells.unionByName(cells.filter("row = 0").select("doc_id", F.lit(99).alias("row"), F.lit(7).alias("col"), F.lit("").alias("text"))))


@query(ORDER_CELLS_SQL + "SELECT doc_id, row, cells[1] AS first_cell, cells[2] AS second_cell, len(cells) AS width FROM grid")
def square_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_grid(spark, sf_dir).select("doc_id", "row", F.get("cells", F.lit(0)).alias("first_cell"), F.get("cells", F.lit(1)).alias("second_cell"), F.size("cells").cast("long").alias("width"))


@query(ORDER_CELLS_SQL + "SELECT doc_id, concat('<!-- table (', count(*), 'x2) -->', chr(10), string_agg(CASE WHEN row = 0 THEN concat('| line | mode |', chr(10), '| --- | --- |') ELSE concat('| ', cells[1], ' | ', cells[2], ' |') END, chr(10) ORDER BY row)) AS markdown FROM grid GROUP BY doc_id")
def tables_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pj.tables_markdown(_order_grid(spark, sf_dir))


@query("""
SELECT l_orderkey AS doc_id, CAST(l_linenumber + i AS INTEGER) AS row, CAST(j AS INTEGER) AS col, CASE WHEN i = 0 AND j = 0 THEN concat(l_linestatus, ' \\| ', l_returnflag) ELSE ' ' END AS text
FROM (SELECT *, unnest(range(0, greatest(1, l_linenumber % 3))) AS i FROM lineitem) t, (SELECT unnest(range(0, 2)) AS j) WHERE j < 1 + t.l_orderkey % 2
""")
def spanned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("row"), F.lit(0).alias("col"), (F.col("l_linenumber") % 3).cast("int").alias("row_span"), (1 + F.col("l_orderkey") % 2).cast("int").alias("col_span"), F.concat("l_linestatus", F.lit(" \n|  "), "l_returnflag").alias("text"))
    return pj.expand_spans(cells)


@query("SELECT doc_id, CASE WHEN f <> 'pdf' THEN concat('forms needs pdf, this is ', f) END AS error FROM (SELECT doc_id, ['pdf', 'html', 'unknown'][doc_id % 3 + 1] AS f FROM documents)")
def format_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.get(F.array(F.lit("pdf"), F.lit("html"), F.lit(None)), (F.col("doc_id") % 3).cast("int")).alias("format"))
    return pj.with_format_error(docs, "format", "pdf", "forms").select("doc_id", "error")


@query(LINES_SQL + """
, hits AS (SELECT doc_id, block FROM lines WHERE list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'tion')),
scans AS (SELECT doc_id, block FROM lines WHERE contains(lower(text), 'tion'))
SELECT doc_id, CAST(block AS INTEGER) AS block, 'index' AS by FROM hits UNION ALL SELECT doc_id, CAST(block AS INTEGER), 'scan' FROM scans WHERE doc_id NOT IN (SELECT doc_id FROM hits)
""")
def session_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("doc_id", "block", "text")
    index = search.postings(lines, ["doc_id", "block"], "text")
    return pj.session_search(search.search_index(index, ["doc_id", "block"], "tion"), search.search_scan(lines, "tion"), lines)


@query(CHUNK_SQL + """
SELECT d.doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS title, coalesce(c.n, 0) AS n_chunks, len(string_split(text, chr(10))) AS n_lines
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) c ON c.doc_id = d.doc_id
""")
def extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = pj.metadata(table(spark, sf_dir, "documents")).select("doc_id", "title")
    return pj.extract_all(meta, chunks=_chunks(spark, sf_dir), lines=_lines(spark, sf_dir))


@query("""
SELECT doc_id, concat('{"@context":"https://schema.org","@type":"ScholarlyArticle","@id":"doc:', doc_id, '","name":"', lang, ' ', doc_id, '","wordCount":', len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')), '}') AS json FROM documents
""")
def linked_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = docs.select("doc_id", F.concat_ws(" ", "lang", F.col("doc_id").cast("string")).alias("title"))
    return pj.linked_data(pj.metadata(docs).drop("title").join(named, "doc_id"))


@query("SELECT doc_id, CAST((length(text) + length(text) - length(regexp_replace(text, '[\\x{1100}-\\x{115F}\\x{2E80}-\\x{A4CF}\\x{AC00}-\\x{D7A3}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE6F}\\x{FF00}-\\x{FF60}\\x{FFE0}-\\x{FFE6}]', '', 'g'))) * 12.0 * 0.5 AS DOUBLE) AS width FROM (SELECT doc_id, concat(text, '漢字') AS text FROM documents)")
def text_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", pj.text_width(F.concat("text", F.lit("漢字")), F.lit(12.0)).alias("width"))


def wave_provider(texts: list[str]) -> list[list[float]]:
    """A provider for tests: 384 numbers from a text's length."""
    return [[math.sin(len(t) + i) * 0.1 for i in range(384)] for t in texts]


@query(CHUNK_SQL + "SELECT doc_id, chunk_id, CAST(384 AS INTEGER) AS dimensions, round(list_sum(list_transform(range(0, 384), lambda i: sin(length(content) + i) * 0.1)), 5) AS total FROM chunks")
def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pj.embed(_chunks(spark, sf_dir), wave_provider, 384)
    return found.select("doc_id", "chunk_id", F.size("embedding").alias("dimensions"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("SELECT vec_id, label FROM (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label + 100 FROM embeddings WHERE vec_id % 10 = 0) WHERE vec_id % 7 <> 3")
def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors added, put in place of others, and deleted."""
    stored = table(spark, sf_dir, "embeddings")
    some = stored.filter("vec_id % 10 = 0").withColumn("label", F.col("label") + 100)
    arrived = some.unionByName(some.withColumn("vec_id", F.col("vec_id") + 1000000))
    after = pj.upsert_vectors(stored, arrived)
    return pj.delete_vectors(after, after.filter("vec_id % 7 = 3")).select("vec_id", "label")


@query(LINES_SQL + """
, fields AS (SELECT doc_id, block, text, trim(text, ' ' || chr(9) || chr(13)) AS bare, length(text) % 11 AS n FROM lines)
SELECT doc_id, CAST(block AS INTEGER) AS block, CASE block % 4 WHEN 0 THEN nullif(string_split(text, '"')[1], '') WHEN 1 THEN nullif(string_split_regex(bare, '\\s')[1], '') WHEN 2 THEN '\\o' END AS target,
  CASE WHEN block % 3 < 2 AND n BETWEEN 2 AND 9 THEN CAST(n - 1 AS INTEGER) END AS level FROM fields
""")
def field_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that link to each line, quoted, bare, behind a switch, and fields of other kinds; names of list styles with a number by the line's length."""
    text, block = F.col("text"), F.col("block")
    field = F.when(block % 4 == 0, F.concat(F.lit(' HYPERLINK "'), text, F.lit('" \\h'))).when(block % 4 == 1, F.concat(F.lit("hyperlink  "), text)).when(block % 4 == 2, F.concat(F.lit('HYPERLINK \\o "'), text, F.lit('"'))).otherwise(F.concat(F.lit("PAGE "), text))
    n = (F.length("text") % 11).cast("string")
    style = F.when(block % 3 == 0, F.concat(F.lit("List Bullet "), n)).when(block % 3 == 1, F.concat(F.lit("List_20_Number_20_"), n)).otherwise(F.concat(F.lit("List Paragraph "), n))
    return _lines(spark, sf_dir).select("doc_id", "block", pj.hyperlink_target(field).alias("target"), tx.list_style_level(style).alias("level"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'image/gif' END AS media_type, p_partkey % 60000 + 1 AS width, CAST(p_size AS BIGINT) AS height FROM part
""")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG, GIF and JPEG headers made from parts; a JPEG's frame comes behind segments of different lengths."""
    width, height = F.col("p_partkey") % 60000 + 1, F.col("p_size").cast("long")
    digits = lambda c, n: F.lpad(F.hex(c), n, "0")
    little = lambda c: F.concat(F.substring(digits(c, 4), 3, 2), F.substring(digits(c, 4), 1, 2))
    pad = F.col("p_partkey") % 200
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), digits(width, 8), digits(height, 8))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFFFFE"), digits(pad + 2, 4), F.repeat(F.lit("C0"), pad.cast("int")), F.lit("FFC4000300FFC2001108"), digits(height, 4), digits(width, 4), F.lit("03011100"))
    gif = F.concat(F.lit("474946383961"), little(width), little(height), F.lit("000000"))
    content = F.unhex(F.when(F.col("p_partkey") % 3 == 0, png).when(F.col("p_partkey") % 3 == 1, jpeg).otherwise(gif))
    return table(spark, sf_dir, "part").select("p_partkey", pj.image_size(content).alias("i")).select("p_partkey", "i.media_type", "i.width", "i.height")


@query("SELECT s_suppkey, ['doc', 'xls', 'ppt', NULL][s_suppkey % 4 + 1] AS kind FROM supplier")
def ole2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers with one stream's name, made from suppliers."""
    names = [n.encode("utf-16-le").hex() for n in ("WordDocument", "Workbook", "PowerPoint Document", "Other")]
    name = F.get(F.array(*map(F.lit, names)), (F.col("s_suppkey") % 4).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", pj.ole2_kind(F.unhex(F.concat(F.lit("D0CF11E0A1B11AE100"), name, F.lit("00")))).alias("kind"))


@query("SELECT c_custkey, c_custkey % 2 = 0 OR c_custkey % 3 = 0 AS bold, CAST(CASE WHEN c_custkey % 5 = 0 THEN 9.0 ELSE 12.0 END AS DOUBLE) AS size FROM customer")
def layered_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    lower = F.struct((key % 2 == 0).alias("bold"), F.lit(12.0).alias("size"))
    upper = F.struct((key % 3 == 0).alias("bold"), F.when(key % 5 == 0, 9.0).alias("size"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", lower.alias("a"), upper.alias("b"))
    return rows.select("c_custkey", pj.layered(F.col("a"), F.col("b"), ["bold"], ["size"]).alias("s")).select("c_custkey", "s.bold", "s.size")


# ---- readers, cells and edit logs on rows whose result is known

@query("""
SELECT n_nationkey AS doc_id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, r = 0 AS is_header,
  CASE WHEN r = 0 THEN ['name', 'note'][c + 1] WHEN r = 1 AND c = 0 THEN concat(n_name, ', of region', chr(10), n_regionkey) WHEN r = 1 THEN 'a "quoted" word' WHEN c = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE '' END AS text
FROM nation, (SELECT unnest([0, 1, 2]) AS r), (SELECT unnest([0, 1]) AS c)
""")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small file for each nation: a quoted field with a comma and a line end, doubled quotes, a blank record, an empty field."""
    docs = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS doc_id", """concat('name,note\\n"', n_name, ', of region\\n', n_regionkey, '","a ""quoted"" word"\\n\\n', n_nationkey, ',') AS text""")
    return readers.csv_cells(docs)


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS whole, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE concat(p_size // 2, '.5') END AS half, '' AS nothing FROM part")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", tx.number_text(size).alias("whole"), tx.number_text(size / 2).alias("half"), tx.number_text(F.lit(float("inf")) + size).alias("nothing"))


@query("SELECT s_suppkey, s_suppkey % 6 IN (0, 1, 2, 5) AS hides, CASE WHEN s_suppkey % 3 = 0 THEN 'figure' WHEN s_suppkey % 3 = 1 THEN 'table' END AS caption, s_suppkey % 4 < 2 AS is_date FROM supplier")
def style_and_caption_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations that hide text and some that do not, openings of captions, and date formats by id and by code."""
    key = F.col("s_suppkey")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (key % n).cast("int"))
    style = pick(("display : none", "color:#FFF; background:white", "font-size: 0px", "color:white", "opacity:0.5", "visibility:hidden"), 6)
    return table(spark, sf_dir, "supplier").select("s_suppkey", tx.style_hides(style).alias("hides"), tx.caption_kind(pick(("Fig. 3: x", "TABLE 4", "Figure x"), 3)).alias("caption"), tx.is_date_format(pick((14, 0, 0, 9), 4), pick((None, "yyyy-mm", '"day"0', "0.00"), 4)).alias("is_date"))


@query(OPS_SQL + "SELECT l.doc_id, l.node_counter, l.node_actor, CASE WHEN l.actor < 2 THEN concat('actor ', l.actor) END AS author, CASE WHEN l.actor < 2 THEN l.actor = 1 END AS is_agent FROM live l")
def edit_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who wrote each live node; the third actor is not in the table of actors."""
    ops = _ops(spark, sf_dir)
    actors = ops.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("id")).select("doc_id", "id", F.concat(F.lit("actor "), F.col("id").cast("string")).alias("name"), (F.col("id") == 1).alias("is_agent"))
    return edit_log.attribution(ops, actors).select("doc_id", "node_counter", "node_actor", "author", "is_agent")


@query(OPS_SQL + "SELECT doc_id, max(counter) + 1 AS next_counter FROM ops GROUP BY doc_id")
def edit_next_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_log.next_counter(_ops(spark, sf_dir))


@query(LINES_SQL + "SELECT doc_id, CAST(block + 1 AS BIGINT) AS counter, CASE WHEN block > 0 THEN CAST(block AS BIGINT) END AS left_counter, text AS content FROM lines")
def edit_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a chain of inserts."""
    return edit_log.from_blocks(_lines(spark, sf_dir)).select("doc_id", "counter", "left_counter", "content")


@query("SELECT n_nationkey AS doc_id, concat(n_name, ' & \"more\" – ', 'é', chr(10), 'A<B') AS text FROM nation")
def html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named, decimal and hexadecimal references."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), readers.unescape(F.concat("n_name", F.lit(" &amp; &quot;more&#34; &ndash; &eacute;&#10;&#x41;&lt;B"))).alias("text"))


@query("SELECT o_orderkey AS doc_id, 1 AS page_number, 0 AS table_idx, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CASE WHEN r = 0 THEN ['key', 'status'][c + 1] WHEN c = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderstatus END AS text FROM orders, (SELECT unnest([0, 1]) AS r), (SELECT unnest([0, 1]) AS c)")
def ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fragments of each order between three rules; a fifth stands outside."""
    orders = table(spark, sf_dir, "orders")
    cells = F.array(*[F.struct(F.lit(i).alias("frag_idx"), text.alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, text, x, y in ((0, F.lit("key"), 50.0, 100.0), (1, F.lit("status"), 200.0, 100.0), (2, F.col("o_orderkey").cast("string"), 50.0, 120.0), (3, F.col("o_orderstatus"), 200.0, 120.0), (4, F.lit("outside"), 50.0, 300.0))])
    fragments = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), F.inline(cells)).withColumns({"width": F.lit(60.0), "height": F.lit(10.0), "font_size": F.lit(10.0)})
    rules = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), F.lit("h").alias("orientation"), F.lit(40.0).alias("x0"), F.explode(F.array(F.lit(95.0), F.lit(115.0), F.lit(135.0))).alias("y0"), F.lit(300.0).alias("x1")).withColumn("y1", F.col("y0"))
    return layout.tables(fragments, rules).select("doc_id", "page_number", "table_idx", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "text")


@query("SELECT o_orderkey AS doc_id, name, CASE WHEN name = 'a' THEN 'figure' ELSE 'image' END AS kind, CASE WHEN name = 'a' THEN concat('Figure 1: ', o_orderstatus) END AS caption FROM orders, (SELECT unnest(['a', 'b']) AS name)")
def captioned_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two images of each order and one caption, a little inside of the first image."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), "o_orderstatus")
    fragments = orders.select("doc_id", "page_number", F.lit(0).alias("frag_idx"), F.concat(F.lit("Figure 1: "), "o_orderstatus").alias("text"), F.lit(60.0).alias("x"), F.lit(199.0).alias("y"), F.lit(80.0).alias("width"), F.lit(10.0).alias("height"))
    images = orders.select("doc_id", "page_number", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(50.0).alias("x"), F.lit(y).alias("y"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height")) for n, y in (("a", 100.0), ("b", 500.0))])))
    return layout.figures(fragments, images).select("doc_id", "name", "kind", "caption")
