"""What is told about documents: counts, metadata, identifiers, hidden runs, grids, comparisons and results for publishing.

Blocks are rows (doc_id, section, block, kind, level, text); runs are rows (doc_id, section, block, run, text, size, hidden).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from docframe.functions.text import caption_kind, list_marker, word_count
from docframe.operators.structure import heading_tree

# Sizes in points and lengths in characters at which behaviour changes.
UNREADABLE = 1.0
LONG_TEXTS = ((100_000, 3), (50_000, 2), (20_000, 1))
IDENTIFIERS = {"doi": r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]*[A-Za-z0-9]", "arxiv": r"(?i)\barxiv:\s?(\d{4}\.\d{4,5})", "pmid": r"(?i)\bpmid:\s?(\d{1,8})", "isbn": r"(?i)\bisbn(?:-1[03])?:?\s?([0-9][0-9-]{8,15}[0-9Xx])"}


def counts(blocks: DataFrame) -> DataFrame:
    """doc_id, sections, blocks, and how many of them are headings, paragraphs, list items and tables."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("heading", "paragraph", "item", "table")]
    return blocks.groupBy("doc_id").agg(F.countDistinct("section").alias("sections"), F.count("*").alias("blocks"), *kinds)


def page_counts(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("doc_id").agg(F.countDistinct("page_number").alias("pages"))


def metadata(docs: DataFrame) -> DataFrame:
    """A flat row of a document: title (its first line that is not blank), size in bytes, characters, words, and lines."""
    lines = F.split("text", "\n")
    title = F.get(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    return docs.select("doc_id", title.alias("title"), F.octet_length("text").cast("long").alias("file_size"), F.length("text").cast("long").alias("chars"), word_count(F.col("text")).cast("long").alias("words"), F.size(lines).cast("long").alias("lines"))


def outline(blocks: DataFrame) -> DataFrame:
    """The headings in order, with their place in the outline and the nearest heading above of a smaller level as parent (null at the top)."""
    heads = blocks.filter("kind = 'heading'").select("doc_id", "block", "kind", "level", "text")
    return heading_tree(heads).select("doc_id", "block", "level", "text", F.col("parent_heading").alias("parent"))


def identifiers(docs: DataFrame) -> DataFrame:
    """doc_id, kind (doi, arxiv, pmid, isbn), value: each different one of a text."""
    def values(kind: str, pattern: str) -> Column:
        different = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0 if kind == "doi" else 1)))
        return F.transform(different, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    each = [values(kind, pattern) for kind, pattern in IDENTIFIERS.items()]
    return docs.select("doc_id", F.inline(F.concat(*each)))


def citations(chunks: DataFrame, bibliography: DataFrame) -> DataFrame:
    """Each [n] or [n, m] of a chunk with the entry of that number in its document: doc_id, chunk_id, number, title (null if there is none)."""
    groups = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(r"\[(\d+(?:,\s*\d+)*)\]"), F.lit(1)), lambda g: F.split(g, r",\s*")))
    refs = chunks.select("doc_id", "chunk_id", F.explode(groups).alias("n")).select("doc_id", "chunk_id", F.col("n").cast("long").alias("number"))
    return refs.join(bibliography.select("doc_id", F.col("number").cast("long").alias("number"), "title"), ["doc_id", "number"], "left").select("doc_id", "chunk_id", "number", "title")


def flag_unreadable(runs: DataFrame) -> DataFrame:
    """Runs of a point or less are hidden; colour is not judged."""
    return runs.withColumn("hidden", F.coalesce("hidden", F.lit(False)) | F.coalesce(F.col("size") <= UNREADABLE, F.lit(False)))


def scan_semantic(runs: DataFrame) -> DataFrame:
    """Hidden runs with text: doc_id, page_number (the section from 1), block, run, reason, the whole text, and a place of zero."""
    rows = runs.filter(F.col("hidden") & (F.trim("text") != ""))
    return rows.select("doc_id", (F.col("section") + 1).alias("page_number"), "block", "run", F.lit("hidden").alias("reason"), F.trim("text").alias("text"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))


def layered(lower: Column, upper: Column, flags: list[str], options: list[str]) -> Column:
    """Two styles as one: flags of either, options of the upper one where it has them."""
    parts = [(F.coalesce(lower[f], F.lit(False)) | F.coalesce(upper[f], F.lit(False))).alias(f) for f in flags] + [F.coalesce(upper[o], lower[o]).alias(o) for o in options]
    return F.struct(*parts)


def length_complexity(docs: DataFrame) -> DataFrame:
    """doc_id, complexity from (chars, tables, figures, equations, kinds): 1 to 3 by length, at most 3, 2, 2 and 3 for the rest; High from 8, Medium from 4."""
    by_length = reduce(lambda c, t: c.when(F.col("chars") > t[0], t[1]), LONG_TEXTS[1:], F.when(F.col("chars") > LONG_TEXTS[0][0], LONG_TEXTS[0][1])).otherwise(0)
    score = by_length + sum((F.least(F.col(c), F.lit(most)) for c, most in (("tables", 3), ("figures", 2), ("equations", 2), ("kinds", 3))), F.lit(0))
    return docs.select("doc_id", F.when(score >= 8, "High").when(score >= 4, "Medium").otherwise("Low").alias("complexity"))


def metrics(calls: DataFrame, operation: str, value: str) -> DataFrame:
    """operation, calls, total, mean, least and most of what was measured."""
    v = F.col(value)
    return calls.groupBy(F.col(operation).alias("operation")).agg(F.count(v).alias("calls"), F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 4).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"))


def compare_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, page_number, state (same, modified, added, removed), similarity of two revisions' pages: the share of common different words."""
    a = old.select("doc_id", "page_number", F.col("text").alias("old_text"))
    b = new.select("doc_id", "page_number", F.col("text").alias("new_text"))
    rows = a.join(b, ["doc_id", "page_number"], "full")
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    both, either = F.size(F.array_intersect(words("old_text"), words("new_text"))), F.size(F.array_union(words("old_text"), words("new_text")))
    state = F.when(F.col("old_text").isNull(), "added").when(F.col("new_text").isNull(), "removed").when(F.col("old_text") == F.col("new_text"), "same").otherwise("modified")
    similarity = F.when(F.col("old_text").isNull() | F.col("new_text").isNull(), 0.0).when(either == 0, 1.0).otherwise(both / either)
    return rows.select("doc_id", "page_number", state.alias("state"), F.round(similarity, 4).alias("similarity"))


def compare_documents(pages: DataFrame) -> DataFrame:
    """doc_id, overall_similarity and counts of pages by state, from compare_pages()."""
    return pages.groupBy("doc_id").agg(F.round(F.avg("similarity"), 6).alias("overall_similarity"), *[F.count_if(F.col("state") == s).alias(s) for s in ("same", "modified", "added", "removed")])


def operations_since(ops: DataFrame, marks: DataFrame) -> DataFrame:
    """The operations after each document's mark (doc_id, counter, actor); all of those without one."""
    m = marks.select("doc_id", F.col("counter").alias("mark_counter"), F.col("actor").alias("mark_actor"))
    later = F.col("mark_counter").isNull() | (F.col("counter") > F.col("mark_counter")) | ((F.col("counter") == F.col("mark_counter")) & (F.col("actor") > F.col("mark_actor")))
    return ops.join(m, "doc_id", "left").filter(later).select(ops.columns)


def median_font(fragments: DataFrame) -> DataFrame:
    """doc_id, page_number, median: the upper median of the sizes, 4 at least."""
    at = Window.partitionBy("doc_id", "page_number").orderBy("font_size", "frag_idx")
    rows = fragments.select("doc_id", "page_number", "font_size", F.row_number().over(at).alias("i"), F.count("*").over(at.orderBy().partitionBy("doc_id", "page_number")).alias("n"))
    return rows.filter(F.col("i") == F.floor(F.col("n") / 2) + 1).select("doc_id", "page_number", F.greatest(F.lit(4.0), "font_size").alias("median"))


def caption_splits(rows: DataFrame) -> DataFrame:
    """Adds part: rows of a region in order (doc_id, page_number, frag_idx, text); each caption begins a part."""
    order = Window.partitionBy("doc_id", "page_number").orderBy("frag_idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("part", F.sum(caption_kind(F.col("text")).isNotNull().cast("int")).over(order))


def list_groups(blocks: DataFrame) -> DataFrame:
    """Adds list: consecutive list items of one kind, bulleted or numbered, are one list, numbered from 1; null for other blocks. structure.nested_lists nests by level."""
    marker = list_marker(F.coalesce("text", F.lit("")))
    marked = blocks.withColumn("marker", F.when(marker == "", "").when(marker.rlike("^[0-9]"), "1").otherwise("-"))
    order = Window.partitionBy("doc_id").orderBy("block")
    starts = (F.col("marker") != "") & (F.coalesce(F.lag("marker").over(order), F.lit("")) != F.col("marker"))
    number = F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("list", F.when(F.col("marker") != "", number)).drop("marker")


def square_grid(cells: DataFrame) -> DataFrame:
    """doc_id, row, cells: rows as arrays of one width, without empty rows at the end and empty columns at the right; a blank is text, so a place that a cell covers stays. cells: doc_id, row, col, text."""
    held = cells.filter(F.coalesce("text", F.lit("")) != "")
    size = held.groupBy("doc_id").agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    rows = size.select("doc_id", "last_col", F.explode(F.sequence(F.lit(0), "last_row")).alias("row"))
    texts = held.groupBy("doc_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("by_col"))
    cell = F.transform(F.sequence(F.lit(0), F.col("last_col")), lambda c: F.coalesce(F.try_element_at("by_col", c), F.lit("")))
    return rows.join(texts, ["doc_id", "row"], "left").select("doc_id", "row", cell.alias("cells"))


def expand_spans(cells: DataFrame) -> DataFrame:
    """Each cell (doc_id, row, col, row_span, col_span, text) at all places it covers: its text at the first one, a blank at the others. White space is one blank, | is escaped."""
    down, across = (F.sequence(F.lit(0), F.greatest(F.lit(1), F.col(c)) - 1) for c in ("row_span", "col_span"))
    text = F.replace(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    rows = cells.withColumn("clean", text).withColumn("i", F.explode(down)).withColumn("j", F.explode(across))
    return rows.select("doc_id", (F.col("row") + F.col("i")).alias("row"), (F.col("col") + F.col("j")).alias("col"), F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("clean")).otherwise(" ").alias("text"))


def tables_markdown(grid: DataFrame) -> DataFrame:
    """doc_id, markdown: a pipe table of square_grid()'s rows under a comment with its size; the first row is the header."""
    line = F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size("cells")))
    parts = grid.select("doc_id", "row", F.size("cells").alias("width"), F.when(F.col("row") == 0, F.concat(line, F.lit("\n"), rule)).otherwise(line).alias("line"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda p: p["line"]), "\n")
    head = F.concat(F.lit("<!-- table ("), F.count("*").cast("string"), F.lit("x"), F.max("width").cast("string"), F.lit(") -->\n"))
    return parts.groupBy("doc_id").agg(F.concat(head, ordered).alias("markdown"))


def with_format_error(docs: DataFrame, format_column: str, wanted: str, operation: str) -> DataFrame:
    """Adds error: named where a document's format is not the one that the operation needs."""
    found = F.coalesce(F.col(format_column), F.lit("unknown"))
    return docs.withColumn("error", F.when(found != wanted, F.concat(F.lit(f"{operation} needs {wanted}, this is "), found)))


def session_search(hits: DataFrame, scanned: DataFrame, documents: DataFrame) -> DataFrame:
    """The index's hits, and for documents in which it finds nothing those of a scan: doc_id, block, by (index or scan)."""
    by_index = documents.select("doc_id").distinct().join(hits, "doc_id").select("doc_id", "block", F.lit("index").alias("by"))
    left = documents.select("doc_id").distinct().join(hits.select("doc_id").distinct(), "doc_id", "left_anti")
    return by_index.unionByName(scanned.join(left, "doc_id").select("doc_id", "block", F.lit("scan").alias("by")))


def extract_all(meta: DataFrame, **parts: DataFrame) -> DataFrame:
    """meta with a count column n_<name> for each table of results by doc_id; 0 where a document has none."""
    rows = meta
    for name, found in parts.items():
        rows = rows.join(found.groupBy("doc_id").agg(F.count("*").alias(f"n_{name}")), "doc_id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return rows


def linked_data(meta: DataFrame) -> DataFrame:
    """doc_id, json: a JSON-LD object of a document."""
    body = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("ScholarlyArticle").alias("@type"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("@id"), F.col("title").alias("name"), F.col("words").alias("wordCount"))
    return meta.select("doc_id", F.to_json(body).alias("json"))


def image_size(content: Column) -> Column:
    """struct(media_type, width, height) from the header of PNG, GIF and JPEG bytes; null otherwise, or if a header is cut off."""
    head = F.hex(F.substring(content, 1, 24))
    number = lambda digits: F.conv(digits, 16, 10).cast("long")
    swapped = lambda at: number(F.concat(F.substring(head, at + 2, 2), F.substring(head, at, 2)))
    size = lambda kind, width, height: F.struct(F.lit(kind).alias("media_type"), width.alias("width"), height.alias("height"))
    png, gif = size("image/png", number(F.substring(head, 33, 8)), number(F.substring(head, 41, 8))), size("image/gif", swapped(13), swapped(17))
    frame = F.pandas_udf(_jpeg_frames, "struct<width:long,height:long>")(F.when(head.startswith("FFD8FF"), content))
    found = F.when(head.startswith("89504E470D0A1A0A") & (F.length(content) >= 24), png).when(head.startswith("474946383761") | head.startswith("474946383961"), gif)
    return found.when(frame["width"].isNotNull(), size("image/jpeg", frame["width"], frame["height"]))


def _jpeg_frames(contents: pd.Series) -> pd.DataFrame:
    """Width and height in the first frame header of each JPEG, behind all segments before it."""

    def frame(data: bytes | None) -> tuple[int | None, int | None]:
        at = 2
        while data and at + 9 <= len(data) and data[at] == 0xFF:
            marker = data[at + 1]
            if marker == 0xFF or marker == 1 or 0xD0 <= marker <= 0xD8:  # fill bytes and markers without a segment
                at += 1 if marker == 0xFF else 2
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
            else:
                at += 2 + int.from_bytes(data[at + 2 : at + 4])
        return None, None

    return pd.DataFrame([frame(c) for c in contents], columns=["width", "height"]).astype("Int64")


def ole2_kind(content: Column) -> Column:
    """doc, xls or ppt by the names of streams (UTF-16LE) in an OLE2 container; null if none is there."""
    whole = F.hex(content)
    has = lambda name: whole.contains(name.encode("utf-16-le").hex().upper())
    kind = F.when(has("WordDocument"), "doc").when(has("Workbook") | has("Book"), "xls").when(has("PowerPoint Document"), "ppt")
    return F.when(whole.startswith("D0CF11E0A1B11AE1"), kind)


def hyperlink_target(field: Column) -> Column:
    """The target of a HYPERLINK (or hyperlink) field: what follows the name, up to the next quote if it is quoted, else its first word; null for other fields or without a target."""
    rest = F.regexp_extract(field, r"(?s)^\s*(?:HYPERLINK|hyperlink)\s*(.*)$", 1)
    target = F.when(rest.startswith('"'), F.regexp_extract(rest, r'(?s)^"([^"]*)', 1)).otherwise(F.regexp_extract(rest, r"^(\S*)", 1))
    return F.when(target != "", target)


def text_width(text: Column, size: Column) -> Column:
    """The measure of a text: half the size for a character, the whole size for a wide one (CJK, kana, Hangul, full-width)."""
    wide = F.length(text) - F.length(F.regexp_replace(text, r"[ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦]", ""))
    return (F.length(text) + wide) * size * 0.5


TEXTS_AT_ONCE = 256  # texts that a provider is given at a time


def embed(chunks: DataFrame, provider, dimensions: int, text: str = "content") -> DataFrame:
    """Adds embedding. provider: a function from a list of texts to as many vectors, which is called for batches inside of tasks."""
    def run(texts: pd.Series) -> pd.Series:
        kept: list[np.ndarray] = []
        for first in range(0, len(texts), TEXTS_AT_ONCE):
            found = provider([t or "" for t in texts.iloc[first : first + TEXTS_AT_ONCE]])
            if any(len(v) != dimensions for v in found):
                raise ValueError(f"the provider must give vectors of {dimensions} numbers")
            kept += [np.asarray(v, np.float64) for v in found]
        return pd.Series(kept)

    return chunks.withColumn("embedding", F.pandas_udf(run, ArrayType(DoubleType()))(F.col(text)))


def upsert_vectors(stored: DataFrame, arrived: DataFrame, key: str = "vec_id") -> DataFrame:
    """The store after an addition: arrived rows take the place of those with their key."""
    return stored.join(arrived.select(key), key, "left_anti").unionByName(arrived.select(stored.columns))


def delete_vectors(stored: DataFrame, keys: DataFrame, key: str = "vec_id") -> DataFrame:
    return stored.join(keys.select(key).distinct(), key, "left_anti")
