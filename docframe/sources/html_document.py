"""HTML pages as documents: runs with their styles, blocks, nested lists, table cells with spans, and text that a page's own rules hide.

A page becomes a table of tokens (JVM-side, by one pattern). Its style rules are rows too, and are joined to the elements that they name:
a tag, a class or an id. Which elements are open at a token is the one thing that needs a stack: _OpenElements, small and over a page's
tags alone, gives each token the nearest open element of each scope and the style in force. All else is windows and groups over tokens.

Defined cases: a null page has no rows; unclosed p, li, td, th, tr and inline elements end where the next block begins or their block ends;
a closing tag without its opening one is ignored; text of script and style is no text; an element that is never closed reaches to the end
of the page; text in a list outside of its items, or in a table outside of its cells and caption, is not part of the document. Rows are
kept apart by `key`; pages of equal keys must not occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docframe.functions.text import style_hides
from docframe.sources.readers import unescape, unescape_xml
from docframe.sources.sinks import written

# Elements without content, elements that end a paragraph, and what a tag says about its text.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "caption", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li",
    "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
TAG_STYLES = {"bold": ("b", "strong"), "italic": ("i", "em", "cite", "var"), "strike": ("s", "del", "strike"), "underline": ("u", "ins"), "code": ("code", "kbd", "samp", "tt"), "superscript": ("sup",), "subscript": ("sub",)}
STYLES = ["hidden", *TAG_STYLES]
SCOPES = {"head": ("head",), "title": ("title",), "para": ("p", *HEADINGS), "item": ("li",), "list": ("ul", "ol"), "cell": ("td", "th"), "row": ("tr",), "table": ("table",), "thead": ("thead",), "caption": ("caption",), "quote": ("blockquote",), "pre": ("pre",), "link": ("a",)}

TOKEN = r"""(?is)<!--.*?(?:-->|\z)|<(script|style)(?=[\s>/]).*?(?:</\1[^>]*+>|\z)|<[!?][^>]*+(?:>|\z)|<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""


def tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, at (place in the page), kind (open, close, text), tag, attrs, text."""
    rows = pages.select(F.col(key), F.posexplode(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))).alias("at", "part"))
    rows = rows.filter(~F.col("part").rlike(r"(?i)^<(?:[!?]|(?:script|style)[\s>/])"))
    tag = F.lower(F.regexp_extract("part", r"^</?([^\s>/]*)", 1))
    is_tag = F.col("part").rlike(r"(?s)^<.*>$")
    rows = rows.withColumn("tag", F.when(is_tag, tag)).filter("tag is null or tag <> ''")
    kind = F.when(~is_tag, "text").when(F.col("part").startswith("</"), "close").when(F.col("tag").isin(*VOID) | F.col("part").rlike(r"/\s*>$"), "void").otherwise("open")
    attrs = F.when(is_tag, F.regexp_replace("part", r"(?s)^</?[^\s>/]*|/?\s*>$", ""))
    return rows.select(key, "at", kind.alias("kind"), "tag", attrs.alias("attrs"), F.when(~is_tag, unescape(F.col("part"))).alias("text"))


def attribute(attrs: Column, name: str) -> Column:
    """Its value, '' if it has none, null if it is not there. Values may be quoted or bare; names in quoted values don't count. Of references, numbers and XML's five names are resolved."""
    pair = r"""(?is)([^\s=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']\S*)|))?"""
    names = F.regexp_extract_all(attrs, F.lit(pair), F.lit(1))
    at = F.array_position(F.transform(names, F.lower), F.lit(name))
    value = F.concat(*[F.get(F.regexp_extract_all(attrs, F.lit(pair), F.lit(g)), at.cast("int") - 1) for g in (2, 3, 4)])
    return F.when(at > 0, unescape_xml(value))


def style_rules(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, rule, kind (tag, class, id), name, declarations: the rules of a page's style elements whose selector is a tag, a class or an id, alone or behind a tag.

    Rules in an at-rule's block count as others do. Selectors with combinators, pseudo-classes or attributes are left out.
    """
    sheets = F.regexp_extract_all(html, F.lit(r"(?is)<style(?=[\s>/])[^>]*+>(.*?)(?:</style|\z)"), F.lit(1))
    css = F.regexp_replace(F.array_join(sheets, "\n"), r"(?s)/\*.*?(?:\*/|\z)", "")
    blocks = F.regexp_extract_all(css, F.lit(r"[^{};]*\{[^{}]*\}"), F.lit(0))
    rows = pages.select(F.col(key), F.posexplode(blocks).alias("rule", "block"))
    rows = rows.select(key, "rule", F.explode(F.split(F.regexp_extract("block", r"^([^{]*)", 1), ",")).alias("selector"), F.trim(F.regexp_extract("block", r"(?s)\{(.*)\}", 1)).alias("declarations"))
    selector = F.lower(F.trim(F.regexp_replace("selector", r"\s+", " ")))
    kind = F.when(selector.rlike(r"^[a-z0-9]*\.[a-z0-9_-]+$"), "class").when(selector.rlike(r"^[a-z0-9]*#[a-z0-9_-]+$"), "id").when(selector.rlike("^[a-z0-9]+$"), "tag")
    return rows.select(key, "rule", kind.alias("kind"), F.regexp_extract(selector, r"([a-z0-9_-]+)$", 1).alias("name"), "declarations").filter("kind is not null and declarations <> ''")


def element_styles(found: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """key, at, and what an element declares about its text (null: nothing); elements that declare nothing may be left out. In the cascade the tag's rules come first, then those of its classes as written, of its id, then its own style."""
    opened = found.filter("kind = 'open'")
    styled = [tag for tags in TAG_STYLES.values() for tag in tags]
    elements = opened.filter((F.trim("attrs") != "") | F.col("tag").isin(*styled)).select(key, "at", "tag", *[attribute(F.col("attrs"), a).alias(a) for a in ("class", "id", "style", "hidden", "aria-hidden")])
    said = lambda kind, name, place: F.struct(F.lit(kind).alias("kind"), F.lower(name).alias("name"), place.alias("place"))
    classes = F.transform(F.filter(F.split(F.coalesce("class", F.lit("")), r"\s+"), lambda c: c != ""), lambda c, i: said("class", c, i + 1))
    ids = F.when(F.col("id").isNotNull(), F.array(said("id", F.trim("id"), F.lit(1_000_000)))).otherwise(F.array().cast("array<struct<kind:string,name:string,place:int>>"))
    names = elements.select(key, "at", F.inline(F.concat(classes, ids)))
    by_tag = opened.select(key, "at", F.lit("tag").alias("kind"), F.col("tag").alias("name"), F.lit(0).alias("place"))
    hits = names.join(rules, [key, "kind", "name"]).unionByName(by_tag.join(rules.filter("kind = 'tag'"), [key, "kind", "name"]))
    matched = hits.groupBy(key, "at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "rule", "declarations"))), lambda x: x["declarations"]), ";").alias("ruled"))
    rows = elements.join(matched, [key, "at"], "full")
    css = F.lower(F.regexp_replace(F.concat_ws(";", "ruled", "style"), r"\s+", ""))
    last = lambda pattern: F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(css, F.lit(rf"(?:^|;){pattern}:([^;]*)"), F.lit(1))), -1)
    weight, slope, line = last("font-weight"), last("font-style"), last("text-decoration(?:-line)?")
    tagged = {name: F.when(F.col("tag").isin(*tags), True) for name, tags in TAG_STYLES.items()}
    bold = F.when(weight != "", F.coalesce(weight.try_cast("int") >= 600, weight.isin("bold", "bolder")))
    found_styles = {
        **tagged,
        "hidden": F.when(style_hides(css) | F.col("hidden").isNotNull() | (F.col("aria-hidden") == "true"), True),
        "bold": F.coalesce(bold, tagged["bold"]),
        "italic": F.coalesce(F.when(slope != "", slope.isin("italic", "oblique")), tagged["italic"]),
        "underline": F.coalesce(F.when(line != "", line.contains("underline")), tagged["underline"]),
        "strike": F.coalesce(F.when(line != "", line.contains("line-through")), tagged["strike"]),
    }
    return rows.select(key, "at", *[found_styles[s].alias(s) for s in STYLES])


class _OpenElements:
    """For each token of pages that come one after the other, sorted: (how many lists are open, the level of the heading or 0, the attributes of the link or None, the nearest open element of each scope or -1, the style in force)."""

    def __init__(self) -> None:
        self.key, self.stack = None, []  # of an open element: place, tag, style, scopes, (open lists, heading, link)
        self.bottom = (-1, "", (False,) * len(STYLES), [-1] * len(SCOPES), (0, 0, None))

    def close_to(self, ends: tuple[str, ...], walls: tuple[str, ...]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][1] in ends:
                del self.stack[i:]
                return
            if self.stack[i][1] in walls:
                return

    def before(self, kind: str, tag: str) -> None:
        """Ends what this tag ends."""
        if kind in ("open", "void") and tag in BLOCKS:
            while self.stack and (self.stack[-1][1] not in BLOCKS or self.stack[-1][1] == "p" or self.stack[-1][1] in HEADINGS):
                self.stack.pop()
            if tag == "li":
                self.close_to(("li",), ("ul", "ol", "td", "th", "table"))
            elif tag in ("td", "th"):
                self.close_to(("td", "th"), ("tr", "table"))
            elif tag == "tr":
                self.close_to(("tr",), ("table",))
        elif kind == "close":
            if tag not in BLOCKS:
                walls = BLOCKS
            elif tag in ("td", "th", "tr", "thead", "tbody", "tfoot"):
                walls = ("table",)
            else:
                walls = () if tag == "table" else ("td", "th")
            self.close_to((tag,), walls)

    def follow(self, keys: list, places: list[int], kinds: list[str], tags: list[str], attrs: list[str], styles: list[list]) -> list[tuple]:
        names, out = list(SCOPES.values()), []
        for key, place, kind, tag, said, own in zip(keys, places, kinds, tags, attrs, styles, strict=True):
            if key != self.key:
                self.key, self.stack = key, []
            self.before(kind, tag)
            _, _, style, scopes, (lists, heading, link) = self.stack[-1] if self.stack else self.bottom
            if kind == "open":
                inner = tuple(b if a is None else bool(a) or (i == 0 and b) for i, (a, b) in enumerate(zip(own, style, strict=True)))
                out.append((lists, heading, link, *scopes, *inner))
                around = (lists + (tag in ("ul", "ol")), int(tag[1]) if tag in HEADINGS else 0 if tag == "p" else heading, said if tag == "a" else link)
                self.stack.append((place, tag, inner, [place if tag in n else s for n, s in zip(names, scopes, strict=True)], around))
            else:
                out.append((lists, heading, link, *scopes, *style))
        return out


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """tokens() with the number of open lists (lists), the level of the heading that it lies in or 0 (heading), the attributes of its link (link), the place of the nearest open element of each scope (in_<scope>, -1: none) and the style in force at the token."""
    found = tokens(pages, key, html)
    styled = found.join(element_styles(found, style_rules(pages, key, html), key), [key, "at"], "left")
    kind = dict(styled.dtypes)[key]
    fields = f"{key} {kind}, at int, kind string, tag string, attrs string, text string, lists int, heading int, link string, " + ", ".join([*[f"in_{s} int" for s in SCOPES], *[f"{s} boolean" for s in STYLES]])
    schema = to_arrow_schema(StructType.fromDDL(fields))
    given = schema.names[:6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _OpenElements()
        for batch in batches:
            styles = list(zip(*(batch.column(s).to_pylist() for s in STYLES), strict=True))
            made = state.follow(*(batch.column(c).to_pylist() for c in given[:5]), styles)
            columns = zip(*made, strict=True) if made else [()] * (len(schema) - len(given))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(schema.field(c).type) for c in given), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[len(given) :], strict=True))], schema=schema)

    return styled.select(*given, *STYLES).repartition(key).sortWithinPartitions(key, "at").mapInArrow(run, fields)


def _in_document(rows: DataFrame) -> DataFrame:
    """Text outside of the head, of lists' gaps and of tables' gaps."""
    outer = F.greatest("in_item", "in_cell", "in_caption")
    return rows.filter("in_head < 0 and in_title < 0").filter((outer > F.col("in_list")) | (F.col("in_list") < 0) | (F.col("in_table") > F.col("in_list"))).filter((F.greatest("in_cell", "in_caption") > F.col("in_table")) | (F.col("in_table") < 0))


def runs(found: DataFrame, key: str = "page_id") -> DataFrame:
    """key, block, at, text, href, styles and scopes of each run of text; a block ends at each tag of a block. White space is one blank, but not in pre."""
    edge = F.col("tag").isin(*BLOCKS) & (F.col("kind") != "text")
    order = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = found.withColumn("block", F.sum(F.when(edge, 1).otherwise(0)).over(order))
    text = F.when(F.col("tag") == "br", "\n").when(F.col("in_pre") >= 0, F.col("text")).otherwise(F.regexp_replace("text", r"\s+", " "))
    rows = _in_document(rows.filter("kind = 'text' or tag = 'br'")).withColumn("text", text).filter("text <> ''")
    return rows.withColumn("href", F.when(F.col("in_link") >= 0, attribute(F.col("link"), "href"))).drop("attrs", "kind", "tag", "link")


def blocks(found: DataFrame, key: str = "page_id") -> DataFrame:
    """key, block, kind (heading, list_item, cell, caption, quote, code, paragraph), level, text, hidden, and the scopes in_item, in_list, in_cell, in_table that it lies in.

    level: of a heading 1 to 6, of a list item the number of lists around it. hidden: all of its text is.
    """
    parts = F.sort_array(F.collect_list(F.struct("at", "text", "hidden")))
    scopes = ["lists", "heading", *[f"in_{s}" for s in SCOPES]]
    whole = runs(found, key).groupBy(key, "block").agg(parts.alias("parts"), F.min("hidden").alias("hidden"), *[F.first(s).alias(s) for s in scopes])
    raw = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    text = F.when(F.col("in_pre") >= 0, F.regexp_replace(raw, r"^\n+|\n+$", "")).otherwise(F.trim(F.regexp_replace(F.regexp_replace(raw, r" *\n *", "\n"), r" +|^\n+|\n+$", " ")))
    whole = whole.withColumn("text", text).filter("trim(text) <> ''")
    inner = F.greatest("in_item", "in_cell", "in_caption", "in_quote")
    kind = (
        F.when(F.col("in_pre") >= 0, "code").when(F.col("heading") > 0, "heading").when(inner < 0, "paragraph")
        .when(inner == F.col("in_item"), "list_item").when(inner == F.col("in_cell"), "cell").when(inner == F.col("in_caption"), "caption").otherwise("quote")
    )
    level = F.when(kind == "heading", F.col("heading")).when(kind == "list_item", F.col("lists")).otherwise(0)
    return whole.select(key, "block", kind.alias("kind"), level.alias("level"), "text", "hidden", "in_item", "in_list", "in_cell", "in_table", "in_caption")


def list_items(found: DataFrame, key: str = "page_id") -> DataFrame:
    """key, list, item (places of their tags), parent_item (of the item that the list lies in, or -1), depth from 1, ordered, number, checked (of a task, else null), text (of the item without the lists in it)."""
    found = written(found)
    lists = found.filter("kind = 'open' and tag in ('ul', 'ol')").select(key, F.col("at").alias("list"), F.col("in_item").alias("parent_item"), (F.col("lists") + 1).alias("depth"), (F.col("tag") == "ol").alias("ordered"), F.coalesce(attribute(F.col("attrs"), "start").try_cast("bigint"), F.lit(1)).alias("start"))
    after = Window.partitionBy(key).orderBy("at")
    box = (F.lead("tag").over(after) == "input") & (F.lower(attribute(F.lead("attrs").over(after), "type")) == "checkbox")
    marked = found.filter("kind <> 'text' or trim(text) <> ''").withColumn("checked", F.when(box, attribute(F.lead("attrs").over(after), "checked").isNotNull()))
    items = marked.filter("kind = 'open' and tag = 'li' and in_list >= 0").select(key, F.col("at").alias("item"), F.col("in_list").alias("list"), "checked")
    items = items.withColumn("place", F.row_number().over(Window.partitionBy(key, "list").orderBy("item")))
    own = blocks(found, key).filter("in_item >= 0").groupBy(key, F.col("in_item").alias("item")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda b: b["text"]), "\n").alias("text"))
    rows = items.join(lists, [key, "list"]).join(own, [key, "item"], "left")
    return rows.select(key, "list", "item", "parent_item", "depth", "ordered", (F.col("start") + F.col("place") - 1).alias("number"), "checked", F.coalesce("text", F.lit("")).alias("text"))


def _columns(rows: list[tuple[int, int, int]]) -> list[int]:
    """First columns of a table's cells (row, col_span, row_span), in order: a cell takes the first free place behind those before it in its row."""
    taken: dict[int, int] = {}  # column -> first row that is free again
    out, row, at = [], -1, 0
    for r, across, down in rows:
        if r != row:
            row, at = r, 0
        while taken.get(at, 0) > r:
            at += 1
        out.append(at)
        for c in range(at, at + across):
            taken[c] = r + down
        at += across
    return out


def cells(found: DataFrame, key: str = "page_id") -> DataFrame:
    """key, table, row, col, row_span, col_span, is_header, caption, text: spans at least 1 and at most 1,000; rows without cells don't count; a header row lies in thead or has only th, from the first row on."""
    found = written(found)
    opened = found.filter("kind = 'open' and tag in ('td', 'th') and in_table >= 0 and in_row > in_table")
    span = lambda name: F.least(F.lit(1000), F.greatest(F.lit(1), F.coalesce(attribute(F.col("attrs"), name).try_cast("int"), F.lit(1))))
    rows = opened.select(key, F.col("at").alias("cell"), F.col("in_table").alias("table"), F.col("in_row"), (F.col("tag") == "th").alias("th"), (F.col("in_thead") > F.col("in_table")).alias("head"), span("rowspan").alias("row_span"), span("colspan").alias("col_span"))
    rows = rows.withColumn("row", F.dense_rank().over(Window.partitionBy(key, "table").orderBy("in_row")) - 1)
    whole = Window.partitionBy(key, "table", "row")
    rows = rows.withColumn("headed", F.min(F.col("th") | F.col("head")).over(whole))
    until = Window.partitionBy(key, "table").orderBy("row").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("is_header", F.min("headed").over(until))
    said = written(blocks(found, key).filter("in_cell >= 0 or kind = 'caption'"))
    texts = said.filter("in_cell >= 0").groupBy(key, F.col("in_cell").alias("cell")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda b: b["text"]), "\n").alias("text"))
    captions = said.filter("kind = 'caption'").groupBy(key, F.col("in_table").alias("table")).agg(F.min_by("text", "block").alias("caption"))
    rows = rows.join(texts, [key, "cell"], "left").join(captions, [key, "table"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    parts = F.sort_array(F.collect_list(F.struct("cell", "row", "col_span", "row_span", "is_header", "text")))
    tables = rows.groupBy(key, "table").agg(F.first("caption").alias("caption"), parts.alias("parts"))
    place = F.pandas_udf(lambda s: s.map(lambda p: _columns([(x["row"], x["col_span"], x["row_span"]) for x in p])), "array<int>")
    tables = tables.withColumn("cols", place("parts"))
    return tables.select(key, "table", "caption", F.explode(F.arrays_zip("parts", "cols")).alias("x")).select(key, "table", "x.parts.row", F.col("x.cols").alias("col"), "x.parts.row_span", "x.parts.col_span", "x.parts.is_header", "caption", "x.parts.text")


def hidden_text(found: DataFrame, key: str = "page_id") -> DataFrame:
    """key, block, text: what a page holds but does not show, whole; runs of a block that lie side by side are one row."""
    order = Window.partitionBy(key, "block").orderBy("at")
    rows = runs(found, key).withColumn("group", F.sum(F.when(F.col("hidden") & ~F.coalesce(F.lag("hidden").over(order), F.lit(False)), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda p: p["text"]), "")
    return rows.filter("hidden").groupBy(key, "block", "group").agg(F.trim(F.regexp_replace(parts, r"\s+", " ")).alias("text")).filter("text <> ''").select(key, "block", "text")


def title(found: DataFrame, key: str = "page_id") -> DataFrame:
    """key, title: the text of the first title element in the head that has one."""
    rows = found.filter("kind = 'text' and in_title >= 0 and in_head >= 0").groupBy(key, "in_title").agg(F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda p: p["text"]), "")).alias("title"))
    return rows.filter("title <> ''").groupBy(key).agg(F.min_by("title", "in_title").alias("title"))
