from __future__ import annotations

import io
import zipfile

from pyspark.sql import Row
from pyspark.sql import functions as F

from docframe.functions import text as tx
from docframe.sources import detect, readers, sinks


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_csv_quotes_lines_and_blanks(spark):
    source = 'region,note\nnorth,"a, b"\n\nsouth,"he said ""hi""\nthen left"\n'
    cells = {(r["row"], r["col"]): r["text"] for r in readers.csv_cells(docs(spark, source, None, "")).filter("doc_id = 0").collect()}
    assert cells == {(0, 0): "region", (0, 1): "note", (1, 0): "north", (1, 1): "a, b", (2, 0): "south", (2, 1): 'he said "hi"\nthen left'}


def test_markdown_blocks(spark):
    source = "# Title\n\nsome text\nwrapped\n\n- one\n  - two\n\n```\ncode # no heading\n```\n\n> quoted\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nUnder\n-----\n\n***\n"
    got = [(r["kind"], r["level"], r["text"]) for r in readers.markdown_blocks(docs(spark, source)).orderBy("block").collect()]
    assert got == [
        ("heading", 1, "Title"), ("paragraph", 0, "some text wrapped"), ("list_item", 0, "one"), ("list_item", 1, "two"), ("code", 0, "code # no heading"), ("quote", 0, "quoted"),
        ("table_row", 0, "| a | b |"), ("table_row", 0, "| 1 | 2 |"), ("heading", 2, "Under"), ("divider", 0, "***"),
    ]


def test_markdown_round_trip(spark):
    source = "# T\n\nbody text\n\n- item\n\n> said"
    blocks = readers.markdown_blocks(docs(spark, source))
    assert sinks.convert(blocks, "md").first()["markdown"] == source
    assert sinks.convert(blocks, "html").first()["html"] == "<h1>T</h1>\n<p>body text</p>\n<li>item</li>\n<blockquote>said</blockquote>"
    assert "body text" in sinks.convert(blocks, "txt").first()["text"]


def test_html_blocks_and_hidden(spark):
    html = '<html><body><h2>A &amp; B</h2><p style="display: none">secret</p><p>shown <b>text</b></p><script>x("</p>")</script><ul><li>i</ul></body>'
    rows = [(r["kind"], r["level"], r["text"], r["hidden"]) for r in readers.html_blocks(docs(spark, html), "text").orderBy("block").collect()]
    assert rows == [("heading", 2, "A & B", False), ("paragraph", 0, "secret", True), ("paragraph", 0, "shown text", False), ("list_item", 0, "i", False)]


def package(**members):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return data.getvalue()


def test_packages(spark):
    docx = package(**{"word/document.xml": '<w:document><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t xml:space="preserve">one </w:t></w:r><w:r><w:t>two &amp; three</w:t></w:r></w:p></w:body></w:document>'})
    xlsx = package(**{"xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><t>x</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2.5</v></c></row></sheetData></worksheet>'})
    epub = package(mimetype="application/epub+zip", **{"o/c.opf": '<package><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>', "o/a.xhtml": "<p>first</p>", "o/b.xhtml": "<p>second</p>"})
    odt = package(mimetype="application/vnd.oasis.opendocument.text", **{"content.xml": '<office:text><text:h text:outline-level="2">H</text:h><text:p>para</text:p></office:text>'})
    files = spark.createDataFrame([(0, docx), (1, xlsx), (2, epub), (3, odt), (4, b"PK\x03\x04broken"), (5, None)], "doc_id long, content binary")
    members = readers.zip_members(files).cache()
    assert {r["doc_id"]: r["format"] for r in readers.package_formats(members).collect()} == {0: "docx", 1: "xlsx", 2: "epub", 3: "odt"}
    blocks = [(r["doc_id"], r["kind"], r["level"], r["text"]) for r in readers.office_blocks(members).orderBy("doc_id", "block").collect()]
    assert blocks == [(0, "heading", 1, "Head"), (0, "paragraph", 0, "one two & three"), (3, "heading", 2, "H"), (3, "paragraph", 0, "para")]
    assert {(r["ref"], r["text"]) for r in readers.sheet_cells(members).collect()} == {("A1", "name"), ("B1", "2.5")}
    assert [r["html"] for r in readers.epub_pages(members).orderBy("position").collect()] == ["<p>first</p>", "<p>second</p>"]
    assert {r["doc_id"]: r["error_kind"] for r in readers.parse_errors(members).collect()} == {4: "damaged", 5: "damaged"}


def test_rtf(spark):
    source = r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\f0\fs24 Caf\'e9 {\b bold}\par next \{x\}}"
    assert readers.rtf_text(docs(spark, source)).first()["text"] == "Café bold\nnext {x}"


def test_detect(spark):
    raw = [b"", b"junk %PDF-1.4", b"PK\x03\x04", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"{\\rtf1", b"<!DOCTYPE html><html>", b"a,b\n1,2\n", b"# head\ntext", b"plain words", b"\x89PNG", b"a\0b"]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, content binary").select("i", detect.detect(F.col("content")).alias("f")).orderBy("i").collect()
    assert [r["f"] for r in rows] == [None, "pdf", "zip", "ole2", "rtf", "html", "csv", "md", "txt", "png", None]
    assert detect.formats(spark).count() == len(detect.FORMATS)


def test_scalar_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert value(tx.number_text(F.lit(3.0))) == "3" and value(tx.number_text(F.lit(2.5))) == "2.5" and value(tx.number_text(F.lit(float("nan")))) == ""
    assert value(tx.date_of_serial(F.lit(1.0))) == "1900-01-01" and value(tx.date_of_serial(F.lit(45292.5))) == "2024-01-01 12:00:00" and value(tx.date_of_serial(F.lit(-1.0))) is None
    assert value(tx.is_date_format(F.lit(14), F.lit(None))) and value(tx.is_date_format(F.lit(164), F.lit("yyyy-mm"))) and not value(tx.is_date_format(F.lit(164), F.lit('0.0 "days"')))
    assert value(tx.style_hides(F.lit("opacity: 0"))) and not value(tx.style_hides(F.lit("opacity: 0.5"))) and value(tx.style_hides(F.lit("color:#fff; background:white")))
    assert value(tx.caption_kind(F.lit("Fig. 3: it"))) == "figure" and value(tx.caption_kind(F.lit("Figures show"))) is None
    assert value(tx.list_marker(F.lit("12) item"))) == "12)" and value(tx.list_marker(F.lit("1234. no"))) == ""


def test_tables_of_documents(spark, tmp_path):
    blocks = readers.text_blocks(docs(spark, "a\n\nb", "c"))
    sinks.write_tables({"blocks": blocks}, str(tmp_path / "t"))
    assert {r["text"] for r in sinks.read_document(spark, str(tmp_path / "t"), "blocks", 0).collect()} == {"a", "b"}
    old = spark.createDataFrame([Row(content=b"x")]).withColumn("doc_hash", F.sha2("content", 256))
    assert sinks.new_documents(spark.createDataFrame([Row(content=b"x"), Row(content=b"y")]), old).count() == 1


def test_accents_and_formulas(spark):
    from docframe.functions.accents import normalize_diacritics
    from docframe.functions.formulas import is_formula, to_latex

    rows = docs(spark, "caf e´ ¨ıve", "x^2 ~ y", "∑ x ≤ ∞", None)
    assert [r["t"] for r in rows.select(normalize_diacritics(F.col("text")).alias("t"), "doc_id").orderBy("doc_id").collect()] == ["caf é ïve", "x^2 ~ y", "∑ x ≤ ∞", None]
    third = rows.filter("doc_id = 2")
    assert third.select(to_latex(F.col("text")).alias("t")).first()["t"] == "\\sum x \\leq \\infty" and third.filter(is_formula(F.col("text"))).count() == 1


def test_typeset_is_found_again(spark):
    from docframe.operators import layout, typeset

    blocks = readers.markdown_blocks(docs(spark, "# Head\n\n" + "word " * 200 + "\n\n- item"))
    fragments = typeset.typeset(blocks)
    assert fragments.columns == typeset.FRAGMENTS and fragments.agg(F.max("width")).first()[0] <= 468
    assert layout.scan(fragments, typeset.page_sizes(fragments)).isEmpty()
    found = [(r["kind"], len(r["text"].split())) for r in layout.blocks(fragments).orderBy("page_number", "block_idx").collect()]
    assert found == [("heading", 1), ("paragraph", 200), ("paragraph", 1)]
