from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from docframe.operators import projections as pj
from docframe.sources import readers


def jpeg(*segments, frame=b"\xff\xc0\x00\x11\x08\x00\x07\x01\x02\x03"):
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + (len(b) + 2).to_bytes(2) + b for m, b in segments) + frame + b"\x00" * 9


def test_image_sizes(spark):
    cases = {
        0: (b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\x00\x00\x00\x05\x00\x00\x00\x09", ("image/png", 5, 9)), 1: (b"GIF89a\x02\x01\x03\x00", ("image/gif", 258, 3)), 2: (jpeg((0xE0, b"JFIF")), ("image/jpeg", 258, 7)),
        3: (jpeg((0xE1, b"\xff\xc0" * 9000), (0xC4, b"x"), frame=b"\xff\xff\xc2\x00\x11\x08\x00\x07\x01\x02\x03"), ("image/jpeg", 258, 7)), 4: (jpeg(frame=b"\xff\xc0\x00")[:6], None), 5: (b"", None), 6: (None, None), 7: (b"\xff\xd8\xffnone at all", None),
    }
    df = spark.createDataFrame([(i, c) for i, (c, _) in cases.items()], "i int, content binary").select("i", pj.image_size(F.col("content")).alias("s"))
    assert {r["i"]: r["s"] and tuple(r["s"]) for r in df.collect()} == {i: want for i, (_, want) in cases.items()}


def test_hyperlink_targets(spark):
    cases = {'HYPERLINK "https://example.invalid/a b" ': "https://example.invalid/a b", r"HYPERLINK https://example.invalid/p \l anchor": "https://example.invalid/p", '  hyperlink "mailto:a@b.invalid"': "mailto:a@b.invalid", "PAGE": None, "HYPERLINK": None, "HYPERLINK   ": None, 'HYPERLINK ""': None, "": None, None: None, "HyperLink x": None, r'HYPERLINK \o "tip" x': r"\o", 'HYPERLINK "open': "open"}
    df = spark.createDataFrame([(c,) for c in cases], "f string").select("f", pj.hyperlink_target(F.col("f")).alias("t"))
    assert {r["f"]: r["t"] for r in df.collect()} == cases


def test_square_grid_keeps_covered_places(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 2, ""), (1, 2, 1, " "), (1, 5, 9, ""), (1, 6, 0, None), (2, 0, 0, "")], "doc_id long, row int, col int, text string")
    assert sorted((r["row"], r["cells"]) for r in pj.square_grid(cells).collect()) == [(0, ["a", ""]), (1, ["", ""]), (2, ["", " "])]


def test_lists_of_two_kinds_are_two(spark):
    rows = [(1, i, t) for i, t in enumerate(["• a", "• b", "1. c", "2) d", "text", "3. e", "• f", None, "• g"])]
    got = pj.list_groups(spark.createDataFrame(rows, "doc_id long, block int, text string")).orderBy("block").collect()
    assert [r["list"] for r in got] == [1, 1, 2, 2, None, 3, 4, None, 5]


def test_hidden_text_is_whole(spark):
    runs = spark.createDataFrame([(1, 0, 0, 0, "x" * 500, None, True), (1, 0, 1, 0, "seen", 12.0, None), (1, 0, 2, 0, "tiny", 1.0, False), (1, 0, 3, 0, " ", 1.0, True)], "doc_id long, section int, block int, run int, text string, size double, hidden boolean")
    assert sorted(len(r["text"]) for r in pj.scan_semantic(pj.flag_unreadable(runs)).collect()) == [4, 500]


def test_files_in_containers(spark):
    def packed(*names, mimetype=None):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            if mimetype:
                z.writestr("mimetype", mimetype)
            for n in names:
                z.writestr(n, "<x/>")
        return buffer.getvalue()

    ole = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
    cases = [
        (packed("word/document.xml"), "docx", None), (packed("xl/workbook.xml"), "xlsx", None), (packed("content.xml", mimetype="application/vnd.oasis.opendocument.spreadsheet"), "ods", None), (packed("other.xml"), None, "unknown"), (b"PK\x03\x04 broken", None, "damaged"),
        (ole + "WordDocument".encode("utf-16-le"), "doc", None), (ole + "Workbook".encode("utf-16-le"), "xls", None), (ole, None, "unknown"), (b"%PDF-1.7", "pdf", None), (b"\x89PNG\r\n\x1a\n", None, "unsupported"), (b"%!PS", None, "unsupported"),
        (b"<html><p>x", "html", None), (b"plain words", "txt", None), (b"", None, "unknown"), (None, None, "unknown"), (b"\x00\x01\x02", None, "unknown"),
    ]
    files = spark.createDataFrame([(i, None, c) for i, (c, _, _) in enumerate(cases)], "doc_id long, hint string, content binary")
    assert {r["doc_id"]: (r["format"], r["error_kind"]) for r in readers.detect_files(files).collect()} == {i: (f, e) for i, (_, f, e) in enumerate(cases)}


def test_outline_hangs_headings_in_headings(spark):
    blocks = spark.createDataFrame([(1, 0, "heading", 1, "a"), (1, 1, "paragraph", 0, "x"), (1, 2, "heading", 3, "b"), (1, 3, "heading", 2, "c"), (1, 4, "heading", 2, "d"), (2, 0, "paragraph", 0, "y")], "doc_id long, block int, kind string, level int, text string")
    assert [tuple(r) for r in pj.outline(blocks).orderBy("doc_id", "block").collect()] == [(1, 0, 1, "a", None), (1, 2, 3, "b", 0), (1, 3, 2, "c", 0), (1, 4, 2, "d", 0)]


def test_identifiers_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "doi:10.1234/x.7, 10.1234/x.7 and arXiv:2101.00007; PMID: 12"), (2, None), (3, ""), (4, "none")], "doc_id long, text string")
    got = sorted(tuple(r) for r in pj.identifiers(docs).collect())
    assert [(d, k) for d, k, _ in got] == [(1, "arxiv"), (1, "doi"), (1, "pmid")]


def test_a_provider_is_given_few_texts_at_a_time(spark):
    """Vectors of a whole batch of texts don't lie in memory as lists of numbers."""
    def provider(texts):
        assert len(texts) <= 256
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.range(1000).coalesce(1).select(F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("content"))
    assert all(r["embedding"] == [float(len(r["content"])), 1.0] for r in pj.embed(rows, provider, 2).collect())
