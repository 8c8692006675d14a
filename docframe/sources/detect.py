"""Format detection in SQL expressions, and the catalogue of formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, label, media type, extensions, whether it is laid out in pages, whether it is read.
FORMATS = [
    ("pdf", "PDF", "application/pdf", "pdf", True, False),
    ("docx", "Word", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx", False, True),
    ("xlsx", "Excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsx", False, True),
    ("pptx", "PowerPoint", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "pptx", True, True),
    ("doc", "Word 97-2003", "application/msword", "doc", False, False),
    ("xls", "Excel 97-2003", "application/vnd.ms-excel", "xls", False, False),
    ("ppt", "PowerPoint 97-2003", "application/vnd.ms-powerpoint", "ppt", True, False),
    ("odt", "OpenDocument text", "application/vnd.oasis.opendocument.text", "odt", False, True),
    ("ods", "OpenDocument sheet", "application/vnd.oasis.opendocument.spreadsheet", "ods", False, True),
    ("odp", "OpenDocument slides", "application/vnd.oasis.opendocument.presentation", "odp", True, True),
    ("rtf", "Rich text", "application/rtf", "rtf", False, True),
    ("epub", "EPUB", "application/epub+zip", "epub", False, True),
    ("html", "HTML", "text/html", "html,htm", False, True),
    ("md", "Markdown", "text/markdown", "md,markdown", False, True),
    ("csv", "Delimited text", "text/csv", "csv,tsv", False, True),
    ("txt", "Plain text", "text/plain", "txt,text", False, True),
]
HTML_TAGS = "html|head|body|div|span|p|a|table|ul|ol|li|h1|h2|h3|h4|h5|h6|br|img|section|article|main"


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "id string, label string, media_type string, extensions string, paginated boolean, supported boolean")


def looks_like_html(text: Column) -> Column:
    low = F.lower(F.ltrim(text))
    return low.rlike(r"^(?:<!doctype html|<html)") | (low.startswith("<?xml") & low.contains("<html")) | (low.startswith("<") & low.rlike(rf"<(?:{HTML_TAGS})[\s>/]"))


def delimiter_counts(text: Column, delimiter: str) -> Column:
    """Unquoted delimiters in each of the first eight lines that are not blank."""
    lines = F.slice(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""), 1, 8)
    return F.transform(lines, lambda x: F.length(F.regexp_replace(x, r'"[^"]*"', "")) - F.length(F.replace(F.regexp_replace(x, r'"[^"]*"', ""), F.lit(delimiter), F.lit(""))))


def looks_like_delimited(text: Column) -> Column:
    found = F.lit(False)
    for d in (",", "\t", ";"):
        counts = delimiter_counts(text, d)
        found = found | ((F.size(counts) >= 2) & (F.get(counts, F.lit(0)) >= 1) & (F.size(F.array_distinct(counts)) == 1))
    return found


def looks_like_markdown(text: Column) -> Column:
    lines = F.slice(F.split(text, r"\r?\n"), 1, 40)
    return F.exists(lines, lambda x: x.rlike(r"^\s*(?:#{1,3} |```|- |\* |> |\| )")) | F.exists(lines, lambda x: x.rlike(r"\[[^\]]*\]\("))


def looks_textual(content: Column) -> Column:
    """No NUL, and less than 5 % control bytes."""
    text = content.cast("string")
    controls = F.length(text) - F.length(F.regexp_replace(text, r"[\x01-\x08\x0B\x0C\x0E-\x1F]", ""))
    return ~F.hex(content).rlike("^(?:..)*?00") & (controls * 20 < F.greatest(F.lit(1), F.length(text)))


def detect_text(text: Column, hint: Column | None = None) -> Column:
    """html, then the hint (csv, md, txt, html), then csv, md, txt."""
    case = F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string")).when(looks_like_html(text), "html")
    if hint is not None:
        case = case.when(F.lower(hint).isin("csv", "md", "txt", "html"), F.lower(hint))
    return case.when(looks_like_delimited(text), "csv").when(looks_like_markdown(text), "md").otherwise("txt")


def detect(content: Column, hint: Column | None = None) -> Column:
    """The format of bytes; zip and ole2 stand for containers whose members decide; png, jpeg and ps are named but not read; null if unknown."""
    head = F.hex(F.substring(content, 1, 1028))
    text = content.cast("string")
    case = F.when(head.rlike("^(?:..){0,1023}255044462D"), "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("D0CF11E0A1B11AE1"), "ole2").when(head.startswith("7B5C727466"), "rtf")
    case = case.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("2521"), "ps")
    return case.when(looks_textual(content), detect_text(text, hint))
