"""Column expressions on texts, fragments and cells. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bullet glyphs, caption openings, date format ids of spreadsheets.
BULLETS = "•◦▪‣·–*-"
CAPTIONS = ("figure", "fig.", "fig", "chart", "table")
DATE_IDS = (*range(14, 23), *range(27, 37), *range(45, 48))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; no stemming, no stop words."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def importance(pages: Column, words: Column) -> Column:
    """0.5, with 0.15 for the first page and 0.1 for over 200 words."""
    return F.least(F.lit(1.0), 0.5 + F.when(F.array_contains(pages, 1), 0.15).otherwise(0.0) + F.when(words > 200, 0.1).otherwise(0.0))


def heading_level(size: Column, body: Column) -> Column:
    """0 if no heading, else 1 to 4 by the ratio to the body's size."""
    ratio = size / body
    return F.when(ratio <= 1.18, 0).when(ratio >= 2, 1).when(ratio >= 1.6, 2).when(ratio >= 1.35, 3).otherwise(4)


def list_marker(text: Column) -> Column:
    """The marker that opens a list item, or ''."""
    return F.regexp_extract(F.trim(text), rf"^([{BULLETS}]|[0-9]{{1,3}}[.)])\s*\S", 1)


def caption_kind(text: Column) -> Column:
    """figure, chart or table if the text opens as a caption with a number, else null."""
    kind = F.lower(F.regexp_extract(F.trim(text), r"(?i)^(figure|fig\.|fig|chart|table)\s*\d", 1))
    return F.when(kind == "", F.lit(None)).when(kind.startswith("fig"), "figure").otherwise(kind)


def number_text(value: Column) -> Column:
    """Whole numbers below 1e15 without a fraction; others in shortest form; '' if not finite."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(~finite, "").when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def date_of_serial(serial: Column) -> Column:
    """Text of a spreadsheet's day number, with the time where there is one; null out of range."""
    day = F.floor(serial)
    seconds = F.round((serial - day) * 86400).cast("int")
    moved = F.when(day < 60, day + 1).otherwise(day).cast("int")
    date = F.date_format(F.date_add(F.to_date(F.lit("1899-12-30")), moved), "yyyy-MM-dd")
    clock = F.format_string("%02d:%02d:%02d", (seconds / 3600).cast("int"), (seconds % 3600 / 60).cast("int"), seconds % 60)
    return F.when((serial < 0) | (serial >= 2958466), F.lit(None)).when(seconds == 0, date).otherwise(F.concat_ws(" ", date, clock))


def is_date_format(format_id: Column, code: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(code, F.lit("")), r'"[^"]*"|\[[^\]]*\]|\\.', "")
    return format_id.isin(*DATE_IDS) | F.lower(bare).rlike("[ydhs]")


def style_hides(style: Column) -> Column:
    """Whether a CSS declaration makes its text invisible."""
    bare = F.lower(F.regexp_replace(F.coalesce(style, F.lit("")), r"\s+", ""))
    white = r"(?:#fff(?:fff)?|white|rgb\(255,255,255\))"
    plain = rf"(?:^|;)color:{white}"
    ground = rf"(?:^|;)background(?:-color)?:{white}"
    return bare.rlike(r"display:none|visibility:hidden|font-size:0(?:px|pt|em|rem|%)?(?:;|$)|opacity:0(?:\.0*)?(?:;|$)") | (bare.rlike(plain) & bare.rlike(ground))


def list_style_level(name: Column) -> Column:
    """The nesting level (from 0) in the name of a built-in list style: List Bullet 2 is 1; null for first levels and other styles."""
    compact = F.regexp_replace(F.regexp_replace(F.lower(name), "_20_", ""), r"\s+", "")
    number = F.regexp_extract(compact, r"^list(?:bullet|number|continue)\+?0*([2-9])$", 1)
    return F.when(number != "", number.cast("int") - 1)
