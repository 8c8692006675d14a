"""Accents that a page draws as fragments of their own, above or below the letter that they belong to."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions.accents import ACCENTS

PAGE = ["doc_id", "page_number"]
GRID = 8.0  # points of a cell's height
MARKS = ACCENTS | {mark: mark for mark in ACCENTS.values()}  # a mark may come as a combining one
NEARBY = (0, -1, 1, -2, 2)  # fixed values: letters that are tried, from the estimated one


def _apply(rows: pd.DataFrame) -> pd.DataFrame:
    """text, used: each base's text with its marks, in order, at the nearest letter that has a form with the mark, and the fragments of marks that found one."""
    out = []
    for text, x, width, marks in zip(rows["text"], rows["x"], rows["width"], rows["marks"], strict=True):
        letters, used = list(text), []
        step = max(0.1, width / max(1, len(letters)))
        for m in marks:
            at = int((m["cx"] - x) // step)
            for i in (at + d for d in NEARBY):
                joined = unicodedata.normalize("NFC", letters[i].replace("ı", "i") + m["mark"]) if 0 <= i < len(letters) and letters[i].isalpha() else ""
                if len(joined) == 1:
                    letters[i] = joined
                    used.append(m["accent"])
                    break
        out.append(("".join(letters), used))
    return pd.DataFrame(out, columns=["text", "used"])


def merge_positional_accents(fragments: DataFrame) -> DataFrame:
    """fragments (doc_id, page_number, frag_idx, text, x, y, width, font_size; y downwards) with lone accents joined to their letters.

    An accent's base is the fragment whose width, and a point more, spans the accent's centre, and whose y is at most its own size below the
    accent's or 0.3 of it above; the one of nearest y, then of smallest frag_idx. They meet on cells of a grid of the page, so no pair is
    tried that is not near. The mark joins the letter under it, or one of the two to either side, that has a form with it. An accent without
    a base or a letter stays a fragment; a base takes several marks in order of frag_idx. Null texts are no bases; other columns pass.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    marks = F.create_map(*[F.lit(v) for pair in MARKS.items() for v in pair])
    rows = fragments.withColumn("_mark", F.when(F.char_length(text) == 1, F.try_element_at(marks, text)))
    cell = lambda y: F.floor(y / GRID).cast("long")
    accents = rows.filter("_mark is not null").select(*PAGE, F.col("frag_idx").alias("accent"), F.col("_mark").alias("mark"), (F.col("x") + F.col("width") / 2).alias("cx"), F.col("y").alias("ay"), cell(F.col("y")).alias("cell"))
    # a text of marks alone is no base
    only = F.forall(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.map_contains_key(marks, c))
    low, high = F.col("y") - F.col("font_size"), F.col("y") + F.col("font_size") * 0.3
    bases = rows.filter(~only & (F.col("font_size") >= 0)).select(*PAGE, "frag_idx", "x", "width", F.col("y").alias("by"), low.alias("low"), high.alias("high"), F.explode(F.sequence(cell(low), cell(high))).alias("cell"))
    near = accents.join(bases, [*PAGE, "cell"]).filter(F.col("cx").between(F.col("x") - 1, F.col("x") + F.col("width") + 1) & F.col("ay").between(F.col("low"), F.col("high")))
    best = near.groupBy(*PAGE, "accent").agg(F.min(F.struct(F.abs(F.col("by") - F.col("ay")).alias("away"), "frag_idx", "cx", "mark")).alias("b"))
    held = best.groupBy(*PAGE, F.col("b.frag_idx").alias("frag_idx")).agg(F.sort_array(F.collect_list(F.struct("accent", F.col("b.cx").alias("cx"), F.col("b.mark").alias("mark")))).alias("marks"))
    changed = fragments.select(*PAGE, "frag_idx", "text", "x", "width").join(held, [*PAGE, "frag_idx"])
    kind = dict(fragments.dtypes)["frag_idx"]
    apply = F.pandas_udf(lambda t, x, w, m: _apply(pd.DataFrame({"text": t, "x": x, "width": w, "marks": m})), f"struct<text:string,used:array<{kind}>>")
    changed = changed.select(*PAGE, "frag_idx", apply("text", "x", "width", "marks").alias("_new"))
    gone = changed.select(*PAGE, F.explode("_new.used").alias("frag_idx"))
    kept = fragments.join(gone, [*PAGE, "frag_idx"], "left_anti").join(changed.withColumn("_new", F.col("_new.text")), [*PAGE, "frag_idx"], "left")
    return kept.withColumn("text", F.coalesce("_new", "text")).select(*fragments.columns)
