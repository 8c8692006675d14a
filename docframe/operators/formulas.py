"""Fractions and matrices from positioned text and rules, in LaTeX. y grows downwards; a fragment stands on its baseline, y + height.

Bars and brackets meet fragments on cells of a grid of the page's height, so that nothing far away is tried. Nested fractions are built from
the inside: each round puts the fractions of the last one into the sides of the bars around them.

Defined cases: a page without rules or brackets has none; null and blank texts are no content; ties in x go by frag_idx, of several
narrower bars in a side the widest, then the nearest is its main one; a bar that is inside of a found fraction is not given again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.functions.formulas import to_latex, wrap_radicals

PAGE = ["doc_id", "page_number"]
GRID = 16.0
# Least and greatest length of a bar (of the page's width), levels of nesting, size of a plain side, width of a matrix.
SHORTEST, LONGEST, LEVELS, SIDE_CHARS, SIDE_WORDS, WIDEST = 4.0, 0.45, 3, 24, 5, 400.0


def _cell(y: Column) -> Column:
    return F.floor(y / GRID).cast("long")


def _joined(rows: str = "parts") -> Column:
    return to_latex(F.array_join(F.transform(rows, lambda p: p["text"]), " "))


def fractions(fragments: DataFrame, rulings: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_number, x0, y, x1, latex: fragments (doc_id, page_number, frag_idx, text, x, y, width, height, font_size), rulings as in operators.tables, pages with their width.

    A bar is a horizontal rule whose extent no other rule of the page has (rules of tables repeat). Its sides are the fragments with their
    centre over it whose baseline is at most 1.8 sizes above or below. Both must hold something; a plain side has 24 characters and five
    words at most; a bar over twice as wide as what it holds (and 8) is no fraction.
    """
    rules = rulings.filter("orientation = 'h'").select(*PAGE, F.least("x0", "x1").alias("x0"), F.greatest("x0", "x1").alias("x1"), F.col("y0").alias("y"))
    extent = Window.partitionBy(*PAGE, F.round(F.col("x0") / 6), F.round(F.col("x1") / 6))
    bars = rules.withColumn("n", F.count("*").over(extent)).join(pages.select(*PAGE, F.col("width").alias("page_width")), PAGE)
    bars = bars.filter((F.col("n") < 2) & (F.col("x1") - F.col("x0") >= SHORTEST) & (F.col("x1") - F.col("x0") <= F.col("page_width") * LONGEST))
    bars = bars.withColumn("bar", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y", "x0", "x1"))).select(*PAGE, "bar", "x0", "x1", "y")
    size = F.greatest(F.lit(8.0), "font_size")
    base = F.col("y") + F.col("height")
    texts = fragments.filter(F.trim("text") != "").select(*PAGE, "frag_idx", F.col("text"), "x", "width", base.alias("base"), size.alias("size"), F.explode(F.sequence(_cell(base - size * 1.8), _cell(base + size * 1.8))).alias("cell"))
    held = bars.withColumn("cell", _cell(F.col("y"))).join(texts, [*PAGE, "cell"]).withColumn("rise", F.col("y") - F.col("base"))
    held = held.filter((F.col("x") + F.col("width") / 2).between(F.col("x0") - 2, F.col("x1") + 2) & (F.abs("rise") > 0.5) & (F.abs("rise") <= F.col("size") * 1.8))
    sides = held.groupBy(*PAGE, "bar", "x0", "x1", "y", (F.col("rise") > 0).alias("above")).agg(F.sort_array(F.collect_list(F.struct("x", "frag_idx", "text"))).alias("parts"), F.max("size").alias("size"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("span"))
    plain = _joined()
    sides = sides.withColumn("plain", F.when((F.length(plain) > 0) & (F.length(plain) <= SIDE_CHARS) & (F.size(F.split(plain, " ")) <= SIDE_WORDS), plain)).drop("parts")
    # narrower bars that lie in a side of another: within its width and three and a half sizes of it
    other = bars.select(*PAGE, F.col("bar").alias("inner"), F.col("x0").alias("ix0"), F.col("x1").alias("ix1"), F.col("y").alias("iy"), _cell(F.col("y")).alias("cell"))
    window = F.col("size") * 3.5
    low, high = F.when(F.col("above"), F.col("y") - window).otherwise(F.col("y") + 2), F.when(F.col("above"), F.col("y") - 2).otherwise(F.col("y") + window)
    inside = sides.withColumn("low", low).withColumn("high", high).withColumn("cell", F.explode(F.sequence(_cell(F.col("low")), _cell(F.col("high"))))).join(other, [*PAGE, "cell"])
    inside = inside.filter((F.col("ix0") >= F.col("x0") - 2) & (F.col("ix1") <= F.col("x1") + 2) & (F.col("iy") >= F.col("low")) & (F.col("iy") <= F.col("high")) & (F.col("ix1") - F.col("ix0") < F.col("x1") - F.col("x0"))).select(*PAGE, "bar", "above", "inner", "y", "iy", "ix0", "ix1")
    found, used = None, None
    for _ in range(LEVELS):
        if found is None:
            filled = sides.withColumn("nested", F.lit(None).cast("string"))
        else:
            chosen = inside.join(found.select(*PAGE, F.col("bar").alias("inner"), "latex"), [*PAGE, "inner"]).groupBy(*PAGE, "bar", "above").agg(F.min(F.struct((F.col("ix0") - F.col("ix1")).alias("w"), F.abs(F.col("iy") - F.col("y")).alias("far"), "inner", "latex")).alias("c"))
            used = chosen
            filled = sides.join(chosen.select(*PAGE, "bar", "above", F.col("c.latex").alias("nested")), [*PAGE, "bar", "above"], "left")
        side = F.coalesce("nested", "plain")
        both = filled.groupBy(*PAGE, "bar", "x0", "x1", "y").agg(F.max(F.when(F.col("above"), side)).alias("over"), F.max(F.when(~F.col("above"), side)).alias("under"), F.max("span").alias("span"))
        both = both.filter((F.col("over") != "") & (F.col("under") != "") & (F.col("x1") - F.col("x0") <= F.col("span") * 2 + 8))
        found = both.withColumn("latex", wrap_radicals(F.concat(F.lit("\\frac{"), "over", F.lit("}{"), "under", F.lit("}"))))
    within = used.join(found.select(*PAGE, "bar"), [*PAGE, "bar"], "left_semi").select(*PAGE, F.col("c.inner").alias("bar"))
    return found.join(within, [*PAGE, "bar"], "left_anti").select(*PAGE, "x0", "y", "x1", "latex")


def _centers(values: str, tolerance: Column) -> Column:
    """Means of runs of sorted values, each within the tolerance of the mean of its run so far."""
    none = F.array().cast("array<struct<s:double,n:int>>")
    last = lambda a: F.element_at(a, -1)
    near = lambda a, v: (F.size(a) > 0) & (F.abs(v - last(a)["s"] / last(a)["n"]) <= tolerance)
    grow = lambda a, v: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct((last(a)["s"] + v).alias("s"), (last(a)["n"] + 1).alias("n"))))
    fresh = lambda a, v: F.concat(a, F.array(F.struct(v.alias("s"), F.lit(1).alias("n"))))
    return F.aggregate(F.sort_array(values), none, lambda a, v: F.when(near(a, v), grow(a, v)).otherwise(fresh(a, v)), lambda a: F.transform(a, lambda c: c["s"] / c["n"]))


def _nearest(centers: str, value: Column) -> Column:
    return F.array_min(F.transform(F.sequence(F.lit(0), F.size(centers) - 1), lambda i: F.struct(F.abs(F.get(centers, i) - value).alias("d"), i.alias("i"))))["i"]


def matrices(fragments: DataFrame) -> DataFrame:
    """doc_id, page_number, open_idx (frag_idx of the bracket), n_rows, n_cols, latex: a full grid of two or more rows and columns between [ and ], or ( and ).

    The closing bracket is the nearest one to the right on about the same line, 400 points away at most; entries lie between the two within
    3.5 sizes of that line. Rows and columns are runs of entries around a running mean.
    """
    texts = fragments.withColumn("text", F.trim("text")).filter("text <> ''").select(*PAGE, "frag_idx", "text", "x", (F.col("y") + F.col("height")).alias("base"), "width", "font_size")
    reach = F.greatest(F.lit(6.0), "font_size")
    opens = texts.filter(F.col("text").isin("[", "(")).select(*PAGE, F.col("frag_idx").alias("open_idx"), F.col("text").alias("sign"), (F.col("x") + F.col("width")).alias("left"), F.col("x").alias("ox"), F.col("base").alias("oy"), reach.alias("reach"), F.greatest(F.lit(8.0), "font_size").alias("size"))
    closes = texts.filter(F.col("text").isin("]", ")")).select(*PAGE, F.when(F.col("text") == "]", "[").otherwise("(").alias("sign"), F.col("x").alias("right"), F.col("base").alias("cy"), _cell(F.col("base")).alias("cell"))
    near = opens.withColumn("cell", F.explode(F.sequence(_cell(F.col("oy") - F.col("reach")), _cell(F.col("oy") + F.col("reach"))))).join(closes, [*PAGE, "sign", "cell"])
    near = near.filter((F.col("right") > F.col("left")) & (F.abs(F.col("cy") - F.col("oy")) <= F.col("reach")))
    pairs = near.groupBy(*PAGE, "open_idx", "sign", "left", "ox", "oy", "size").agg(F.min("right").alias("right")).filter(F.col("right") - F.col("ox") <= WIDEST)
    band = F.col("size") * 3.5
    entries = pairs.withColumn("cell", F.explode(F.sequence(_cell(F.col("oy") - band), _cell(F.col("oy") + band)))).join(texts.withColumn("cell", _cell(F.col("base"))), [*PAGE, "cell"])
    entries = entries.withColumn("cx", F.col("x") + F.col("width") / 2).filter((F.col("cx") > F.col("left") - 1) & (F.col("cx") < F.col("right") + 1) & (F.abs(F.col("base") - F.col("oy")) <= band))
    grids = entries.groupBy(*PAGE, "open_idx", "sign", "size").agg(F.collect_list("base").alias("ys"), F.collect_list("cx").alias("xs"), F.collect_list(F.struct("x", "frag_idx", "text", "base", "cx")).alias("parts")).filter(F.size("parts") >= 4)
    grids = grids.withColumn("ys", _centers("ys", F.col("size") * 0.7)).withColumn("xs", _centers("xs", F.col("size") * 1.2)).filter((F.size("ys") >= 2) & (F.size("xs") >= 2))
    placed = grids.select(*PAGE, "open_idx", "sign", "ys", "xs", F.explode("parts").alias("p")).withColumn("row", _nearest("ys", F.col("p.base"))).withColumn("col", _nearest("xs", F.col("p.cx")))
    keys = [*PAGE, "open_idx", "sign"]
    cells = placed.groupBy(*keys, F.size("ys").alias("n_rows"), F.size("xs").alias("n_cols"), "row", "col").agg(F.sort_array(F.collect_list(F.struct("p.x", "p.frag_idx", "p.text"))).alias("parts"))
    cells = cells.withColumn("text", _joined()).filter("text <> ''")
    rows = cells.groupBy(*keys, "n_rows", "n_cols", "row").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]), " & ").alias("line"))
    whole = rows.groupBy(*keys, "n_rows", "n_cols").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), " \\\\ ").alias("body")).filter("n = n_rows * n_cols")
    name = F.when(F.col("sign") == "[", "bmatrix").otherwise("pmatrix")
    return whole.select(*PAGE, "open_idx", "n_rows", "n_cols", F.concat(F.lit("\\begin{"), name, F.lit("} "), "body", F.lit(" \\end{"), name, F.lit("}")).alias("latex"))
