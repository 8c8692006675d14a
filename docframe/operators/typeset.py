"""Setting blocks on pages: positioned fragments from (doc_id, block, kind, level, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE_WIDTH, PAGE_HEIGHT, MARGIN, BODY = 612.0, 792.0, 72.0, 12.0
MOST_PAGES = 20_000
FRAGMENTS = ["doc_id", "page_number", "frag_idx", "text", "x", "y", "width", "height", "font_size"]


def break_lines(blocks: DataFrame) -> DataFrame:
    """doc_id, block, kind, level, font_size, line_idx, text: words are filled into lines greedily, by a fold over each block's words; a character is half its size wide."""
    size = F.when(F.col("kind") != "heading", BODY).when(F.col("level") <= 1, 24.0).when(F.col("level") == 2, 19.2).otherwise(16.2)
    rows = blocks.withColumn("font_size", size).withColumn("most", F.floor((PAGE_WIDTH - 2 * MARGIN) / (F.col("font_size") * 0.5)))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def add(state, word):
        fits = (state["line"] == "") | (F.length(state["line"]) + 1 + F.length(word) <= F.col("most"))
        longer = F.when(state["line"] == "", word).otherwise(F.concat_ws(" ", state["line"], word))
        return F.struct(F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["line"]))).alias("done"), F.when(fits, longer).otherwise(word).alias("line"))

    lines = F.aggregate(words, start, add, lambda s: F.when(s["line"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["line"]))))
    return rows.select("doc_id", "block", "kind", "level", "font_size", F.posexplode(lines).alias("line_idx", "text"))


def typeset(blocks: DataFrame) -> DataFrame:
    """Fragments of all blocks: lines of 1.25 sizes, as much again after a block (layout ends a paragraph at over 1.4 sizes), a new page where the text area ends."""
    rows = break_lines(blocks)
    order = Window.partitionBy("doc_id").orderBy("block", "line_idx")
    last = F.coalesce(F.lead("block").over(order) != F.col("block"), F.lit(True))
    rows = rows.withColumn("step", F.col("font_size") * (1.25 + F.when(last, 1.25).otherwise(0.0)))
    area = PAGE_HEIGHT - 2 * MARGIN
    before = F.coalesce(F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("top", before).withColumn("page_number", (F.floor(F.col("top") / area) + 1).cast("int")).filter(F.col("page_number") <= MOST_PAGES)
    place = F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("block", "line_idx")) - 1
    return rows.select(
        "doc_id", "page_number", place.alias("frag_idx"), "text", F.lit(MARGIN).alias("x"), (MARGIN + F.col("top") - (F.col("page_number") - 1) * area).alias("y"),
        (F.length("text") * F.col("font_size") * 0.5).alias("width"), F.col("font_size").alias("height"), "font_size",
    )


def page_sizes(fragments: DataFrame) -> DataFrame:
    return fragments.select("doc_id", "page_number").distinct().select("doc_id", "page_number", F.lit(PAGE_WIDTH).alias("width"), F.lit(PAGE_HEIGHT).alias("height"))
