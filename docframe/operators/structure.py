"""Structure from flat rows: nested lists and the tree of a document's nodes, by windows with a bounded number of levels.

No document is collected: a row's parent is the last row before it of a smaller level, kept for each of LEVELS levels by a running window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 9  # fixed value: levels of lists and of headings


def _last_at_levels(level: Column, place: Column, order) -> Column:  # noqa: ANN001
    """Array by level of the last place before the current row at that level; null where there is none."""
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return F.array(*[F.last(F.when(level == k, place), ignorenulls=True).over(before) for k in range(LEVELS)])


def nested_lists(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds to blocks (key, block, level, ordered, start; level null: no item) depth, parent_item, list and number.

    depth (from 0): the item's level, but at most one below the item before it; the first item after another block has depth 0. parent_item:
    the block of the item that it lies in, or null. list: the block of its list's first item; a change between ordered and not begins a
    list. number: start of the list's first item plus its place in an ordered list, else null. Levels are cut to 0..8; a null start is 1.
    Of equal block numbers the order is undefined.
    """
    order = Window.partitionBy(key).orderBy("block")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_item = F.col("level").isNotNull()
    rows = blocks.withColumn("_run", F.sum(F.when(~is_item, 1).otherwise(0)).over(up_to)).withColumn("_i", F.row_number().over(order))
    run = Window.partitionBy(key, "_run", is_item).orderBy("block")
    level = F.when(F.row_number().over(run) == 1, 0).otherwise(F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.col("level"))))
    # depth(i) = min(level(i), depth(i - 1) + 1) = i + the least of level(j) - j up to i
    rows = rows.withColumn("_level", F.when(is_item, level)).withColumn("_place", F.row_number().over(run))
    depth = F.min(F.col("_level") - F.col("_place")).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_place")
    rows = rows.withColumn("depth", F.when(is_item, depth))
    above = F.get(_last_at_levels(F.col("depth"), F.col("block"), run), F.col("depth") - 1)
    rows = rows.withColumn("parent_item", F.when(is_item & (F.col("depth") > 0), above))
    same = Window.partitionBy(key, "_run", is_item, "parent_item", "depth").orderBy("block")
    begins = F.coalesce(F.lag("ordered").over(same) != F.col("ordered"), F.lit(True))
    rows = rows.withColumn("_begins", begins).withColumn("list", F.when(is_item, F.last(F.when(F.col("_begins"), F.col("block")), ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    own = Window.partitionBy(key, "list").orderBy("block")
    first = F.first(F.coalesce("start", F.lit(1))).over(own)
    rows = rows.withColumn("number", F.when(is_item & F.col("ordered"), first + F.row_number().over(own) - 1))
    return rows.drop("_run", "_i", "_level", "_place", "_begins")


def heading_tree(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds parent_heading to blocks (key, block, kind, level): of a heading the last one before it of a smaller level, of another block the last heading before it; null if there is none."""
    order = Window.partitionBy(key).orderBy("block")
    level = F.when(F.col("kind") == "heading", F.least(F.lit(LEVELS), F.greatest(F.lit(1), F.col("level"))) - 1)
    rows = blocks.withColumn("_level", level).withColumn("_last", _last_at_levels(F.col("_level"), F.col("block"), order))
    inner = F.when(F.col("_level").isNotNull(), F.slice("_last", F.lit(1), F.col("_level"))).otherwise(F.col("_last"))
    return rows.withColumn("parent_heading", F.array_max(F.filter(inner, lambda p: p.isNotNull()))).drop("_level", "_last")


def structure_nodes(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The tree of documents as rows: key, node (block), parent, kind, text. blocks: key, block, kind, level, ordered, start, text.

    A list and its items are nodes: a list is named by its first item's block minus 0.5, and hangs in its parent item or under its
    heading. Other blocks hang under their heading, headings in the heading above; null is the document itself.
    """
    rows = nested_lists(blocks.withColumn("_all", F.col("level")).withColumn("level", F.when(F.col("kind") == "list_item", F.col("level"))), key)
    rows = heading_tree(rows.withColumn("level", F.col("_all")), key)
    item = F.col("kind") == "list_item"
    node, list_node = F.col("block").cast("double"), F.col("list") - 0.5
    own = rows.select(key, node.alias("node"), F.when(item, list_node).otherwise(F.col("parent_heading").cast("double")).alias("parent"), F.col("kind"), F.col("text"))
    lists = rows.filter(item & (F.col("list") == F.col("block"))).select(key, list_node.alias("node"), F.coalesce("parent_item", "parent_heading").cast("double").alias("parent"), F.when(F.col("ordered"), "ordered_list").otherwise("list").alias("kind"), F.lit(None).cast("string").alias("text"))
    return own.unionByName(lists)
