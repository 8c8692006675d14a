"""Append-only edit logs: merge, order, current content and attribution.

An operation has an id (counter, actor). Insert puts a node after its left neighbour under a parent, Replace gives a node another content,
Delete is final. The current content is that of the operation with the largest id among the insert and the replaces of a node.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ID = ["doc_id", "counter", "actor"]
NODE = ["doc_id", "node_counter", "node_actor"]


def merge(*logs: DataFrame) -> DataFrame:
    """The union of logs; operations never change, so any copy of an id will do. Idempotent, and the order of logs does not matter."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out.dropDuplicates(ID)


def next_counter(ops: DataFrame) -> DataFrame:
    return ops.groupBy("doc_id").agg((F.max("counter") + 1).alias("next_counter"))


def _of_nodes(ops: DataFrame) -> DataFrame:
    insert = F.col("op") == "insert"
    return ops.withColumn("node_counter", F.when(insert, F.col("counter")).otherwise(F.col("target_counter"))).withColumn("node_actor", F.when(insert, F.col("actor")).otherwise(F.col("target_actor")))


def winners(ops: DataFrame) -> DataFrame:
    """A row for each live node: content, and counter, actor and time of the operation that gave it. Delete beats every replace."""
    rows = _of_nodes(ops)
    deleted = rows.filter("op = 'delete'").select(*NODE).distinct()
    inserted = rows.filter("op = 'insert'").select(*NODE)
    best = rows.filter("op <> 'delete'").groupBy(*NODE).agg(F.max_by(F.struct("content", "counter", "actor", "ts_ms"), F.struct("counter", "actor")).alias("best"))
    return best.join(inserted, NODE, "left_semi").join(deleted, NODE, "left_anti").select(*NODE, "best.content", "best.counter", "best.actor", "best.ts_ms")


def attribution(ops: DataFrame, actors: DataFrame) -> DataFrame:
    """winners() with the author's name and kind; null where the actor is not in the table."""
    names = actors.select("doc_id", F.col("id").alias("actor"), F.col("name").alias("author"), "is_agent")
    return winners(ops).join(names, ["doc_id", "actor"], "left")


def edit_counts(ops: DataFrame) -> DataFrame:
    return ops.groupBy("doc_id", "actor").agg(F.count("*").alias("edits"))


def _pre_order(part: pd.DataFrame) -> pd.DataFrame:
    """Of one document's inserts the order: after each node its followers, the larger id first. A missing or later neighbour counts as none."""
    ids = list(zip(part["counter"].tolist(), part["actor"].tolist(), strict=True))
    lefts = zip(part["left_counter"].tolist(), part["left_actor"].tolist(), strict=True)
    known, followers = set(ids), {}
    for node, left in zip(ids, lefts, strict=True):
        followers.setdefault(left if left in known and left < node else None, []).append(node)
    order, waiting = [], sorted(followers.get(None, []))
    while waiting:
        node = waiting.pop()
        order.append(node)
        waiting += sorted(followers.get(node, []))
    return pd.DataFrame({"doc_id": part["doc_id"].iloc[0], "counter": [c for c, _ in order], "actor": [a for _, a in order], "place": range(len(order))})


def ordered(ops: DataFrame) -> DataFrame:
    """Live nodes with their position from 0. Only ids go to the per-document step; contents are joined afterwards."""
    inserts = ops.filter("op = 'insert'").select("doc_id", "counter", "actor", "left_counter", "left_actor")
    places = inserts.groupBy("doc_id").applyInPandas(_pre_order, "doc_id long, counter long, actor long, place long")
    live = winners(ops).select("doc_id", F.col("node_counter").alias("counter"), F.col("node_actor").alias("actor"), "content")
    position = F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1
    return places.join(live, ID).select("doc_id", "counter", "actor", "content", position.alias("position"))


def from_blocks(blocks: DataFrame, actor: int = 1) -> DataFrame:
    """A chain of inserts from (doc_id, block, text): each block after the one before it."""
    before = F.lag("block").over(Window.partitionBy("doc_id").orderBy("block")) + 1
    none = F.lit(None).cast("long")
    return blocks.select(
        "doc_id", (F.col("block") + 1).cast("long").alias("counter"), F.lit(actor).cast("long").alias("actor"), F.lit(0).cast("long").alias("ts_ms"), F.lit("insert").alias("op"),
        before.cast("long").alias("left_counter"), F.when(before.isNotNull(), F.lit(actor)).cast("long").alias("left_actor"), none.alias("target_counter"), none.alias("target_actor"), F.col("text").alias("content"),
    )
