"""Connected components by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.shared import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them. edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    near = edges.join(least, "a").filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return near.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every node that has an edge; edges: columns a, b, both not null."""
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    while True:
        after = materialize(_small_star(_large_star(edges)), "components")
        # both are sets: equal sizes and nothing new mean that they are equal
        if after.count() == edges.count() and after.join(edges, ["a", "b"], "left_anti").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        edges = after
