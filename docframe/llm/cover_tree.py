"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data are indexed together. Pivots from a bounded sample, each the farthest from those before it, are the tree's top: a
prefix of them is the net of a level. Every row joins its nearest pivot's cell, with the exact covering radius. A large cell is dealt into groups by a hash of the id, so a hot vector is spread. Each group holds a cover tree of
its own. Pairs of groups, then pairs of nodes, are dropped when the bound <q,p> <= <cq,cp> + |cq| rp + |cp| rq + rq rp (centres c, covering
radii r) is below the worst kth score of the query group. First each query group meets its most promising data groups, which gives kth
scores; then all other pairs whose bound still reaches them.

Defined cases: vectors that are null, or hold a null or a component that is not finite, and rows without an id take no part; equal scores
go to the smaller vec_id; rows that repeat an id count once, with the least of their vectors; a shorter vector counts as padded by zeros;
fewer than k candidates give fewer rows, an empty table none; products beyond 64 bits are reckoned exactly and given as the nearest long.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from docframe.llm.shared import materialize

SAMPLE = 4096  # rows of which pivots are chosen, by the hash of their id
PIVOTS = 1024  # at most; a net of as many cells as the rows fill groups
DATA_GROUP, QUERY_GROUP = 8192, 1024  # rows of a group, about
FIRST = 2  # data groups that give a query group its first kth scores
LEAF, CHILDREN, SHRINK = 64, 64, 1.3  # a node is split if so many children of a radius smaller by SHRINK cover it
GROUP = "gid long, center array<double>, radius double, n int, ids binary, vectors binary"


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, as doubles; null if a component is null or not finite."""
    doubles = vector.cast("array<double>")
    sound = ~F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # floor as a double: Spark's own gives a bigint, which large components overflow
    down = lambda x: F.when(F.abs(x) >= 2.0**52, x).otherwise(F.floor(F.when(F.abs(x) < 2.0**52, x).otherwise(0.0)).cast("double"))
    return F.when(sound, F.transform(doubles, lambda x: down(x * factor)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    n = len(column)
    if n and len(values) == n * width:
        return values.reshape(n, width)
    out = np.zeros((n, width))
    sizes = np.diff(offsets)
    rows = np.repeat(np.arange(n), sizes)
    out[rows, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    return out


def _far_points(x: np.ndarray, most: int) -> np.ndarray:
    """Rows of x that are far from each other: each next one is the farthest from those before it."""
    chosen = [0]
    gap = _distances(x, x[0])
    while len(chosen) < most and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(x, x[chosen[-1]]))
    return x[chosen]


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x - c) ** 2).sum(axis=1), 0.0))


def _pivots(rows: DataFrame, width: int, most: int) -> np.ndarray:
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    return _far_points(_matrix(sample.column("vector").combine_chunks(), width), most)


def _cells(rows: DataFrame, pivots: np.ndarray, levels: tuple[int, int]) -> DataFrame:
    """rows with the number of their nearest pivot, among the first levels[0] (data_cell) and the first levels[1] (query_cell)."""
    width, squares = pivots.shape[1], (pivots**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = squares - 2 * _matrix(batch.column("vector"), width) @ pivots.T
            near = [pa.array(far[:, :m].argmin(axis=1), pa.int32()) for m in levels]
            yield pa.RecordBatch.from_arrays([*batch.columns, *near], names=[*batch.schema.names, "data_cell", "query_cell"])

    return rows.mapInArrow(run, "vec_id long, vector array<double>, is_query boolean, data_cell int, query_cell int")


def _groups(rows: DataFrame, cell: str, size: int, width: int) -> DataFrame:
    """GROUP rows: cells dealt into groups of about `size` rows by a hash of the id, each packed in the order of ids, with centre and radius."""
    cells = rows.select("vec_id", "vector", F.col(cell).alias("cell"))
    counts = cells.groupBy("cell").count().collect()  # PIVOTS rows at most
    first, at = {}, 0
    for row in sorted(counts, key=lambda r: r["cell"]):
        first[row["cell"]] = (at, -(-row["count"] // size))
        at += first[row["cell"]][1]
    if not first:
        return cells.sparkSession.createDataFrame([], GROUP)
    known = F.create_map(*[F.lit(x) for cell, pair in first.items() for x in (cell, pair[0])])
    parts = F.create_map(*[F.lit(x) for cell, pair in first.items() for x in (cell, pair[1])])
    gid = (known[F.col("cell")] + F.pmod(F.xxhash64("vec_id", F.lit(13)), parts[F.col("cell")])).cast("long")

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        order = ids.argsort()
        x = _matrix(table.column("vector").combine_chunks(), width)[order]
        center = x.mean(axis=0)
        row = [int(table.column("gid")[0].as_py()), center, float(_distances(x, center).max()), len(ids), ids[order].tobytes(), x.tobytes()]
        kinds = [pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["gid", "center", "radius", "n", "ids", "vectors"])

    return cells.select(gid.alias("gid"), "vec_id", "vector").groupBy("gid").applyInArrow(pack, GROUP)


class Node:
    """Rows of a group with their centre and covering radius; a leaf, or children that cover it."""

    def __init__(self, x: np.ndarray, rows: np.ndarray) -> None:
        self.rows = rows
        self.center = x[rows].mean(axis=0)
        self.norm = float(np.sqrt((self.center**2).sum()))
        self.radius = float(_distances(x[rows], self.center).max())
        self.children: list[Node] = []
        if len(rows) > LEAF and self.radius > 0:
            self.children = [Node(x, part) for part in _cover(x, rows, self.radius / SHRINK)]


def _cover(x: np.ndarray, rows: np.ndarray, radius: float) -> list[np.ndarray]:
    """rows cut into balls of this radius around rows that are farther from each other; nothing if they need over CHILDREN balls, or one."""
    parts: list[np.ndarray] = []
    while len(rows):
        if len(parts) == CHILDREN:
            return []
        near = _distances(x[rows], x[rows[0]]) <= radius
        parts.append(rows[near])
        rows = rows[~near]
    return parts if len(parts) > 1 else []


class Search:
    """The k best of data for each query, between two trees; known: kth scores that are already reached."""

    def __init__(self, qx: np.ndarray, qids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, known: np.ndarray) -> None:
        self.qx, self.qids, self.x, self.ids, self.k, self.known = qx, qids, x, ids, k, known
        n = len(qids)
        self.scores, self.found, self.sizes = np.full((n, k), -np.inf), np.zeros((n, k), dtype=np.int64), np.zeros(n, dtype=np.int64)
        most = np.abs(qx).max(initial=0.0) * np.abs(x).max(initial=0.0) * max(1, qx.shape[1])
        self.exact = most < 2.0**50 / max(1, len(ids))  # products, and keys made of them, are whole doubles and longs
        self.slack = 1e-9 * most + 1e-6  # above what rounding can take from a bound

    def bars(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.known[rows], self.scores[rows, self.k - 1])

    def visit(self, q: Node, d: Node) -> None:
        bound = float(q.center @ d.center) + q.norm * d.radius + d.norm * q.radius + q.radius * d.radius + self.slack
        if bound < self.bars(q.rows).min():
            return
        if not q.children and not d.children:
            self.compare(q.rows, d)
        elif d.children and (not q.children or d.radius >= q.radius):
            promise = np.array([q.center @ c.center + q.norm * c.radius for c in d.children])
            for i in (-promise).argsort(kind="stable"):
                self.visit(q, d.children[i])
        else:
            for child in q.children:
                self.visit(child, d)

    def compare(self, rows: np.ndarray, d: Node) -> None:
        q = self.qx[rows]
        # of each query alone
        near = q @ d.center + np.sqrt((q**2).sum(axis=1)) * d.radius + self.slack >= self.bars(rows)
        rows, q = rows[near], q[near]
        if not len(rows):
            return
        cols = np.sort(d.rows)  # in the order of ids
        if not self.exact:
            self._compare_wide(rows, q, cols)
            return
        scores = (q @ self.x[cols].T).astype(np.int64)
        n = len(cols)
        keys = scores * n + np.arange(n - 1, -1, -1)  # of equal scores the smaller id has the larger key
        keys[self.qids[rows][:, None] == self.ids[cols][None, :]] = np.iinfo(np.int64).min
        take = min(self.k + 1, n)
        best = np.argpartition(keys, n - take, axis=1)[:, n - take:] if take < n else np.broadcast_to(np.arange(n), (len(rows), n))
        for i, row in enumerate(rows):
            mine = [c for c in best[i] if self.ids[cols[c]] != self.qids[row]]
            self._merge(row, scores[i, mine], self.ids[cols[mine]])

    def _compare_wide(self, rows: np.ndarray, q: np.ndarray, cols: np.ndarray) -> None:
        """Products that doubles can't hold, in whole numbers of any size."""
        whole = [[int(v) for v in self.x[c]] for c in cols]
        top = 2**63 - 1
        for row, own in zip(rows, q, strict=True):
            a = [int(v) for v in own]
            found = sorted((-max(-top - 1, min(top, sum(u * v for u, v in zip(a, b, strict=True)))), int(self.ids[c])) for b, c in zip(whole, cols, strict=True) if self.ids[c] != self.qids[row])[: self.k]
            self._merge(row, np.array([-s for s, _ in found], dtype=object), np.array([i for _, i in found], dtype=np.int64))

    def _merge(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        n = self.sizes[row]
        if self.exact:
            s, i = np.concatenate([self.scores[row, :n], scores]), np.concatenate([self.found[row, :n], ids])
            order = np.lexsort((i, -s))[: self.k]
        else:
            if self.scores.dtype != object:
                self.scores = self.scores.astype(object)
            s, i = np.concatenate([self.scores[row, :n], scores]), np.concatenate([self.found[row, :n], ids])
            order = np.array(sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[: self.k], dtype=np.int64)
        self.sizes[row] = len(order)
        self.scores[row, : len(order)], self.found[row, : len(order)] = s[order], i[order]


def _searcher(k: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one query group and one data group each to query_id, vec_id, score."""

    def unpack(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(row[f"{side}_ids"].as_buffer(), np.int64)
        return np.frombuffer(row[f"{side}_vectors"].as_buffer(), np.float64).reshape(len(ids), width), ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, Node | None] = (None, None)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                (qx, qids), (x, ids) = unpack(row, "q"), unpack(row, "d")
                known = np.frombuffer(row["known"].as_buffer(), np.float64) if row["known"].is_valid else np.full(len(qids), -np.inf)
                gid = row["gid"].as_py()
                if gid != held[0]:
                    held = (gid, Node(x, np.arange(len(ids))))
                search = Search(qx, qids, x, ids, k, known)
                search.visit(Node(qx, np.arange(len(qids))), held[1])
                n, cut = search.sizes, np.arange(k)[None, :] < search.sizes[:, None]
                scores = search.scores[cut].astype(np.int64) if search.exact else [int(v) for v in search.scores[cut]]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(search.found[cut]), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, factor: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) for which is_query holds, the k other rows of largest inner product.

    The table of group pairs has a row for each query group and data group that the bound leaves; where vectors don't cluster, that is
    every pair, as any exact search must then compare them.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), factor).alias("vector"), is_query.alias("is_query")).filter("vec_id is not null and vector is not null")
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("is_query").alias("is_query"))
    rows = materialize(rows, "vectors")
    width, n_rows, n_queries = rows.agg(F.max(F.size("vector")), F.count("*"), F.count(F.when(F.col("is_query"), 1))).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    levels = tuple(max(1, min(PIVOTS, n // size)) for n, size in ((n_rows, DATA_GROUP), (n_queries, QUERY_GROUP)))
    cells = materialize(_cells(rows, _pivots(rows, width, max(levels)), levels), "cells")
    data = materialize(_groups(cells, "data_cell", DATA_GROUP, width), "data_groups")
    asked = materialize(_groups(cells.filter("is_query"), "query_cell", QUERY_GROUP, width), "query_groups")

    q, d = asked.select(F.col("gid").alias("qid"), F.col("center").alias("qc"), F.col("radius").alias("qr")), data.select("gid", F.col("center").alias("dc"), F.col("radius").alias("dr"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = lambda a: F.sqrt(dot(a, a))
    bound = dot("qc", "dc") + size("qc") * F.col("dr") + size("dc") * F.col("qr") + F.col("qr") * F.col("dr")
    bound = bound * F.when(bound > 0, 1 + 1e-9).otherwise(1 - 1e-9) + 1e-6 + 1e-9 * (size("qc") + F.col("qr")) * (size("dc") + F.col("dr"))
    # centres of groups against centres of groups: a row for 1,024 queries and 8,192 rows
    pairs = q.join(d, F.lit(True)).select("qid", "gid", bound.alias("bound"))
    pairs = materialize(pairs.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "gid"))), "group_pairs")
    packed_q = asked.select(F.col("gid").alias("qid"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    packed_d = data.select("gid", F.col("ids").alias("d_ids"), F.col("vectors").alias("d_vectors"))

    def meet(chosen: DataFrame, queries: DataFrame) -> DataFrame:
        return chosen.select("qid", "gid").join(queries, "qid").join(packed_d, "gid").drop("qid").mapInArrow(_searcher(k, width), "query_id long, vec_id long, score long")

    first = materialize(_best(meet(pairs.filter(F.col("place") <= FIRST), packed_q.withColumn("known", F.lit(None).cast("binary"))), k), "first")
    # each query group's kth scores in the order of its ids, and the worst of them
    kth = first.filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"))
    members = asked.select(F.col("gid").alias("qid"), F.explode(F.pandas_udf(_unpacked_ids, ArrayType(LongType()))("ids")).alias("query_id")).join(kth, "query_id", "left")
    known = members.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("query_id", F.coalesce("kth", F.lit(float("-inf"))).alias("kth")))).alias("kths"), F.min(F.coalesce("kth", F.lit(float("-inf")))).alias("worst"))
    known = materialize(known, "known")
    left = pairs.filter(F.col("place") > FIRST).join(known.select("qid", "worst"), "qid").filter(F.col("bound") >= F.col("worst"))
    with_known = packed_q.join(known.select("qid", F.pandas_udf(_packed_doubles, BinaryType())(F.transform("kths", lambda x: x["kth"])).alias("known")), "qid")
    found = first.select("query_id", "vec_id", "score").unionByName(meet(left, with_known))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def _unpacked_ids(packed: pd.Series) -> pd.Series:
    return packed.map(lambda b: np.frombuffer(b, np.int64))


def _packed_doubles(values: pd.Series) -> pd.Series:
    return values.map(lambda v: np.asarray(v, dtype=np.float64).tobytes())
