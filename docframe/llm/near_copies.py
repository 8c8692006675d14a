"""Near-copies: SimHash fingerprints of five-word shingles, joined on the grid of their segments' bit counts, and an exact similarity of 0.8.

Texts of one set of shingles are one node, with one fingerprint. Candidates are, first, nodes whose fingerprints differ in at most
RADIUS bits, by the fingerprints' grid join. Sets of a similarity of 0.8 differ in about ten bits of 64, and at such a radius the counts of
segments tell hardly any pair apart (about one pair in twenty would be a candidate). So, second, nodes that share at least one of BANDS keys, each made of
ROWS minima of the set under different hash functions: a pair of similarity 0.8 has none in common with a probability of 3 in a million.
In a group of one key each node is first compared with two representatives (the smallest node, and the one that shares most keys with all others).
Then the nodes of groups that links have not made one component are joined on the rare hashes of their sets, by an exact bound that no pair of
similarity 0.8 fails, so that no pair of a group is lost and a large group is not paired with itself. Every candidate is verified with
the two whole sets, so that a link is exact.

Defined cases: words are runs without ASCII white space, A-Z lower-cased; a text of fewer than `shingle` words is one shingle;
texts without words (null, empty, blank) are copies of each other; rows without a doc_id link others, but stay themselves;
repeated rows stay once; an empty table gives an empty table; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.components import connected_components
from docframe.llm.shared import list_array, materialize, text_chunks, texts_of
from docframe.llm.simhash import fingerprint_links, majority

SHINGLE, LEAST, RADIUS = 5, 0.8, 2
ROUNDING = 1e-6  # a share of exactly `least` is a link
BANDS, ROWS = 32, 5
_RNG = np.random.default_rng(11)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the text's shingles, each once."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(shingle, len(words)) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[width:].tolist(), strict=True)], dtype=np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[k : k + 2048, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def _nodes(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, node (hash of the set), n (its size), fp (the fingerprint), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch):
                found, keys, sizes, prints, own = [], [], [], [], []
                for text in texts:
                    hashes = shingle_set(text, shingle)
                    found.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                    sizes.append(len(hashes))
                    keys.append(band_keys(hashes))
                    prints.append(majority(hashes))
                    own.append(xxhash.xxh64_intdigest(text.encode(), 42))
                made = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (own, found, prints)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), *made, pa.array(sizes, pa.int32()), list_array(keys, pa.int64())], ["doc_id", "text_hash", "node", "fp", "n", "bands"])

    return texts_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, text_hash long, node long, fp long, n int, bands array<long>")


def links(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """a, b: candidate pairs of nodes whose sets have a similarity of at least `least`; only pairs of nodes that other links join already may be left out. nodes: those of docs, as _nodes() gives them."""
    each = nodes.dropDuplicates(["node"])
    rows = each.select("node", F.explode("bands").alias("key")).hint("merge")  # Spark takes the exploded rows for one a node, and would broadcast them
    first = materialize(_to_representatives(rows).unionByName(_grid_pairs(each.filter("n > 0").select("node", "fp"))).distinct(), "near-candidates")
    met = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = materialize(_verified(materialize(_sets(docs, nodes, met, shingle), "near-sets"), first, least), "near-links")
    left = materialize(_unsettled(rows, connected_components(found)), "near-unsettled")
    sets = materialize(_sets(docs, nodes, left.select("node"), shingle), "near-sets")
    rest = materialize(_apart(sets.join(left, "node"), least).join(first, ["a", "b"], "left_anti"), "near-rest")
    return found.unionByName(_verified(sets, rest, least))


def _unsettled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """node, root: nodes that share a key (rows: node, key) with a node of another root (roots: node, root; others are their own)."""
    shared = rows.join(rows.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1").select("key"), "key")
    placed = materialize(shared.join(roots.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left").select("key", "node", F.coalesce("root", "node").alias("root")), "near-placed")
    open_keys = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    return placed.join(open_keys, "key").select("node", "root").distinct()


def _apart(sets: DataFrame, least: float) -> DataFrame:
    """a, b: pairs of nodes of different roots, among them all of a similarity of at least `least` (sets: node, root, hashes).

    A set's hashes stand in one order for all sets: those of one root alone, which no such pair shares, then the others, rare ones first. Two
    sets of n and m hashes share at least least / (1 + least) * (n + m), so that the first hash that they share stands early enough in both
    to leave as many. That is the join's condition: a passage that many texts share stands late in their sets and pairs none of them.
    In each hash the nodes outside of its most frequent root meet all others, so nodes that one component holds never meet.
    """
    rows = sets.select("node", "root", F.size("hashes").alias("n"), F.explode("hashes").alias("hash")).hint("merge")
    common = rows.groupBy("hash").agg(F.count("*").alias("held"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("hash", "held")
    own = Window.partitionBy("node")
    ranked = rows.join(common, "hash").withColumn("place", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("held", "hash")))
    early = materialize(ranked.filter(F.col("n") - F.col("place") + 1 >= least * F.col("n") - ROUNDING).select("hash", "node", "root", "n", "place"), "near-early")
    roots = early.groupBy("hash").agg(F.mode("root").alias("main"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("hash", "main")
    met = early.join(roots, "hash")
    few, all_nodes = met.filter("root <> main").alias("f"), met.alias("e")
    once = (F.col("f.root") != F.col("e.root")) & ((F.col("e.root") == F.col("e.main")) | (F.col("f.node") < F.col("e.node")))
    left = 1 + F.least(F.col("f.n") - F.col("f.place"), F.col("e.n") - F.col("e.place"))
    enough = left * (1 + least) >= least * (F.col("f.n") + F.col("e.n")) - ROUNDING
    pairs = few.join(all_nodes, (F.col("f.hash") == F.col("e.hash")) & once & enough)
    return pairs.select(F.least("f.node", "e.node").alias("a"), F.greatest("f.node", "e.node").alias("b")).distinct()


def _sets(docs: DataFrame, nodes: DataFrame, met: DataFrame, shingle: int) -> DataFrame:
    """node, hashes of the nodes in met (node, each once). One row of docs stands for each: by its id, or by its text where it has none."""
    first = nodes.filter("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(met, "node")
    named = _set_rows(docs.filter("doc_id is not null"), first, shingle)
    unnamed = _set_rows(docs.filter("doc_id is null"), met.join(first, "node", "left_anti"), shingle)
    return named.unionByName(unnamed).dropDuplicates(["node"])


def _verified(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose whole sets (node, hashes) have a similarity of at least `least`."""
    one, two = sets.select(F.col("node").alias("a"), F.col("hashes").alias("a_set")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("b_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    found = pairs.join(one, "a").join(two, "b").withColumn("both", both)
    return found.filter(F.col("both") >= least * (F.size("a_set") + F.size("b_set") - F.col("both")) - ROUNDING).select("a", "b")


def _to_representatives(rows: DataFrame) -> DataFrame:
    """a, b: each node with two representatives of each key that it shares (columns node, key): the smallest node, and the one that shares most with all others.
    So a group gives two pairs for each member, not all pairs."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
    shared = materialize(rows.join(sizes, "key"), "near-shared")
    degree = shared.groupBy("node").agg(F.sum("held").alias("degree"))
    chosen = shared.join(degree, "node").groupBy("key").agg(F.min("node").alias("least"), F.max(F.struct("degree", "node")).alias("hub"))
    met = shared.join(chosen, "key").select("node", F.explode(F.array("least", "hub.node")).alias("other")).filter("node <> other")
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def _grid_pairs(each: DataFrame) -> DataFrame:
    """a, b: nodes of one fingerprint by their representatives, and the smallest nodes of fingerprints within RADIUS bits."""
    least = materialize(each.groupBy("fp").agg(F.min("node").alias("node")), "near-prints")
    links = fingerprint_links(least.select("fp"), RADIUS)
    one, two = least.select(F.col("fp").alias("a"), F.col("node").alias("one")), least.select(F.col("fp").alias("b"), F.col("node").alias("two"))
    between = links.join(one, "a").join(two, "b").select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
    return _to_representatives(each.select("node", F.col("fp").alias("key"))).unionByName(between)


def _set_rows(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node, hashes of the wanted nodes; wanted: node, and doc_id where docs are found by it."""
    texts = texts_of(docs, "doc_id", "text")
    if "doc_id" in wanted.columns:
        texts = texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some in text_chunks(batch):
                sets = [shingle_set(t, shingle) for t in some]
                own = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), list_array([s.view(np.int64) for s in sets], pa.int64())], ["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes array<long>").join(wanted.select("node"), "node", "left_semi")


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """docs without near-copies: of each component of links the document with the smallest doc_id stays, once; rows without a doc_id stay."""
    nodes = materialize(_nodes(docs, shingle), "near-nodes")
    roots = connected_components(links(docs, nodes, shingle, least)).withColumnRenamed("node", "own")
    groups = nodes.filter("doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    members = groups.join(roots, F.col("node") == F.col("own"), "left").withColumn("root", F.coalesce("root", "node"))
    kept = members.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash")
    met = (F.col("d.doc_id") == F.col("k.doc_id")) & (F.xxhash64(F.coalesce("d.text", F.lit(""))) == F.col("k.text_hash"))
    named = docs.alias("d").join(kept.alias("k"), met, "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(docs.columns).unionByName(docs.filter("doc_id is null"))
