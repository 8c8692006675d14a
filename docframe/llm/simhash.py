"""SimHash fingerprints, and their links by a segment-popcount embedding.

A fingerprint of 64 bits is mapped to the bit counts of its segments. Each differing bit changes one
count by at most one, so that the Manhattan distance of two such vectors is at most the Hamming distance of
the fingerprints. Links within `radius` bits are therefore found by a grid range-join: vectors are grid
cells, each distinct fingerprint probes the cells within `radius` of its own on one side of it (the
other side comes to it), and the join's condition verifies the exact distance, so that only links leave it.
Copies have one fingerprint and enter once, with the smallest of their doc_ids.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and is linked like any other;
repeated rows are one document of the group; null doc_ids are no smallest doc_id unless a component has no other
(component_id is null then); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.components import connected_components
from docframe.llm.shared import materialize, text_chunks, texts_of

BITS = 64
HOT_SHARE = 4096


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned. Words are runs without ASCII white space, A-Z lower-cased; each shingle counts as often as it occurs."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(shingle, len(words)) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width:].tolist(), strict=True)], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; none of no hashes."""
    hashes = hashes.astype("<u8", copy=False)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch):
                found = np.array([fingerprint(x, shingle, seed) for x in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(found)], ["doc_id", "fp"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _cell(fp: Column, segments: int) -> Column:
    """The vector of bit counts as one number, with a digit wide enough that counts out of range meet no cell."""
    size = BITS // segments
    return sum(F.bit_count(F.shiftrightunsigned(fp, i * size).bitwiseAND(F.lit((1 << size) - 1))).cast("long") * F.lit((2 * size) ** i) for i in range(segments))


def _steps(segments: int, radius: int) -> list[int]:
    """The cells within `radius`, on one side, as differences of cell numbers; the own cell is 0."""
    base = 2 * (BITS // segments)
    vectors = [()]
    for _ in range(segments):
        vectors = [(*v, d) for v, d in product(vectors, range(-radius, radius + 1)) if sum(map(abs, v)) + abs(d) <= radius]
    return sorted(n for v in vectors if (n := sum(d * base**i for i, d in enumerate(v))) >= 0)


def fingerprint_links(distinct: DataFrame, radius: int = 2, segments: int = 8) -> DataFrame:
    """a, b: all pairs of distinct fingerprints (column fp) with at most `radius` differing bits."""
    cells = distinct.select(F.col("fp").alias("b"), _cell(F.col("fp"), segments).alias("cell"))
    steps = F.array(*[F.lit(n).cast("long") for n in _steps(segments, radius)])
    probes = distinct.select(F.col("fp").alias("a"), _cell(F.col("fp"), segments).alias("own")).select("a", "own", F.explode(steps).alias("step"))
    probes = probes.select("a", (F.col("own") + F.col("step")).alias("cell"), (F.col("step") > 0).alias("other"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    # the steps make many probes of a row, which Spark doesn't count: without the hint it takes the probes for small and broadcasts them
    met = probes.alias("p").hint("merge").join(cells.alias("c"), (F.col("p.cell") == F.col("c.cell")) & near & (F.col("p.other") | (F.col("a") < F.col("b"))))
    return met.select("a", "b")


def components(docs: DataFrame, shingle: int = 3, seed: int = 42, radius: int = 2, segments: int = 8) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hexadecimal digits), component_id (the smallest doc_id reachable over links), n_links (fingerprints linked with it)."""
    rows = materialize(fingerprints(docs, shingle, seed), "simhash")
    groups = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "simhash-groups")
    links = materialize(fingerprint_links(groups.select("fp"), radius, segments), "simhash-links")
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    roots = connected_components(links).withColumnRenamed("node", "fp")
    members = groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = members.join(smallest, "root").join(degree, "fp", "left").select("fp", "copies", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    labels = materialize(labels, "simhash-labels")
    total = rows.count()
    # fewer than HOT_SHARE fingerprints can have over 1/HOT_SHARE of the rows each: they are broadcast, so no task gets a large group of copies
    hot = F.broadcast(labels.filter(F.col("copies") * HOT_SHARE > total).drop("copies"))
    cold = labels.filter(F.col("copies") * HOT_SHARE <= total).drop("copies")
    found = rows.join(hot, "fp").unionByName(rows.join(hot, "fp", "left_anti").join(cold, "fp"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def keep_one_of_each(docs: DataFrame, shingle: int = 3, seed: int = 42, radius: int = 2, segments: int = 8) -> DataFrame:
    """docs without near-copies: of each component the document with the smallest doc_id stays, once (with the smallest text, where that id has
    several); rows without a doc_id stay."""
    kept = components(docs, shingle, seed, radius, segments).filter("doc_id = component_id").select("doc_id").distinct()
    texts = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("least_text")).join(kept, "doc_id")
    met = docs.alias("d").join(texts.alias("k"), (F.col("d.doc_id") == F.col("k.doc_id")) & (F.coalesce("d.text", F.lit("")) == F.col("k.least_text")), "left_semi")
    return met.dropDuplicates(["doc_id"]).select(docs.columns).unionByName(docs.filter("doc_id is null"))
