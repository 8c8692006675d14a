"""Term index, AND search by index and by scan, relevance, and vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docframe.functions.text import tokens
from docframe.functions.vectors import cosine

SLAB = 64  # queries that are scored at once


def postings(chunks: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """term, keys: each term once for each row that has it."""
    return chunks.select(*keys, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).select("term", *keys)


def write_index(index: DataFrame, path: str, buckets: int = 64) -> None:
    """Partitioned by the term's bucket, so that a search reads a few directories and, in them, row groups that may hold the term."""
    rows = index.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    rows.repartition("bucket", F.pmod(F.xxhash64(*[c for c in index.columns if c != "term"]), F.lit(8))).sortWithinPartitions("term").write.partitionBy("bucket").parquet(path)


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(query: str) -> list[str]:
    """The query's tokens, as the index has them."""
    import unicodedata

    out, current = [], ""
    for c in query.lower():
        if c.isalpha() or unicodedata.category(c).startswith("N"):
            current += c
        elif current:
            out.append(current)
            current = ""
    return list(dict.fromkeys([*out, current] if current else out))


def search_index(index: DataFrame, keys: list[str], query: str) -> DataFrame:
    """Keys of rows with all of the query's terms. A query without terms finds nothing."""
    terms = query_terms(query)
    if not terms:
        return index.select(*keys).limit(0)
    hits = index.filter(F.col("term").isin(terms))
    return hits.groupBy(*keys).agg(F.countDistinct("term").alias("found")).filter(F.col("found") == len(terms)).select(*keys)


def search_scan(blocks: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Rows whose lower-cased text contains all of the query's words between blanks. A blank query finds nothing."""
    words = query.lower().split()
    if not words:
        return blocks.limit(0)
    low = F.lower(text)
    condition = F.lit(True)
    for w in words:
        condition = condition & low.contains(w)
    return blocks.filter(condition)


def search_pattern(blocks: DataFrame, pattern: str, *, regex: bool = False, whole_word: bool = False, case_sensitive: bool = False, text: str = "text") -> DataFrame:
    """Rows that match; a pattern has at most 64 characters."""
    if len(pattern) > 64:
        raise ValueError("a pattern has at most 64 characters")
    quoted = pattern if regex else "\\Q" + pattern.replace("\\E", "") + "\\E"
    if whole_word:
        quoted = rf"\b(?:{quoted})\b"
    return blocks.filter(F.col(text).rlike(quoted if case_sensitive else f"(?iu){quoted}"))


def relevance(chunks: DataFrame, keys: list[str], query: str, most: int = 5) -> DataFrame:
    """Of each document the `most` chunks by score: 2 for each time that a query word occurs, 3 for each of the chunk's keywords that has a query word
    in it, times the importance, and times 1.5 for paragraphs after the first page (late) if the query asks for a conclusion or recommendation.
    chunks: keys, content, importance, keywords, late."""
    words, low = query.lower().split(), F.lower("content")
    uses = lambda w: (F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)
    hits = sum((2 * uses(w) for w in words), F.lit(0.0))
    marks = 3 * F.size(F.filter("keywords", lambda k: reduce(lambda a, b: a | b, [F.lower(k).contains(w) for w in words], F.lit(False))))
    concludes = "conclusion" in query or "recommendation" in query
    boost = F.when(F.col("late"), 1.5).otherwise(1.0) if concludes else F.lit(1.0)
    scored = chunks.withColumn("score", (hits + marks) * F.col("importance") * boost).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy(keys[0]).orderBy(F.desc("score"), *keys[1:]))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most).select(*keys, "score", "rank")


def nearest(vectors: DataFrame, query: list[float], k: int = 10, *, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k rows of largest cosine; ties by key. Rows of another length are dropped. Spark keeps k rows in each task, so no full sort is made."""
    target = F.array(*[F.lit(float(x)) for x in query])
    found = vectors.select(key, cosine(F.col(column), target).alias("score")).dropna()
    return found.orderBy(F.desc(F.round("score", 6)), key).limit(k)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int = 10, *, key: str = "vec_id", column: str = "embedding", block: int = 16384) -> DataFrame:
    """query_id, key, score: for each row of queries (keys are distinct) the k rows of largest cosine; ties by key.

    Rows of another length, or with nulls, are dropped; so are those without a direction because a component is not finite. Rows are dealt by
    a hash of their key into blocks of about `block`, and each query goes to each block. A task reads a block's rows, then its queries as a
    stream, and keeps k rows for each query and block: Python holds one block, one batch of vectors and the scores of SLAB queries.
    """
    sound = lambda df: df.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("vector")).filter("key is not null and vector is not null and not exists(vector, x -> x is null)")
    rows, asked = sound(vectors), sound(queries)
    parts = max(1, -(-rows.count() // block))
    dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(parts)).cast("long").alias("gid"), F.size("vector").alias("dims"), F.lit(0).alias("asked"), "key", "vector")
    sent = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("gid"), F.size("vector").alias("dims"), F.lit(1).alias("asked"), "key", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, units = None, np.zeros(0, np.int64), []
        for batch in batches:
            marks = np.column_stack([batch.column(c).to_numpy() for c in ("gid", "dims", "asked")])
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                gid, dims, is_asked = marks[a].tolist()
                if (gid, dims) != at:
                    at, ids, units = (gid, dims), np.zeros(0, np.int64), []
                own = batch.column("key").slice(a, b - a).to_numpy()
                found = _unit(batch.column("vector").slice(a, b - a).flatten().to_numpy().reshape(b - a, dims))
                good = ~np.isnan(found).any(axis=1)
                own, found = own[good], found[good]
                if not is_asked:
                    ids, units = np.concatenate((ids, own)), [*units, found]
                elif len(ids):
                    units = units if len(units) == 1 else [np.concatenate(units)]
                    for n in range(0, len(own), SLAB):
                        yield _best(own[n : n + SLAB], found[n : n + SLAB], ids, units[0], k, key)

    kept = dealt.unionByName(sent).repartition("gid").sortWithinPartitions("gid", "dims", "asked").select("gid", "dims", "asked", "key", "vector").mapInArrow(run, f"query_id long, {key} long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), key))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", key, "score")


def _best(q_ids: np.ndarray, q_units: np.ndarray, ids: np.ndarray, units: np.ndarray, k: int, key: str) -> pa.RecordBatch:
    """query_id, key, score: of each query the k rows of largest rounded score; ties by key."""
    scores = q_units @ units.T
    rounded, most = np.round(scores, 6), min(k, len(ids))
    bars = np.partition(rounded, len(ids) - most, axis=1)[:, len(ids) - most]
    best = [reach[np.lexsort((ids[reach], -r[reach]))[:k]] for r, reach in ((r, np.flatnonzero(r >= bar)) for r, bar in zip(rounded, bars, strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, [len(x) for x in best])), pa.array(np.concatenate([ids[x] for x in best])), pa.array(np.concatenate([scores[j][x] for j, x in enumerate(best)]))], ["query_id", key, "score"])


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows by their norms; zeros stay zeros."""
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norms == 0, 1.0, norms)
