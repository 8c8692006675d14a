"""Ranked lexical search over a two-level quantised index.

The index is cut by documents: a row holds a run of documents with the postings of all their terms. Its first level has one byte for each
posting, the term's impact in the document rounded upward, so sums of bytes times term weights are upper bounds of scores, and sums of one
less are lower bounds. Its second level has the exact counts. A search reads the rows once: documents whose upper bound reaches the kth
best score known so far are scored again in exact integers; the bar only rises, so every document that reaches the last bar was scored.

Defined cases: a null or empty text has no terms and is no document of N; rows without a doc_id or item_id take no part; a repeated row
is a document of its own and ties with its copy; of equal scores the smaller doc_id comes first; an item without terms, or whose terms are
in no document, has no rows; an item_id that repeats is one item with the terms of all its rows. A text is read whole at any length; a run
holds RUN_BYTES or one longer text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.shared import materialize, texts_of

NOT_A_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
UNIT = 10**9
STEP = -(-(UNIT // 1000) // 255)  # an impact is below UNIT / 1000; so many of it make one of the byte's steps
RUN_BYTES = 2_000_000
PAIRS_IN_BLOCK = 1 << 20  # pairs of item and term that one reading of the index serves
INDEX = "doc_ids array<long>, m array<long>, terms binary, ends array<int>, docs binary, impacts binary, tfs binary"


def terms_of(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, NOT_A_TERM), lambda t: t != "")


def corpus_counts(docs: DataFrame) -> tuple[int, int]:
    """(documents with at least one term, all their terms)."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    row = docs.select(n.cast("long").alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return row["docs"], row["terms"]


def build(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Rows of the index (INDEX) for docs (doc_id, text). No shuffle: a row holds documents that one task reads one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        words: list[list[bytes]] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if ids and held + len(raw) > RUN_BYTES:
                    yield _index_row(ids, words, n_docs, n_terms)
                    ids, words, held = [], [], 0
                found = raw.translate(TERM_BYTES).split()
                if found:
                    ids.append(doc_id)
                    words.append(found)
                    held += len(raw)
        if ids:
            yield _index_row(ids, words, n_docs, n_terms)

    return docs.select("doc_id", "text").mapInArrow(run, INDEX)


def _index_row(ids: list[int], words: list[list[bytes]], n_docs: int, n_terms: int) -> pa.RecordBatch:
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    m = 10 + 90 * lengths * n_docs // n_terms
    codes, terms = pd.factorize(np.array([t for w in words for t in w], dtype=object))
    keys, tfs = np.unique(codes * np.int64(len(ids)) + np.repeat(np.arange(len(ids), dtype=np.int64), lengths), return_counts=True)
    code, doc = np.divmod(keys, len(ids))
    impacts = -(-_exact(tfs, m[doc]) // STEP)
    ends = np.searchsorted(code, np.arange(len(terms)), side="right")
    row = [ids, m.tolist(), b" ".join(terms), ends.tolist(), doc.astype(np.int32).tobytes(), impacts.astype(np.uint8).tobytes(), tfs.astype(np.int32).tobytes()]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["doc_ids", "m", "terms", "ends", "docs", "impacts", "tfs"])


def _exact(tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    return UNIT * tfs // (1000 * tfs + 8 * m)


def document_frequencies(index: DataFrame) -> DataFrame:
    """term, df: a row of the index gives each of its terms with the number of its documents, so a frequent term is summed, not gathered."""
    rows = index.select(F.posexplode(F.split(F.decode("terms", "UTF-8"), " ")).alias("i", "term"), "ends")
    n = F.col("ends")[F.col("i")] - F.when(F.col("i") > 0, F.col("ends")[F.col("i") - 1]).otherwise(0)
    return rows.select("term", n.cast("long").alias("n")).groupBy("term").agg(F.sum("n").alias("df"))


def weigh(items: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """item_id, term, w: the items' terms that are in a document."""
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array_distinct(terms_of(F.col("text").cast("string")))).alias("term")).filter("item_id is not null").distinct()
    df = document_frequencies(index)
    w = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
    return wanted.join(df, "term").select("item_id", "term", w.cast("long").alias("w"))


def search(index: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0.

    The items' terms are sent to the tasks in blocks of about PAIRS_IN_BLOCK pairs (or one item with more); each block reads the index
    once. A task keeps k results for each item, so what is shuffled does not grow with a term's frequency or a group of copies.
    """
    spark = index.sparkSession
    weights = materialize(weights, "weights")
    n_blocks = -(-weights.count() // PAIRS_IN_BLOCK)
    if not n_blocks:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    cuts = weights.agg(F.percentile_approx("item_id", [i / n_blocks for i in range(1, n_blocks)], 10_000).alias("cuts")).first()["cuts"] if n_blocks > 1 else []
    found = []
    for low, high in zip([None, *sorted({*cuts})], [*sorted({*cuts}), None], strict=True):
        block = weights.filter((F.lit(True) if low is None else F.col("item_id") > low) & (F.lit(True) if high is None else F.col("item_id") <= high))
        rows = block.toPandas()
        best = index.mapInArrow(_searcher(rows, k), "item_id long, doc_id long, score long")
        order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
        found.append(materialize(best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "ranked_items"))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result.select("item_id", "rank", "doc_id", "score")


def _searcher(rows: pd.DataFrame, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    terms, codes = np.unique(rows["term"].to_numpy(dtype=object), return_inverse=True)
    number = {t.encode(): i for i, t in enumerate(terms)}
    item_ids, item = np.unique(rows["item_id"].to_numpy(), return_inverse=True)
    order = np.argsort(item, kind="stable")
    cuts = np.searchsorted(item[order], np.arange(len(item_ids) + 1))
    own = [(codes[order[a:b]], rows["w"].to_numpy()[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in item_ids]  # of each item (-score, doc_id), ascending, k at most
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                _search_row(row, number, own, best, k)
        out = [(int(item_ids[j]), doc, -score) for j, found in enumerate(best) for score, doc in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], names=["item_id", "doc_id", "score"])

    return run


def _search_row(row: dict, number: dict[bytes, int], own: list, best: list, k: int) -> None:
    ends = row["ends"].values.to_numpy()
    begins = np.concatenate([[0], ends[:-1]])
    span: dict[int, tuple[int, int]] = {}
    for t, a, b in zip(row["terms"].as_py().split(b" "), begins.tolist(), ends.tolist(), strict=True):
        n = number.get(t)
        if n is not None:
            span[n] = (a, b)
    docs, impacts, tfs = np.frombuffer(row["docs"].as_buffer(), np.int32), np.frombuffer(row["impacts"].as_buffer(), np.uint8), np.frombuffer(row["tfs"].as_buffer(), np.int32)
    ids, m = row["doc_ids"].values.to_numpy(), row["m"].values.to_numpy()
    for j, (codes, weights) in enumerate(own):
        here = [(*span[c], w) for c, w in zip(codes.tolist(), weights.tolist(), strict=True) if c in span]
        if not here:
            continue
        places = np.concatenate([docs[a:b] for a, b, _ in here])
        sizes, w = np.array([b - a for a, b, _ in here]), np.array([w for _, _, w in here], dtype=np.int64)
        each = np.repeat(w, sizes)
        high = np.bincount(places, each * np.concatenate([impacts[a:b] for a, b, _ in here]), minlength=len(ids))
        # the bar: the kth best score so far, or the kth best lower bound of this row
        bar = -best[j][-1][0] if len(best[j]) == k else 0
        if len(ids) >= k:
            low = high - np.bincount(places, each, minlength=len(ids))
            bar = max(bar, int(np.partition(low, len(low) - k)[len(low) - k]) * STEP)
        chosen = np.flatnonzero((high * STEP >= bar) & (high > 0))
        if not len(chosen):
            continue
        at = np.full(len(ids), -1)
        at[chosen] = np.arange(len(chosen))
        mine = at[places] >= 0
        # exact integers from here on; postings of the chosen documents alone
        posting = np.concatenate([np.arange(a, b) for a, b, _ in here])[mine]
        scores = np.zeros(len(chosen), dtype=np.int64)
        np.add.at(scores, at[places[mine]], each[mine] * _exact(tfs[posting].astype(np.int64), m[places[mine]]))
        keep = scores > 0
        best[j] = sorted([*best[j], *zip((-scores[keep]).tolist(), ids[chosen[keep]].tolist(), strict=True)])[:k]


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of docs (doc_id, text) for each of items (item_id, text)."""
    texts = texts_of(docs, "doc_id", "text").filter("doc_id is not null")
    n_docs, n_terms = corpus_counts(texts)
    if not n_docs:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    index = materialize(build(texts, n_docs, n_terms), "lexical_index")
    return search(index, weigh(items, index, n_docs), k)
