"""Cutting ordered fragments into overlapping chunks.

A chunk is closed before a fragment that would make it exceed `size` words; the last `overlap` words are carried into the next one. A single
fragment is never split. Carried words have no page any more, and the last chunk's importance is computed without pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCS_AT_ONCE = 256
CHUNKS = "doc_id long, chunk_id int, content string, page_numbers array<int>, token_count int, importance double"


def clamp(size: int, overlap: int) -> tuple[int, int]:
    """The sizes that callers may ask for: 50 to 10,000 words, overlap at most half of it."""
    size = min(10_000, max(50, size))
    return size, min(max(0, overlap), size // 2)


def fold(fragments: list[tuple[int, str]], size: int, overlap: int) -> list[tuple[str, list[int], int, float]]:
    """(content, pages, words, importance) of each chunk of one document's (page, text) fragments in order."""
    done: list[tuple[str, list[int], int, float]] = []
    text, pages, count = "", [], 0
    for page, piece in fragments:
        incoming = len(piece.split())
        if count and count + incoming > size:
            done.append((text, pages, count, min(1.0, 0.5 + 0.15 * (1 in pages) + 0.1 * (count > 200))))
            carried = text.split()[-overlap:] if overlap else []
            text, pages, count = " ".join(carried), [], len(carried)
        text = f"{text} {piece}" if text else piece
        count += incoming
        if page not in pages:
            pages = [*pages, page]
    if count:
        done.append((text, pages, count, 0.5 + 0.1 * (count > 200)))
    return done


def chunk_texts(docs: DataFrame, size: int = 500, overlap: int = 50, *, separator: str = "\n") -> DataFrame:
    """Chunks of (doc_id, text), whose fragments are the text's parts between separators, all on page 1. A document is one row, so nothing is shuffled."""
    size, overlap = clamp(size, overlap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # a batch's chunks are given in parts, so that they do not lie in memory together with all its texts
            for first in range(0, max(1, len(batch)), DOCS_AT_ONCE):
                part, rows = batch.iloc[first : first + DOCS_AT_ONCE], []
                for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                    fragments = [(1, p) for p in (text or "").split(separator) if p.strip()]
                    rows += [(doc_id, k, *c) for k, c in enumerate(fold(fragments, size, overlap))]
                yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "content", "page_numbers", "token_count", "importance"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInPandas(run, CHUNKS)


def chunk_fragments(fragments: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of (doc_id, page_number, frag_idx, text) rows; a document's fragments go to one task, as the fold is sequential."""
    size, overlap = clamp(size, overlap)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["page_number", "frag_idx"])
        found = fold(list(zip(part["page_number"].tolist(), part["text"].fillna("").tolist(), strict=True)), size, overlap)
        rows = [(part["doc_id"].iloc[0], k, *c) for k, c in enumerate(found)]
        return pd.DataFrame(rows, columns=["doc_id", "chunk_id", "content", "page_numbers", "token_count", "importance"])

    return fragments.select("doc_id", "page_number", "frag_idx", "text").groupBy("doc_id").applyInPandas(run, CHUNKS)


def sliding(docs: DataFrame, size: int, step: int) -> DataFrame:
    """Fixed windows of `size` words every `step` words (step = size: without overlap), in DataFrame functions."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = docs.select("doc_id", words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 1), F.lit(step))
    # each window is cut before rows are made of them, so that no row carries the whole text
    window = lambda at: F.struct(F.array_join(F.slice("words", at + 1, F.lit(size)), " ").alias("content"), F.least(F.lit(size), F.size("words") - at).alias("token_count"))
    return rows.select("doc_id", F.posexplode(F.transform(starts, window)).alias("chunk_id", "w")).select("doc_id", "chunk_id", "w.content", "w.token_count")
