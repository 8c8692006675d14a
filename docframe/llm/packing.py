"""Best-fit packing of token sequences by bulk-synchronous rounds.

Documents are cut into pieces of at most `capacity` ids (only longer documents; the first piece is
the shorter one) and range-sorted by length, which gives each piece its rank among the pieces of its
length. A round then works on runs: all pieces of one length, and all sequences with one gap, are a
run each, so a round's tables have at most `capacity` rows at any number of documents. In a round every
length sweeps to its successor, the smallest gap that holds it; lengths that meet at one gap are
resolved by rank, the longest first; all gaps are updated at once; and the next round begins. When no
gap holds a piece any more, as many new sequences are opened as the remaining ids need at least,
with the longest pieces in them. What comes out is a list of rank ranges (length, first rank, count ->
first sequence, offset), also bounded by the capacity alone, and one join on it places all pieces.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each by itself;
equal lengths are ranked by (doc_id, piece); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.shared import list_array, materialize, text_chunks, texts_of
from docframe.llm.token_cache import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row for each piece; keep_ids adds its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch):
                owner, number, start, length, crc, kept = [], [], [], [], [], []
                for i, found in enumerate(encoder(tokenizer).encode(texts)):
                    ids = np.append(found, np.uint32(end_id)).astype("<u4")
                    ends = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
                    begin = 0
                    for k, end in enumerate(ends):
                        owner.append(first + i)
                        number.append(k)
                        start.append(begin)
                        length.append(end - begin)
                        crc.append(zlib.crc32(ids[begin:end].data))
                        if keep_ids:
                            kept.append(ids[begin:end].astype(np.int32))
                        begin = end
                columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, list_array(kept, pa.int32())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return texts_of(docs, id_col, text_col).mapInArrow(cut, PIECES + ", ids array<int>" * keep_ids)


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds rank, from 0 among the pieces of its length: range-sort, count each length in each range, sum the counts before."""
    order = ["length", "doc_id", "piece"]
    rows = materialize(pieces.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "packing-sorted")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    cells = rows.groupBy("length", "part").agg(F.count("*").alias("held"), F.min("at").alias("first_at"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("length", "part", "first_at", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    # a range of sorted lengths meets few of them: at most ranges + capacity rows
    return rows.join(F.broadcast(bases), ["length", "part"]).withColumn("rank", F.col("base") + F.col("at") - F.col("first_at")).drop("at", "part", "first_at", "base")


def plan_runs(counts: np.ndarray, capacity: int) -> tuple[pd.DataFrame, int]:
    """The rounds. counts[n]: pieces of length n. Returns rank ranges with their places, and how many sequences there are."""
    left, used = counts.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)
    placed, opened = [], 0
    sizes = np.arange(capacity + 1)

    def place(size: int, first: int, many: int, gap: int) -> None:
        placed.append((size, int(used[size]), many, first, capacity - gap))
        used[size] += many
        left[size] -= many

    full = int(left[capacity])
    if full:
        place(capacity, 0, full, capacity)
        opened = full
    while left.any():
        while True:  # rounds until no piece has a successor
            there = np.array(sorted(g for g, runs in gaps.items() if runs and g), dtype=np.int64)
            want = np.nonzero(left)[0]
            at = np.searchsorted(there, want) if len(there) else np.full(len(want), 0)
            want, at = want[at < len(there)], at[at < len(there)]
            if not len(want):
                break
            new: list[tuple[int, int, int]] = []
            for k in np.unique(at):
                gap, runs = int(there[k]), gaps.pop(int(there[k]))
                for size in want[at == k][::-1]:  # rank: the longest piece first
                    while left[size] and runs:
                        first, many = runs.pop()
                        take = min(many, int(left[size]))
                        place(int(size), first, take, gap)
                        new.append((gap - int(size), first, take))
                        if take < many:
                            runs.append((first + take, many - take))
                if runs:
                    gaps.setdefault(gap, []).extend(runs)
            for gap, first, many in new:
                gaps.setdefault(gap, []).append((first, many))
        if not left.any():
            break
        needed = max(1, -(-int((left * sizes).sum()) // capacity))
        for size in np.nonzero(left)[0][::-1]:
            take = min(needed, int(left[size]))
            place(int(size), opened, take, capacity)
            gaps.setdefault(capacity - int(size), []).append((opened, take))
            opened, needed = opened + take, needed - take
            if not needed:
                break
    return pd.DataFrame(placed, columns=["length", "first_rank", "many", "first_sequence", "offset"]), opened


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to the pieces."""
    spark = pieces.sparkSession
    rows = ranked(materialize(pieces, "packing-pieces"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in rows.groupBy("length").count().collect():  # at most `capacity` rows
        counts[row["length"]] = row["count"]
    plan, _ = plan_runs(counts, capacity)
    table = spark.createDataFrame(plan.astype("int64"), "length long, first_rank long, many long, first_sequence long, offset long")
    found = rows.join(F.broadcast(table.withColumnRenamed("length", "of_length")), (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("many")))
    return found.withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("first_rank")).drop("of_length", "first_rank", "many", "first_sequence", "rank")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, *, keep_ids: bool = False) -> DataFrame:
    """Every document's pieces with sequence_id and offset (gapless from 0 in each sequence)."""
    return pack(token_pieces(docs, tokenizer, end_id, capacity, keep_ids=keep_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from a packing that kept them; a group holds at most `capacity` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
