"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on document ids.

The table is in ascending document order: documents are range-partitioned and sorted by id, each
task encodes its range and writes ORC files whose stripes are read in parallel. ORC keeps integers
run-length encoded (RLEv2), an index entry for every `row_index_stride` rows and, on doc_id, a Bloom
filter, so that a look-up of ids skips files, stripes and row groups by their metadata.

Defined cases: a null or empty text has only the end id; a null doc_id sorts first; repeated doc_ids
follow each other in the order of their texts' hashes; an empty table gives an empty table; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docframe.llm.shared import text_chunks, texts_of
from docframe.llm.token_cache import encoder

STORED = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"


def write_token_table(docs: DataFrame, tokenizer: str, path: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", row_index_stride: int = 1000, stripe_bytes: int = 64 << 20, bloom_fpp: float = 0.01) -> None:
    """Encode every whole text and write its ids with end_id after them. `tokenizer`: a tokenizers file that executors can read."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for first, texts in text_chunks(batch):
                found = encoder(tokenizer).encode_bytes(texts)
                sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4 + 1
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.frombuffer(end.join([*found, b""]), "<i4")))
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)), pa.array(np.full(len(texts), part, np.int32)), pa.array(starts), pa.array(sizes.astype(np.int32)), ids],
                    ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = texts_of(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    (
        ordered.mapInArrow(encode, STORED)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .orc(path)
    )


def read_token_table(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. doc_ids: read only these, pruned by ORC's indexes and Bloom filters.

    Only the per-part sums (a row for each task of the writer) are broadcast.
    """
    rows = spark.read.schema(STORED).orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(list(doc_ids)))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def with_checksum(rows: DataFrame, ids_col: str = "ids") -> DataFrame:
    """In place of the ids their ids_crc32: of little-endian unsigned 32-bit integers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(ids_col)
            values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].data) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            rest = [c for c in batch.schema.names if c != ids_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(sums, pa.int64())], [*rest, "ids_crc32"])

    kept = [f for f in rows.schema.fields if f.name != ids_col]
    return rows.mapInArrow(add, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", ids_crc32 long")
