"""What the operators share: the folder that all executors see, and Arrow batch helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_CHARS = 4_000_000
_local_dir: str | None = None  # of a local session without spark.checkpoint.dir


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may go without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _local_dir
    _local_dir = _local_dir or tempfile.mkdtemp(prefix="docframe-")
    return _local_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage is cut and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and text alone, so that no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(id_column: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


class Kept:
    """Values by key. make(keys, get) gives the values of keys that are new, of others too if it likes; get(key): a kept value, or None. At most
    about `most` are kept, in two halves: a full half becomes the old one, the one before it is dropped, and what is asked for again is taken
    over from the old one, so that frequent keys stay."""

    def __init__(self, make: Callable[[list[str], Callable], dict[str, bytes]], most: int):
        self._make, self._half = make, max(1, most // 2)
        self._new, self._old = {}, {}

    def get(self, key: str) -> bytes | None:
        found = self._new.get(key)
        return self._old.get(key) if found is None else found

    def joined(self, keys: list[str]) -> bytes:
        """The values of all keys, end to end."""
        distinct = set(keys)
        missing = distinct.difference(self._new)
        if missing and len(self._new) + len(missing) > self._half:
            self._old, self._new, missing = self._new, {}, distinct
        if missing:
            back = missing & self._old.keys()
            self._new.update((k, self._old[k]) for k in back)
            self._new.update(self._make([k for k in missing if k not in back], self.get))
        return b"".join(map(self._new.__getitem__, keys))


def text_chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about `most` characters, so that memory does not follow the batch's size."""
    texts, first, held = [], 0, 0
    for i, x in enumerate(batch.column(column)):
        text = x.as_py() or ""
        if texts and held + len(text) > most:
            yield first, texts
            texts, first, held = [], i, 0
        texts.append(text)
        held += len(text)
    if texts:
        yield first, texts


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
