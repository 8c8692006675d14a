"""Media columns: texts stored as progressive JPEG files, read back to RGB tensors and features.

A text's UTF-8 bytes, filled with 255 up to a positive multiple of `unit`, are an image's quantized coefficients: byte minus OFFSET, in scan
order. The last macroblock is filled with zeros. The number of payload bytes stands in the file's comment.

Defined cases: a null or empty text is one unit of 255; equal texts give equal files and features, as all arithmetic is in whole numbers;
repeated rows give equal rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docframe.llm import progressive_jpeg as jpeg
from docframe.llm.shared import text_chunks, texts_of

UNIT, OFFSET = 576, 104  # the offset is near the mean of prose, so that coefficients are small
_AT_ONCE = 1_500_000


def store(docs: DataFrame, *, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (before filling), media (the file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch, most=_AT_ONCE):
                raw = [t.encode() for t in texts]
                images, comments = [], []
                for b in raw:
                    payload = b + b"\xff" * (max(1, -(-len(b) // unit)) * unit - len(b))
                    mcus = -(-len(payload) // (jpeg.MCU_BLOCKS * jpeg.BLOCK))
                    image = np.zeros(mcus * jpeg.MCU_BLOCKS * jpeg.BLOCK, np.int16)
                    image[: len(payload)] = np.frombuffer(payload, np.uint8).astype(np.int16) - OFFSET
                    images.append(image.reshape(mcus, jpeg.MCU_BLOCKS, jpeg.BLOCK))
                    comments.append(b"%d" % len(payload))
                files = jpeg.encode_images(images, comments)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array([len(b) for b in raw], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _file_chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    files, first, held = [], 0, 0
    for i, x in enumerate(batch.column("media")):
        file = x.as_py()
        if files and held + len(file) > _AT_ONCE:
            yield first, files
            files, first, held = [], i, 0
        files.append(file)
        held += len(file)
    if files:
        yield first, files


def _features(mcus: np.ndarray) -> str:
    """Of each colour the mean, the mean square and the share of values in each eighth of the range."""
    flat = mcus.reshape(-1, 3)
    parts = []
    for c in range(3):
        x = flat[:, c]
        held = np.bincount(x, minlength=256)
        level = np.arange(256)
        shares = held.reshape(8, 32).sum(axis=1)
        parts.append(",".join([f"{int(held @ level) / len(x):.4f}", f"{int(held @ (level * level)) / len(x):.2f}", *(f"{int(n) / len(x):.4f}" for n in shares)]))
    return ";".join(parts)


def read(stored: DataFrame, *, tensors: bool = True) -> DataFrame:
    """doc_id, n_bytes, payload digests, media digests, feature, and with tensors height, width and rgb (height * width * 3 bytes, row by row)."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["height", "width", "rgb"] * tensors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, files in _file_chunks(batch):
                decoded = jpeg.decode_images(files)
                pixels = jpeg.to_rgb(np.concatenate([x[0] for x in decoded]))
                rows, at = [], 0
                for file, (blocks, (wide, high), comment) in zip(files, decoded, strict=True):
                    payload = (blocks.reshape(-1)[: int(comment)] + OFFSET).astype(np.uint8).tobytes()
                    own = pixels[at : at + len(blocks)]
                    at += len(blocks)
                    row = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), _features(own)]
                    rows.append(row + ([high * 16, wide * 16, jpeg.assemble(own, wide, high).tobytes()] if tensors else []))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[: len(rows[0])], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(first, len(files)) for c in ("doc_id", "n_bytes")] + made, names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema + ", height int, width int, rgb binary" * tensors)
