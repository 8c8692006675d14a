"""Content hashes of blocks, and claims held against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["doc_id", "section", "block"]


def record(blocks: DataFrame) -> DataFrame:
    """A row for each block, empty ones too: the hash of its trimmed text; page 0 and no box, as authored blocks have none."""
    return blocks.select(*KEYS, F.lit(0).alias("page"), F.sha2(F.trim(F.coalesce("text", F.lit(""))), 256).alias("hash"))


def verify(claims: DataFrame, records: DataFrame) -> DataFrame:
    """matched, drifted or unrecorded. A claim's text is hashed as it stands, so a trailing blank drifts."""
    found = claims.join(records.select(*KEYS, "hash"), KEYS, "left")
    same = F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("hash")
    return found.select(*claims.columns, F.when(F.col("hash").isNull(), "unrecorded").when(same, "matched").otherwise("drifted").alias("state"))
