"""Prefix trie of conversations, built level by level and rolled up in reverse.

Conversations of equal turns are one class first, so a level holds no copies. Per depth the live classes are grouped by (parent node, next
turn) and get the smallest conv_id of their group as the node's name. A class that is alone in its node leaves the loop: the rest of its
turns is a chain whose counts are known. The rounds end at the depth down to which two different conversations agree. The levels are then
joined in reverse, each node adding its children's leaves and savings.

Defined cases: rows without a conv_id belong to no conversation; a null role or text is empty; turns are in ascending order, null first,
rows of one turn by role, then text, repeated rows all count; texts of any length are read once, as a digest and a length; a conversation
may have no turns after rebuilding and is then a member of the root alone; an empty table has no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.shared import materialize, new_path

EMPTY = hashlib.sha256(b"").hexdigest()
IDS_IN_CHUNK = 4096


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, r (from 1), key (digest of role and text), n_bytes, upto (bytes up to this turn).

    Turns are range-sorted, so a conversation of very many turns lies in many partitions; ranks and sums run within a partition and
    are moved by what lies before it.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv_id is not null")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = materialize(rows.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), key.alias("key"), F.octet_length("text").cast("long").alias("n_bytes")), "turns")
    runs = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"))
    here = Window.partitionBy("conv_id", "part").orderBy("place")
    rows = rows.withColumn("r", F.row_number().over(here)).withColumn("upto", F.sum("n_bytes").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("r") + F.col("rows_before")).alias("r"), "key", "n_bytes", (F.col("upto") + F.col("bytes_before")).alias("upto"))


def own_turns(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) and the turns (conv_id, depth, key, n_bytes, rest) of conversations as they are; rest: bytes from this turn to the end."""
    convs = ranked.groupBy("conv_id").agg(F.count("*").alias("length"), F.sum("n_bytes").alias("total"))
    turns = ranked.join(convs, "conv_id").select("conv_id", F.col("r").alias("depth"), "key", "n_bytes", (F.col("total") - F.col("upto") + F.col("n_bytes")).alias("rest"))
    return convs.select("conv_id", "length"), turns


def rebuilt_turns(ranked: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """As own_turns, but conversation c begins with the first h turns of conversation c - c % group, then has its own after its first h; h = crc32(c) % most.

    A conversation lends at most most - 1 turns to fewer than 2 * group others, so the join by lender has no hot key.
    """
    head = F.when(F.col("r") < most, F.struct("r", "key", "n_bytes"))
    convs = ranked.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("total"), F.sort_array(F.collect_list(head)).alias("head"))
    convs = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    lenders = convs.select(F.col("conv_id").alias("lender"), F.col("head").alias("lent"))
    none = F.filter("head", lambda x: F.lit(False))
    convs = convs.withColumn("lender", F.col("conv_id") - F.col("conv_id") % group).join(lenders, "lender", "left")
    convs = convs.withColumn("lent", F.slice(F.coalesce("lent", none), F.lit(1), F.col("h")))
    added = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["n_bytes"])
    convs = convs.withColumn("rest", F.col("total") - added(F.slice("head", F.lit(1), F.col("h")))).withColumn("length", F.size("lent") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    convs = materialize(convs.select("conv_id", "h", "lent", "total", "rest", "length"), "rebuilt")
    first = convs.select("conv_id", "rest", "lent", F.posexplode("lent").alias("i", "x"))
    first = first.select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "x.key", "x.n_bytes", (added(F.slice("lent", F.col("i") + 1, F.size("lent"))) + F.col("rest")).alias("rest"))
    own = ranked.join(convs.select("conv_id", "h", "total", F.size("lent").alias("lent")), "conv_id").filter("r > h")
    own = own.select("conv_id", (F.col("lent") + F.col("r") - F.col("h")).alias("depth"), "key", "n_bytes", (F.col("total") - F.col("upto") + F.col("n_bytes")).alias("rest"))
    return convs.select("conv_id", "length"), first.unionByName(own)


def _classes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, rep (smallest conv_id with the same turns), weight (how many those are), length. Equal turns: equal 128 bits of hashes and equal length."""
    mixed = [F.bit_xor(F.xxhash64("depth", "key", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
    hashed = convs.join(turns.groupBy("conv_id").agg(*mixed), "conv_id", "left").select("conv_id", "length", F.coalesce("x1", F.lit(0)).alias("x1"), F.coalesce("x2", F.lit(0)).alias("x2"))
    hashed = materialize(hashed, "hashed")
    groups = hashed.groupBy("x1", "x2", "length").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight"))
    return materialize(hashed.join(groups, ["x1", "x2", "length"]).select("conv_id", "rep", "weight", "length"), "classes")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (rep, conv_id) to rows (rep, first, ids): up to IDS_IN_CHUNK ids of one rep as text."""
    rep, ids = None, []
    for batch in batches:
        rows: list[tuple[int, int, str]] = []
        for r, c in zip(batch.column("rep").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (r != rep or len(ids) == IDS_IN_CHUNK):
                rows.append((rep, ids[0], ",".join(map(str, ids))))
                ids = []
            rep = r
            ids.append(c)
        yield _rows(rows, ("rep", "first", "ids"), (pa.int64(), pa.int64(), pa.string()))
    if ids:
        yield _rows([(rep, ids[0], ",".join(map(str, ids)))], ("rep", "first", "ids"), (pa.int64(), pa.int64(), pa.string()))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (rep, first, ids) to (rep, ends): the digest runs over the chunks as they come."""
    rep, state = None, None
    for batch in batches:
        rows = []
        for r, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if state is not None and r == rep:
                state.update(b",")
            else:
                if state is not None:
                    rows.append((rep, state.hexdigest()))
                rep, state = r, hashlib.sha256()
            state.update(ids.encode())
        yield _rows(rows, ("rep", "ends"), (pa.int64(), pa.string()))
    if state is not None:
        yield _rows([(rep, state.hexdigest())], ("rep", "ends"), (pa.int64(), pa.string()))


def _rows(rows: list[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=list(names))


def end_digests(classes: DataFrame) -> DataFrame:
    """rep, ends: SHA-256 of the members' ids, ascending and comma-joined.

    A digest reads its input in order, so a class's ids pass one task in the end, but as a stream of chunks that sorted range partitions have joined.
    """
    alone = classes.filter("weight = 1").select("rep", F.sha2(F.col("rep").cast("string"), 256).alias("ends"))
    members = classes.filter("weight > 1").select("rep", "conv_id").repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id")
    chunks = members.mapInArrow(_chunks, "rep long, first long, ids string").repartition("rep").sortWithinPartitions("rep", "first")
    return alone.unionByName(chunks.mapInArrow(_hashes, "rep long, ends string"))


def build(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie over convs (conv_id, length) and turns (conv_id, depth from 1, key, n_bytes, rest).

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A node is named by its depth and its
    smallest member. saved_tokens: over the subtree, (n_convs - 1) times the bytes of the node's last text.
    """
    spark = convs.sparkSession
    classes = _classes(convs, turns)
    reps = classes.filter("conv_id = rep").select("conv_id", "weight", "length")
    turns = materialize(turns.join(reps, "conv_id").sortWithinPartitions("depth"), "class_turns")  # pages of other depths are skipped
    root = classes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    ended = reps.filter("length = 0").select(F.col("conv_id").alias("ended"))
    root = materialize(root.join(F.broadcast(ended), F.lit(True), "left"), "root")  # ended: one row at most

    levels, rolled = new_path(spark, "levels"), new_path(spark, "rolled")
    live = reps.filter("length > 0").select("conv_id").join(F.broadcast(root.select(F.col("conv_id").alias("parent"))), F.lit(True))
    depth, kind = 0, None
    while depth == 0 or not live.isEmpty():
        depth += 1
        step = turns.filter(F.col("depth") == depth).drop("depth").join(live, "conv_id")
        groups = step.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.sum("weight").alias("n_convs"), F.count("*").alias("n_classes"))
        level = step.join(groups, ["parent", "key"]).drop("key")
        level.write.option("compression", "zstd").parquet(f"{levels}/depth={depth}")
        kind = level.schema
        live = spark.read.schema(kind).parquet(f"{levels}/depth={depth}").filter(f"n_classes > 1 and length > {depth}").select("conv_id", F.col("node").alias("parent"))
    deepest = depth

    def at(d: int) -> DataFrame:
        return spark.read.schema(kind).parquet(f"{levels}/depth={d}")

    columns = ["conv_id", "parent", "n_convs", "n_children", "n_leaves", "saved", "ended"]
    below = None
    for d in range(deepest, -1, -1):
        if d:
            shared = at(d).filter("n_classes > 1")
            # of a node's classes one at most has no further turn
            nodes = shared.groupBy("node", "parent", "n_convs").agg(F.max("n_bytes").alias("n_bytes"), F.max(F.when(F.col("length") == d, F.col("conv_id"))).alias("ended")).withColumnRenamed("node", "conv_id")
        else:
            nodes = root.select("conv_id", F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("n_bytes"), "ended")
        if d < deepest:
            chains = at(d + 1).filter("n_classes = 1").select("parent", F.lit(1).cast("long").alias("n_leaves"), ((F.col("weight") - 1) * F.col("rest")).alias("saved"))
            children = chains.unionByName(below.select("parent", "n_leaves", "saved")).groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("below_leaves"), F.sum("saved").alias("below_saved"))
            nodes = nodes.join(children, "conv_id", "left")
        else:
            nodes = nodes.select("*", *[F.lit(None).cast("long").alias(c) for c in ("n_children", "below_leaves", "below_saved")])
        saved = (F.col("n_convs") - 1) * F.col("n_bytes") + F.coalesce("below_saved", F.lit(0))
        nodes = nodes.select("conv_id", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("below_leaves", F.lit(1)).alias("n_leaves"), saved.alias("saved"), "ended").select(*columns)
        nodes.write.option("compression", "zstd").parquet(f"{rolled}/depth={d}")
        below = spark.read.schema(nodes.schema).parquet(f"{rolled}/depth={d}")

    shared = spark.read.parquet(rolled).select("depth", *columns)
    alone = spark.read.parquet(levels).filter("n_classes = 1").select("conv_id", F.col("depth").alias("begin"), "parent")
    chains = turns.join(alone, "conv_id").filter("depth >= begin")
    chains = chains.select("depth", "conv_id", F.when(F.col("depth") == F.col("begin"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent"), F.col("weight").alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"), F.lit(1).alias("n_leaves"), ((F.col("weight") - 1) * F.col("rest")).alias("saved"), F.when(F.col("depth") == F.col("length"), F.col("conv_id")).alias("ended"))
    nodes = shared.unionByName(chains)
    open_nodes = nodes.filter("ended is null").withColumn("ends_sha256", F.lit(EMPTY))
    closed = nodes.filter("ended is not null").join(end_digests(classes).withColumnRenamed("ends", "ends_sha256"), F.col("ended") == F.col("rep"))
    found = [F.col("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), *[F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves")], F.col("saved").cast("long").alias("saved_tokens"), F.col("ends_sha256")]
    return open_nodes.select(*found).unionByName(closed.select(*found))


def trie_of(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """build() over a table (conv_id, turn, role, text); rebuild: over conversations rebuilt as in rebuilt_turns."""
    ranked = materialize(ranked_turns(conversations), "ranked")
    convs, turns = rebuilt_turns(ranked) if rebuild else own_turns(ranked)
    return build(convs, turns)
