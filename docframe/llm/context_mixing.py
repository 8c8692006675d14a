"""Language-model scores by online logistic context mixing.

A text's tokens are its words and one end. Frequent words, the end, and classes of other words are coded as bits that are mixed over
contexts of words, with weights and maps that are refined along each text (word_bits.py). A word of a class then costs
    log10((1 - new) * (its share of the class in training) + new * (the probability of its spelling)),
new being the class's share of words seen once. Spellings are coded bit by bit as the word's bytes and a blank (spelling.py). The score
is the log10 probability of all these bits.

What is gathered covers all training text and grows with it: every word is counted by Spark; tables of hashed contexts have a slot for each
TOKENS_A_SLOT tokens (or word of a class), up to MOST_BITS binary digits (beyond that contexts share slots); weights and maps are fitted on
all training documents and words, and averaged over tasks. Tables are summed shard by shard, in streams. What a training text
adds to the counts itself is taken out again where it is scored, so that only other text speaks for it. Of words, the
CODED most frequent ones have codes, and the values of HOT words at most are broadcast; all others are joined by hash.

Base score: sum over tokens of log10((c + 0.5) / (N + 0.5 * (V + 1))), with c, N and V of training tokens.

Defined cases: a null or empty text is the end alone; documents without doc_id are scored like others (crc32 of the empty text decides); with no
training text all counts are 0; very long texts are cut into runs, with no limit; equal texts of one fold score alike up to rounding;
repeated rows give equal rows; other columns are ignored. Words are told apart by a hash of 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm import spelling, word_bits
from docframe.llm.shared import held_out, materialize, text_chunks, texts_of

MODULUS, REMAINDER = 5, 1
HOT, CODED = 100_000, 512
TOKENS_A_SLOT, MOST_BITS, MOST_SPELLING_BITS = 64, 22, 20
SHARD, TASK_TABLES, AT_ONCE = 1 << 11, 32, 1_200_000


def count_words(docs: DataFrame) -> DataFrame:
    """hash (0: the end), kind (its class), word, held (uses in all documents), trained (in training documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array(batch.column("out").to_pylist(), bool)
            for first, texts in text_chunks(batch):
                tokens = word_bits.tokens_of(texts)
                trained = np.repeat(~out[first : first + len(texts)], np.diff(tokens.first))
                # sorted by the upper bits, with the token's number in the lower ones: hashes that share those bits may give several rows, which Spark adds up
                places = np.uint64((1 << len(tokens.hashes).bit_length()) - 1)
                order = (np.sort(tokens.hashes & ~places | np.arange(len(tokens.hashes), dtype=np.uint64)) & places).astype(np.int64)
                ordered = tokens.hashes[order]
                heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
                hashes, at, held = ordered[heads], order[heads], np.diff(np.concatenate((heads, [len(order)])))
                word_at = np.full(len(tokens.hashes), -1)
                word_at[tokens.place] = np.arange(len(tokens.place))
                raw, where = tokens.raw.tobytes(), word_at[at]
                words = [raw[a:b] if k >= 0 else b"" for k, a, b in zip(where.tolist(), tokens.starts[where].tolist() if len(tokens.starts) else [0] * len(where), tokens.ends[where].tolist() if len(tokens.ends) else [0] * len(where), strict=True)]
                uses = np.add.reduceat(trained[order].astype(np.int64), heads)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(tokens.kinds[at]), pa.array(words, pa.binary()), pa.array(held), pa.array(uses)], ["hash", "kind", "word", "held", "trained"])

    uses = docs.mapInArrow(run, "hash long, kind int, word binary, held long, trained long")
    return uses.groupBy("hash", "kind", "word").agg(F.sum("held").alias("held"), F.sum("trained").alias("trained"))


def _table_bits(many: int, most: int) -> int:
    return min(most, max(12, math.ceil(math.log2(max(1, many)))))


def _shards(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    flat = np.ascontiguousarray(table, np.uint32).reshape(-1, 2)
    for k in range(0, len(flat), SHARD):
        part = flat[k : k + SHARD]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k // SHARD], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["shard", "counts"])


def summed(parts: DataFrame, slots: int) -> np.ndarray:
    """(slots, 2) as 16-bit numbers from shard, counts of many tasks: added up shard by shard as they stream in, so that no task holds all parts of a shard."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, counts in zip(batch.column("shard").to_pylist(), batch.column("counts"), strict=True):
                part = np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64)
                totals[shard] = totals[shard] + part if shard in totals else part
        for shard, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([word_bits.packed_counts(total.reshape(-1, 2)).tobytes()], pa.binary())], ["shard", "counts"])

    out = np.zeros((slots, 2), np.uint16)
    for row in parts.repartition("shard").mapInArrow(add, "shard long, counts binary").collect():  # slots * 4 bytes in all, bounded by MOST_BITS
        part = np.frombuffer(bytes(row["counts"]), np.uint16).reshape(-1, 2)
        out[row["shard"] * SHARD : row["shard"] * SHARD + len(part)] = part
    return out


def _averaged(parts: DataFrame, start: np.ndarray) -> np.ndarray:
    """The mean of arrays from many tasks, weighted; parts: x array<double>, weight double. start where there are none."""
    rows = parts.select(F.posexplode("x").alias("i", "v"), "weight").groupBy("i").agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("v")).collect()  # len(start) rows
    out = start.reshape(-1).copy()
    for r in rows:
        out[r["i"]] = r["v"]
    return out.reshape(start.shape)


class _Mean:
    """The weighted mean of a task's arrays, given as one row, so that rows do not grow with the text."""

    def __init__(self) -> None:
        self.sum, self.weight = None, 0

    def add(self, x: np.ndarray, weight: int) -> None:
        x = x.reshape(-1).astype(np.float64) * weight
        self.sum, self.weight = x if self.sum is None else self.sum + x, self.weight + weight

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.weight:
            yield pa.RecordBatch.from_arrays([pa.array([self.sum / self.weight], pa.list_(pa.float64())), pa.array([float(self.weight)])], ["x", "weight"])


def train_words(docs: DataFrame, code: word_bits.WordCode, tokens: int) -> word_bits.Mixer:
    """Counts, weights and map of all training documents."""
    spark, bits = docs.sparkSession, _table_bits(tokens // TOKENS_A_SLOT, MOST_BITS)
    shared = spark.sparkContext.broadcast(code)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits, 2), np.uint32)
        for batch in batches:
            for _, texts in text_chunks(batch, most=AT_ONCE):
                word_bits.count(shared.value, word_bits.tokens_of(texts), bits, total)
        yield from _shards(total)

    # so many tasks that their tables together stay a fixed share of the text
    tasks = max(12, tokens // (TASK_TABLES << bits))
    known = docs.filter("not out").select("doc_id", "text")
    counts = summed(known.coalesce(tasks).mapInArrow(count, "shard long, counts binary"), 2 << bits)
    mixer = word_bits.Mixer.fresh(counts.reshape(2, 1 << bits, 2))
    given = spark.sparkContext.broadcast(mixer)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Mean()
        for batch in batches:
            for _, texts in text_chunks(batch, most=AT_ONCE):
                _, weights, refined, _ = word_bits.mix(shared.value, given.value, word_bits.tokens_of(texts), np.ones(len(texts), bool), word_bits.FIT_RATE)
                total.add(np.concatenate((weights.reshape(-1), refined.reshape(-1))), len(texts))
        yield from total.rows()

    found = _averaged(known.mapInArrow(fit, "x array<double>, weight double"), np.concatenate((mixer.weights.reshape(-1), mixer.refined.reshape(-1)))).astype(np.float32)
    cut = mixer.weights.size
    return word_bits.Mixer(mixer.counts, found[:cut].reshape(mixer.weights.shape), found[cut:].reshape(mixer.refined.shape))


def train_spelling(vocabulary: DataFrame, types: int) -> spelling.Speller:
    """Counts, weights and map of all training words that have no code, each once."""
    spark, bits = vocabulary.sparkSession, _table_bits(types, MOST_SPELLING_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((spelling.PREDICTORS << bits, 2), np.uint32)
        for batch in batches:
            for k in range(0, len(batch), 3000):
                part = batch.slice(k, 3000)
                spelling.count(part.column("word").to_pylist(), part.column("kind").to_numpy(), bits, total)
        yield from _shards(total)

    tasks = max(6, types // (TASK_TABLES << bits))
    known = vocabulary.filter("trained > 0").select("word", "kind", "hash")
    speller = spelling.Speller.fresh(summed(known.coalesce(tasks).mapInArrow(count, "shard long, counts binary"), spelling.PREDICTORS << bits))
    given = spark.sparkContext.broadcast(speller)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Mean()
        for batch in batches:
            if len(batch):
                total.add(given.value.fitted(batch.column("word").to_pylist(), batch.column("kind").to_numpy()), len(batch))
        yield from total.rows()

    return speller.with_fit(_averaged(known.mapInArrow(fit, "x array<double>, weight double"), speller.fit_state()))


def _hot_threshold(vocabulary: DataFrame) -> int:
    """The least number of uses that HOT words at most have, from a histogram with a row for each eighth of a power of two."""
    step = F.floor(F.log2("held") * 8).cast("int")
    rows = sorted(vocabulary.filter("held > 0").groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"])
    total, least = 0, None
    for r in rows:
        total += r["count"]
        if total > HOT:
            break
        least = r["step"]
    return max(1, math.ceil(2 ** (least / 8) - 1e-9)) if least is not None else 1 << 62


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    rows = texts_of(docs, "doc_id", "text").withColumn("out", held_out(F.col("doc_id"), MODULUS, REMAINDER))
    vocabulary = materialize(count_words(rows), "lm-words")
    sums = vocabulary.agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("tokens"), F.count_if(F.col("trained") > 0).alias("distinct"), F.coalesce(F.sum(F.when(F.col("hash") == 0, F.col("trained"))), F.lit(0)).alias("ends")).first()
    tokens, divisor = sums["tokens"], sums["tokens"] + 0.5 * (sums["distinct"] + 1)
    coded = vocabulary.filter("trained > 1 AND hash <> 0").orderBy(F.desc("trained"), "hash").limit(CODED).select("hash", "trained").toPandas()
    classed = vocabulary.filter("hash <> 0").join(F.broadcast(spark.createDataFrame(coded[["hash"]].astype("int64"), "hash long")), "hash", "left_anti")  # CODED rows
    by_kind = {r["kind"]: r for r in classed.groupBy("kind").agg(F.sum("trained").alias("uses"), F.count_if(F.col("trained") == 1).alias("once"), F.count_if(F.col("trained") > 0).alias("types")).collect()}
    uses, once = (np.array([by_kind[k][c] if k in by_kind else 0 for k in range(word_bits.KINDS)], np.float64) for c in ("uses", "once"))
    code = word_bits.WordCode(coded["hash"].to_numpy(np.int64).view(np.uint64), coded["trained"].to_numpy(np.float64), sums["ends"], uses)
    new = np.clip((once + 0.5) / (uses + 1), 1e-4, 0.9999)
    speller = spark.sparkContext.broadcast(train_spelling(classed, sum(r["types"] for r in by_kind.values())))

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """log10 probability of each word in its class: for text outside training, and for training text, without the use that is scored."""
        for batch in batches:
            kind, trained = batch.column("kind").to_numpy(), batch.column("trained").to_numpy().astype(np.float64)
            spelled = 2.0 ** speller.value.log2(batch.column("word").to_pylist(), kind)
            fresh = np.log10(np.maximum((1 - new[kind]) * trained / np.maximum(1, uses[kind]) + new[kind] * spelled, 1e-300))
            own = np.log10(np.maximum((1 - new[kind]) * np.maximum(0, trained - 1) / np.maximum(1, uses[kind] - 1) + new[kind] * spelled, 1e-300))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("hash", "held", "trained")), pa.array(fresh), pa.array(own)], ["hash", "held", "trained", "fresh", "own"])

    scored = materialize(classed.mapInArrow(value, "hash long, held long, trained long, fresh double, own double"), "lm-scored")
    least = _hot_threshold(scored)
    hot = scored.filter(F.col("held") >= least).toPandas()
    values = np.vstack([np.column_stack([np.log10((hot["trained"] + 0.5) / divisor), hot["trained"] > 0, hot["fresh"], hot["own"]]).astype(np.float64).reshape(-1, 4), np.zeros((1, 4))])
    of_code = np.concatenate((coded["trained"].to_numpy(np.float64), [sums["ends"]]))
    base_of = np.concatenate((np.log10((of_code + 0.5) / divisor), np.zeros(word_bits.KINDS)))
    known_of = np.concatenate((of_code > 0, np.zeros(word_bits.KINDS, bool)))
    model = spark.sparkContext.broadcast((code, train_words(rows, code, tokens), word_bits.Places(hot["hash"].to_numpy(np.int64).view(np.uint64)), values, base_of, known_of))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (code, mixer, places, values, base_of, known_of), at = model.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            out = np.array(batch.column("out").to_pylist(), bool)
            for first, texts in text_chunks(batch, most=AT_ONCE):
                many, trained = len(texts), ~out[first : first + len(texts)]
                found = word_bits.tokens_of(texts)
                bits, _, _, symbols = word_bits.mix(code, mixer, found, trained)
                owner = np.repeat(np.arange(many), np.diff(found.first))
                rest = np.flatnonzero(symbols > code.end)
                place = places.of(found.hashes[rest])
                use = np.where(trained[owner[rest]], 3, 2)
                total = [
                    np.bincount(owner, base_of[symbols], many) + np.bincount(owner[rest], values[place, 0], many),
                    np.bincount(owner, known_of[symbols], many) + np.bincount(owner[rest], values[place, 1], many),
                    bits * math.log10(2) + np.bincount(owner[rest], values[place, use], many),
                ]
                lost = rest[place < 0]
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner[lost], minlength=many)))).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.hashes[lost].view(np.int64)))
                columns = [batch.column("doc_id").slice(first, many), batch.column("out").slice(first, many), pa.array(np.arange(at, at + many)), pa.array(np.diff(found.first)), pa.array(found.sizes), *map(pa.array, total), tail]
                at += many
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "out", "row", "n_tokens", "n_bytes", "base", "known", "score", "tail"])

    some = materialize(rows.mapInArrow(add_up, "doc_id long, out boolean, row long, n_tokens long, n_bytes long, base double, known double, score double, tail array<long>"), "lm-documents")
    rare = scored.filter(F.col("held") < least).select("hash", F.log10((F.col("trained") + 0.5) / divisor).alias("tail_base"), (F.col("trained") > 0).cast("double").alias("tail_known"), "fresh", "own")
    tails = some.select("row", "out", F.explode("tail").alias("hash")).join(rare, "hash").groupBy("row").agg(F.sum("tail_base").alias("tail_base"), F.sum("tail_known").alias("tail_known"), F.sum(F.when(F.col("out"), F.col("fresh")).otherwise(F.col("own"))).alias("tail_score"))
    whole = some.drop("tail").join(tails, "row", "left")
    both = {c: F.col(c) + F.coalesce(F.col(f"tail_{c}"), F.lit(0.0)) for c in ("base", "known", "score")}
    return whole.select(
        "doc_id", F.col("out").alias("held_out"), "n_tokens", F.round(both["known"]).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        both["base"].alias("base_score"), both["score"].alias("score"), "n_bytes", F.when(F.col("n_bytes") > 0, -both["score"] * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
