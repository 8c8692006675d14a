"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word is given by word inputs (its smoothed log-odds between toxic and other labelled documents, by hash) and
character inputs (the same of its prefixes and character n-grams: the two largest, the mean, and its length). Windows of WINDOW words, every STRIDE
words, go through a gated recurrent layer in both directions, attention weighs the steps, and a logistic output
scores the window. A document's score is that of its worst window; all windows of the whole text are scored.

The labelled rows outside the held-out fold, `most_labelled` at most, are halved by a hash: one half gives the log-odds, the other one the
windows to train on (of each document those with the largest inputs), so that the network sees inputs as unseen text has them.

Defined cases: a text without words (null, empty, blank) scores 0; without a label of either class every score is 0;
repeated rows and equal texts score alike; other columns (lang, source, ...) are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.shared import held_out, text_chunks, texts_of
from docframe.llm.training import Adam, calibrate, labelled_sample, sigmoid

MODULUS, REMAINDER, THRESHOLD = 3, 1, 0.7
BUCKETS = 1 << 17
WINDOW, STRIDE, INPUTS, HIDDEN = 32, 16, 6, 8
_WORDS_KEPT = 400_000
_MARKS = " .,;:!?\"'()[]{}<>|*#$%&@-_=+/\\~^`"


_LONG, _STEP = 24, 16
_PARTS = re.compile(r"[^\W_]+|[\W_]+")


def pieces_of(text: str) -> list[str]:
    """The steps of the network: runs without white space. Runs over _LONG characters are cut at marks, and what is still longer into
    overlapping parts, so that every character is in some step."""
    pieces = text.split()
    if not pieces or max(map(len, pieces)) <= _LONG:
        return pieces
    out: list[str] = []
    for piece in pieces:
        if len(piece) <= _LONG:
            out.append(piece)
            continue
        for part in _PARTS.findall(piece):
            if len(part) <= _LONG:
                out.append(part)
            else:
                out += [part[k : k + _LONG] for k in range(0, len(part) - _LONG + _STEP, _STEP)]
    return out


_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WORD, _PREFIX, _INNER, _SUFFIX = (np.uint64(k * 0xC2B2AE3D27D4EB4F % 2**64) for k in range(1, 5))
GRAM, PREFIXES, AT_ONCE = 4, range(2, 10), 8192


def _bucket(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX
    return ((hashes ^ (hashes >> np.uint64(29))) * _FACTOR >> np.uint64(47)).view(np.int64)


def buckets_of(words: list[str]) -> np.ndarray:
    """A row for each word (none empty): the word's bucket first, then those of its prefixes, its last characters and all inner n-grams; -1 where it has no more."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    most = int(sizes.max(initial=GRAM))
    chars = np.zeros((len(words), most), np.uint64)
    chars[np.arange(most) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    powers = np.multiply.accumulate(np.full(most, _FACTOR, np.uint64))
    upto = np.cumsum(chars * powers, axis=1, dtype=np.uint64)  # hashes of all prefixes; the last is the word's
    inner = sum(chars[:, k : most - GRAM + 1 + k] * powers[k] for k in range(GRAM))
    tail = inner[np.arange(len(words)), np.maximum(sizes - GRAM, 0)]
    prefixes = [n for n in PREFIXES if n <= most]
    found = np.concatenate([upto[:, -1:] ^ _WORD, tail[:, None] ^ _SUFFIX, upto[:, [n - 1 for n in prefixes]] ^ _PREFIX, inner ^ _INNER], axis=1)
    needed = np.array([1, 1, *prefixes, *range(GRAM, most + 1)])
    return np.where(needed <= sizes[:, None], _bucket(found), -1)


class WordInputs:
    """Input rows of words, kept by the word as it stands in the text, within a bound."""

    def __init__(self, odds: np.ndarray):
        self._odds = np.append(odds, np.float32(-np.inf))  # of bucket -1
        self._rows: dict[str, int] = {}
        self._table = np.zeros((4096, INPUTS), np.float32)

    def rows_of(self, pieces: list[str]) -> np.ndarray:
        out = np.zeros((len(pieces), INPUTS), np.float32)
        words = [p.lower().strip(_MARKS) for p in pieces]
        at = np.flatnonzero(np.fromiter(map(bool, words), bool, len(words)))
        for k in range(0, len(at), AT_ONCE):
            some = at[k : k + AT_ONCE]
            part = [words[i] for i in some.tolist()]
            odds = self._odds[buckets_of(part)]
            chars = np.partition(odds[:, 1:], -2, axis=1)
            has = np.isfinite(odds[:, 1:])
            first, second = chars[:, -1], np.where(np.isfinite(chars[:, -2]), chars[:, -2], chars[:, -1])
            mean = np.where(has, odds[:, 1:], 0).sum(axis=1, dtype=np.float64) / has.sum(axis=1)
            sizes = np.fromiter(map(len, part), np.float64, len(part))
            out[some] = np.column_stack([odds[:, 0], first, second, mean, np.minimum(sizes, 20) / 20, np.ones(len(part))])
        return out

    def of(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [pieces_of(t) for t in texts]
        new = set().union(*pieces).difference(self._rows)
        if new and len(self._rows) + len(new) > _WORDS_KEPT:
            self._rows.clear()
            new = set().union(*pieces)
        if new:
            held, some = len(self._rows), list(new)
            if held + len(some) > len(self._table):
                self._table = np.concatenate([self._table[:held], np.zeros((held + 2 * len(some), INPUTS), np.float32)])
            self._table[held : held + len(some)] = self.rows_of(some)
            self._rows.update(zip(some, range(held, held + len(some)), strict=True))
        row = self._rows.__getitem__
        return [self._table[np.fromiter(map(row, p), np.int64, len(p))] for p in pieces]


def windows(inputs: np.ndarray) -> np.ndarray:
    """(windows, WINDOW, INPUTS): every STRIDE words one, the last reaching the end; zeros after it."""
    many = max(1, -(-(len(inputs) - WINDOW) // STRIDE) + 1)
    padded = np.zeros(((many - 1) * STRIDE + WINDOW, INPUTS), np.float32)
    padded[: len(inputs)] = inputs
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW, axis=0)[::STRIDE].transpose(0, 2, 1)


class GatedNetwork:
    """Weights carry the direction as first axis. The last input is 1 for a word and 0 for padding, and masks the attention."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        some = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.w = {"wx": some(2, INPUTS, 3 * HIDDEN), "wh": some(2, HIDDEN, 3 * HIDDEN), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32), "att": some(2 * HIDDEN), "out": some(2 * HIDDEN), "bias": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        many, steps = x.shape[:2]
        w = self.w
        both = np.stack([x.transpose(1, 0, 2), x.transpose(1, 0, 2)[::-1]], axis=1)  # step, direction, window, input
        pre = both @ w["wx"] + w["b"]
        h = np.zeros((2, many, HIDDEN), np.float32)
        states = np.empty((steps, 2, many, HIDDEN), np.float32)
        gates = []
        wh_gate, wh_new = w["wh"][:, :, : 2 * HIDDEN], w["wh"][:, :, 2 * HIDDEN :]
        for t in range(steps):
            zr = sigmoid(pre[t, :, :, : 2 * HIDDEN] + h @ wh_gate)
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            new = np.tanh(pre[t, :, :, 2 * HIDDEN :] + (r * h) @ wh_new)
            gates.append((z, r, new, h))
            h = h + z * (new - h)
            states[t] = h
        all_h = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)  # step, window, 2 * hidden
        alpha = all_h @ w["att"] + np.where(x[:, :, -1].T > 0, 0, -30).astype(np.float32)
        alpha = np.exp(alpha - alpha.max(axis=0))
        alpha /= alpha.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", alpha, all_h)
        return pooled @ w["out"] + w["bias"][0], (both, gates, all_h, alpha, pooled)

    def logits(self, x: np.ndarray, most: int = 2048) -> np.ndarray:
        return np.concatenate([self.forward(x[k : k + most])[0] for k in range(0, len(x), most)])

    def gradients(self, x: np.ndarray, error: np.ndarray) -> dict[str, np.ndarray]:
        """error: the loss's derivative by each logit, from forward() on the same x."""
        _, (both, gates, all_h, alpha, pooled) = self.forward(x)
        w, steps = self.w, len(all_h)
        d_pooled = np.outer(error, w["out"])
        d_h = alpha[:, :, None] * d_pooled
        d_alpha = np.einsum("tbh,bh->tb", all_h, d_pooled)
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        d_h = d_h + d_score[:, :, None] * w["att"]
        grads = {"att": np.einsum("tb,tbh->h", d_score, all_h), "out": pooled.T @ error, "bias": np.array([error.sum()]), "wx": np.zeros_like(w["wx"]), "wh": np.zeros_like(w["wh"]), "b": np.zeros_like(w["b"])}
        d_states = np.stack([d_h[:, :, :HIDDEN], d_h[::-1, :, HIDDEN:]], axis=1)
        carry = np.zeros_like(d_states[0])
        for t in range(steps - 1, -1, -1):
            z, r, new, before = gates[t]
            d = d_states[t] + carry
            d_new = d * z * (1 - new * new)
            d_z = d * (new - before) * z * (1 - z)
            back_new = d_new @ w["wh"][:, :, 2 * HIDDEN :].transpose(0, 2, 1)
            d_r = back_new * before * r * (1 - r)
            d_gate = np.concatenate([d_z, d_r], axis=-1)
            carry = d * (1 - z) + back_new * r + d_gate @ w["wh"][:, :, : 2 * HIDDEN].transpose(0, 2, 1)
            d_all = np.concatenate([d_gate, d_new], axis=-1)
            grads["wx"] += both[t].transpose(0, 2, 1) @ d_all
            grads["b"] += d_all.sum(axis=1, keepdims=True)
            grads["wh"][:, :, : 2 * HIDDEN] += before.transpose(0, 2, 1) @ d_gate
            grads["wh"][:, :, 2 * HIDDEN :] += (r * before).transpose(0, 2, 1) @ d_new
        return grads

    def train(self, x: np.ndarray, y: np.ndarray, *, steps: int = 220, batch: int = 256, seed: int = 6) -> None:
        rng, adam = np.random.default_rng(seed), Adam(self.w, 0.02)
        ones, zeros = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
        for k in range(steps):
            adam.rate = 0.02 * (1 - k / steps) + 0.001
            some = np.concatenate([rng.choice(ones, batch // 2), rng.choice(zeros, batch // 2)])
            logit = self.forward(x[some])[0]
            grads = self.gradients(x[some], ((sigmoid(logit) - y[some]) / batch).astype(np.float32))
            adam.update({n: (g + 1e-4 * self.w[n]).astype(np.float32) for n, g in grads.items()})


def log_odds(counts: np.ndarray, documents: np.ndarray, pull: float = 10.0) -> np.ndarray:
    """counts[label, bucket]: documents of that label that have the bucket. Rare buckets are pulled to 0."""
    ratio = documents[1] / documents[0]
    return np.log((counts[1] + pull * ratio) / ((counts[0] + pull) * ratio)).astype(np.float32)


def _count_buckets(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Document counts by label and bucket, summed by Spark; the bucket table has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, documents = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for first, texts in text_chunks(batch):
                for label, text in zip(batch.column("label").slice(first, len(texts)).to_pylist(), texts, strict=True):
                    words, seen = sorted({p.lower().strip(_MARKS) for p in set(pieces_of(text))} - {""}), np.zeros(BUCKETS + 1, bool)
                    for k in range(0, len(words), AT_ONCE):
                        seen[buckets_of(words[k : k + AT_ONCE])] = True  # -1 is the last place
                    counts[label] += seen[:-1]
                    documents[label] += 1
        at = np.nonzero(counts.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([documents[0], *counts[0, at]], pa.int64()), pa.array([documents[1], *counts[1, at]], pa.int64())], ["bucket", "zero", "one"])

    sums = rows.select("label", "text").mapInArrow(run, "bucket int, zero long, one long").groupBy("bucket").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).toPandas()
    counts, documents = np.zeros((2, BUCKETS)), np.zeros(2)
    head = sums["bucket"] == -1
    documents[:] = sums.loc[head, ["zero", "one"]].sum().to_numpy()
    rest = sums[~head]
    counts[0, rest["bucket"]], counts[1, rest["bucket"]] = rest["zero"], rest["one"]
    return counts, documents


def _training_windows(rows: DataFrame, odds: np.ndarray, of_each: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows with the largest inputs, at most `of_each` of a document, with document number and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = WordInputs(odds)
        for batch in batches:
            for first, texts in text_chunks(batch):
                found = []
                for rows_of_text in inputs.of(texts):
                    x = windows(rows_of_text)
                    best = np.argsort(-x[:, :, :2].sum(axis=2).max(axis=1), kind="stable")[:of_each]
                    found.append(np.ascontiguousarray(x[best], dtype=np.float16).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), batch.column("label").slice(first, len(texts)), pa.array(found, pa.binary())], ["doc_id", "label", "x"])

    got = sorted(((r["doc_id"], r["label"], bytes(r["x"])) for r in rows.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, x binary").collect()), key=lambda r: (r[0], r[2]))
    parts = [np.frombuffer(r[2], np.float16).reshape(-1, WINDOW, INPUTS) for r in got]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return np.concatenate(parts).astype(np.float32), owner, np.array([r[1] for r in got])


class ToxicityModel:
    def __init__(self, odds: np.ndarray, network: GatedNetwork, slope: float, offset: float):
        self.odds, self.network, self.slope, self.offset = odds, network, slope, offset

    def score(self, texts: list[str], inputs: WordInputs) -> np.ndarray:
        """Of each text the score of its worst window."""
        found = inputs.of(texts)
        x = [windows(f) for f in found]
        ends = np.cumsum([len(p) for p in x])
        logits = self.network.logits(np.concatenate(x))
        worst = np.maximum.reduceat(logits, np.concatenate(([0], ends[:-1])))
        return np.where([len(f) > 0 for f in found], sigmoid(self.slope * worst.astype(np.float64) + self.offset), 0.0)


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 16000) -> ToxicityModel | None:
    sample = labelled_sample(docs, labels, "toxic", most_labelled, MODULUS, REMAINDER)
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0
    counts, documents = _count_buckets(sample.filter(half))
    if not documents.all():
        return None
    odds = log_odds(counts, documents)
    rest = sample.filter(~half)
    if rest.select("label").distinct().count() < 2:
        return None
    x, owner, y = _training_windows(rest, odds)
    network = GatedNetwork()
    first = np.concatenate(([True], owner[1:] != owner[:-1]))
    use = first | (y[owner] == 0)  # of toxic documents the worst window alone is known to be toxic
    network.train(x[use], y[owner][use])
    logits = np.maximum.reduceat(network.logits(x), np.nonzero(first)[0])
    return ToxicityModel(odds, network, *calibrate(logits.astype(np.float64), y))


def score_documents(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 16000) -> DataFrame:
    """doc_id, held_out, score, predicted (1: toxic)."""
    model = fit(docs, labels, most_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = WordInputs(model.odds) if model else None
        for batch in batches:
            for first, texts in text_chunks(batch, most=400_000):
                score = model.score(texts, inputs) if model else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(score, pa.float64())], ["doc_id", "score"])

    found = texts_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 16000) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic."""
    model = fit(docs, labels, most_labelled)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = WordInputs(model.odds)
        for batch in batches:
            for first, texts in text_chunks(batch, most=400_000):
                yield batch.slice(first, len(texts)).filter(pa.array(model.score(texts, inputs) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
