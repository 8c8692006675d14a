"""Quality scores by positive-unlabelled learning.

A small network on counts of a whole text's character-class pairs and word repetitions minimises the
non-negative unbiased risk: trusted positives (documents labelled good) and unlabelled text of the whole
corpus, weighed by an estimated class prior. Where the unlabelled part of the risk goes below zero, the step is
taken back instead. The prior is the share of good ones among labelled rows outside the held-out fold; a logistic curve
fitted on those rows turns the output into a score.

Bounds: at most `most_labelled` labelled rows and `most_unlabelled` others are fitted on; their features (not texts) come to the driver.

Defined cases: null, empty and blank texts have the features zero and get the score of that; without any label of either class
the score is 0.5 throughout; repeated rows and equal texts score alike; other columns (lang, source, ...) are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.shared import held_out, text_chunks, texts_of
from docframe.llm.training import Adam, calibrate, labelled_sample, sigmoid, unlabelled_sample

MODULUS, REMAINDER, THRESHOLD = 5, 0, 0.3
HIDDEN = 24


def _classes() -> np.ndarray:
    """A class for each byte: lower, upper, digit, blank, line end, one each for common marks, other ASCII, lead and trail bytes of UTF-8."""
    kind = np.full(256, 14, np.uint8)
    kind[128:192], kind[192:] = 12, 13
    for b in range(128):
        c = chr(b)
        kind[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 14
    for i, marks in enumerate((" \t", "\n\r", ".", ",", "!?", "|", "*#$%&@^~", "-_=+/\\", "'\"()[]{}<>`:;")):
        for c in marks:
            kind[ord(c)] = 3 + i
    return kind


KINDS = 15
CLASSES = _classes()


def features(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    out = np.zeros(KINDS * KINDS + 7, np.float32)
    if not len(raw):
        return out
    kinds = CLASSES[raw].astype(np.int16)
    pairs = np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS)[: KINDS * KINDS]
    out[: KINDS * KINDS] = np.log1p(pairs * (1000.0 / len(raw)))
    words = text.split()
    if words:
        many = len(words)
        lines = text.split("\n")
        distinct = len(set(words))
        repeats = sum(map(str.__eq__, words, words[1:]))
        out[KINDS * KINDS :] = (np.log1p(many), distinct / many, np.log1p(1000.0 * repeats / many), (len(text) - many) / many, len(set(lines)) / len(lines), np.log1p(many / len(lines)), many / max(1.0, distinct) > 3)
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float
    slope: float = 1.0
    offset: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.spread @ self.weights["w1"] + self.weights["b1"])
        return hidden @ self.weights["w2"] + self.weights["b2"][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.logit(x) + self.offset)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, epochs: int = 25, batch: int = 256, seed: int = 3) -> QualityModel:
    """Minimise prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) with the sigmoid loss l(z) = sigmoid(-z)."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, spread = both.mean(axis=0), both.std(axis=0) + 0.05
    size = both.shape[1]
    w = {"w1": rng.normal(0, size**-0.5, (size, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b2": np.zeros(1)}
    adam = Adam(w, 0.003)
    p_all, u_all = (positive - mean) / spread, (unlabelled - mean) / spread

    for _ in range(epochs * max(1, len(unlabelled) // batch)):
        p = p_all[rng.integers(0, len(p_all), batch)]
        u = u_all[rng.integers(0, len(u_all), batch)]
        x = np.concatenate([p, u])
        hidden = np.tanh(x @ w["w1"] + w["b1"])
        s = sigmoid(hidden @ w["w2"] + w["b2"][0])  # l(-g) = s, l(g) = 1 - s
        slope = s * (1 - s) / batch
        sp, su = s[:batch], s[batch:]
        negative = su.mean() - prior * sp.mean()
        grad = np.empty(2 * batch)
        if negative >= 0:
            grad[:batch], grad[batch:] = -2 * prior * slope[:batch], slope[batch:]
        else:
            grad[:batch], grad[batch:] = prior * slope[:batch], -slope[batch:]
        back = np.outer(grad, w["w2"]) * (1 - hidden * hidden)
        adam.update({"w1": x.T @ back + 1e-5 * w["w1"], "b1": back.sum(axis=0), "w2": hidden.T @ grad, "b2": np.array([grad.sum()])})
    return QualityModel(mean, spread, w, prior)


def _features_of(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch):
                found = pa.array([features(x).tobytes() for x in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), batch.column("label").slice(first, len(texts)), found], ["doc_id", "label", "x"])

    return rows.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(run, "doc_id long, label int, x binary")


def _matrix(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    found = sorted(((r["doc_id"], r["label"], bytes(r["x"])) for r in _features_of(rows).collect()), key=lambda r: (r[0], r[2]))
    x = np.array([np.frombuffer(r[2], np.float32) for r in found], dtype=np.float64).reshape(len(found), KINDS * KINDS + 7)
    return x, np.array([-1 if r[1] is None else r[1] for r in found], dtype=np.int64)


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 8000, most_unlabelled: int = 8000) -> QualityModel | None:
    x, y = _matrix(labelled_sample(docs, labels, "quality", most_labelled, MODULUS, REMAINDER))
    if not (y == 1).any() or not (y == 0).any():
        return None
    unlabelled, _ = _matrix(unlabelled_sample(docs, most_unlabelled).withColumn("label", F.lit(None).cast("int")))
    model = fit_nnpu(x[y == 1], unlabelled, prior=float(min(0.98, (y == 1).mean())))
    model.slope, model.offset = calibrate(model.logit(x), y)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 8000, most_unlabelled: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted (1: keep)."""
    model = fit(docs, labels, most_labelled, most_unlabelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch):
                x = np.array([features(t) for t in texts], dtype=np.float64)
                score = model.score(x) if model else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(score, pa.float64())], ["doc_id", "score"])

    found = texts_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 8000, most_unlabelled: int = 8000) -> DataFrame:
    """The rows of docs, with all their columns, that are predicted good."""
    model = fit(docs, labels, most_labelled, most_unlabelled)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch):
                score = model.score(np.array([features(t) for t in texts], dtype=np.float64))
                yield batch.slice(first, len(texts)).filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
