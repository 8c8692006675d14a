"""Samples for classifiers: bounded numbers of rows, chosen by a hash of their ids, written to the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.shared import held_out, materialize, texts_of

SEED = 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, modulus: int, remainder: int) -> DataFrame:
    """doc_id, text, label of at most `most` labelled rows outside the held-out fold. Null labels and ids are no labels; of several labels of an id the largest counts, and of rows with one id and text one."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col(label) > 0, 1).when(F.col(label) <= 0, 0).alias("label")).dropna()
    fit = named.filter(~held_out(F.col("doc_id"), modulus, remainder)).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = fit.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)
    return _at_most(texts_of(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id"), most, "labelled")


def unlabelled_sample(docs: DataFrame, most: int) -> DataFrame:
    """doc_id, text of at most `most` different ids of the whole table."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna()
    chosen = ids.orderBy(F.xxhash64("doc_id", F.lit(SEED + 1)), "doc_id").limit(most).distinct()
    return _at_most(texts_of(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id"), most, "unlabelled")


def _at_most(rows: DataFrame, most: int, name: str) -> DataFrame:
    """At most `most` rows: an id that is repeated brings its different texts, by their hash, as far as there is room."""
    rows = materialize(rows.dropDuplicates(["doc_id", "text"]), name)
    if rows.count() <= most:
        return rows
    return materialize(rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(most), name)


class Adam:
    """Adaptive moment steps on a dictionary of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.01):
        self.weights, self.rate, self.step = weights, rate, 0
        self._mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self._square = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grads.items():
            self._mean[k] += 0.1 * (g - self._mean[k])
            self._square[k] += 0.001 * (g * g - self._square[k])
            self.weights[k] -= self.rate * (self._mean[k] / (1 - 0.9**self.step)) / (np.sqrt(self._square[k] / (1 - 0.999**self.step)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def calibrate(logits: np.ndarray, labels: np.ndarray, steps: int = 400) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (logit, label), with a weak pull to slope 1; classes weigh alike."""
    slope, offset = 1.0, 0.0
    if not len(labels) or labels.min() == labels.max():
        return slope, offset
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    scale = max(1.0, float(np.abs(logits).max()))
    for _ in range(steps):
        error = weight * (sigmoid(slope * logits + offset) - labels)
        slope -= 0.5 / scale * float((error * logits).mean() / scale + 0.001 * (slope - 1))
        offset -= 0.5 * float(error.mean())
    return slope, offset
