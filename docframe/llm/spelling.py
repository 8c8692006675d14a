"""Spellings as mixed bits: a word's bytes and a blank, each bit predicted after several hashed contexts.

Contexts: the class and place, the last byte and the class, the last two and the class, the last three, and the word so far. Their stretched
probabilities are combined by weights that a gate (place and bit) selects, and an adaptive map from the bits known and the mixed
probability refines the result. Contexts end at the word's start, so that a spelling is computed once for each distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SEGMENT, PREDICTORS = 32, 5
GATES, BUCKETS = 64, 33
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Lanes:
    """Words as runs of at most SEGMENT bytes, each with the bytes before it; long words are many runs, so that all advance in step."""

    def __init__(self, words: list[bytes], kinds: np.ndarray):
        texts, owner, first, before = [], [], [], []
        for i, word in enumerate(words):
            coded = word + b" "
            for k in range(0, len(coded), SEGMENT):
                texts.append(coded[k : k + SEGMENT])
                owner.append(i)
                first.append(k == 0)
                before.append(int.from_bytes(coded[max(0, k - 3) : k], "big"))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-sizes, kind="stable")
        self.sizes, self.owner = sizes[order], np.array(owner, np.int64)[order]
        self.kinds = np.asarray(kinds, np.uint64)[self.owner] << np.uint64(32)
        self.first, self.before = np.array(first, bool)[order], np.array(before, np.uint64)[order]
        self.bytes = np.frombuffer(b"".join(texts[i].ljust(SEGMENT, b"\0") for i in order), np.uint8).reshape(len(texts), SEGMENT)

    def steps(self, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each bit: how many runs (from the first) still go on, slots (PREDICTORS, runs), gate of each run, bits known of the byte, the bit."""
        last, word = self.before.copy(), np.where(self.first, np.uint64(1), np.uint64(0))
        tables = (np.arange(PREDICTORS, dtype=np.int64) << bits)[:, None]
        for at in range(int(self.sizes.max(initial=0))):
            live = int(np.searchsorted(-self.sizes, -at, side="left"))
            value, recent, so_far, kind = self.bytes[:live, at].astype(np.uint64), last[:live], word[:live], self.kinds[:live]
            place = np.where(self.first[:live], np.uint64(min(at, 7)), np.uint64(7))
            contexts = np.stack([place | kind, recent & np.uint64(0xFF) | kind, recent & np.uint64(0xFFFF) | kind, recent & np.uint64(0xFFFFFF), so_far]) * _MULTIPLIERS[:, None]
            contexts ^= contexts >> np.uint64(29)
            contexts *= np.uint64(0xBF58476D1CE4E5B9)
            contexts ^= contexts >> np.uint64(32)
            known = np.ones(live, np.uint64)
            for bit in range(8):
                mixed = contexts + known * np.uint64(0x2545F4914F6CDD1D)
                mixed *= np.uint64(0x9E3779B97F4A7C15)
                mixed >>= np.uint64(64 - bits)
                one = (value >> np.uint64(7 - bit)) & np.uint64(1)
                yield live, mixed.view(np.int64) + tables, (place.astype(np.int64) << 3) + bit, known.astype(np.int64), one.astype(np.int64)
                known = known << np.uint64(1) | one
            last[:live] = (recent << np.uint64(8) | value) & np.uint64(0xFFFFFFFF)
            word[:live] = np.where(so_far > 0, (so_far * np.uint64(0x100000001B3)) ^ (value + np.uint64(1)), so_far)


def count(words: list[bytes], kinds: np.ndarray, bits: int, total: np.ndarray) -> None:
    """Adds how often each slot's bit was 0 and 1, each word once. total: (PREDICTORS << bits, 2)."""
    flat = total.reshape(-1)
    for _, slots, _, _, bit in Lanes(words, kinds).steps(bits):
        np.add.at(flat, (slots * 2 + bit).reshape(-1), flat.dtype.type(1))


def _stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)))


@dataclass
class Speller:
    """counts: (slots, 2); inputs: stretched probability by slot; weights: of each gate; refined: probability by known bits and mixed probability."""

    counts: np.ndarray
    inputs: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    @staticmethod
    def fresh(counts: np.ndarray) -> Speller:
        ones = counts.astype(np.float32)
        return Speller(counts, _stretched(ones[:, 0], ones[:, 1]), np.full((GATES, PREDICTORS), 0.35, np.float32), np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS))), (256, 1)).astype(np.float32))

    @property
    def bits(self) -> int:
        return (len(self.counts) // PREDICTORS).bit_length() - 1

    def fit_state(self) -> np.ndarray:
        return np.concatenate((self.weights.reshape(-1), self.refined.reshape(-1))).astype(np.float64)

    def with_fit(self, state: np.ndarray) -> Speller:
        cut = self.weights.size
        return Speller(self.counts, self.inputs, state[:cut].reshape(self.weights.shape).astype(np.float32), state[cut:].reshape(self.refined.shape).astype(np.float32))

    def _bucket(self, z: np.ndarray) -> np.ndarray:
        return np.rint((np.clip(z, -8, 8) + 8) * ((BUCKETS - 1) / 16)).astype(np.int64)

    def fitted(self, words: list[bytes], kinds: np.ndarray, batch: int = 400, rate: float = 0.15) -> np.ndarray:
        """fit_state() after these words, bit after bit over batches of them. A word's own use is taken out of the counts it sees."""
        weights, hits = self.weights.copy(), np.stack([1 - self.refined, self.refined], axis=2) * 8.0
        for k in range(0, len(words), batch):
            lanes = Lanes(words[k : k + batch], kinds[k : k + batch])
            for _, slots, gates, known, bit in lanes.steps(self.bits):
                seen = self.counts[slots].astype(np.float32)
                x = _stretched(np.maximum(0, seen[..., 0] - (1 - bit)), np.maximum(0, seen[..., 1] - bit))
                z = np.einsum("il,li->l", x, weights[gates])
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                np.add.at(hits, (known, self._bucket(z), bit), 1)
                for g in np.unique(gates):
                    at = gates == g
                    weights[g] += rate * (x[:, at] @ (bit - p)[at]) / at.sum()
        return np.concatenate((weights.reshape(-1), (hits[..., 1] / hits.sum(axis=2)).reshape(-1)))

    def log2(self, words: list[bytes], kinds: np.ndarray, batch: int = 6000) -> np.ndarray:
        out = np.zeros(len(words))
        for k in range(0, len(words), batch):
            lanes = Lanes(words[k : k + batch], kinds[k : k + batch])
            total = np.zeros(len(lanes.owner))
            for live, slots, gates, known, bit in lanes.steps(self.bits):
                x = self.inputs[slots]
                z = x.T @ self.weights[gates[0]] if (gates == gates[0]).all() else np.einsum("il,li->l", x, self.weights[gates])
                p = 0.5 / (1 + np.exp(-z)) + 0.5 * self.refined[known, self._bucket(z)]
                total[:live] += np.log2(np.clip(np.where(bit == 1, p, 1 - p), 1e-7, 1))
            np.add.at(out[k : k + batch], lanes.owner, total)
        return out
