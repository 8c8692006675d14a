"""Words as bits: vectorised tokens, a prefix code over frequent words, and the bitwise mixing of word contexts.

A token is coded as the bits on its way down a Huffman tree. The tree's leaves are the frequent words, the end of a text, and KINDS classes of all
other words (by their last two bytes). Each bit is predicted at its inner node from
    the node alone (its exact shares in training),
    the node after the word before, and after the last two common words before, which tell language and subject (hashed slots of counts),
    and an offset of the node in this run of the text (learned online),
whose stretched probabilities are combined by weights that a gate selects (depth of the node, and whether the word before
was seen often), and then refined by an adaptive map. Weights, map and offsets are updated after each bit. A run is
at most RUN tokens of one document; contexts of words reach over its border, what is learned online starts anew.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

KINDS, COMMON, RUN = 512, 64, 192
DEPTHS, BUCKETS, OWN = 12, 33, 256
GATES, INPUTS = 2 * DEPTHS, 3
RATE, FIT_RATE, REFINE = np.float32(0.015), np.float32(0.05), np.float32(0.02)
LIMIT, OWN_RATE = np.float32(7.9), np.float32(0.15)
START = np.array([0.4, 0.35, 0.4], np.float32)

FOLD = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)
END_HASH = 0


def _power(many: int) -> np.ndarray:
    global _powers
    if len(_powers) < many:
        _powers = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(2 * many, _FACTOR | np.uint64(1), np.uint64))))
    return _powers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


@dataclass
class Tokens:
    """Of some texts: tokens in order (words, then the end, of each text)."""

    raw: np.ndarray  # bytes of all texts, each with a blank after it
    starts: np.ndarray  # of each word in raw
    ends: np.ndarray
    place: np.ndarray  # of each word among the tokens
    hashes: np.ndarray  # of each token, END_HASH for ends
    kinds: np.ndarray  # class of each token
    first: np.ndarray  # first token of each text, and the number of tokens at last
    sizes: np.ndarray  # bytes of each text


def tokens_of(texts: list[str]) -> Tokens:
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(b) for b in coded], np.int64)
    raw = np.frombuffer((b" ".join(coded) + b" ").translate(FOLD), np.uint8)
    borders = np.cumsum(sizes + 1) - 1
    blank = raw == 32
    at = np.flatnonzero(~blank)
    begins = np.empty(len(at), bool)
    begins[:1] = True
    begins[1:] = np.diff(at) > 1
    heads = np.flatnonzero(begins)
    starts = at[heads]
    ends = at[np.concatenate((heads[1:], [len(at)]))[: len(heads)] - 1] + 1
    inside = at - np.repeat(starts, np.diff(np.concatenate((heads, [len(at)]))))
    values = (raw[at].astype(np.uint64) + np.uint64(1)) * _power(int(inside.max(initial=0)) + 1)[inside]
    words = _mixed(np.add.reduceat(values, heads)) | np.uint64(1) if len(heads) else np.zeros(0, np.uint64)
    owner = np.searchsorted(borders, starts)
    many = np.bincount(owner, minlength=len(texts)) + 1
    first = np.concatenate(([0], np.cumsum(many)))
    place = np.arange(len(starts)) + owner
    hashes = np.full(first[-1], END_HASH, np.uint64)
    hashes[place] = words
    kinds = np.zeros(first[-1], np.int32)
    before = np.where(ends - starts > 1, raw[np.maximum(ends - 2, 0)], 0).astype(np.int32)
    kinds[place] = (before * 7 + raw[ends - 1].astype(np.int32) * 13) % KINDS
    return Tokens(raw, starts, ends, place, hashes, kinds, first, sizes)


class Places:
    """Position of a hash among the given ones (none is 0), -1 for others; open addressing, all look-ups in step."""

    def __init__(self, hashes: np.ndarray):
        self._bits = max(4, int(len(hashes)).bit_length() + 3)
        self._keys, self._found = np.zeros(1 << self._bits, np.uint64), np.full(1 << self._bits, -1, np.int32)
        mask = (1 << self._bits) - 1
        for place, h in enumerate(hashes.tolist()):
            at = h >> (64 - self._bits)
            while self._keys[at]:
                at = (at + 1) & mask
            self._keys[at], self._found[at] = h, place

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self._bits)).astype(np.int32)
        keys = self._keys[at]
        out = np.where(keys == hashes, self._found[at], -1)
        on = np.flatnonzero((keys != hashes) & (keys != 0))
        at = at[on]
        while len(on):
            at = (at + 1) & ((1 << self._bits) - 1)
            keys = self._keys[at]
            hit = keys == hashes[on]
            out[on[hit]] = self._found[at[hit]]
            more = ~hit & (keys != 0)
            on, at = on[more], at[more]
        return out


class WordCode:
    """The prefix code. Symbols: frequent words in the given order, then the end, then the classes."""

    def __init__(self, hashes: np.ndarray, uses: np.ndarray, ends: int, of_kind: np.ndarray):
        self.words = len(hashes)
        self.end = self.words
        weights = np.concatenate((uses, [ends], of_kind)).astype(np.float64)
        weights = np.maximum(weights + 0.5, weights.sum() / 2**20)
        heap = [(w, i) for i, w in enumerate(weights.tolist())]
        heapq.heapify(heap)
        leaves, above, total = len(heap), {}, dict(enumerate(weights.tolist()))
        for node in range(leaves, 2 * leaves - 1):
            (a, zero), (b, one) = heapq.heappop(heap), heapq.heappop(heap)
            above[zero], above[one], total[node] = (node, 0), (node, 1), a + b
            heapq.heappush(heap, (a + b, node))
        nodes, bits, lengths = [], [], []
        for symbol in range(leaves):
            way, at = [], symbol
            while at in above:
                at, bit = above[at]
                way.append((at - leaves, bit))
            lengths.append(len(way))
            nodes += [n for n, _ in reversed(way)]
            bits += [b for _, b in reversed(way)]
        self.lengths = np.array(lengths, np.int32)
        self.begin = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int32)
        self.nodes, self.bits = np.array(nodes, np.int32), np.array(bits, np.uint8)
        share = np.full(max(1, leaves - 1), 0.5)
        for child, (node, bit) in above.items():
            if bit:
                share[node - leaves] = total[child] / total[node]
        self.stretched = np.log(share / (1 - share)).astype(np.float32)  # share of ones at each inner node
        deep = np.arange(len(self.nodes)) - np.repeat(self.begin, self.lengths)
        self.gate = np.minimum(deep, DEPTHS - 1).astype(np.int32)
        self._places = Places(hashes)

    def symbols(self, tokens: Tokens) -> np.ndarray:
        found = self._places.of(tokens.hashes)
        out = np.where(found >= 0, found, self.words + 1 + tokens.kinds)
        out[tokens.hashes == END_HASH] = self.end
        return out.astype(np.int32)


def contexts(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token a hash of the word before, and of the last two of the COMMON most frequent words before; both begin anew with each text."""
    one = np.empty(len(symbols), np.uint64)
    one[1:] = symbols[:-1] + 2
    one[first[:-1]] = 1
    at = np.arange(len(symbols), dtype=np.int64)
    begin = np.repeat(first[:-1], np.diff(first))
    last = np.concatenate(([-1], np.maximum.accumulate(np.where(symbols < COMMON, at, -1))[:-1]))
    last = np.where(last >= begin, last, -1)
    older = np.where(last >= 0, last[last], -1)
    two = (np.where(last >= 0, symbols[last] + 1, 0) * (COMMON + 1) + np.where(older >= 0, symbols[older] + 1, 0)).astype(np.uint64)
    return _mixed(one * _FACTOR), _mixed(two * _FACTOR + np.uint64(5))


def _of_nodes(nodes: np.ndarray) -> np.ndarray:
    return nodes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def slots_of(context: np.ndarray, hashed_nodes: np.ndarray, bits: int) -> np.ndarray:
    slots = context + hashed_nodes
    slots *= _MIX
    slots >>= np.uint64(64 - bits)
    return slots.view(np.int64)


def count(code: WordCode, tokens: Tokens, bits: int, total: np.ndarray) -> None:
    """Adds how often each slot's bit was 0 and 1. total: (2 contexts, 1 << bits, 2)."""
    symbols = code.symbols(tokens)
    lengths = code.lengths[symbols]
    token = np.repeat(np.arange(len(symbols), dtype=np.int32), lengths)
    step = np.arange(len(token), dtype=np.int32) + np.repeat(code.begin[symbols] - (np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    hashed, ones = _of_nodes(code.nodes[step]), code.bits[step]
    for k, context in enumerate(contexts(symbols, tokens.first)):
        np.add.at(total[k].reshape(-1), slots_of(context[token], hashed, bits) * 2 + ones, total.dtype.type(1))


_LOGS = np.log(np.arange(1 << 16, dtype=np.float32) + np.float32(0.4))


@dataclass
class Mixer:
    """What is learned: counts (2 contexts, slots, 2) as 16-bit numbers, weights (GATES, INPUTS), refined (GATES, BUCKETS)."""

    counts: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    @staticmethod
    def fresh(counts: np.ndarray) -> Mixer:
        weights = np.repeat(START[None], GATES, axis=0)
        return Mixer(counts, weights, np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS, dtype=np.float32))), (GATES, 1)))


def packed_counts(total: np.ndarray) -> np.ndarray:
    """Counts as 16-bit numbers; pairs that do not fit keep their ratio."""
    most = np.maximum(1.0, total.max(axis=-1, keepdims=True) / 65535.0)
    return np.floor(total / most).astype(np.uint16)


def mix(code: WordCode, mixer: Mixer, tokens: Tokens, trained: np.ndarray, rate: np.float32 = RATE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """log2 probability of each text's bits, its symbols, and the weights and map after each run, averaged. trained: whether a text's own tokens are
    in the counts; its use of a slot is then taken out."""
    symbols = code.symbols(tokens)
    texts, bits = len(tokens.first) - 1, int(mixer.counts.shape[1]).bit_length() - 1
    lengths = code.lengths[symbols]
    owner = np.repeat(np.arange(texts), np.diff(tokens.first))
    head = (np.arange(len(symbols)) - tokens.first[owner]) % RUN == 0
    runs = np.flatnonzero(head)
    run_of = np.cumsum(head) - 1
    many = np.add.reduceat(lengths, runs)
    order = np.argsort(-many, kind="stable")
    rank = np.empty(len(runs), np.int32)
    rank[order] = np.arange(len(runs))
    live = np.searchsorted(-many[order], -np.arange(int(many.max(initial=0))), side="left")  # runs that have a bit at each step
    offset = np.concatenate(([0], np.cumsum(live))).astype(np.int32)
    before = (np.cumsum(lengths) - lengths).astype(np.int32)
    deep = np.arange(int(lengths.sum()), dtype=np.int32) - np.repeat(before, lengths)
    step = np.repeat(code.begin[symbols], lengths) + deep
    nodes, ones, gate = code.nodes[step], code.bits[step].astype(np.int32), code.gate[step]
    hashed = _of_nodes(nodes)
    own = np.repeat(trained[owner].astype(np.int32), lengths) if trained.any() else None
    # from the order of the text to that of the steps: bit by bit, all runs side by side
    to = offset[np.repeat(before - before[runs][run_of], lengths) + deep] + np.repeat(rank[run_of], lengths)
    del deep, step
    inputs = np.empty((INPUTS, len(to)), np.float32)
    for k, context in enumerate(contexts(symbols, tokens.first)):
        pair = mixer.counts[k].reshape(-1, 2).view(np.uint32).reshape(-1)[slots_of(np.repeat(context, lengths), hashed, bits)]
        zeros, some = (pair & np.uint32(0xFFFF)).view(np.int32), (pair >> np.uint32(16)).view(np.int32)
        if own is not None:
            of_one = own * ones
            some -= of_one
            zeros -= own - of_one
            np.maximum(some, 0, out=some)
            np.maximum(zeros, 0, out=zeros)
        inputs[k + 1][to] = _LOGS[some] - _LOGS[zeros]
        if k == 0:
            gate += DEPTHS * (zeros + some > 3)
    packed = np.empty(len(to), np.int32)
    packed[to] = (nodes * GATES + gate) * 2 + ones
    ones, packed = packed & 1, packed >> 1
    nodes = packed // GATES
    gate = packed - nodes * GATES
    inputs[0] = code.stretched[nodes]
    return *_online(mixer, inputs, nodes, ones, gate, live, offset, owner[runs][order], texts, rate), symbols


def _online(mixer: Mixer, inputs: np.ndarray, nodes: np.ndarray, ones: np.ndarray, gate: np.ndarray, live: np.ndarray, offset: np.ndarray, owner: np.ndarray, texts: int, rate: np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit after bit, all runs in step, each with weights, map and node offsets of its own."""
    runs, one = len(owner), np.float32(1)
    weights = [np.tile(mixer.weights[:, k], runs) for k in range(INPUTS)]  # of each input: runs * GATES
    refined = np.tile(mixer.refined.reshape(-1), runs)
    held = np.zeros(runs * OWN, np.float32)
    base_gate, base_own = np.arange(runs) * GATES, np.arange(runs) * OWN
    nodes = nodes & (OWN - 1)
    found = np.empty(len(ones), np.float32)
    bits = ones.astype(np.float32)
    a = 0
    for m in live.tolist():
        b = a + m
        bit = bits[a:b]
        place, g = base_own[:m] + nodes[a:b], base_gate[:m] + gate[a:b]
        some, extra = [w.take(g) for w in weights], held.take(place)
        z = extra.copy()
        for x, w in zip(inputs, some, strict=True):
            z += x[a:b] * w
        np.minimum(np.maximum(z, -LIMIT, out=z), LIMIT, out=z)
        p = one / (one + np.exp(-z))
        error = bit - p
        step = rate * error
        for x, w, all_w in zip(inputs, some, weights, strict=True):
            all_w[g] = w + step * x[a:b]
        held[place] = extra + OWN_RATE * error
        cell = g * BUCKETS + (z * 2 + 16.5).astype(np.int64)
        q = refined.take(cell)
        refined[cell] = q + REFINE * (bit - q)
        found[a:b] = np.abs(0.5 * (p + q) - (one - bit))
        a = b
    run = np.arange(len(ones)) - np.repeat(offset[:-1], live)
    total = np.bincount(owner[run], np.log2(found), texts) if len(ones) else np.zeros(texts)
    return total, np.stack([w.reshape(runs, GATES).mean(axis=0) for w in weights], axis=1), refined.reshape(runs, GATES, BUCKETS).mean(axis=0)
