"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

For vocabularies of words with an end mark and lower case. A sequence of tokens is the merge result
exactly if each neighbouring pair is: merging the two tokens' symbols gives these two again. An
Aho-Corasick automaton over the reversed tokens finds the longest token at each position of a word;
the encoder takes it if the pair with the token before is compatible, tries shorter ones if it is not,
and steps back if none is. Dead positions are marked, so a word takes linear time. Tokens of words, and of the pieces between
blanks, are kept by their texts, within bounds; frequent ones stay when a bound is reached.

Defined cases: a null or empty text has no ids and decodes to an empty text; special tokens' strings
in a text become their ids, as the library does; code points that Unicode assigned only lately may count as letters here and not there; repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docframe.llm.shared import Kept, list_array, text_chunks, texts_of

_END = "\ue000"  # stands for the end mark inside symbol strings; byte symbols never use it
_PIECES_KEPT, _WORDS_KEPT = 1_000_000, 600_000
_PAIRS_KEPT = 1_000_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable in Latin-1, else the next free code from 256."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class OffsetTable:
    """Strings end to end in one array, with the offset of each: many ids become their joined text by one gather."""

    def __init__(self, strings: list[bytes]):
        self._lengths = np.array([len(x) for x in strings], dtype=np.int64)
        self._offsets = np.cumsum(self._lengths) - self._lengths
        self._bytes = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def join(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of all ids, and the end of each id's bytes in them."""
        lengths = self._lengths[ids]
        ends = np.cumsum(lengths)
        where = np.repeat(self._offsets[ids] - ends + lengths, lengths)
        where += np.arange(len(where))
        return self._bytes[where].data, ends


class BacktrackingBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self._suffix = model["end_of_word_suffix"]
        self._special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocabulary = {**model["vocab"], **self._special}
        self.strings = [""] * (max(vocabulary.values()) + 1)
        for text, i in vocabulary.items():
            self.strings[i] = text
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self._words = regex.compile(pattern)
        self._between = regex.compile("(" + "|".join(map(regex.escape, self._special)) + ")")
        self._byte = byte_symbols()
        size = len(self._suffix)
        marked = {t: (t[:-size] + _END if t.endswith(self._suffix) and len(t) > size else t) for t in model["vocab"]}
        self._id = {marked[t]: i for t, i in model["vocab"].items()}
        self._size = {i: len(t) for t, i in self._id.items()}
        self._rank: dict[tuple[int, int], int] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        made: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, both = (self._id[marked[x]] for x in (a, b, a + b))
            self._rank[left, right] = rank
            self._halves.setdefault(both, (left, right))
            made.setdefault(both, rank)
        self._made = made
        self._automaton = ahocorasick.Automaton()
        for text, i in self._id.items():
            self._automaton.add_word(text[::-1], i)
        self._automaton.make_automaton()
        self._shorter = {i: self._id.get(self._prefix(text)) for text, i in self._id.items()}
        self._fits: dict[tuple[int, int], bool] = {}
        self._known = Kept(lambda pieces, _: {p: self._piece(p) for p in pieces}, _PIECES_KEPT)
        self._merged = Kept(lambda words, _: {w: self._ids(w) for w in words}, _WORDS_KEPT)
        self.table = OffsetTable([x.encode() + b" " for x in self.strings])
        self.decimals = OffsetTable([b"%d " % i for i in range(len(self.strings))])

    def _prefix(self, text: str) -> str:
        return next((text[:k] for k in range(len(text) - 1, 0, -1) if text[:k] in self._id), "")

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay two when their symbols are merged: no merge across the border comes before those that built them.

        The tokens are taken apart from the last merge backwards; at each state of the border a merge across it must be later than the merge that is undone next.
        """
        known = self._fits.get((left, right))
        if known is None:
            a, b, limit, known = left, right, len(self._rank), True
            while True:
                if self._rank.get((a, b), len(self._rank)) < limit:
                    known = False
                    break
                ma, mb = self._made.get(a, -1), self._made.get(b, -1)
                if ma < 0 and mb < 0:
                    break
                # the border pair existed until the later of the two last merges at the border; an equal
                # merge happens from left to right, so that in the left token goes first
                if ma > mb:
                    limit, a = ma, self._halves[a][1]
                else:
                    limit, b = mb + 1, self._halves[b][0]
            if len(self._fits) > _PAIRS_KEPT:
                self._fits.clear()
            self._fits[left, right] = known
        return known

    def word(self, symbols: str) -> list[int]:
        """Ids of one word, given as byte symbols with the end mark."""
        whole = self._id.get(symbols)
        if whole is not None:
            return [whole]
        size = len(symbols)
        longest: list[int | None] = [None] * (size + 1)
        for end, i in self._automaton.iter(symbols[::-1]):
            begin = size - 1 - end
            if longest[begin] is None or self._size[i] > self._size[longest[begin]]:
                longest[begin] = i
        out: list[int] = []
        at, token, dead = 0, longest[0], set()
        while at < size:
            while token is not None:
                after = at + self._size[token]
                if after not in dead and (after == size or longest[after] is not None) and (not out or self._compatible(out[-1], token)):
                    break
                token = self._shorter[token]
            if token is None:
                if not out:
                    raise ValueError("the vocabulary has no token for a symbol")
                dead.add(at)
                token = out.pop()
                at -= self._size[token]
                token = self._shorter[token]
            else:
                out.append(token)
                at += self._size[token]
                token = longest[at] if at < size else None
        return out

    def _ids(self, word: str) -> bytes:
        return np.array(self.word("".join([self._byte[b] for b in word.encode()]) + _END), dtype=np.int32).tobytes()

    def _piece(self, piece: str) -> bytes:
        found: list[bytes] = []
        for k, part in enumerate(self._between.split(piece)):
            if k % 2:
                found.append(self._special[part].to_bytes(4, "little"))
            elif part:
                normal = part.lower() if part.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", part))
                found.append(self._merged.joined(self._words.findall(normal)))
        return b"".join(found)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self._known.joined(text.replace("\n", " ").split(" ")), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return bytes(self.table.join(np.asarray(ids))[0][:-1]).decode()


@lru_cache(maxsize=2)
def codec(path: str) -> BacktrackingBpe:
    """One for each Python worker; it outlives a task."""
    return BacktrackingBpe(path)


def _joined(table: OffsetTable, ids: list[np.ndarray]) -> list[memoryview]:
    """Each document's strings, joined by one blank."""
    sizes = np.cumsum([len(x) for x in ids])
    data, ends = table.join(np.concatenate(ids))
    stops = [0, *(int(ends[k - 1]) if k else 0 for k in sizes)]
    return [data[a : max(a, b - 1)] for a, b in zip(stops[:-1], stops[1:], strict=True)]


def encode_decode(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, and ids and decoded text; with digests the sha256 of both instead (ids as decimals joined by one blank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for batch in batches:
            for first, texts in text_chunks(batch, most=1_000_000):
                ids = [bpe.encode(x) for x in texts]
                decoded = _joined(bpe.table, ids)
                if digests:
                    rest = [pa.array([hashlib.sha256(x).hexdigest() for x in some], pa.string()) for some in (_joined(bpe.decimals, ids), decoded)]
                else:
                    rest = [list_array(ids, pa.int32()), pa.array([bytes(x).decode() for x in decoded], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array([len(x) for x in ids], pa.int64()), *rest], names)

    kind = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    names = ["doc_id", "n_tokens", *(x.split(" ")[0] for x in kind.split(", "))]
    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, " + kind)
