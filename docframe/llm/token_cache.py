"""Whole-text encoding with the tokenizers library's merges, made once for each distinct piece between blanks.

Both kinds of vocabulary split a text at blanks before they merge, so a text's ids are its pieces' ids in
order. Where a blank stands inside a longer run of white space (or where a special token's opening
occurs) that does not hold, and the library gets the whole text. A piece that is not kept yet is normalized and split into words as the
vocabulary's file says, and the library's model merges each word. Where words take the blank before them, pieces of letters are
merged without the marks behind them, which are a word of their own: so a word is merged once, whatever mark follows it.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache
from string import punctuation

import numpy as np
import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from docframe.llm.shared import Kept

_RUN = re.compile(r"\s (?:\s|\Z)")
_PIECES_KEPT, _TAIL = 1_200_000, 3

# How the two kinds of vocabulary split words.
_SPACED_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BARE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class CachedEncoder:
    """Ids of whole texts; what it keeps of pieces is bounded by _PIECES_KEPT entries."""

    def __init__(self, path: str):
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._spaced = self._library.normalizer is None  # then a piece takes the blank before it
        self._words = regex.compile(_SPACED_WORDS if self._spaced else _BARE_WORDS)
        self._symbols = ByteLevel(add_prefix_space=False, use_regex=False)
        self._merge = self._library.model.tokenize
        self._cache = Kept(self._made, _PIECES_KEPT)
        self._tails: dict[str, bytes] = {}  # of at most _TAIL marks

    def _whole(self, text: str) -> bytes:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _pieces(self, text: str) -> list[str] | None:
        if "<|" in text or "\0" in text or (self._spaced and _RUN.search(text)):
            return None
        if not self._spaced:
            return text.replace("\n", " ").split(" ")
        first, *rest = text.split(" ")
        return ["\0" + first, *rest]  # the first piece has no blank before it

    def _piece(self, piece: str) -> bytes:
        if self._spaced and piece.isascii() and piece.isalpha():
            return self._ids("Ġ" + piece)
        if self._spaced:
            text = piece[1:] if piece[:1] == "\0" else " " + piece
        else:
            text = piece
        if not text.isascii() and max(text) > "\u024f":  # beyond Latin letters Unicode tables may differ
            return self._whole(text)
        if not self._spaced:
            text = text.lower() if text.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", text))
        words = self._words.findall(text)
        if text.isascii() and text.isprintable():
            words = ["Ġ" + w[1:] if w[0] == " " else w for w in words]  # other printable ASCII stands for itself
        else:
            words = [self._symbols.pre_tokenize_str(w)[0][0] for w in words]
        return array("I", [t.id for w in words for t in self._merge(w)]).tobytes()

    def _made(self, pieces: list[str], known: Callable[[str], bytes | None]) -> dict[str, bytes]:
        """Of each piece the ids, and of the words in them that are pieces without the marks at their end."""
        if not self._spaced:
            return {p: self._piece(p) for p in pieces}
        made: dict[str, bytes] = {}
        for piece in pieces:
            word = piece.rstrip(punctuation)
            if 0 < len(piece) - len(word) <= _TAIL and word.isalpha() and (word.isascii() or max(word) <= "\u024f"):
                ids = made.get(word) or known(word)
                if ids is None:
                    ids = made[word] = self._piece(word)
                tail = piece[len(word) :]
                if tail not in self._tails:
                    self._tails[tail] = self._ids(tail)
                made[piece] = ids + self._tails[tail]
            elif piece not in made:
                made[piece] = self._piece(piece)
        return made

    def _ids(self, symbols: str) -> bytes:
        return array("I", [t.id for t in self._merge(symbols)]).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, dtype="<u4") for x in self.encode_bytes(texts)]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            pieces = self._pieces(text)
            out.append(self._whole(text) if pieces is None else self._cache.joined(pieces))
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> CachedEncoder:
    """One for each Python worker; it outlives a task."""
    return CachedEncoder(path)
