"""Byte-level BPE ids of whole texts, with the pieces between spaces kept in a bounded cache.

A text is cut at spaces that stand between two characters which are not white space. The
vocabulary's pre-tokenizer never joins characters across such a place (a space opens the piece that
follows it), so the ids of the parts, one after another, are the ids of the text.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import regex

#: The public vocabulary file; any byte-level BPE file of the tokenizers library does.
VOCABULARY = "byte_bpe_50k.json"

#: The vocabulary's own pre-tokenizer, as its documentation gives it (fixed value).
_PIECE = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

#: Parts a worker keeps, twice over (about 150 bytes a part).
CACHE = 800_000

#: Letters below are letters in every version of Unicode in use.
_SETTLED = "\u0530"


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: 0x100 + i for i, b in enumerate(others)}


_LETTERS = _byte_letters()


def _spelled(piece: str) -> str:
    """A piece with a letter for each of its UTF-8 bytes, as the vocabulary spells it."""
    if piece.isascii() and piece.isprintable():
        return piece.replace(" ", "Ġ")
    return piece.encode().decode("latin-1").translate(_LETTERS)


_RUNS = re.compile(r"\s\s")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """`encode(text)` gives the ids as little-endian unsigned 32-bit integers in one bytes object."""

    def __init__(self, vocabulary: str = VOCABULARY, cache_size: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # the cache here stands before the library's own
        self.packed = [struct.pack("<I", i) for i in range(1 + self._last_id())]
        self.cache_size = cache_size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, pieces: list[str]) -> bytes:
        """Ids of pre-tokenized pieces of text."""
        packed, tokenize = self.packed, self.model.tokenize
        return b"".join([packed[t.id] for p in pieces for t in tokenize(_spelled(p))])

    def _fresh(self, part: str) -> bytes:
        """Ids of a part that follows a space."""
        if part.isalpha():
            if part.isascii():
                packed = self.packed
                return b"".join([packed[t.id] for t in self.model.tokenize("Ġ" + part)])
            if max(part) < _SETTLED:
                return self._ids([" " + part])
        if len(part) > 1 and part[-1] in ",." and part[-2].isalpha() and part[-2] < _SETTLED:
            return self._known(part[:-1]) + self._ids([part[-1]])
        return self._ids(_PIECE.findall(" " + part))

    def _known(self, part: str) -> bytes:
        found = self.young.get(part)
        if found is None:
            found = self.old.get(part)
            if found is None:
                found = self._fresh(part)
            if len(part) > 64:
                return found
            if len(self.young) >= self.cache_size:
                self.old, self.young = self.young, {}
            self.young[part] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text; none for null or empty."""
        if not text:
            return b""
        if any(t in text for t in self.added):  # the library gives their strings ids of their own
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = _BETWEEN.split(text) if _RUNS.search(text) or text[0] == " " or text[-1] == " " \
            else text.split(" ")
        first = self._ids(_PIECE.findall(parts[0]))
        rest = parts[1:]
        found = list(map(self.young.get, rest))
        if None in found:
            known = self._known
            found = [known(p) if f is None else f for p, f in zip(rest, found)]
        return first + b"".join(found)

    def _last_id(self) -> int:
        return max(self.tokenizer.get_vocab().values())

    def byte_lengths(self) -> np.ndarray:
        """Bytes of text each id stands for."""
        sizes = np.zeros(1 + self._last_id(), np.int64)
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            sizes[i] = len(piece)  # one character stands for one byte
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            sizes[i] = len(token.content.encode())
        return sizes


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY, cache_size: int = CACHE) -> Encoder:
    """One per Python worker; the cache stays warm from task to task."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary, cache_size)
    return _ENCODERS[vocabulary]


def forget() -> None:
    """Give the memory of this Python worker's encoders back; other stages use the worker too."""
    _ENCODERS.clear()
