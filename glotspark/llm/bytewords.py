"""Vectorised words and word hashes over UTF-8 buffers.

Texts come as Arrow string arrays. All work is done with numpy on the bytes of many texts at
once, in pieces of bounded size, so that memory follows the piece and not the table. A word is a
run of bytes of one class; the classes used here (white space, ASCII punctuation) are made of
ASCII bytes only, so that cutting bytes never cuts a UTF-8 character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE = 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Everything but space, tab, line feed, vertical tab, form feed and carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False

#: Digits, a-z and every byte of a non-ASCII character (texts are lower-cased before).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers = {"pow": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["pow"]) < n:
        for name, base in (("pow", _B), ("inv", _B_INVERSE)):
            full = np.full(n, base, np.uint64)
            full[0] = 1
            _powers[name] = np.multiply.accumulate(full)
    return _powers["pow"][:n], _powers["inv"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def arrow_texts(column) -> pa.Array:
    """One string array whose nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.fill_null("" if not pa.types.is_binary(column.type) else b"") if column.null_count else column


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array, and where each text begins (one more entry than texts)."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


@dataclass
class Piece:
    """Some whole texts: number of the first, bytes, where each text begins, and their words."""

    first: int
    data: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word_at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.data)
        pow_, inv = _power(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * pow_[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * inv[self.start] + (self.end - self.start).astype(np.uint64))

    def owner(self) -> np.ndarray:
        """For each word the text it stands in, counted from the piece's first."""
        return np.repeat(np.arange(len(self)), np.diff(self.word_at))


def cut(at: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes, at least one text each."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def pieces(texts: pa.Array, word: np.ndarray, lower: bool = True, size: int = PIECE) -> Iterator[Piece]:
    """The texts in pieces, with A-Z lower-cased, and the runs of bytes for which word is true."""
    data, at = raw(texts)
    for i, j in cut(at, size):
        b, o = data[at[i] : at[j]], at[i : j + 1] - at[i]
        if lower:
            b = LOWER[b]
        in_word = word[b]
        first, last = in_word.copy(), in_word.copy()
        first[1:] &= ~in_word[:-1]
        last[:-1] &= ~in_word[1:]
        full = o[:-1][np.diff(o) > 0]
        first[full] = in_word[full]
        last[full[1:] - 1] = in_word[full[1:] - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        yield Piece(i, b, o, start, end, np.searchsorted(start, o))


def windows(hashes: np.ndarray, word_at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of n consecutive words within a text, and the number of its first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * _B + hashes[k : k + m]
    left = np.zeros(len(hashes), np.int64)
    end = np.repeat(word_at[1:], np.diff(word_at))
    left = end - np.arange(len(hashes))
    at = np.flatnonzero(left[:m] >= n)
    return mix(h[at]), at


def whole(hashes: np.ndarray) -> np.uint64:
    """The hash that windows() gives a run of exactly these words."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for x in hashes:
            h = h * _B + x
        return mix(np.array([h], np.uint64))[0]
