"""Vectorised word hashing over the raw buffers of an Arrow string column.

Texts are handled whole, in blocks of whole rows of about ``BLOCK`` bytes (a longer text is a
block of its own), so that memory follows the block and not the Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1

ASCII_SPACE = bytes([0x20, *range(0x09, 0x0E)])


def _lower() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[ord("A"):ord("Z") + 1] += 32
    return lut


def space_words() -> np.ndarray:
    """True for each byte that belongs to a word ``[^\\x20\\x09-\\x0D]+``."""
    inside = np.ones(256, dtype=bool)
    inside[list(ASCII_SPACE)] = False
    return inside


def letter_words() -> np.ndarray:
    """True for ASCII letters, digits and every byte of a non-ASCII character."""
    inside = np.zeros(256, dtype=bool)
    inside[128:] = True
    inside[[c for c in range(128) if chr(c).isalnum()]] = True
    return inside


LOWER = _lower()
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> None:
    for k, base in enumerate((_BASE, _INVERSE)):
        if len(_powers[k]) < n:
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a block of texts: ``first[d]:first[d + 1]`` are the words of text d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        low = LOWER[data]
        word = inside[data]
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)  # a text begins here
        edge[offsets] = True
        begin, finish = word.copy(), word.copy()
        if n:
            begin[1:] &= ~word[:-1] | edge[1:-1]
            finish[:-1] &= ~word[1:] | edge[1:-1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, offsets)
        _grow(n + 1)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=self.prefix[1:])

    def hashes(self, length: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``length`` bytes."""
        end = self.end if length is None else np.minimum(self.end, self.start + length)
        h = (self.prefix[end] - self.prefix[self.start]) * _powers[1][self.start]
        return mix(h, 1 if length is None else 7 + length)


def blocks(column: pa.Array, limit: int = BLOCK):
    """(first row, one past the last, bytes, offsets) of blocks of whole rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, values = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def plain_words() -> np.ndarray:
    """True for ASCII letters and every byte of a non-ASCII character."""
    inside = np.zeros(256, dtype=bool)
    inside[128:] = True
    inside[[c for c in range(128) if chr(c).isalpha()]] = True
    return inside


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the words of a block: ``first[d]:first[d + 1]`` are those of text d."""
    word = inside[data]
    begin, finish = word.copy(), word.copy()
    if len(data):
        edge = np.zeros(len(data) + 1, dtype=bool)  # a text begins here
        edge[offsets] = True
        begin[1:] &= ~word[:-1] | edge[1:-1]
        finish[:-1] &= ~word[1:] | edge[1:-1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(finish) + 1, np.searchsorted(start, offsets)


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.LargeStringArray:
    """The words ``data[start:end]`` as an Arrow column."""
    size = end - start
    where = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.repeat(start - where[:-1], size) + np.arange(where[-1])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(data[at])))
