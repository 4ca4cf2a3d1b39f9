"""Vectorised scans of text columns: words, word hashes and shingle hashes.

A word is ``[^\\x20\\x09-\\x0D]+``. All separators are single ASCII bytes, so the scan
works on UTF-8 bytes as they lie in the Arrow buffer. Texts are taken in chunks of
whole documents, so that memory follows the chunk and the longest document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 500_000
SHINGLE_WORDS = 5

IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER_CASE = np.arange(256, dtype=np.uint8)
LOWER_CASE[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _BASE, dtype=np.uint64)
    down = np.full(size, _BASE_INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(CHUNK_BYTES + 1)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for at least ``size`` exponents.

    A worker keeps those of a usual chunk; those for a longer text go with it.
    """
    return _usual_powers() if size <= CHUNK_BYTES + 1 else _powers(size)


class SpanHasher:
    """64-bit hashes of byte spans ``[start, end)`` of ``data``, equal for equal spans."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.prefix[end] - self.prefix[start]) * self.down[start]
        return mix64(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return SpanHasher(data)(start, end)


@dataclass
class Chunk:
    """Some whole documents: their bytes end to end, and where each begins (and the last ends)."""

    first_row: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """The words of a chunk in order. Words of document ``d`` are ``bounds[d]`` to ``bounds[d + 1]``."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.bounds)


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a text column into chunks of whole documents; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offset_buffer, data_buffer = texts.buffers()
    if len(texts) == 0:
        return
    offsets = np.frombuffer(offset_buffer, dtype=np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield Chunk(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last
    give_back_memory()


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not the GNU C library
        return lambda _: 0


def give_back_memory() -> None:
    """Return what a batch took to the machine: workers stay between stages, and hold on to it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def scan_words(chunk: Chunk, is_separator: np.ndarray = IS_SEPARATOR) -> Words:
    size = len(chunk.data)
    inside = np.empty(size + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(is_separator[chunk.data], out=inside[1:-1])
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    # A document's edge also ends a word.
    edges = chunk.offsets[(chunk.offsets > 0) & (chunk.offsets < size)]
    starts[edges] = inside[1:-1][edges]
    ends[edges - 1] = inside[1:-1][edges - 1]
    start = np.flatnonzero(starts)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, chunk.offsets))


def lower(chunk: Chunk) -> Chunk:
    """A to Z become a to z; other characters stay."""
    return Chunk(chunk.first_row, LOWER_CASE[chunk.data], chunk.offsets)


_PLACES = [np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64)) for j in range(64)]


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``words``-word shingles, and the bounds of each document's run.

    A document with fewer words has its whole sequence as one shingle; one without
    words has none. Repeats within a document stay.
    """
    total = len(hashes)
    counts = np.diff(bounds)
    rows = np.repeat(np.arange(len(counts)), counts)
    rank = np.arange(total) - bounds[:-1][rows]
    left = counts[rows] - rank
    keep = (left >= words) | ((rank == 0) & (counts[rows] < words))
    at = np.flatnonzero(keep)
    length = np.minimum(left[at], words)
    value = length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for j in range(words):
        use = length > j
        value[use] += hashes[at[use] + j] * _PLACES[j]
    return mix64(value), np.searchsorted(rows[at], np.arange(len(counts) + 1))


def reduce_rows(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each run of ``bounds``; empty runs give 0."""
    sums = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


class Lookup:
    """Values by 64-bit key: an open-addressed table that is probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.slots = np.full(size, -1, dtype=np.int32)
        self.keys, self.values = keys, values
        at, rest = self._home(keys), np.arange(len(keys), dtype=np.int32)
        while len(rest):
            open_now = self.slots[at] < 0
            # Of several keys for one free slot the last written stays; the others go on.
            self.slots[at[open_now]] = rest[open_now]
            lost = self.slots[at] != rest
            at, rest = (at[lost] + 1) & (size - 1), rest[lost]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in ``values``, or -1."""
        found = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.keys):
            return found
        rest, at = np.arange(len(keys)), self._home(keys)
        while len(rest):
            place = self.slots[at]
            same = (place >= 0) & (self.keys[place] == keys[rest])
            found[rest[same]] = place[same]
            go_on = (place >= 0) & ~same
            rest, at = rest[go_on], (at[go_on] + 1) & (len(self.slots) - 1)
        return found
