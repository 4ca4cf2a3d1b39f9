"""Quality rules from repetition: a suffix array over words and its common-prefix intervals.

Texts are scanned in chunks of whole documents. All words of a chunk make one suffix
array by prefix doubling; a document's number is part of the first rank, so that
suffixes of different documents never compare equal. Only suffixes that still tie are
sorted again, so that the cost follows the repetition. Adjacent suffixes with a long
common prefix make the intervals of the maximal repeated substrings; the union of
their occurrences is the covered part of the text. That union is taken from the
neighbours' common prefixes directly; ``maximal_repeats`` lists the intervals.

A document is kept unless the base rules fail, repeats of ``MIN_REPEAT`` words or more
cover over ``MAX_COVERED`` hundredths of its words, or its longest repeat has more than
``MAX_LONGEST`` words. Occurrences may overlap, as in a word repeated many times.

Null texts, empty texts and texts without words have zeros everywhere and fail the base
rules (fewer than 50 words). Very long texts are scanned whole, in memory that follows
the longest one. A share that equals a limit is within it. Repeated rows each get a row.
Other columns are ignored, or kept where documents are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescast.llm.textscan import IS_SEPARATOR, Chunk, Words, chunks, mix64, reduce_rows, scan_words, span_hashes

MIN_WORDS = 50
MAX_REPEAT_WORDS = 50
WINDOW = 3
MIN_REPEAT = 8
MAX_COVERED = 40
MAX_LONGEST = 100

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_START = (np.arange(256) & 0xC0) != 0x80
_IN_WORD_START = _IS_START & ~IS_SEPARATOR


@dataclass
class Repeat:
    """A maximal repeated substring: its words, and where it occurs (word numbers in the chunk)."""

    words: int
    places: np.ndarray


@dataclass
class SuffixArray:
    order: np.ndarray
    ranks: list[np.ndarray]
    last: np.ndarray

    def shares(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``left`` and ``right`` (of one document) begin with alike."""
        length = np.zeros(len(left), dtype=np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            a, b = left + length, right + length
            inside = (a < self.last[left]) & (b < self.last[right])
            at = np.flatnonzero(inside)
            same = at[rank[a[at]] == rank[b[at]]]
            length[same] += 1 << level
        return length


def _group_starts(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys, whether each entry begins a group of equal ones."""
    fresh = np.ones(len(keys[0]), dtype=bool)
    fresh[1:] = False
    for key in keys:
        fresh[1:] |= key[1:] != key[:-1]
    return fresh


def suffix_array(tokens: np.ndarray, bounds: np.ndarray) -> SuffixArray:
    """Suffix array of several documents' tokens (any unsigned 64-bit values) by prefix doubling.

    ``ranks[k]`` is equal for suffixes of one document whose first ``2 ** k`` tokens
    agree; it is the place in ``order`` where their group begins.
    """
    size = len(tokens)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    last = bounds[1:][rows] if size else np.zeros(0, np.int64)
    order = np.argsort(mix64(tokens + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    fresh = _group_starts(tokens[order], rows[order])
    group = np.maximum.accumulate(np.where(fresh, np.arange(size), 0))
    rank = np.empty(size, dtype=np.int64)
    rank[order] = group
    ranks = [rank]
    slots = np.arange(size)
    step = 1
    while True:
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        slots = slots[~alone]
        if not len(slots):
            return SuffixArray(order, ranks, last)
        at = order[slots]
        first = rank[at]
        ahead = at + step
        second = np.where(ahead < last[at], rank[np.minimum(ahead, size - 1)], -1)
        # Within its group, each entry ends up in the group's slots in the order of the second half.
        by = np.argsort(first * np.int64(size + 1) + second + 1, kind="stable")
        at, first, second = at[by], first[by], second[by]
        order[slots] = at
        fresh = _group_starts(first, second)
        rank = rank.copy()
        rank[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        ranks.append(rank)
        step *= 2


def common_prefixes(suffixes: SuffixArray, least: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, or 0 where it is under ``least``."""
    shared = np.zeros(len(suffixes.order), dtype=np.int64)
    level = min(least.bit_length() - 1, len(suffixes.ranks) - 1)
    tied = suffixes.ranks[level][suffixes.order]
    at = np.flatnonzero(tied[1:] == tied[:-1]) + 1
    if 1 << level <= least and len(at):
        found = suffixes.shares(suffixes.order[at - 1], suffixes.order[at])
        shared[at] = np.where(found >= least, found, 0)
    return shared


def maximal_repeats(tokens: np.ndarray, bounds: np.ndarray, least: int = MIN_REPEAT) -> Iterator[Repeat]:
    """Substrings of at least ``least`` tokens found twice or more in a document that no extension keeps.

    An interval of suffixes with a common prefix can't be extended to the right; it is
    maximal if the tokens before its occurrences differ.
    """
    suffixes = suffix_array(tokens, bounds)
    shared = common_prefixes(suffixes, least)
    begins = np.zeros(len(tokens) + 1, dtype=bool)
    begins[bounds[:-1]] = True
    before = np.where(begins[: len(tokens)], np.uint64(0), np.concatenate([[np.uint64(0)], tokens[:-1]]))
    fresh_before = begins[: len(tokens)]

    def repeat(words: int, low: int, high: int) -> Iterator[Repeat]:
        places = suffixes.order[low:high]
        if fresh_before[places].any() or len(np.unique(before[places])) > 1:
            yield Repeat(words, places)

    open_intervals: list[tuple[int, int]] = []
    at = np.flatnonzero(shared)
    previous = -2
    for slot in at.tolist():
        if slot != previous + 1:
            while open_intervals:
                words, low = open_intervals.pop()
                yield from repeat(words, low, previous + 1)
        low = slot - 1
        while open_intervals and open_intervals[-1][0] > shared[slot]:
            words, low = open_intervals.pop()
            yield from repeat(words, low, slot)
        if not open_intervals or open_intervals[-1][0] < shared[slot]:
            open_intervals.append((int(shared[slot]), low))
        previous = slot
    while open_intervals:
        words, low = open_intervals.pop()
        yield from repeat(words, low, previous + 1)


def repetition(tokens: np.ndarray, bounds: np.ndarray, least: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """Per document: tokens covered by maximal repeats, and tokens of the longest one (0 if none).

    The longest repeat that begins at a suffix is its common prefix with the suffix
    before or after it, whichever is longer. These spans have the same union as all
    occurrences of all maximal repeats, whose list can grow with the square of a text.
    """
    suffixes = suffix_array(tokens, bounds)
    shared = common_prefixes(suffixes, least)
    reach = np.maximum(shared, np.append(shared[1:], 0))
    at = np.flatnonzero(reach)
    places, lengths = suffixes.order[at], reach[at]
    edges = np.bincount(places, minlength=len(tokens) + 1) - np.bincount(places + lengths, minlength=len(tokens) + 1)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    longest = np.zeros(len(bounds) - 1, dtype=np.int64)
    np.maximum.at(longest, rows[places], lengths)
    return reduce_rows(np.cumsum(edges)[:-1] > 0, bounds), longest


def _again(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value occurs twice or more in its row, and whether it occurred there before."""
    order = np.argsort(mix64(values + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    fresh = _group_starts(values[order], rows[order])
    alone = fresh.copy()
    alone[:-1] &= fresh[1:]
    twice = np.empty(len(values), dtype=bool)
    later = np.empty(len(values), dtype=bool)
    twice[order] = ~alone
    later[order] = ~fresh
    return twice, later


def _repeated_windows(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words in windows of ``WINDOW`` words that are found twice or more in their document."""
    total = len(hashes)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    covered = np.zeros(total, dtype=bool)
    at = np.flatnonzero(np.arange(total) + WINDOW <= bounds[1:][rows])
    value = sum(hashes[at + j] * np.uint64(2 * j + 3) ** np.uint64(7) for j in range(WINDOW))
    if len(at):
        twice, _ = _again(mix64(value), rows[at])
        for j in range(WINDOW):
            covered[at[twice] + j] = True
    return reduce_rows(covered, bounds)


def _repeated_lines(chunk: Chunk, words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    size = len(chunk.data)
    cut = np.zeros(size + 1, dtype=bool)
    breaks = np.flatnonzero(chunk.data == 10)
    cut[breaks + 1] = True
    cut[chunk.offsets] = True
    start = np.flatnonzero(cut[:size])
    end = np.append(start[1:], size)
    if not len(start):
        return np.zeros(chunk.rows, dtype=np.int64)
    text_end = end - (chunk.data[end - 1] == 10)
    has_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, text_end = start[has_word], text_end[has_word]
    rows = np.searchsorted(chunk.offsets, start, side="right") - 1
    _, later = _again(span_hashes(chunk.data, start, text_end), rows)
    return np.bincount(rows[later], minlength=chunk.rows)


RESULT_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_words long, longest_repeat long"
)
_NAMES = [part.split()[0] for part in RESULT_SCHEMA.split(", ")]


def _measure(chunk: Chunk) -> list[pa.Array]:
    words = scan_words(chunk)
    hashes = span_hashes(chunk.data, words.start, words.end)
    n_words = words.per_row
    repeat_words = _repeated_windows(hashes, words.bounds)
    covered, longest = repetition(hashes, words.bounds)
    failed = (n_words < MIN_WORDS) | (100 * repeat_words > MAX_REPEAT_WORDS * n_words)
    kept = ~failed & (100 * covered <= MAX_COVERED * n_words) & (longest <= MAX_LONGEST)
    columns = [
        n_words,
        reduce_rows(_IN_WORD_START[chunk.data], chunk.offsets),
        reduce_rows(_IS_SYMBOL[chunk.data], chunk.offsets),
        _repeated_lines(chunk, words),
        repeat_words,
        failed,
        kept,
        covered,
        longest,
    ]
    return [pa.array(c, pa.bool_() if c.dtype == bool else pa.int64()) for c in columns]


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts, the verdicts, and the repetition found."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                ids = batch.column(0).slice(chunk.first_row, chunk.rows)
                yield pa.RecordBatch.from_arrays([ids, *_measure(chunk)], names=_NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, RESULT_SCHEMA)


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, in one pass without a shuffle."""
    place = docs.columns.index("text")
    verdict = _NAMES.index("kept") - 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(place)):
                yield batch.slice(chunk.first_row, chunk.rows).filter(_measure(chunk)[verdict])

    return docs.mapInArrow(scan, docs.schema)
