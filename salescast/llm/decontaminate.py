"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so similarity says little; what counts is the
share of an item's distinct 5-word shingles found in the document.

Items are partitioned by their number of shingles into classes that double. An item of
``n`` shingles reaches containment ``t`` only if it misses at most ``n - ceil(t * n)``
of them. Its sketch is its ``k`` smallest MinHash values, with ``k`` set per size class
to the class's largest allowed number of misses plus ``SPARE``; a document that contains
the item has at least ``k - misses`` of them. The search therefore loses nothing, and
the sketches are a fraction of the items. Candidates are then verified by exact
containment of the shingles themselves, compared as text.

The sketches of a bounded block of items are broadcast; a larger benchmark takes more
blocks, each one pass over the documents, so memory stays bounded at any size. The
documents are never shuffled.

Null, empty and word-free texts have no shingle: as items they match nothing, as
documents they contain nothing. Fewer than five words make one shingle of the whole
sequence, which is found only in a document of just these words. Very long texts are
scanned whole, in memory that follows the longest one. Every item that a document
contains is a row, so there are no ties. Repeated rows each get their rows, and an empty
table has none. Other columns are ignored, or kept where documents are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescast.llm.textscan import SHINGLE_WORDS, chunks, lower, mix64, scan_words, shingle_hashes, span_hashes

CONTAINMENT = (75, 100)
SPARE = 3
# Bytes of item text in one broadcast block.
BLOCK_BYTES = 16_000_000


def shingle_texts(text: str | bytes) -> set[bytes]:
    """The distinct shingles of a text, as bytes."""
    data = text.encode() if isinstance(text, str) else text
    words = data.lower().split()
    if not words:
        return set()
    count = max(1, len(words) - SHINGLE_WORDS + 1)
    return {b" ".join(words[i : i + SHINGLE_WORDS]) for i in range(count)}


def least_shared(shingles: int) -> int:
    """Shingles that must be found for the containment."""
    part, most = CONTAINMENT
    return -(-part * shingles // most)


def sketch_size(shingles: int) -> int:
    """MinHash values kept for an item: one size for all items of a size class."""
    top = (1 << shingles.bit_length()) - 1
    return top - least_shared(top) + SPARE


@dataclass
class SketchedItems:
    """A block of items and an index from MinHash value to the items that keep it.

    ``hashes`` is sorted; entry ``i`` belongs to item ``owner[i]``. ``needed[j]`` of the
    values kept for item ``j`` must be found before it is verified.
    """

    ids: list[int]
    texts: list[str]
    hashes: np.ndarray
    owner: np.ndarray
    needed: np.ndarray


def sketch_items(ids: list[int], texts: list[str]) -> SketchedItems:
    hashes, owner, needed = [], [], []
    arrow = pa.array(texts, pa.string())
    number = 0
    for chunk in chunks(arrow):
        values, bounds = _shingles(chunk)
        for row in range(chunk.rows):
            ranked = np.sort(mix64(np.unique(values[bounds[row] : bounds[row + 1]])))
            kept = ranked[: sketch_size(len(ranked))]
            misses = len(ranked) - least_shared(len(ranked))
            hashes.append(kept)
            owner.append(np.full(len(kept), number))
            needed.append(max(1, len(kept) - misses))
            number += 1
    values = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    owners = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")
    return SketchedItems(ids, texts, values[order], owners[order], np.array(needed, dtype=np.int64))


def _shingles(chunk) -> tuple[np.ndarray, np.ndarray]:
    chunk = lower(chunk)
    words = scan_words(chunk)
    return shingle_hashes(span_hashes(chunk.data, words.start, words.end), words.bounds)


class _Probe:
    """A table of one bit per hash prefix: most shingles of a document are dismissed by one look."""

    def __init__(self, hashes: np.ndarray):
        bits = max(16, int(len(hashes)).bit_length() + 5)
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[(hashes >> self.shift).astype(np.int64)] = True

    def __call__(self, values: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.seen[(values >> self.shift).astype(np.int64)])


def candidates(texts: pa.Array, items: SketchedItems, probe: _Probe) -> Iterator[tuple[int, int]]:
    """Pairs (row, item number) whose sketches allow the containment, row by row."""
    for chunk in chunks(texts):
        values, bounds = _shingles(chunk)
        values = mix64(values)
        at = probe(values)
        low = np.searchsorted(items.hashes, values[at], side="left")
        high = np.searchsorted(items.hashes, values[at], side="right")
        found = high > low
        at, low, high = at[found], low[found], high[found]
        if not len(at):
            continue
        rows = np.searchsorted(bounds, at, side="right") - 1
        for row in np.unique(rows).tolist():
            mine = rows == row
            slots = np.unique(np.concatenate([np.arange(a, b) for a, b in zip(low[mine], high[mine])]))
            owners, hits = np.unique(items.owner[slots], return_counts=True)
            for item in owners[hits >= items.needed[owners]].tolist():
                yield chunk.first_row + row, item


RESULT_SCHEMA = "doc_id long, item_id long, n_shared long, n_item_shingles long"


class _Search:
    """One block of items, ready to be found in texts."""

    def __init__(self, block: SketchedItems):
        self.block, self.probe = block, _Probe(block.hashes)
        self.shingles: dict[int, set[bytes]] = {}

    def contained(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """Row, item_id, shared shingles and the item's shingles, for each item a text contains."""
        current, own = -1, set()
        for row, item in candidates(texts, self.block, self.probe):
            if row != current:
                current, own = row, shingle_texts(texts[row].as_py())
            if item not in self.shingles:
                self.shingles[item] = shingle_texts(self.block.texts[item])
            wanted = self.shingles[item]
            shared = len(wanted & own)
            if shared >= least_shared(len(wanted)):
                yield row, self.block.ids[item], shared, len(wanted)


def search_block(docs: DataFrame, items: SketchedItems) -> DataFrame:
    """Pairs of a document and an item of the block that it contains."""
    shared_items = docs.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(shared_items.value)
        for batch in batches:
            found = list(search.contained(batch.column(1)))
            rows, ids, shared, wanted = (pa.array([f[c] for f in found], pa.int64()) for c in range(4))
            columns = [batch.column(0).take(rows), ids, shared, wanted]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "n_shared", "n_item_shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, RESULT_SCHEMA)


def clean_documents(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, without a shuffle."""
    place, schema = docs.columns.index("text"), docs.schema
    for items in item_blocks(benchmark, block_bytes):
        shared_items = docs.sparkSession.sparkContext.broadcast(items)

        def scan(batches: Iterator[pa.RecordBatch], shared_items=shared_items) -> Iterator[pa.RecordBatch]:
            search = _Search(shared_items.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[row for row, _, _, _ in search.contained(batch.column(place))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(scan, schema)
    return docs


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[SketchedItems]:
    """The items in blocks of about ``block_bytes`` of text, in turn.

    A block is taken by hash of the item, so that only one block at a time is on the driver.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(total // block_bytes) + 1
    for block in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).orderBy("item_id", "text")
        rows = part.toArrow()
        if rows.num_rows:
            yield sketch_items(rows.column("item_id").to_pylist(), rows.column("text").to_pylist())


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and benchmark item that it contains: doc_id, item_id, n_shared, n_item_shingles."""
    found = [search_block(docs, items) for items in item_blocks(benchmark, block_bytes)]
    if not found:
        return docs.sparkSession.createDataFrame([], RESULT_SCHEMA)
    result = found[0]
    for more in found[1:]:
        result = result.union(more)
    return result
