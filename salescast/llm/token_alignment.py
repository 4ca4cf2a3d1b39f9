"""Alignment of two tokenizers' tokens by interval coalescing, with corpus-wide pair counts.

Tokenizer A is a byte-level BPE (a ``tokenizers`` file), B a piece model with byte
fallback (a ``sentencepiece`` file, which puts a space before the text; A gets
space+text). A token covers a range of bytes. All tokens of A and B are sorted by start;
where a start reaches the running maximum of the ends before it, both tokenizers have
ended a token, and a group ends. Within a group each A token is linked with the B tokens
whose ranges overlap its own.

Neither tokenizer joins what lies on both sides of a single space between two characters
that are no white space: A's words begin there, and no piece of B has a space behind
another character (``PieceTable`` checks it; otherwise texts are not cut). So texts are
cut there, each distinct piece of text is encoded and aligned once per task (of more than
``KNOWN_SEGMENTS`` the half seen most often is kept), and its groups and links stand for
every place it occurs.

Links are counted per pair of ids in each document, stored, summed in the task and then
over the corpus. The ``HOT_PAIRS`` most frequent pairs are broadcast for the documents'
sums; rarer ones, if there are any, are joined by shuffle. The highest count of each B id
is one row per id of B's vocabulary.

A text that is null, empty, or that either tokenizer doesn't give back byte for byte has
no tokens and all zeros. Very long texts are encoded whole, piece by piece. Several A ids
with a B id's highest count all count as best. Repeated rows each get a row and each
count. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescast.llm.scratch import stored
from salescast.llm.textscan import Chunk, Lookup, chunks, reduce_rows

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
KNOWN_SEGMENTS = 250_000
KNOWN_BYTES = 8_000_000
RUN_BYTES = 65_536
HOT_PAIRS = 1_000_000
PENDING_PAIRS = 1_000_000
_B_BITS = 32

_SPACE = 32
# Bytes that may end, or begin, a white-space character of Unicode.
_ENDS_SPACE, _BEGINS_SPACE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_ENDS_SPACE[[*range(9, 14), *range(28, 33), *range(0x80, 0x8B), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_BEGINS_SPACE[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def byte_of_char() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, have
    the characters from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(0x100 + i): b for i, b in enumerate(hidden)}}


class ByteTable:
    """Tokenizer A: encodes texts, to which it adds a space, and the bytes of each id."""

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.encode_special_tokens = True
        char = byte_of_char()
        entries = json.loads(source)["model"]["vocab"]
        table = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            table[i] = bytes(char[c] for c in entry) if all(c in char for c in entry) else entry.encode()
        self.entries = pa.array(table, pa.large_binary())
        self.lengths = np.array([len(entry) for entry in table])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceTable:
    """Tokenizer B: encodes texts, to which it adds a space, and the bytes of each id."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.tokenizer = SentencePieceProcessor(model_proto=model)
        ids = range(self.tokenizer.get_piece_size())
        pieces = [self.tokenizer.id_to_piece(i) for i in ids]
        self.entries = pa.array(
            [bytes([int(p[3:-1], 16)]) if self.tokenizer.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)],
            pa.large_binary(),
        )
        self.lengths = pc.binary_length(self.entries).to_numpy()
        self.may_cut = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.tokenizer.encode(texts, num_threads=1)


@dataclass
class Tokenizers:
    """Both files' contents, as broadcast to the tasks (a few MB, fixed by the vocabularies)."""

    a_source: str
    b_model: bytes

    @classmethod
    def read(cls, a_path: str = TOKENIZER_A, b_path: str = TOKENIZER_B) -> Tokenizers:
        return cls(Path(a_path).read_text(encoding="utf-8"), Path(b_path).read_bytes())

    @cached_property
    def a(self) -> ByteTable:
        return ByteTable(self.a_source)

    @cached_property
    def b(self) -> PieceTable:
        return PieceTable(self.b_model)

    def __getstate__(self):
        return {"a_source": self.a_source, "b_model": self.b_model}


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``first[i]`` to ``first[i] + count[i] - 1`` of all i, in order."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


@dataclass
class Aligned:
    """Groups and links of some segments. Links of segment ``s`` are ``bounds[s]`` to ``bounds[s + 1]``."""

    valid: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    bounds: np.ndarray
    links: np.ndarray
    groups: list[bytes]

    @property
    def n_links(self) -> np.ndarray:
        return np.diff(self.bounds)

    def take(self, at: np.ndarray) -> Aligned:
        some = {n: getattr(self, n)[at] for n in ("valid", "n_a", "n_b", "n_groups")}
        count = self.n_links[at]
        links = self.links[_expand(self.bounds[at], count)]
        return Aligned(bounds=_offsets(count), links=links, groups=[self.groups[i] for i in at.tolist()], **some)

    @classmethod
    def none(cls) -> Aligned:
        zero = np.zeros(0, np.int64)
        return cls(zero.astype(bool), zero, zero, zero, np.zeros(1, np.int64), zero, [])

    def plus(self, other: Aligned) -> Aligned:
        both = {n: np.concatenate([getattr(self, n), getattr(other, n)]) for n in ("valid", "n_a", "n_b", "n_groups", "links")}
        return Aligned(bounds=np.concatenate([self.bounds, self.bounds[-1] + other.bounds[1:]]), groups=self.groups + other.groups, **both)


def _may_join(segments: list[bytes]) -> np.ndarray:
    """Whether a segment is a single space, then text that neither begins nor ends with white space."""
    return np.array(
        [len(s) > 1 and not _BEGINS_SPACE[s[1]] and not _ENDS_SPACE[s[-1]] and s[0] == _SPACE for s in segments], dtype=bool
    )


def encode_segments(segments: list[bytes], table: ByteTable | PieceTable, may_join: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments in order, and the segment of each.

    Segments that may lie side by side are encoded in runs and told apart by where their
    tokens end; a run whose tokens don't end with its segments is encoded one by one.
    """
    size = np.array([len(s) for s in segments], dtype=np.int64)
    alone = np.flatnonzero(~may_join).tolist()
    joined = np.flatnonzero(may_join)
    ends = np.cumsum(size[joined])
    runs = np.split(joined, np.flatnonzero(np.diff(ends // RUN_BYTES)) + 1) if len(joined) else []
    texts = [b"".join([segments[i] for i in run.tolist()])[1:].decode(errors="replace") for run in runs]
    ids, of = [], []
    for run, found in zip(runs, table.encode(texts) if texts else []):
        found = np.array(found, dtype=np.int64)
        stops, wanted = np.cumsum(table.lengths[found]), np.cumsum(size[run])
        at = np.searchsorted(stops, wanted)
        if len(stops) and stops[-1] == wanted[-1] and (stops[at] == wanted).all():
            ids.append(found)
            of.append(np.repeat(run, np.diff(at, prepend=-1)))
        else:
            alone += run.tolist()
    if alone:
        found = table.encode([segments[i][1:].decode(errors="replace") for i in alone])
        ids.append(np.array([i for f in found for i in f], dtype=np.int64))
        of.append(np.repeat(alone, [len(f) for f in found]))
    ids, of = np.concatenate(ids), np.concatenate(of).astype(np.int64)
    order = np.argsort(of, kind="stable")
    return ids[order], of[order]


def _gives_back(segments: list[bytes], ids: np.ndarray, of: np.ndarray, table: ByteTable | PieceTable) -> np.ndarray:
    """Whether the tokens' bytes of each segment, joined, are the segment."""
    size = np.array([len(s) for s in segments], dtype=np.int64)
    same = np.bincount(of, weights=table.lengths[ids], minlength=len(segments)).astype(np.int64) == size
    wanted = np.frombuffer(b"".join(s for s, ok in zip(segments, same.tolist()) if ok), dtype=np.uint8)
    if len(wanted):
        taken = table.entries.take(pa.array(ids[same[of]]))
        joined = np.frombuffer(taken.buffers()[2], dtype=np.uint8)[: len(wanted)]
        differs = reduce_rows((joined != wanted).astype(np.int64), _offsets(size[same])) > 0
        same[np.flatnonzero(same)[differs]] = False
    return same


def align_segments(segments: list[bytes], tokenizers: Tokenizers) -> Aligned:
    """Groups and links of texts that begin with a space and stand for themselves."""
    count, tables = len(segments), (tokenizers.a, tokenizers.b)
    may_join = _may_join(segments) & tokenizers.b.may_cut
    ids, of = map(list, zip(*[encode_segments(segments, table, may_join) for table in tables]))
    valid = np.ones(count, dtype=bool)
    for side, table in enumerate(tables):
        valid &= _gives_back(segments, ids[side], of[side], table)
    start, end = [], []
    for side, table in enumerate(tables):
        keep = valid[of[side]]
        ids[side], of[side] = ids[side][keep], of[side][keep]
        lengths = table.lengths[ids[side]]
        end.append(np.cumsum(lengths))
        start.append(end[-1] - lengths)

    # Valid segments lie end to end, and both tokenizers cover them without a gap.
    sides = np.repeat([0, 1], [len(ids[0]), len(ids[1])])
    starts, ends = np.concatenate(start), np.concatenate(end)
    order = np.lexsort((sides, starts))
    reached = np.maximum.accumulate(ends[order]) if len(order) else ends
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = starts[order][1:] >= reached[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(fresh) - 1
    groups = int(fresh.sum())
    group_segment = np.concatenate(of)[order][fresh]

    # Overlaps within the groups: B tokens that end behind an A token's start and start before its end.
    first = np.searchsorted(end[1], start[0], side="right")
    linked = np.searchsorted(start[1], end[0], side="left") - first
    links = (np.repeat(ids[0], linked) << _B_BITS) | ids[1][_expand(first, linked)]
    n_links = np.bincount(of[0], weights=linked, minlength=count).astype(np.int64)

    parts = []
    for side in (0, 1):
        mine = group[sides == side]
        bounds = pa.array(np.searchsorted(mine, np.arange(groups + 1)).astype(np.int32))
        parts.append(pc.binary_join(pa.ListArray.from_arrays(bounds, pa.array(ids[side]).cast(pa.string())), ","))
    told = pc.binary_join_element_wise(*parts, "|")
    bounds = pa.array(np.searchsorted(group_segment, np.arange(count + 1)).astype(np.int32))
    told = pc.binary_join(pa.ListArray.from_arrays(bounds, told), ";")
    per_segment = [np.bincount(x, minlength=count) for x in (of[0], of[1], group_segment)]
    return Aligned(valid, *per_segment, _offsets(n_links), links, told.cast(pa.binary()).to_pylist())


def cut(chunk: Chunk, may_cut: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Segments of a chunk's texts, each text with a space before it, and the bounds of each text's segments.

    Empty texts have no segment.
    """
    filled = np.flatnonzero(np.diff(chunk.offsets) > 0)
    begins = chunk.offsets[filled]
    data = np.insert(chunk.data, begins, np.uint8(_SPACE))
    begins = begins + np.arange(len(filled))
    here = np.zeros(len(data) + 1, dtype=bool)
    if may_cut and len(data) > 2:
        here[1:-2] = (data[1:-1] == _SPACE) & ~_ENDS_SPACE[data[:-2]] & ~_BEGINS_SPACE[data[2:]]
    here[begins] = here[-1] = True
    cuts = np.flatnonzero(here)
    size = np.diff(chunk.offsets) + (np.diff(chunk.offsets) > 0)
    bounds = np.searchsorted(cuts[:-1], _offsets(size))
    segments = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]
    )
    return segments, bounds


class KnownSegments:
    """The segments a task has aligned, so that each distinct one is aligned once."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.place: dict[bytes, int] = {}
        self.aligned, self.seen, self.bytes = Aligned.none(), np.zeros(0, np.int64), 0

    def _forget(self) -> None:
        """Keep the half of the segments that was seen most often, if those are not long."""
        often = np.sort(np.argsort(-self.seen, kind="stable")[: KNOWN_SEGMENTS // 2])
        names = list(self.place)
        kept = [names[i] for i in often.tolist()]
        self.bytes = sum(map(len, kept))
        if self.bytes > KNOWN_BYTES // 2:
            often, kept, self.bytes = often[:0], [], 0
        self.place = {name: i for i, name in enumerate(kept)}
        self.aligned, self.seen = self.aligned.take(often), np.zeros(len(kept), np.int64)

    def places(self, segments: pa.Array) -> np.ndarray:
        """Place of each segment in ``aligned``, which holds at least these."""
        coded = segments.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [s for s in distinct if s not in self.place]
        if self.place and (len(self.place) + len(new) > KNOWN_SEGMENTS or self.bytes > KNOWN_BYTES):
            self._forget()
            new = [s for s in distinct if s not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.aligned = self.aligned.plus(align_segments(new, self.tokenizers))
            self.seen = np.append(self.seen, np.zeros(len(new), np.int64))
            self.bytes += sum(map(len, new))
        at = np.array([self.place[s] for s in distinct], dtype=np.int64)
        self.seen[at] += 1
        return at[coded.indices.to_numpy()]


_ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string,"
    " pairs array<long>, times array<int>"
)


def aligned_documents(docs: DataFrame, tokenizers: Tokenizers, with_groups: bool = False) -> DataFrame:
    """Tokens, groups and links of each document, and how often it links each pair of ids.

    A pair is ``a << 32 | b``. ``groups`` (the text that ``groups_sha256`` is of) is null
    unless asked for.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KnownSegments(shared.value)
        may_cut = shared.value.b.may_cut
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                segments, bounds = cut(chunk, may_cut)
                at = known.places(segments)
                found = known.aligned
                bad = reduce_rows((~found.valid[at]).astype(np.int64), bounds) > 0
                if bad.any():
                    kept = np.repeat(~bad, np.diff(bounds))
                    bounds = _offsets(np.where(bad, 0, np.diff(bounds)))
                    at = at[kept]
                sums = [reduce_rows(values[at], bounds) for values in (found.n_a, found.n_b, found.n_groups, found.n_links)]
                told = [
                    b";".join([found.groups[s] for s in at[bounds[i] : bounds[i + 1]].tolist()]) for i in range(chunk.rows)
                ]
                # Equal pairs of a document are one entry with a count.
                pairs, code = np.unique(found.links, return_inverse=True)
                linked = code[_expand(found.bounds[at], found.n_links[at])]
                row = np.repeat(np.arange(chunk.rows), sums[3])
                entry, times = np.unique(row * max(len(pairs), 1) + linked, return_counts=True)
                row, linked = entry // max(len(pairs), 1), entry % max(len(pairs), 1)
                lists = pa.array(np.searchsorted(row, np.arange(chunk.rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first_row, chunk.rows),
                        *[pa.array(s) for s in sums],
                        pa.array([sha256(t).hexdigest() if t else "" for t in told]),
                        pa.array([t.decode() for t in told] if with_groups else [None] * chunk.rows, pa.string()),
                        pa.ListArray.from_arrays(lists, pa.array(pairs[linked])),
                        pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32))),
                    ],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Links of each pair of ids over all documents: pair, count, best.

    ``best`` is whether no other A id is linked more often with the pair's B id. Tasks sum
    their own documents first.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs, entry = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return pairs, np.bincount(entry, weights=np.concatenate([h[1] for h in held])).astype(np.int64)

        def rows(pairs: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(pairs), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[part]), pa.array(times[part])], names=["pair", "times"])

        size = 0
        for batch in batches:
            pairs, times = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
            held.append((pairs, times))
            size += len(pairs)
            if size > PENDING_PAIRS:
                held[:] = [summed()]
                if len(held[0][0]) > PENDING_PAIRS // 2:
                    yield from rows(*held.pop())
                size = len(held[0][0]) if held else 0
        if held:
            yield from rows(*summed())

    found = aligned.select("pairs", "times").mapInArrow(gather, "pair long, times long")
    counts = stored(found.groupBy("pair").agg(F.sum("times").alias("count")), "alignment-pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1))
    # At most a row for each id of B's vocabulary.
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    ranked = counts.withColumn("b", b).join(F.broadcast(highest), "b")
    return ranked.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


_KEPT = ["row_no", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
_SCORED = (
    "row_no long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string,"
    " n_best long, count_sum long, rare array<struct<pair: long, times: int>>"
)


def with_counts(aligned: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Add n_best and count_sum to stored ``aligned`` rows from stored ``counts``."""
    hot = counts.orderBy(F.desc("count"), "pair").limit(hot_pairs).toArrow()
    keys = hot["pair"].to_numpy()
    shared = aligned.sparkSession.sparkContext.broadcast((keys, hot["count"].to_numpy(), hot["best"].to_numpy()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = shared.value
        index = Lookup(keys.view(np.uint64), count)
        count, best = np.append(count, 0), np.append(best, False)
        for batch in batches:
            pairs, times = batch["pairs"], batch["times"]
            bounds = pairs.offsets.to_numpy().astype(np.int64)
            bounds = bounds - bounds[0]
            pairs, times = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            at = index.find(pairs.view(np.uint64))
            rare = np.flatnonzero(at < 0)
            lists = pa.array(np.searchsorted(rare, bounds).astype(np.int32))
            entries = pa.StructArray.from_arrays([pa.array(pairs[rare]), pa.array(times[rare].astype(np.int32))], ["pair", "times"])
            columns = [
                *[batch[name] for name in _KEPT],
                pa.array(reduce_rows(times * best[at], bounds)),
                pa.array(reduce_rows(times * count[at], bounds)),
                pa.ListArray.from_arrays(lists, entries),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*_KEPT, "n_best", "count_sum", "rare"])

    rows = aligned.withColumn("row_no", F.monotonically_increasing_id())
    scored = rows.select(*_KEPT, "pairs", "times").mapInArrow(scan, _SCORED)
    if len(keys) < hot_pairs:
        return scored.drop("row_no", "rare")
    scored = stored(scored, "alignment-scored")
    asked = scored.select("row_no", F.explode("rare").alias("r")).select("row_no", "r.*")
    more = asked.join(counts, "pair").groupBy("row_no")
    more = more.agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("count")).alias("more_sum"),
    )
    zero = F.lit(0).cast("long")
    result = scored.join(more, "row_no", "left")
    result = result.withColumns(
        {
            "n_best": F.col("n_best") + F.coalesce("more_best", zero),
            "count_sum": F.col("count_sum") + F.coalesce("more_sum", zero),
        }
    )
    return result.drop("row_no", "rare", "more_best", "more_sum")


def align_tokenizers(
    docs: DataFrame,
    a_path: str = TOKENIZER_A,
    b_path: str = TOKENIZER_B,
    with_groups: bool = False,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups."""
    aligned = stored(aligned_documents(docs, Tokenizers.read(a_path, b_path), with_groups), "alignment-documents")
    counts = stored(pair_counts(aligned), "alignment-counts")
    return with_counts(aligned, counts, hot_pairs)
