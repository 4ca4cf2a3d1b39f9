"""Language-model scores by context-tree weighting over bytes.

The model reads a text as its words in lower case, joined by one space, then an end
byte. Each byte is decomposed into eight binary choices. For every context of 0 to
``DEPTH`` preceding bytes and every bit prefix there is a Krichevsky-Trofimov estimate
from the training counts, and a node's weighted probability is half its own estimate's
and half the product of its children's; the ratio of the two is the weight with which a
node answers itself instead of asking a deeper context. Scoring mixes along the path
from the longest known context to the empty one. A context that training never met has
no say.

All counts follow from those of the ``DEPTH + 1``-grams, which tasks sum before the
shuffle, over all training texts. Grams that occur only in held-out texts join the table
with count 0, so that each gram of the corpus is scored once. A task's counts travel as
packed blocks, one for each of ``TREE_GROUPS`` groups of three-byte contexts, in which the
trees are weighted; a group holds distinct grams, not occurrences. The levels above are
bounded by the alphabet and pass the driver: the nodes of the two-byte contexts that
occur with a symbol (about 10^5 in text), and those of at most 257 shorter contexts.

A text's score is the sum of its grams' code lengths. The most frequent grams and words,
as many as ``HOT_GRAMS`` and ``HOT_WORDS``, are broadcast; all others are joined by
shuffle, which is exact and small, since rare keys have few occurrences. Its code length
per byte is in bits, over the bytes as the model reads them, with the end byte.

Null, empty and word-free texts are the end byte alone and one end token. Repeated rows
each get a row. Without training rows every bit costs one bit, and each token has
probability 1 as in the formula. Rows without doc_id train. Very long texts are read
whole; equal scores need no order. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescast.llm.scratch import stored
from salescast.llm.textscan import Chunk, Lookup, chunks, lower, mix64, scan_words, span_hashes

DEPTH = 6
END = 0xFF
SPACE = 0x20
END_TOKEN = np.uint64(0x1D8AF066E5F3A2B7)
HOT_GRAMS = 1_400_000
HOT_WORDS = 500_000
HOLD = 2_000_000
TREE_GROUPS = 1024
GROUP_CONTEXT = 3
GRAM, WORD, NODE = 0, 1, 2
LOG_HALF = math.log(0.5)


def byte_stream(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk as the model reads it: bytes and their bounds, word hashes and their bounds.

    The bytes of a document end with ``END``, its words with ``END_TOKEN``.
    """
    chunk = lower(chunk)
    words = scan_words(chunk)
    rows = np.repeat(np.arange(chunk.rows), words.per_row)
    # A byte of a word stays, and so does what comes behind the word: a separator or the document's end.
    data = np.insert(chunk.data, chunk.offsets[1:], np.uint8(SPACE))
    begin, end = words.start + rows, words.end + rows
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[begin] += 1
    np.subtract.at(step, end, np.int8(1))
    inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    data[~inside] = SPACE
    kept = inside.copy()
    kept[end] = True
    last = chunk.offsets[1:] + np.arange(chunk.rows)
    empty = words.per_row == 0
    kept[last[empty]] = True
    out = data[kept]
    lengths = words.end - words.start
    word_bytes = np.bincount(rows, weights=lengths + 1, minlength=chunk.rows).astype(np.int64)
    bounds = np.zeros(chunk.rows + 1, dtype=np.int64)
    np.cumsum(np.maximum(word_bytes, 1), out=bounds[1:])
    out[bounds[1:] - 1] = END

    hashes = span_hashes(chunk.data, words.start, words.end)
    tokens = np.full(len(hashes) + chunk.rows, END_TOKEN, dtype=np.uint64)
    tokens[np.arange(len(hashes)) + rows] = hashes
    token_bounds = words.bounds + np.arange(chunk.rows + 1)
    return out, bounds, tokens, token_bounds


def gram_keys(stream: np.ndarray, bounds: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each byte its context, latest byte highest, and the byte itself lowest.

    Before a document there are only end bytes.
    """
    padded = np.concatenate([np.full(8, END, dtype=np.uint8), stream, np.zeros(8, dtype=np.uint8)])
    # The eight bytes before each byte as one number, the latest highest.
    before = np.ndarray(len(stream), dtype="<u8", buffer=padded, strides=(1,)).astype(np.uint64)
    low = np.uint64(64 - 8 * depth)
    key = ((before >> low) << np.uint64(8)) | stream
    for within in range(depth):
        at = bounds[:-1] + within
        at = at[at < bounds[1:]]
        key[at] |= np.uint64(((1 << 8 * (depth - within)) - 1) << 8)
    return key


class _Counts:
    """Counts of keys seen so far by a task; yields blocks of them when they outgrow ``HOLD``.

    Keys that are equal without their lowest ``shift`` bits are in one group.
    """

    def __init__(self, kind: int, shift: int = 0):
        self.kind, self.shift = kind, np.uint64(shift)
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, weight: int) -> Iterator[pa.RecordBatch]:
        found, times = np.unique(keys, return_counts=True)
        self.keys.append(found)
        self.counts.append(times * weight)
        self.size += len(found)
        if self.size > HOLD:
            self._merge()
            if self.size > HOLD // 2:
                yield from self.flush()

    def _merge(self) -> None:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.keys, self.counts = [keys[starts]], [np.add.reduceat(counts, starts)]
        self.size = len(starts)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        self._merge()
        keys, counts = self.keys[0], self.counts[0]
        self.keys, self.counts, self.size = [], [], 0
        group = (mix64(keys >> self.shift) % np.uint64(TREE_GROUPS)).astype(np.uint16)
        order = np.argsort(group, kind="stable")
        keys, counts = keys[order], counts[order]
        found, starts = np.unique(group[order], return_index=True)
        parts = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(keys)])]
        columns = [
            pa.array(np.full(len(found), self.kind, dtype=np.int32)),
            pa.array(found.astype(np.int32)),
            pa.array([packed(np.diff(keys[part], prepend=np.uint64(0))) for part in parts], pa.binary()),
            pa.array([packed(counts[part].astype(np.uint64)) for part in parts], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "group", "keys", "times"])


def packed(values: np.ndarray) -> bytes:
    """64-bit values as bytes: all lowest bytes first, so that the zeros of small values lie together."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(block: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(block, dtype=np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


def merged_blocks(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a group's blocks, and the sum of their counts."""
    keys = np.concatenate([np.cumsum(unpacked(block), dtype=np.uint64) for block in rows["keys"].to_pylist()])
    times = np.concatenate([unpacked(block) for block in rows["times"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(times[order], starts).astype(np.int64)


def with_fold(docs: DataFrame) -> DataFrame:
    """doc_id, text and held_out."""
    doc_id = F.col("doc_id").cast("long")
    fold = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7))
    return docs.select(doc_id.alias("doc_id"), "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out"))


def _group_shift(depth: int) -> int:
    return 8 * (depth + 1 - min(GROUP_CONTEXT, depth))


def corpus_counts(folds: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Blocks of training counts of grams and words: kind, group, keys, times. Grams of held-out texts alone have 0."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = _Counts(GRAM, _group_shift(depth)), _Counts(WORD)
        for batch in batches:
            held_out = batch.column(1).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(0)):
                stream, bounds, tokens, token_bounds = byte_stream(chunk)
                keys = gram_keys(stream, bounds, depth)
                held = held_out[chunk.first_row : chunk.first_row + chunk.rows]
                of_held = np.repeat(held, np.diff(bounds))
                yield from grams.add(keys[~of_held], 1)
                yield from grams.add(keys[of_held], 0)
                yield from words.add(tokens[~np.repeat(held, np.diff(token_bounds))], 1)
        yield from grams.flush()
        yield from words.flush()

    return folds.select("text", "held_out").mapInArrow(gather, "kind int, group int, keys binary, times binary")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive values: Stirling's series after eight steps up."""
    x = np.asarray(x, dtype=np.float64)
    product = np.ones_like(x)
    for step in range(8):
        product *= x + step
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    small = zeros + ones
    value = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(small + 1) - math.log(math.pi)
    return np.where(small == 0, 0.0, value)


def weigh(own: np.ndarray, deeper: np.ndarray) -> np.ndarray:
    """Weighted probability (as a logarithm) of nodes with children."""
    return np.logaddexp(own, deeper) + LOG_HALF


def _bit_level(symbols: np.ndarray, counts: np.ndarray, bit: int):
    """Nodes of one bit level: node of each entry, zeros and ones of each node, and the node identifiers.

    ``symbols`` are sorted context-and-byte keys.
    """
    ids = symbols >> np.uint64(8 - bit)
    fresh = np.concatenate([[True], ids[1:] != ids[:-1]])
    starts = np.flatnonzero(fresh)
    is_one = (symbols >> np.uint64(7 - bit)) & np.uint64(1) == 1
    total = np.add.reduceat(counts, starts)
    ones = np.add.reduceat(np.where(is_one, counts, 0), starts)
    return np.cumsum(fresh) - 1, total - ones, ones, ids[starts], is_one


def weigh_group(
    keys: np.ndarray, times: np.ndarray, depth: int = DEPTH
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight the subtrees of some three-byte contexts, given all grams that have them (distinct and sorted).

    Returns, for each gram, the probability of each of its eight bits as mixed from the
    contexts of three bytes and more (NaN where none is known); and for each bit prefix of
    the three-byte contexts a key (the two latest bytes, then the prefix as a heap number)
    and its weighted probability (as a logarithm). A model of less depth than three begins
    at its own.
    """
    mixed = np.full((8, len(keys)), np.nan)
    below: list[tuple[np.ndarray, np.ndarray]] = []
    least = min(GROUP_CONTEXT, depth)
    for length in range(depth, least - 1, -1):
        symbols = ((keys >> np.uint64(8 * (depth - length + 1))) << np.uint64(8)) | (keys & np.uint64(0xFF))
        symbols, entry = np.unique(symbols, return_inverse=True)
        counts = np.bincount(entry, weights=times).astype(np.int64)
        above = []
        for bit in range(8):
            node, zeros, ones, ids, is_one = _bit_level(symbols, counts, bit)
            own = log_estimate(zeros, ones)
            weighted, stay = own, np.ones(len(own))
            if length < depth:
                child_ids, child_weighted = below[bit]
                parent = ((child_ids >> np.uint64(bit + 8)) << np.uint64(bit)) | (child_ids & np.uint64((1 << bit) - 1))
                deeper = np.bincount(np.searchsorted(ids, parent), weights=child_weighted, minlength=len(ids))
                weighted = weigh(own, deeper)
                stay = np.exp(own + LOG_HALF - weighted)
            above.append((ids, weighted))
            seen = np.where(is_one, ones[node], zeros[node])
            total = (zeros + ones)[node]
            estimate = ((seen + 0.5) / (total + 1))[entry]
            known, weight = (total > 0)[entry], stay[node][entry]
            old = mixed[bit]
            fresh = np.where(np.isnan(old), estimate, weight * estimate + (1 - weight) * old)
            mixed[bit] = np.where(known, fresh, old)
        below = above
    node_keys, node_weights = [], []
    for bit, (ids, weighted) in enumerate(below):
        above = (ids >> np.uint64(bit + 8)).astype(np.int64)
        heap = (1 << bit) + (ids & np.uint64((1 << bit) - 1)).astype(np.int64)
        node_keys.append((above << 8) | heap)
        node_weights.append(weighted)
    return mixed, np.concatenate(node_keys), np.concatenate(node_weights)


_BITS = [f"bit_{i}" for i in range(8)]
_WEIGHTED = "kind int, key long, times long, " + ", ".join(f"{name} double" for name in _BITS)


def _weigh_table(rows: pa.Table, depth: int) -> pa.Table:
    """Words with their counts; or grams with counts and bit probabilities, and the nodes above them."""
    kind = rows["kind"][0].as_py()
    keys, times = merged_blocks(rows)
    kinds = np.full(len(keys), kind, dtype=np.int32)
    bits = np.zeros((8, len(keys)))
    if kind == GRAM:
        bits, node_keys, node_weights = weigh_group(keys, times, depth)
        node_keys, entry = np.unique(node_keys, return_inverse=True)
        node_weights = np.bincount(entry, weights=node_weights)
        above = np.zeros((8, len(node_keys)))
        above[0] = node_weights
        kinds = np.concatenate([kinds, np.full(len(node_keys), NODE, dtype=np.int32)])
        keys, times = np.concatenate([keys, node_keys.view(np.uint64)]), np.concatenate([times, np.zeros(len(node_keys), np.int64)])
        bits = np.concatenate([bits, above], axis=1)
    return pa.table([pa.array(c) for c in (kinds, keys.view(np.int64), times, *bits)], names=["kind", "key", "times", *_BITS])


class SecondLevel:
    """Estimates and weights of the two-byte contexts that occur, by context and symbol.

    ``symbols`` are sorted context-and-byte keys with their counts; ``nodes`` sorted keys
    (context, then bit prefix as a heap number) with the weights of the contexts below.
    """

    def __init__(self, symbols: np.ndarray, counts: np.ndarray, nodes: np.ndarray, weights: np.ndarray):
        self.symbols = symbols
        self.estimate, self.stay = np.full((8, len(symbols)), np.nan), np.zeros((8, len(symbols)))
        self.above = np.zeros((256, 256))
        for bit in range(8) if len(symbols) else ():
            node, zeros, ones, ids, is_one = _bit_level(symbols, counts, bit)
            own = log_estimate(zeros, ones)
            context, prefix = ids >> np.uint64(bit), ids & np.uint64((1 << bit) - 1)
            heap = (prefix + np.uint64(1 << bit)).astype(np.int64)
            deeper = weights[np.searchsorted(nodes, (context << np.uint64(8)).astype(np.int64) | heap)]
            weighted = weigh(own, deeper)
            np.add.at(self.above, ((context >> np.uint64(8)).astype(np.int64), heap), weighted)
            total, seen = (zeros + ones)[node], np.where(is_one, ones[node], zeros[node])
            self.estimate[bit] = np.where(total > 0, (seen + 0.5) / (total + 1), np.nan)
            self.stay[bit] = np.exp(own + LOG_HALF - weighted)[node]

    def mix(self, keys: np.ndarray, bits: np.ndarray, depth: int) -> np.ndarray:
        """``bits`` (gram by bit) of longer contexts, mixed with those of two bytes."""
        symbol = ((keys >> np.uint64(8 * (depth - 1))) << np.uint64(8)) | (keys & np.uint64(0xFF))
        at = np.searchsorted(self.symbols, symbol)
        estimate, stay = self.estimate[:, at].T, self.stay[:, at].T
        fresh = np.where(np.isnan(bits), estimate, stay * estimate + (1 - stay) * bits)
        return np.where(np.isnan(estimate), bits, fresh)


class TopLevels:
    """Estimates and weights of the contexts of one byte and of none. Arrays over (latest byte, heap node)."""

    def __init__(self, symbol_counts: np.ndarray, deeper: np.ndarray):
        zeros, ones = self._nodes(symbol_counts)
        own = log_estimate(zeros, ones)
        weighted = weigh(own, deeper)
        self.one_total, self.one_ones = zeros + ones, ones
        self.one_stay = np.exp(own + LOG_HALF - weighted)
        zeros, ones = zeros.sum(axis=0), ones.sum(axis=0)
        own = log_estimate(zeros, ones)
        self.none_total, self.none_ones = zeros + ones, ones
        self.none_stay = np.exp(own + LOG_HALF - weigh(own, weighted.sum(axis=0)))

    @staticmethod
    def _nodes(symbol_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        zeros, ones = np.zeros((256, 256)), np.zeros((256, 256))
        for bit in range(8):
            halves = symbol_counts.reshape(256, 1 << bit, 2, -1).sum(axis=3)
            zeros[:, 1 << bit : 2 << bit], ones[:, 1 << bit : 2 << bit] = halves[:, :, 0], halves[:, :, 1]
        return zeros, ones

    def log10_probability(self, keys: np.ndarray, bits: np.ndarray, depth: int) -> np.ndarray:
        latest = (keys >> np.uint64(8 * depth)).astype(np.int64) & 0xFF
        symbol = (keys & np.uint64(0xFF)).astype(np.int64)
        total = np.zeros(len(keys))
        for bit in range(8):
            node = (1 << bit) + (symbol >> (8 - bit))
            is_one = (symbol >> (7 - bit)) & 1 == 1
            value = bits[:, bit]
            for count, ones, stay in (
                (self.one_total[latest, node], self.one_ones[latest, node], self.one_stay[latest, node]),
                (self.none_total[node], self.none_ones[node], self.none_stay[node]),
            ):
                estimate = (np.where(is_one, ones, count - ones) + 0.5) / (count + 1)
                fresh = np.where(np.isnan(value), estimate, stay * estimate + (1 - stay) * value)
                value = np.where(count > 0, fresh, value)
            total += np.log10(np.where(np.isnan(value), 0.5, value))
        return total


def top_levels(weighted: DataFrame, depth: int) -> tuple[SecondLevel | None, TopLevels]:
    """The levels above the groups, from the symbols and nodes of the contexts right above them.

    At most a row for each context of at most two bytes and symbol: bounded by the alphabet.
    """
    above = min(GROUP_CONTEXT, depth) - 1
    context = F.shiftrightunsigned("key", 8 * (depth - above + 1))
    symbol = F.shiftleft(context, 8).bitwiseOR(F.col("key").bitwiseAND(255))
    symbols = weighted.where(F.col("kind") == GRAM).groupBy(symbol.alias("symbol")).agg(F.sum("times").alias("times"))
    symbols = symbols.toPandas().sort_values("symbol")
    nodes = weighted.where(F.col("kind") == NODE).groupBy("key").agg(F.sum("bit_0").alias("weighted"))
    nodes = nodes.toPandas().sort_values("key")
    symbol, times = symbols["symbol"].to_numpy(np.int64), symbols["times"].to_numpy(np.int64)
    deeper, by_symbol, second = np.zeros((256, 256)), np.zeros((256, 256)), None
    if above == 2:
        second = SecondLevel(symbol.view(np.uint64), times, nodes["key"].to_numpy(np.int64), nodes["weighted"].to_numpy(float))
        deeper = second.above
        symbol = ((symbol >> 16) << 8) | (symbol & 255)
    else:
        key = nodes["key"].to_numpy(np.int64)
        deeper[key >> 8, key & 255] = nodes["weighted"]
    np.add.at(by_symbol, (symbol >> 8, symbol & 255), times)
    return second, TopLevels(by_symbol, deeper)


def gram_scores(weighted: DataFrame, depth: int = DEPTH) -> DataFrame:
    """log10 probability of each gram's last byte after its context: key, times, value."""
    top = weighted.sparkSession.sparkContext.broadcast(top_levels(weighted, depth))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second, top_ = top.value
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            bits = np.stack([batch.column(2 + bit).to_numpy(zero_copy_only=False) for bit in range(8)], axis=1)
            if second is not None:
                bits = second.mix(keys, bits, depth)
            value = top_.log10_probability(keys, bits, depth)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], names=["key", "times", "value"])

    grams = weighted.where(F.col("kind") == GRAM).select("key", "times", *_BITS)
    return grams.mapInArrow(score, "key long, times long, value double")


def hottest(table: DataFrame, limit: int) -> Lookup:
    """Values of the most frequent keys, about ``limit`` and never much more.

    All keys seen as often as the least bound that keeps them within the limit, and of
    those up to the next lower bound a share by hash.
    """
    bounds = [*range(64), *sorted({int(64 * 1.2**k) for k in range(200)})]
    sizes = table.agg(*[F.count(F.when(F.col("times") >= b, True)).alias(str(b)) for b in bounds]).first()
    fits = [b for b in bounds if sizes[str(b)] <= limit]
    least = fits[0] if fits else bounds[-1] + 1
    is_hot = F.col("times") >= least
    if least > 0:
        below = max(b for b in bounds if b < least)
        held = sizes[str(least)] if fits else 0
        share = (limit - held) / max(sizes[str(below)] - held, 1)
        is_hot |= (F.col("times") >= below) & (F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 990_000))
    rows = table.where(is_hot).select("key", "value").toArrow()
    return Lookup(rows["key"].to_numpy().view(np.uint64), rows["value"].to_numpy())


_SCAN_SCHEMA = (
    "row_id long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base_score double, score double, "
    "cold_words array<long>, cold_grams array<long>"
)


def _scan_scores(folds: DataFrame, words: Lookup, grams: Lookup, depth: int) -> DataFrame:
    """Sums over the hot keys of each document, and its other keys."""
    shared = folds.sparkSession.sparkContext.broadcast((words, grams))

    def cold(found: np.ndarray, keys: np.ndarray, rows: np.ndarray, count: int) -> pa.Array:
        missing = found < 0
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows[missing], minlength=count))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[missing].view(np.int64)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word, by_gram = shared.value
        for batch in batches:
            for chunk in chunks(batch.column(3)):
                stream, bounds, tokens, token_bounds = byte_stream(chunk)
                keys = gram_keys(stream, bounds, depth)
                token_rows = np.repeat(np.arange(chunk.rows), np.diff(token_bounds))
                gram_rows = np.repeat(np.arange(chunk.rows), np.diff(bounds))
                at_word, at_gram = by_word.find(tokens), by_gram.find(keys)
                hot = at_word >= 0
                base = np.bincount(token_rows[hot], weights=by_word.values[at_word[hot]], minlength=chunk.rows)
                known = np.bincount(token_rows[hot], minlength=chunk.rows)
                hot = at_gram >= 0
                score = np.bincount(gram_rows[hot], weights=by_gram.values[at_gram[hot]], minlength=chunk.rows)
                mine = batch.slice(chunk.first_row, chunk.rows)
                columns = [mine.column(0), mine.column(1), mine.column(2), pa.array(np.diff(token_bounds)), pa.array(np.diff(bounds)),
                           pa.array(known.astype(np.int64)), pa.array(base.astype(np.float64)), pa.array(score.astype(np.float64)),
                           cold(at_word, tokens, token_rows, chunk.rows), cold(at_gram, keys, gram_rows, chunk.rows)]
                yield pa.RecordBatch.from_arrays(columns, names=[part.split()[0] for part in _SCAN_SCHEMA.split(", ")])

    rows = folds.withColumn("row_id", F.monotonically_increasing_id())
    return rows.select("row_id", "doc_id", "held_out", "text").mapInArrow(scan, _SCAN_SCHEMA)


def score_documents(
    docs: DataFrame, depth: int = DEPTH, hot_grams: int = HOT_GRAMS, hot_words: int = HOT_WORDS
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    folds = with_fold(docs)
    blocks = corpus_counts(folds, depth).groupBy("kind", "group")
    weighted = stored(blocks.applyInArrow(lambda rows: _weigh_table(rows, depth), _WEIGHTED), "tree-weighted")
    grams = stored(gram_scores(weighted, depth), "tree-grams")
    words = weighted.where(F.col("kind") == WORD).select("key", "times")
    train_tokens, distinct = words.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count("*")).first()
    floor = float(train_tokens + distinct + 1)
    words = words.withColumn("value", F.log10((F.col("times") + 1) / F.lit(floor)))
    scanned = _scan_scores(folds, hottest(words, hot_words), hottest(grams, hot_grams), depth)
    scanned = stored(scanned, "tree-scan")

    cold_words = scanned.select("row_id", F.explode("cold_words").alias("key"))
    cold_words = cold_words.join(words, "key", "left").select(
        "row_id",
        F.col("times").isNotNull().cast("long").alias("n_known"),
        F.coalesce("value", F.lit(math.log10(1 / floor))).alias("base_score"),
        F.lit(0.0).alias("score"),
    )
    cold_grams = scanned.select("row_id", F.explode("cold_grams").alias("key"))
    cold_grams = cold_grams.join(grams, "key").select(
        "row_id", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base_score"), F.col("value").alias("score")
    )
    sums = ["n_known", "base_score", "score"]
    parts = cold_words.union(cold_grams).groupBy("row_id").agg(*[F.sum(c).alias(f"cold_{c}") for c in sums])
    rows = scanned.drop("cold_words", "cold_grams").join(parts, "row_id", "left")
    both = {c: F.col(c) + F.coalesce(F.col(f"cold_{c}"), F.lit(0)) for c in sums}
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        both["n_known"].alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        both["base_score"].alias("base_score"),
        both["score"].alias("score"),
        "n_bytes",
        (-both["score"] * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
