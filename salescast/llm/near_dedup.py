"""Near-duplicate groups by MinHash bands, odd sketches and exact confirmation.

1. One scan makes each document's set of distinct 5-word shingles, a 128-bit
   fingerprint of the set, ``BANDS * ROWS`` MinHash samples as band keys, and an odd
   sketch: the samples folded into a bitmap of parities.
2. Documents with equal sets become one class, summed map-side, so a group of copies
   of any size is one row from here on.
3. In each band bucket every class is paired with the smallest one there, which is
   linear in the bucket. The XOR population count of two odd sketches drops pairs far
   below the similarity; the rest are confirmed on their full sets.
4. What leaders could not decide is compared within its bucket, in blocks of bounded
   size, by odd sketches, and only between classes that are not yet connected. For
   these classes a finer odd sketch is made, of ten times the samples, which tells
   0.75 from 0.69. First the most similar pairs that would connect a block are
   confirmed, which is linear in the block; then all pairs that are still open.

A pair at similarity 0.75 meets in at least one of the 40 buckets with probability
1 - 2e-5, and more surely above; the bounds on the sketches lie five and four standard
deviations below 0.75. Every link is exact.

Nulls, empty texts and texts without words have no shingle and link with nothing. Very
long texts have all their shingles, in memory that follows the longest one.
Rows that share a doc_id and have different texts are different documents, each with its
own group and links: such a row is known by a 64-bit hash of its doc_id and text, and only
the result goes by doc_id. Rows equal in both are one. Rows without doc_id are kept, in no
group. Ties go to the smallest doc_id. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescast.llm.components import connected_components
from salescast.llm.scratch import stored
from salescast.llm.textscan import chunks, lower, mix64, scan_words, shingle_hashes, span_hashes

BANDS = 40
ROWS = 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
SKETCH_WORDS = SKETCH_BITS // 64
SIMILARITY = (75, 100)
SIGMAS = 5.0
FINE_SAMPLES = 2048
FINE_BITS = 4096
FINE_SIGMAS = 4.0
BLOCK_ROWS = 2048
# A semi-join's list of identifiers is broadcast up to this many (8 bytes each).
BROADCAST_IDS = 1_000_000
PIECE = 1024


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors of ``count`` hash functions on 32-bit values."""
    seeds = mix64(np.arange(1, count + 1, dtype=np.uint64))
    masks = (seeds >> np.uint64(32)).astype(np.uint32)[:, None]
    return masks, ((seeds & np.uint64(0xFFFFFFFF)) | np.uint64(1)).astype(np.uint32)[:, None]


_COARSE, _FINE = _functions(SAMPLES), _functions(FINE_SAMPLES)
_BAND_PLACES = mix64(np.arange(1001, 1001 + SAMPLES, dtype=np.uint64)) | np.uint64(1)
SKETCH = [f"sketch_{i}" for i in range(SKETCH_WORDS)]


def sketch_bound(
    samples: int = SAMPLES,
    bits: int = SKETCH_BITS,
    sigmas: float = SIGMAS,
    similarity: float = SIMILARITY[0] / SIMILARITY[1],
) -> int:
    """Most differing bits that a pair at ``similarity`` shows, ``sigmas`` deviations included.

    Each differing sample flips two bits. The deviations come from the sample of
    differing positions and from bits that meet.
    """
    differing = samples * (1 - similarity)
    left = math.exp(-4 * differing / bits)
    expected = bits / 2 * (1 - left)
    from_samples = 2 * left * math.sqrt(samples * similarity * (1 - similarity))
    from_bits = math.sqrt(bits / 4 * (1 - left * left))
    return math.ceil(expected + sigmas * math.hypot(from_samples, from_bits))


def minhash(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray] = _COARSE) -> np.ndarray:
    """The MinHash values of a non-empty set of 64-bit shingle hashes."""
    masks, factors = functions
    low = shingles.astype(np.uint32)
    least = np.full(len(masks), 0xFFFFFFFF, dtype=np.uint32)
    piece = max(1, PIECE * SAMPLES // len(masks))
    for at in range(0, len(low), piece):
        values = low[None, at : at + piece] ^ masks
        values *= factors
        np.minimum(least, values.min(axis=1), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key per document and band."""
    spread = mix64(samples.astype(np.uint64) + _BAND_PLACES) * _BAND_PLACES
    return mix64(spread.reshape(len(samples), BANDS, ROWS).sum(axis=2, dtype=np.uint64))


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps of the samples: ``bits // 64`` words per document."""
    rows, count = samples.shape
    place = mix64(samples.astype(np.uint64) * np.uint64(count) + np.arange(count, dtype=np.uint64))
    place = (place % np.uint64(bits)).astype(np.int64) + bits * np.arange(rows)[:, None]
    parity = (np.bincount(place.ravel(), minlength=rows * bits) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(rows, bits), axis=1).view(np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for chunk in chunks(texts):
        chunk = lower(chunk)
        words = scan_words(chunk)
        values, bounds = shingle_hashes(span_hashes(chunk.data, words.start, words.end), words.bounds)
        for row in range(chunk.rows):
            yield np.unique(values[bounds[row] : bounds[row + 1]])


SIGNATURE_SCHEMA = (
    "doc_id long, real_id long, n_shingles long, set_a long, set_b long, bands array<long>, "
    + ", ".join(f"{name} long" for name in SKETCH)
)
_SIGNATURE_ARROW = pa.schema(
    [(name, pa.int64()) for name in ("doc_id", "real_id", "n_shingles", "set_a", "set_b")]
    + [("bands", pa.list_(pa.int64()))]
    + [(name, pa.int64()) for name in SKETCH]
)
WRITE_ROWS = 2000


def _signature_batch(ids: list[pa.Array], sets: list[np.ndarray]) -> pa.RecordBatch:
    rows = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    samples = np.zeros((rows, SAMPLES), dtype=np.uint32)
    set_a = np.zeros(rows, dtype=np.uint64)
    set_b = np.zeros(rows, dtype=np.uint64)
    for row, shingles in enumerate(sets):
        if len(shingles):
            samples[row] = minhash(shingles)
            set_a[row] = mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
            set_b[row] = mix64(shingles ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    keys = band_keys(samples).view(np.int64)
    offsets = np.arange(rows + 1, dtype=np.int32) * BANDS
    bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
    sketches = odd_sketches(samples).view(np.int64)
    columns = [*ids, pa.array(sizes), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)), bands]
    columns += [pa.array(np.ascontiguousarray(sketches[:, i])) for i in range(SKETCH_WORDS)]
    return pa.RecordBatch.from_arrays(columns, schema=_SIGNATURE_ARROW)


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, set fingerprint, band keys and odd sketch of every document (doc_id, real_id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, sets = 0, []

            def signed() -> pa.RecordBatch:
                return _signature_batch([batch.column(c).slice(first, len(sets)) for c in (0, 1)], sets)  # noqa: B023

            for shingles in shingle_sets(batch.column(2)):
                sets.append(shingles)
                if len(sets) == WRITE_ROWS:
                    yield signed()
                    first, sets = first + len(sets), []
            if sets:
                yield signed()

    return docs.select("doc_id", "real_id", "text").mapInArrow(scan, SIGNATURE_SCHEMA)


def similar_size(left: str, right: str):
    """Sets whose sizes alone allow the similarity."""
    most, part = SIMILARITY[1], SIMILARITY[0]
    return F.least(left, right) * most >= F.greatest(left, right) * part


def near_sketches(left: str, right: str, bound: int | None = None):
    """The XOR of two odd sketches has few bits."""
    bits = [F.bit_count(F.col(f"{left}.{name}").bitwiseXOR(F.col(f"{right}.{name}"))) for name in SKETCH]
    return sum(bits[1:], bits[0]) <= (sketch_bound() if bound is None else bound)


def sketched_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that sizes and odd sketches allow."""
    left, right = nodes.alias("l"), nodes.alias("r")
    joined = pairs.join(left, F.col("a") == F.col("l.class_id")).join(right, F.col("b") == F.col("r.class_id"))
    return joined.where(similar_size("l.n_shingles", "r.n_shingles") & near_sketches("l", "r")).select("a", "b")


def class_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """class_id and text of the documents in ``ids`` (class_id)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("class_id"), "text")
    texts = texts.join(_listed(ids), "class_id", "left_semi")
    return texts.where(F.col("text").isNotNull()).dropDuplicates(["class_id"])


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
    texts = stored(class_texts(docs, ids), "near-texts")
    first = texts.select(F.col("class_id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("class_id").alias("b"), F.col("text").alias("text_b"))
    part, most = SIMILARITY

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(shingle_sets(batch.column("text_a")), shingle_sets(batch.column("text_b")))
            keep = []
            for left, right in both:
                shared = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(most * shared >= part * (len(left) + len(right) - shared) and shared > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(
        compare, "a long, b long"
    )


def fine_sketches(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """class_id and fine odd sketch (bytes) of the classes in ``ids``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, shingles in enumerate(shingle_sets(batch.column(1))):
                sketch = odd_sketches(minhash(shingles, _FINE)[None, :], FINE_BITS).tobytes()
                columns = [batch.column(0).slice(row, 1), pa.array([sketch], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["class_id", "fine"])

    return class_texts(docs, ids).mapInArrow(scan, "class_id long, fine binary")


class _Block:
    """The rows of some cells as arrays, and the pairs of a cell that may be links."""

    def __init__(self, rows: pa.StructArray):
        get = {f.name: rows.field(f.name) for f in rows.type}
        self.ids, self.component, self.sizes, self.block = (
            get[name].to_numpy() for name in ("class_id", "component", "n_shingles", "block")
        )
        self.coarse = np.stack([get[name].to_numpy() for name in SKETCH], axis=1)
        self.bands = get["bands"].flatten().to_numpy().reshape(-1, BANDS)
        fine = b"".join(get["fine"].to_pylist())
        self.fine = np.frombuffer(fine, dtype=np.uint64).reshape(len(rows), -1)
        self.bounds = sketch_bound(), sketch_bound(FINE_SAMPLES, FINE_BITS, FINE_SIGMAS)

    def pairs(self, low: int, high: int, first: int, second: int, band: int) -> tuple[np.ndarray, ...]:
        """Row numbers of both ends, and differing bits, of pairs between two blocks in a cell's rows.

        A pair that meets in an earlier band is left to that band.
        """
        part, most = SIMILARITY
        found: list[tuple[np.ndarray, ...]] = []
        span = np.arange(low, high)
        others = span[self.block[span] == second]
        for x in span[self.block[span] == first].tolist():
            at = others[others > x] if first == second else others
            at = at[self.component[at] != self.component[x]]
            size = self.sizes[at]
            at = at[np.minimum(size, self.sizes[x]) * most >= np.maximum(size, self.sizes[x]) * part]
            at = at[np.bitwise_count(self.coarse[at] ^ self.coarse[x]).sum(axis=1) <= self.bounds[0]]
            at = at[~(self.bands[at, :band] == self.bands[x, :band]).any(axis=1)]
            if len(at):
                differ = np.bitwise_count(self.fine[at] ^ self.fine[x]).sum(axis=1, dtype=np.int64)
                keep = differ <= self.bounds[1]
                found.append((np.full(keep.sum(), x), at[keep], differ[keep]))
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        return tuple(np.concatenate(column) for column in zip(*found))

    def forest(self, left: np.ndarray, right: np.ndarray, differ: np.ndarray) -> np.ndarray:
        """Numbers of the most similar pairs that connect as many components as all pairs do."""
        root: dict[int, int] = {}

        def find(node: int) -> int:
            while root.setdefault(node, node) != node:
                root[node] = root[root[node]]
                node = root[node]
            return node

        kept = []
        for i in np.argsort(differ, kind="stable").tolist():
            a, b = find(int(self.component[left[i]])), find(int(self.component[right[i]]))
            if a != b:
                root[a] = b
                kept.append(i)
        return np.array(kept, dtype=np.int64)


def _bucket_pairs(members: DataFrame, spanning: bool) -> DataFrame:
    """Pairs of one bucket in different components that sizes and sketches allow: all, or a spanning forest.

    A bucket is cut into blocks of about ``BLOCK_ROWS``; each pair of blocks is one
    row here, so neither a task nor a row holds a whole bucket.
    """
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    row = F.struct("class_id", "component", "n_shingles", "block", "bands", "fine", *SKETCH)
    cells = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.struct(
            F.least("block", other).alias("first"), F.greatest("block", other).alias("second")
        ),
    )
    placed = members.withColumn("block", F.pmod(F.xxhash64("class_id"), blocks).cast("int"))
    grouped = (
        placed.select("key", "band", F.explode(cells).alias("cell"), row.alias("row"))
        .groupBy("key", "band", "cell")
        .agg(F.collect_list("row").alias("rows"))
        .select("cell.first", "cell.second", "band", "rows")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            block = _Block(lists.flatten())
            ends = np.cumsum(np.concatenate([[0], lists.value_lengths().to_numpy()]))
            for i in range(batch.num_rows):
                first, second, band = (batch.column(c)[i].as_py() for c in range(3))
                left, right, differ = block.pairs(ends[i], ends[i + 1], first, second, band)
                if spanning:
                    kept = block.forest(left, right, differ)
                    left, right = left[kept], right[kept]
                a, b = block.ids[left], block.ids[right]
                columns = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return grouped.mapInArrow(compare, "a long, b long").distinct()


def class_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Component of every class that has a link: class_id, component (its smallest class).

    ``nodes`` has one row per class: class_id, n_shingles, bands and sketch.
    """
    sketches = nodes.select("class_id", "n_shingles", *SKETCH)
    members = nodes.select("class_id", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("key", "band").agg(F.min("class_id").alias("leader"), F.count("*").alias("size"))
    buckets = stored(buckets.where("size > 1"), "near-buckets")
    shared = stored(members.join(buckets, ["key", "band"]), "near-members")
    stars = shared.where("class_id > leader").select(F.col("leader").alias("a"), F.col("class_id").alias("b"))
    stars = stored(sketched_pairs(stars.distinct(), sketches), "near-stars")

    # One leader per class first: it settles most classes of a group at the price of one comparison each.
    nearest = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = stored(confirmed(nearest, docs), "near-links")
    labels = connected_components(links)
    more = stored(confirmed(across(stars.join(nearest, ["a", "b"], "left_anti"), labels), docs), "near-links")
    links = links.union(more)
    labels = connected_components(links)

    # Buckets of two are settled by their only pair.
    shared = shared.where("size > 2")
    ids = open_members(shared, labels).select("class_id").distinct()
    fine = stored(fine_sketches(docs, stored(ids, "near-open")), "near-fine").join(nodes, "class_id")
    for spanning in (True, False):
        rows = open_members(shared, labels).join(fine, "class_id")
        pairs = _bucket_pairs(rows, spanning).join(stars, ["a", "b"], "left_anti")
        links = links.union(stored(confirmed(stored(pairs, "near-rest"), docs), "near-links"))
        labels = connected_components(links)
    return labels


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component, with the component of each."""
    rows = with_component(members, labels, "class_id", "component")
    keys = rows.groupBy("key", "band").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    return rows.join(keys.where("least < most").select("key", "band"), ["key", "band"], "left_semi")


def with_component(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """Add the component of ``node``; a node without links is its own."""
    found = labels.select(F.col("node").alias(node), F.col("label").alias("_label"))
    return rows.join(found, node, "left").withColumn(name, F.coalesce("_label", node)).drop("_label")


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not connected yet."""
    labelled = with_component(with_component(pairs, labels, "a", "_of_a"), labels, "b", "_of_b")
    return labelled.where("_of_a != _of_b").select("a", "b")


def clashing_ids(docs: DataFrame) -> DataFrame:
    """The doc_ids that rows of different texts share, stored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"))
    texts = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("hash").alias("least"), F.max("hash").alias("most"))
    return stored(texts.where("least != most").select("doc_id"), "near-clashing")


def with_row_key(docs: DataFrame, clashing: DataFrame) -> DataFrame:
    """row_key, and the rows of ``docs`` as one column. The key is the doc_id, or a hash where that clashes; null without doc_id.

    Keys keep the order of the doc_ids: a group's first row, often the original of the
    others, is the leader that they are compared with.
    """
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("row_key"), F.xxhash64(doc_id, "text").alias("hash"), F.struct(*docs.columns).alias("row"))
    if clashing.isEmpty():
        return rows.select("row_key", "row")
    listed = _listed(clashing.select(F.col("doc_id").alias("row_key"), F.lit(True).alias("clashes")))
    rows = rows.join(listed, "row_key", "left")
    return rows.select(F.when(F.col("clashes"), F.col("hash")).otherwise(F.col("row_key")).alias("row_key"), "row")


def grouped_rows(docs: DataFrame, clashing: DataFrame) -> DataFrame:
    """One row per row of ``docs``: row_key, doc_id, n_shingles, component_id, and first_key, that of its group's first row."""
    keyed = with_row_key(docs.select("doc_id", "text"), clashing)
    keyed = keyed.select(F.col("row_key").alias("doc_id"), F.col("row.doc_id").cast("long").alias("real_id"), F.col("row.text").alias("text"))
    signed = stored(signatures(keyed), "near-signatures")
    key = ["set_a", "set_b", "n_shingles"]
    named = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("real_id", F.col("doc_id").alias("row_key"))).alias("first")
    classes = stored(named.groupBy(*key).agg(F.min("doc_id").alias("class_id"), first), "near-classes")
    heads = classes.select("class_id")
    nodes = named.join(heads, named["doc_id"] == heads["class_id"], "left_semi")
    nodes = nodes.withColumnRenamed("doc_id", "class_id").dropDuplicates(["class_id"])
    labels = class_links(keyed.select("doc_id", "text"), nodes.drop("set_a", "set_b", "real_id"))
    placed = with_component(classes, labels, "class_id", "component")
    firsts = placed.groupBy("component").agg(F.min("first").alias("least"))
    placed = placed.join(firsts, "component").select(*key, "least")
    members = signed.select("doc_id", "real_id", *key).join(placed, key, "left")
    return members.select(
        F.col("doc_id").alias("row_key"),
        F.col("real_id").alias("doc_id"),
        "n_shingles",
        F.when(F.col("real_id").isNotNull(), F.coalesce("least.real_id", "real_id")).alias("component_id"),
        F.when(F.col("real_id").isNotNull(), F.coalesce("least.row_key", "doc_id")).alias("first_key"),
    )


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return grouped_rows(docs, clashing_ids(docs)).select("doc_id", "n_shingles", "component_id", kept)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one for each group of near-duplicates, and those without doc_id.

    It is a row with the group's smallest doc_id. Only rows that are there several times
    are shuffled, as long as the list of rows to drop may be broadcast.
    """
    clashing = clashing_ids(docs)
    groups = grouped_rows(docs, clashing).where("row_key IS NOT NULL").select("row_key", "first_key")
    groups = stored(groups, "near-groups")
    gone = groups.where("row_key != first_key").select("row_key").distinct()
    repeated = groups.where("row_key = first_key").groupBy("row_key").count().where("count > 1").select("row_key")
    rows = with_row_key(docs, clashing)
    first = rows.join(_listed(repeated), "row_key", "left_semi").dropDuplicates(["row_key"])
    rest = rows.join(_listed(gone.union(repeated)), "row_key", "left_anti")
    return rest.union(first).select("row.*")


def _listed(ids: DataFrame) -> DataFrame:
    """Broadcast a list of identifiers if it is small enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
