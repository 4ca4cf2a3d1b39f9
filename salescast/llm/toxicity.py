"""Toxicity scores from a classifier that is regularised by counterfactuals.

Features are the presence of a word (letters only, lower case) and of word beginnings of
4 to 6 bytes, hashed. The model is logistic; besides its loss and an L2 penalty it pays
for every labelled text whose score changes when identity terms are swapped for others
of their kind, so that a neutral mention of a group is not taken for an insult.

Labels come only from rows whose crc32 of doc_id, mod 4, is not 2. Of these, a sample of
about ``SAMPLE_ROWS`` chosen by hash is learned from: a documented bound, at any size of
the corpus. The ``FEATURES`` whose frequency differs most between the labels are kept,
and the identity terms' own. Fitting passes only the sample's kept features (their
numbers) to the driver; scoring is one scan with a broadcast weight per feature.

Null and empty texts have no feature and get the score of the bias. Labels that are null
are no labels; several labels of a document count each. Without any usable label every
score is 0.5. Very long texts are scanned whole. Features that tell the labels apart
equally well are kept in order of their hash. Repeated rows each get a row, and an empty
table has none. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescast.llm.scratch import stored
from salescast.llm.textscan import Chunk, Lookup, SpanHasher, chunks, lower, mix64, scan_words

THRESHOLD = 0.3
SAMPLE_ROWS = 30_000
FEATURES = 8_192
LEAST_TEXTS = 3
BEGINNINGS = (4, 5, 6)
L2 = 2e-4
FAIRNESS = 1.0
STEPS = 200
RATE = 0.15
# A join's list of labelled rows is broadcast up to this many (about 16 bytes each).
BROADCAST_LABELS = 2_000_000

# Identity terms by kind. A term is swapped for the next of its kind.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["female", "male", "transgender"],
    ["gay", "straight", "lesbian", "bisexual", "queer"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "african", "arab"],
    ["immigrants", "citizens", "refugees", "natives"],
    ["mexican", "american", "chinese", "indian", "german", "french", "turkish", "polish"],
    ["disabled", "blind", "deaf", "old", "young"],
]
SWAPS = {term: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, term in enumerate(kind)}

_NO_LETTER = np.ones(256, dtype=bool)
_NO_LETTER[128:] = False
for _first, _last in ((65, 90), (97, 122)):
    _NO_LETTER[_first : _last + 1] = False


def text_features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of a chunk, and the row of each. Repeats stay."""
    chunk = lower(chunk)
    words = scan_words(chunk, _NO_LETTER)
    rows = np.repeat(np.arange(chunk.rows), words.per_row)
    hasher = SpanHasher(chunk.data)
    found, of = [hasher(words.start, words.end)], [rows]
    length = words.end - words.start
    for size in BEGINNINGS:
        longer = np.flatnonzero(length > size)
        begin = hasher(words.start[longer], words.start[longer] + size)
        found.append(mix64(begin + np.uint64(size)))
        of.append(rows[longer])
    return np.concatenate(found), np.concatenate(of)


def word_features(word: str) -> np.ndarray:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return text_features(Chunk(0, data, np.array([0, len(data)])))[0]


def swap_terms() -> dict[int, np.ndarray]:
    """For each identity term's hash, the features it has and those of the term it is swapped for."""
    return {int(word_features(term)[0]): (word_features(term), word_features(other)) for term, other in SWAPS.items()}


def folded(docs: DataFrame) -> DataFrame:
    """doc_id, text and held_out. A null doc_id is not held out, and has no label."""
    doc_id = F.col("doc_id").cast("long")
    fold = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))
    return docs.select(doc_id.alias("doc_id"), "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out"))


def training_texts(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and toxic of the sampled labelled rows."""
    doc_id, toxic = F.col("doc_id").cast("long"), F.col("toxic").cast("int")
    usable = labels.where(F.col("toxic").isin(0, 1)).select(doc_id.alias("doc_id"), toxic.alias("toxic"))
    usable = usable.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    count = usable.count()
    if count > sample_rows:
        usable = usable.where(share < int(1_000_000 * sample_rows / count))
    if count <= BROADCAST_LABELS:
        usable = F.broadcast(usable)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(usable, "doc_id").select("text", "toxic")


def feature_counts(rows: DataFrame) -> DataFrame:
    """Texts with each feature by label: feature, ones, zeros. Tasks sum their own rows first."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                features, entry = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
                ones = np.bincount(entry, weights=np.concatenate([h[1] for h in held])).astype(np.int64)
                texts = np.bincount(entry, weights=np.concatenate([h[2] for h in held])).astype(np.int64)
                for at in range(0, len(features), 100_000):
                    part = slice(at, at + 100_000)
                    columns = [features[part].view(np.int64), ones[part], texts[part] - ones[part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["feature", "ones", "zeros"])
            held.clear()

        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for chunk in chunks(batch.column(0)):
                features, of = text_features(chunk)
                order = np.lexsort((of, features))
                features, of = features[order], of[order]
                fresh = np.ones(len(features), dtype=bool)
                fresh[1:] = (features[1:] != features[:-1]) | (of[1:] != of[:-1])
                features, of = features[fresh], of[fresh]
                label = toxic[chunk.first_row : chunk.first_row + chunk.rows][of]
                features, entry = np.unique(features, return_inverse=True)
                if not len(features):
                    continue
                held.append((features, np.bincount(entry, weights=label), np.bincount(entry)))
                size += len(features)
                if size > 2_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    found = rows.mapInArrow(gather, "feature long, ones long, zeros long")
    return found.groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def kept_features(counts: DataFrame, ones: int, zeros: int, limit: int = FEATURES) -> np.ndarray:
    """The features whose share of texts differs most between the labels, in deviations; ``limit`` rows."""
    total = float(ones + zeros)
    both = (F.col("ones") + F.col("zeros")) / total
    differ = F.abs(F.col("ones") / float(ones) - F.col("zeros") / float(zeros))
    deviation = differ / F.sqrt(F.greatest(both * (1 - both), F.lit(1 / total)) * (1 / ones + 1 / zeros))
    ranked = counts.where(F.col("ones") + F.col("zeros") >= LEAST_TEXTS).select("feature", deviation.alias("deviation"))
    rows = ranked.orderBy(F.desc("deviation"), "feature").limit(limit).toPandas()
    own = [word_features(term) for term in SWAPS]
    return np.unique(np.concatenate([rows["feature"].to_numpy(dtype=np.int64).view(np.uint64), *own]))


def _present(chunk: Chunk, index: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, kept feature) of a chunk, and all its feature hashes with their rows."""
    features, of = text_features(chunk)
    place = index.find(features)
    known = place >= 0
    pairs = np.unique(of[known].astype(np.int64) * (len(index.keys) + 1) + place[known])
    return pairs // (len(index.keys) + 1), pairs % (len(index.keys) + 1), features, of


def encoded(rows: DataFrame, kept: np.ndarray) -> DataFrame:
    """toxic, the kept features of each text, and of its copy with identity terms swapped (null without any)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Lookup(kept, kept)
        swaps = {term: (index.find(old), index.find(new)) for term, (old, new) in swap_terms().items()}
        terms = np.array(sorted(swaps), dtype=np.uint64)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                row, feature, features, of = _present(chunk, index)
                bounds = np.searchsorted(row, np.arange(chunk.rows + 1))
                own = [feature[bounds[i] : bounds[i + 1]] for i in range(chunk.rows)]
                named: dict[int, set[int]] = {}
                hit = np.isin(features, terms)
                for i, term in zip(of[hit].tolist(), features[hit].tolist()):
                    named.setdefault(i, set()).add(term)
                swapped: list = [None] * chunk.rows
                for i, mentioned in named.items():
                    gone = np.concatenate([swaps[t][0] for t in mentioned])
                    come = np.concatenate([swaps[t][1] for t in mentioned])
                    left = np.setdiff1d(own[i], gone)
                    swapped[i] = np.union1d(left, come[come >= 0])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(chunk.first_row, chunk.rows),
                        pa.array([o.tolist() for o in own], pa.list_(pa.int32())),
                        pa.array([None if s is None else s.tolist() for s in swapped], pa.list_(pa.int32())),
                    ],
                    names=["toxic", "own", "swapped"],
                )

    return rows.mapInArrow(encode, "toxic int, own array<int>, swapped array<int>")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_weights(
    toxic: np.ndarray, own: list, swapped: list, features: int, fairness: float = FAIRNESS, steps: int = STEPS
) -> tuple[np.ndarray, float]:
    """Weights and bias with the least logistic loss, L2 penalty and counterfactual penalty (Adam on all rows)."""
    rows = len(toxic)
    lengths = np.array([len(o) for o in own])
    column = np.concatenate([np.asarray(o, dtype=np.int64) for o in own]) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(rows), lengths)
    # Differences between a text and its swapped copy, one row each.
    pairs = [(o, s) for o, s in zip(own, swapped) if s is not None]
    gone = [np.setdiff1d(o, s) for o, s in pairs]
    come = [np.setdiff1d(s, o) for o, s in pairs]
    differ = np.concatenate([*gone, *come, np.zeros(0)]).astype(np.int64)
    sign = np.concatenate([np.ones(sum(map(len, gone))), -np.ones(sum(map(len, come)))])
    pair = np.repeat(np.tile(np.arange(len(pairs)), 2), [len(g) for g in gone] + [len(c) for c in come]).astype(np.int64)

    weight, bias = np.zeros(features), float(np.log((toxic.sum() + 1) / (rows - toxic.sum() + 1)))
    mean, square = np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, steps + 1):
        error = sigmoid(np.bincount(row, weights=weight[column], minlength=rows) + bias) - toxic
        slope = np.bincount(column, weights=error[row], minlength=features) / rows + 2 * L2 * weight
        if len(pairs):
            change = np.bincount(pair, weights=sign * weight[differ], minlength=len(pairs))
            slope += 2 * fairness / len(pairs) * np.bincount(differ, weights=sign * change[pair], minlength=features)
        slope = np.append(slope, error.mean())
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope * slope
        move = RATE * (1 - step / (steps + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, bias


@dataclass
class ToxicityModel:
    features: np.ndarray
    weights: np.ndarray
    bias: float


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, fairness: float = FAIRNESS) -> ToxicityModel:
    rows = stored(training_texts(docs, labels, sample_rows), "toxicity-sample")
    counts = rows.groupBy("toxic").count().collect()  # two rows at most
    by_label = {row["toxic"]: row["count"] for row in counts}
    ones, zeros = by_label.get(1, 0), by_label.get(0, 0)
    none = np.zeros(0)
    if not ones or not zeros:
        return ToxicityModel(none.astype(np.uint64), none, float(np.log((ones + 1) / (zeros + 1))) if ones + zeros else 0.0)
    kept = kept_features(feature_counts(rows), ones, zeros)
    sample = encoded(rows, kept).toArrow()
    toxic = sample["toxic"].to_numpy().astype(np.float64)
    own = [np.asarray(o) for o in sample["own"].to_pylist()]
    swapped = [None if s is None else np.asarray(s, dtype=np.int64) for s in sample["swapped"].to_pylist()]
    return ToxicityModel(kept, *fit_weights(toxic, own, swapped, len(kept), fairness))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Lookup(shared.value.features, shared.value.weights)
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                row, feature, _, _ = _present(chunk, index)
                total = np.bincount(row, weights=shared.value.weights[feature], minlength=chunk.rows)
                value = sigmoid(total.astype(np.float64) + shared.value.bias)
                mine = batch.slice(chunk.first_row, chunk.rows)
                predicted = (value >= THRESHOLD).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [mine.column(0), mine.column(1), pa.array(value), pa.array(predicted)],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = folded(docs).select("doc_id", "held_out", "text")
    return rows.mapInArrow(scan, "doc_id long, held_out boolean, score double, predicted int")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
