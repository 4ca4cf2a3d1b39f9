"""Quality scores from a sparse ensemble of rules over text statistics.

A scan computes the statistics of every whole text by built-in functions and stores
them. Spark ML grows a forest of shallow trees on labelled rows; every path from a root
to a node below it is a rule: a conjunction of bounds on statistics, one interval each.
Rules that say the same are one. A logistic regression with an L1 penalty weighs the rules
(one that holds for all or none of the sample gets no weight), and those with a weight
are compiled into one Spark column expression, which scores all documents without Python.

Labels come only from rows whose crc32 of doc_id, mod 3, is not 1. Of these, a sample of
about ``SAMPLE_ROWS`` chosen by hash is learned from: a documented bound, at any size of
the corpus. The driver sees the trees and the weights, never rows.

Null and empty texts, and those without words, have statistics of 0 and are scored by
them. Labels that are null or neither 0 nor 1 are no labels; several labels of a document
count each; equal scores need no order. Without labels of both kinds every score is the
share of ones, with one of each added. Very long texts are scanned whole. Repeated rows
each get a row; an empty table has none. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescast.llm.scratch import stored

THRESHOLD = 0.5
SAMPLE_ROWS = 30_000
TREES = 30
DEPTH = 3
LEAST_ROWS = 10
PENALTY = 0.001
STEPS = 60
SAMPLE_PARTITIONS = 4
# A join's list of labelled rows is broadcast up to this many (about 16 bytes each).
BROADCAST_LABELS = 2_000_000

_SPACE = r"\x20\x09-\x0D"
STATISTICS = [
    "log_words", "log_lines", "word_length", "line_words", "longest_word", "longest_line", "different_words", "different_lines",
    "no_letters", "capitals", "digits", "symbols", "stops", "commas", "marks", "signs",
]


def _share(part: Column, whole: Column) -> Column:
    """Quotient as a double, 0 without a whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text (``STATISTICS``), as doubles."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = found.select(
        "doc_id",
        "text",
        F.regexp_replace("text", rf"[\p{{L}}{_SPACE}]+", "").alias("rest"),
        F.split("text", f"[{_SPACE}]+").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(f"[^{_SPACE}]")).alias("lines"),
    )
    found = found.withColumn("different", F.array_distinct("words"))
    # White space at an end of the text leaves an empty word there.
    empty = (F.element_at("words", 1) == "").cast("int")
    empty += ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")

    def count(characters: str, of: str = "rest") -> Column:
        return F.char_length(of) - F.char_length(F.regexp_replace(of, f"{characters}+", ""))

    counts = found.select(
        "doc_id",
        (F.size("words") - empty).alias("n_words"),
        F.size("lines").alias("n_lines"),
        F.char_length("text").alias("n_chars"),
        F.char_length("rest").alias("rest"),
        (F.size("different") - F.least(empty, F.lit(1))).alias("different_words"),
        F.size(F.array_distinct("lines")).alias("different_lines"),
        F.array_max(F.transform("different", F.char_length)).alias("longest_word"),
        F.coalesce(F.array_max(F.transform("lines", F.char_length)), F.lit(0)).alias("longest_line"),
        count(r"\p{Lu}", "text").alias("capitals"),
        count(r"\p{N}").alias("digits"),
        count("[#*$%&|<>]").alias("symbols"),
        count("[.]").alias("stops"),
        count("[,;:]").alias("commas"),
        count("[!?]").alias("marks"),
        count("[(){}\\[\\]\"'=_/@+~^`\\\\-]").alias("signs"),
    )
    words, lines, chars = F.col("n_words"), F.col("n_lines"), F.col("n_chars")
    shares = {
        "log_words": F.log1p(words.cast("double")),
        "log_lines": F.log1p(lines.cast("double")),
        "word_length": _share(chars, words),
        "line_words": _share(words, lines),
        "longest_word": F.log1p(F.col("longest_word").cast("double")),
        "longest_line": F.log1p(F.col("longest_line").cast("double")),
        "different_words": _share(F.col("different_words"), words),
        "different_lines": _share(F.col("different_lines"), lines),
        "no_letters": _share(F.col("rest"), chars),
        "capitals": _share(F.col("capitals"), chars),
        "digits": _share(F.col("digits"), chars),
        "symbols": _share(F.col("symbols"), words),
        "stops": _share(F.col("stops"), words),
        "commas": _share(F.col("commas"), words),
        "marks": _share(F.col("marks"), words),
        "signs": _share(F.col("signs"), words),
    }
    return counts.select("doc_id", *[shares[name].alias(name) for name in STATISTICS])


@dataclass(frozen=True)
class Rule:
    """Bounds on statistics: (name, over, at_most) for each, in order of the names."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        """Whether the rule holds for a row."""
        parts = []
        for name, over, at_most in self.bounds:
            if over > -math.inf:
                parts.append(F.col(name) > over)
            if at_most < math.inf:
                parts.append(F.col(name) <= at_most)
        return reduce(Column.__and__, parts)


def paths(root, names: list[str]) -> list[Rule]:
    """A rule for each node of a fitted tree but its root."""
    found = []

    def walk(node, bounds: dict[str, tuple[float, float]]) -> None:
        if bounds:
            found.append(Rule(tuple((n, *bounds[n]) for n in names if n in bounds)))
        if node.subtreeDepth() == 0:
            return
        name, at = names[node.split().featureIndex()], node.split().threshold()
        over, at_most = bounds.get(name, (-math.inf, math.inf))
        walk(node.leftChild(), {**bounds, name: (over, min(at_most, at))})
        walk(node.rightChild(), {**bounds, name: (max(over, at), at_most)})

    walk(root, {})
    return found


def rules_of(forest, names: list[str]) -> list[Rule]:
    """The distinct rules of a fitted forest, in order."""
    return list(dict.fromkeys(rule for tree in forest.trees for rule in paths(tree._call_java("rootNode"), names)))


@dataclass
class RuleModel:
    """A logistic model: the rules with a weight, and the bias."""

    rules: list[tuple[Rule, float]]
    bias: float

    def score(self) -> Column:
        """The model as a column expression over ``STATISTICS``."""
        parts = [F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0)) for rule, weight in self.rules]
        margin = reduce(Column.__add__, parts, F.lit(self.bias))
        return 1 / (1 + F.exp(-margin))


def is_held_out(doc_id: Column) -> Column:
    """A null doc_id is not held out, and has no label."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_rows(measured: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics and label of the sampled labelled rows, dealt alike in each run."""
    doc_id = F.col("doc_id").cast("long")
    usable = labels.where(F.col("quality").isin(0, 1)).select(doc_id.alias("doc_id"), F.col("quality").cast("double").alias("label"))
    usable = usable.where(~is_held_out(F.col("doc_id")))
    share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    count = usable.count()
    if count > sample_rows:
        usable = usable.where(share < int(1_000_000 * sample_rows / count))
    if count <= BROADCAST_LABELS:
        usable = F.broadcast(usable)
    rows = measured.select("doc_id", *STATISTICS).join(usable, "doc_id")
    return rows.repartition(SAMPLE_PARTITIONS, "doc_id").sortWithinPartitions("doc_id", "label", *STATISTICS)


def fit(
    measured: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY
) -> RuleModel:
    """Rules and weights learned from the labelled rows of ``measured`` (doc_id and ``STATISTICS``)."""
    rows = stored(training_rows(measured, labels, sample_rows), "rules-sample")
    counts = {row["label"]: row["count"] for row in rows.groupBy("label").count().collect()}  # two rows at most
    ones, zeros = counts.get(1.0, 0), counts.get(0.0, 0)
    constant = RuleModel([], math.log((ones + 1) / (zeros + 1)))
    if not ones or not zeros:
        return constant
    forest = RandomForestClassifier(
        featuresCol="measured",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=LEAST_ROWS,
        featureSubsetStrategy="onethird",
        subsamplingRate=0.7,
        maxBins=64,
        seed=7,
    )
    rules = rules_of(forest.fit(rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("measured"))), STATISTICS)
    if not rules:
        return constant
    held = array_to_vector(F.array(*[rule.column().cast("double") for rule in rules])).alias("held")
    held = stored(rows.select("label", held), "rules-held")
    lasso = LogisticRegression(featuresCol="held", elasticNetParam=1.0, regParam=penalty, maxIter=STEPS)
    fitted = lasso.fit(held)
    weights = fitted.coefficients.toArray().tolist()
    return RuleModel([(rule, weight) for rule, weight in zip(rules, weights) if weight], float(fitted.intercept))


def score(measured: DataFrame, model: RuleModel) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = measured.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    measured = stored(statistics(docs), "rules-statistics")
    return score(measured, fit(measured, labels))
