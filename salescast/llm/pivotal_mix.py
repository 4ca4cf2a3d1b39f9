"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words. A document is to be taken ``target / source size``
times: the whole part is certain, the rest is a probability. Pivotal rounding pairs two
documents with open probabilities and randomly moves mass from one to the other until
one of them is 0 or 1. Mass is counted in words, so that every step keeps the words
taken exactly; a document's expected copies stay what they were.

The rounding is a reduction tree. Groups of bounded size, cut by a hash of the
document, each decide all their documents but one at most. These residuals meet in
groups of ``FAN_IN`` on the next level, and so on until a source has one residual left,
which is rounded by itself. A source's words therefore end within one document of its
target. Every choice is drawn from a generator seeded by the group, over rows in a
fixed order: reruns agree, on any number of executors.

Documents without words (null, empty or white space) have size 0 and take nothing.
A null source is a source of its own, last in order. Repeated rows are rounded one by
one, those that tie in order of doc_id and size. Very long texts are counted whole. An
empty table gives an empty mix. Other columns are ignored; the stage keeps them, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescast.llm.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
GROUP_ROWS = 2_000
FAN_IN = 64
SEED = 20_240_613
ALMOST = 1e-9


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_copies: float = MOST_COPIES
) -> DataFrame:
    """One row per source: source, source_size, rows, target.

    Targets share all words by weight, given in the sources' code-point order (null
    last) and repeating. None exceeds ``most_copies`` times its source; what is cut is
    shared again by weight among the others until none is above. Sources at their limit
    are those whose limit per weight is lowest: in that order, one is at its limit if
    the share left for it and all after it would exceed it. One row per source is
    windowed, however many documents there are.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    place = F.row_number().over(order) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.element_at(listed, (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(float(most_copies)))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    shared = ranked.withColumn("rate", left / weight_left)
    shared = shared.withColumn("is_limited", F.col("limit") <= F.col("weight") * F.col("rate"))
    # The first source below its limit has the rate that holds for all below theirs.
    shared = shared.withColumn("by_limit", F.row_number().over(by_limit))
    rate = F.min(F.when(~F.col("is_limited"), F.struct("by_limit", "rate"))).over(everything)["rate"]
    target = F.when(F.col("is_limited"), F.col("limit")).otherwise(F.col("weight") * rate)
    return shared.select("source", "source_size", "rows", F.coalesce(target, F.lit(0.0)).alias("target"))


def pivot(size: np.ndarray, open_part: np.ndarray, draws: np.ndarray) -> int:
    """Round ``open_part`` in place until at most one entry is open; its index, or -1.

    ``size`` must be positive where an entry is open. ``draws`` has a uniform number
    for each entry.
    """
    held = -1
    for i in np.flatnonzero((open_part > 0) & (open_part < 1)).tolist():
        if held < 0:
            held = i
            continue
        s, p, t, q = size[held], open_part[held], size[i], open_part[i]
        to_held = min(s * (1 - p), t * q)
        to_next = min(s * p, t * (1 - q))
        if draws[i] * (to_held + to_next) < to_next:
            p, q = p + to_held / s, q - to_held / t
        else:
            p, q = p - to_next / s, q + to_next / t
        p = 0.0 if p < ALMOST else 1.0 if p > 1 - ALMOST else p
        q = 0.0 if q < ALMOST else 1.0 if q > 1 - ALMOST else q
        open_part[held], open_part[i] = p, q
        held = held if 0 < p < 1 else i if 0 < q < 1 else -1
    return held


_STATE = "doc_id long, size long, source string, source_size long, target double, spread long, group long, whole long, open double"


def _round_group(rows: pd.DataFrame, level: int, is_last: bool) -> pd.DataFrame:
    rows = rows.sort_values(["spread", "doc_id", "size"], kind="stable", ignore_index=True)
    seed = [SEED, level, int(rows["group"].iloc[0]), int(rows["source_key"].iloc[0]) & 0xFFFFFFFFFFFFFFFF]
    draws = np.random.Generator(np.random.PCG64(seed)).random(len(rows) + 1)
    part = rows["open"].to_numpy(copy=True)
    size = rows["size"].to_numpy(dtype=np.float64)
    part[size == 0] = 0.0
    held = pivot(size, part, draws)
    if held >= 0 and is_last:
        part[held] = float(draws[-1] < part[held])
    rows["open"] = part
    return rows.drop(columns="source_key")


def _round_level(state: DataFrame, level: int, is_last: bool) -> DataFrame:
    keyed = state.withColumn("source_key", F.xxhash64(F.lit("source"), "source"))
    return keyed.groupBy("source", "group").applyInPandas(
        lambda rows: _round_group(rows, level, is_last), schema=_STATE
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    most_copies: float = MOST_COPIES,
    group_rows: int = GROUP_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words), copies."""
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count().alias("size"))
    sized = stored(sized, "mix-sizes")
    targets = stored(source_targets(sized, weights, most_copies), "mix-targets")
    widest = targets.agg(F.max("rows")).first()[0] or 0
    groups = -(-widest // group_rows)

    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = F.least(wanted, F.lit(float(most_copies)))
    spread = F.xxhash64("doc_id", F.lit(SEED))
    own_groups = F.ceil(F.col("rows") / group_rows)
    # One row per source: the planner broadcasts it if it is small, or else joins it by shuffle.
    state = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(
        "doc_id", "size", sized["source"], "source_size", "target",
        spread.alias("spread"),
        F.pmod(spread, own_groups).cast("long").alias("group"),
        F.floor(wanted).cast("long").alias("whole"),
        (wanted - F.floor(wanted)).alias("open"),
    )
    decided = []
    level = 0
    while True:
        is_last = groups <= 1
        state = stored(_round_level(state, level, is_last), "mix-level")
        is_open = (F.col("open") > 0) & (F.col("open") < 1)
        decided.append(state.where(~is_open))
        if is_last:
            break
        state = state.where(is_open).withColumn("group", F.floor(F.col("group") / fan_in).cast("long"))
        groups = -(-groups // fan_in)
        level += 1
    result = decided[0]
    for more in decided[1:]:
        result = result.union(more)
    copies = F.col("whole") + F.col("open").cast("long")
    return result.select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Documents without words carry nothing to mix and are taken once. The texts are
    shuffled once, to meet their copies by doc_id; rows that share a doc_id take theirs
    by size. A row without doc_id goes by a hash of its text.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    chosen = mix_sources(docs.select(key.alias("doc_id"), "text", "source"))
    taken = F.when(F.col("size") > 0, F.col("copies")).otherwise(1)
    chosen = chosen.select(F.col("doc_id").alias("key"), F.struct("size", taken.cast("int").alias("copies")).alias("c"))
    chosen = chosen.groupBy("key").agg(F.sort_array(F.collect_list("c")).alias("chosen"))
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), key.alias("key"), word_count().alias("size"), F.xxhash64("text", "source").alias("tie")
    )
    rows = rows.join(chosen, "key")
    place = F.row_number().over(Window.partitionBy("key").orderBy("size", "tie"))
    rows = rows.withColumn("copies", F.element_at("chosen", place)["copies"]).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
