"""Data-quality tables per series, and of the whole panel.

A series has at most one row per day, so its exact percentiles need a bounded
buffer however large the panel is. Those of the whole panel are found by rank: values
are counted, dealt by range, and only the ranges' sizes are added up.
"""

from __future__ import annotations

from collections.abc import Sequence

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salescast.schema import ALL_TARGETS, FEATURES, KEYS
from salescast.session import shared_dir, shuffle_partitions

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe_columns(
    panel: DataFrame, columns: Sequence[str] = tuple(ALL_TARGETS), keys: Sequence[str] = KEYS
) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum of each column."""
    aggregates, rows = [], []
    for name in columns:
        aggregates.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(name).alias("count"),
                F.avg(name).alias("mean"),
                F.stddev_samp(name).alias("std"),
                F.min(name).alias("min"),
                F.percentile(name, [0.25, 0.5, 0.75]).alias("quartiles"),
                F.max(name).alias("max"),
            ).alias(f"_{name}")
        )
        rows.append(F.col(f"_{name}"))
    table = panel.groupBy(*keys).agg(*aggregates).select(*keys, F.inline(F.array(*rows)))
    return table.select(
        *keys,
        "column",
        "count",
        "mean",
        "std",
        "min",
        F.col("quartiles")[0].alias("p25"),
        F.col("quartiles")[1].alias("p50"),
        F.col("quartiles")[2].alias("p75"),
        "max",
    )


def _stored_ranges(counts: DataFrame) -> DataFrame:
    """Counted values dealt by range and written with the number of their range, which then stays the same."""
    spark = counts.sparkSession
    path = f"{shared_dir(spark)}/value-ranges-{uuid4().hex}"
    dealt = counts.repartitionByRange(shuffle_partitions(spark), "column", "value")
    dealt.withColumn("part", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def describe_pooled(panel: DataFrame, columns: Sequence[str] = tuple(ALL_TARGETS)) -> DataFrame:
    """``describe_columns`` of the whole panel, with exact quartiles and without a buffer of all values.

    Each distinct value is counted, tasks first. The counts are dealt by range; sums over
    whole ranges say which range holds a wanted rank, and only those ranges are numbered
    value by value. Quartiles between two ranks are interpolated.
    """
    pairs = [F.struct(F.lit(name).alias("column"), F.col(name).cast("double").alias("value")) for name in columns]
    values = panel.select(F.inline(F.array(*pairs)))
    totals = values.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    counts = values.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("times"))
    counts = _stored_ranges(counts)

    # One row per column and range; a column has as many ranges as there are shuffle partitions at most.
    ranges = counts.groupBy("column", "part").agg(F.sum("times").alias("rows"))
    upto = Window.partitionBy("column").orderBy("part")
    ranges = ranges.withColumns(
        {
            "behind": F.sum("rows").over(upto) - F.col("rows"),
            "count": F.sum("rows").over(Window.partitionBy("column")),
        }
    )
    place = [
        F.struct(F.lit(name).alias("quartile"), (F.lit(share) * (F.col("count") - 1)).alias("place"))
        for name, share in QUARTILES.items()
    ]
    wanted = ranges.select("column", "part", "rows", "behind", F.inline(F.array(*place)))
    ranks = F.array_distinct(F.array(F.floor("place"), F.ceil("place")))
    wanted = wanted.select("*", F.explode(ranks).alias("rank"))
    wanted = wanted.where((F.col("rank") >= F.col("behind")) & (F.col("rank") < F.col("behind") + F.col("rows")))

    held = counts.join(F.broadcast(wanted.select("column", "part").distinct()), ["column", "part"])
    upto = Window.partitionBy("column", "part").orderBy("value")
    held = held.withColumn("last", F.sum("times").over(upto))
    found = held.join(F.broadcast(wanted), ["column", "part"])
    rank = F.col("rank") - F.col("behind")
    found = found.where((rank < F.col("last")) & (rank >= F.col("last") - F.col("times")))
    ends = found.groupBy("column", "quartile").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.first("place").alias("place")
    )
    share = F.col("place") - F.floor("place")
    ends = ends.withColumn("quantile", F.col("low") + (F.col("high") - F.col("low")) * share)
    quartiles = ends.groupBy("column").agg(
        *[F.max(F.when(F.col("quartile") == name, F.col("quantile"))).alias(name) for name in QUARTILES]
    )
    return totals.join(F.broadcast(quartiles), "column", "left").select(
        "column", "count", "mean", "std", "min", *QUARTILES, "max"
    )


def null_counts(
    panel: DataFrame, columns: Sequence[str] = (*FEATURES, *ALL_TARGETS), keys: Sequence[str] = KEYS
) -> DataFrame:
    """Rows and missing values of each column."""
    totals = panel.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(name).isNull()).alias(name) for name in columns]
    )
    counted = [F.struct(F.lit(name).alias("column"), F.col(name).alias("nulls")) for name in columns]
    return totals.select(*keys, "rows", F.inline(F.array(*counted)))
