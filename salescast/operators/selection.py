"""Choice of one configuration per target by validation error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Errors this near each other, relative to the lower one, are a tie: their last bits
# depend on the order rows were summed in, which differs from run to run.
TIE = 1e-9


def is_tied(error: Column, least: Column) -> Column:
    return error <= least + F.abs(least) * TIE


def best_configuration(tuning: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """The row of lowest MAE per group; ties go to the lower ``config_order``.

    Rows without an error (NULL or NaN) never win. A group has one row per configuration.
    """
    scored = tuning.where(F.col("MAE").isNotNull() & ~F.isnan("MAE"))
    rest = [name for name in tuning.columns if name not in by]
    row = F.struct("config_order", F.struct(*rest).alias("row"), F.col("MAE").alias("error"))
    grouped = scored.groupBy(*by).agg(F.min("MAE").alias("_least"), F.collect_list(row).alias("_rows"))
    tied = F.filter("_rows", lambda row: is_tied(row["error"], F.col("_least")))
    return grouped.select(*by, F.array_min(tied)["row"].alias("best")).select(*by, "best.*")
