"""Feature and target columns of the daily panel."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from salescast.functions.calendar import calendar_columns, with_holiday_flag
from salescast.functions.numeric import ratio
from salescast.schema import (
    ALL_TARGETS,
    BASELINE_FEATURE,
    DATE,
    DIRECT_TARGET,
    FEATURES,
    HORIZON_DAYS,
    KEYS,
    QUANTITY,
    TARGETS,
)

LAGS = (1, 7, 14, 28)
WEEK = 7
MONTH = 28
# Weeks of history that the longest frame (56 days) reaches back.
WEEKS_BACK = 8
HISTORY_DAYS = WEEK * WEEKS_BACK


def _by_day(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(DATE)


def add_lags(dense: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    by_day = _by_day(keys)
    return dense.select("*", *[F.lag(QUANTITY, k).over(by_day).alias(f"quantity_lag_{k}") for k in LAGS])


def add_targets(dense: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Quantity of each of the next seven days, and their sum (NULL if one is missing)."""
    by_day = _by_day(keys)
    ahead = dense.select("*", *[F.lead(QUANTITY, k).over(by_day).alias(t) for k, t in enumerate(TARGETS, 1)])
    return ahead.withColumn(DIRECT_TARGET, reduce(add, [F.col(t) for t in TARGETS]))


def add_rolling(dense: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rolling means, sums, offset sums and the 28-day standard deviation.

    Rows with fewer than 28 days before them have no usable values and are
    dropped, so only the frames reaching back further can be cut off by the
    start of a series; those cover the days there are.

    Every frame is a run of whole weeks ending one or eight days back. Spark
    evaluates a sliding frame from scratch for each row, so frames of 7 to 56
    days cost their length per row. Instead one 7-day frame is evaluated and
    the longer ones are put together from its values 7, 14, ... days earlier,
    which are plain lags over the same partitioning and order. Sums only ever
    add, and the deviation merges the weeks' variances around the common mean,
    so nothing cancels.
    """
    by_day = _by_day(keys)
    last_week = by_day.rowsBetween(-WEEK, -1)
    weekly = dense.select(
        "*",
        F.row_number().over(by_day).alias("_day"),
        F.sum(QUANTITY).over(last_week).alias("_sum_0"),
        F.var_pop(QUANTITY).over(last_week).alias("_var_0"),
    )
    weekly = weekly.select(
        "*",
        *[F.lag("_sum_0", WEEK * k).over(by_day).alias(f"_sum_{k}") for k in range(1, WEEKS_BACK)],
        *[F.lag("_var_0", WEEK * k).over(by_day).alias(f"_var_{k}") for k in range(1, MONTH // WEEK)],
    )
    weekly = weekly.where(F.col("_day") > MONTH)

    def total(first: int, last: int) -> Column:
        """Sum over the weeks ``first`` to ``last`` back."""
        weeks = [F.col(f"_sum_{k}") for k in range(first, last + 1)]
        return reduce(add, [F.coalesce(w, F.lit(0.0)) if k >= 4 else w for k, w in enumerate(weeks, first)])

    sums = weekly.withColumns(
        {
            "quantity_sum_7d": total(0, 0),
            "quantity_sum_14d": total(0, 1),
            "quantity_sum_28d": total(0, 3),
            "quantity_sum_56d": total(0, 7),
            "quantity_sum_previous_7d": total(1, 1),
            "quantity_sum_previous_14d": total(1, 2),
            "quantity_sum_previous_28d": total(1, 4),
        }
    )
    means = sums.withColumns(
        {f"quantity_mean_{days}d": F.col(f"quantity_sum_{days}d") / days for days in (7, 14, 28)}
    )

    def variance(week: int) -> Column:
        shift = F.col(f"_sum_{week}") / WEEK - F.col("quantity_mean_28d")
        return F.col(f"_var_{week}") + shift * shift

    squares = WEEK * reduce(add, [variance(week) for week in range(MONTH // WEEK)])
    result = means.withColumn("quantity_std_28d", F.sqrt(squares / (MONTH - 1)))
    return result.select(*dense.columns, *[name for name in FEATURES if _is_rolling(name)])


def _is_rolling(name: str) -> bool:
    return name.startswith(("quantity_mean_", "quantity_sum_", "quantity_std_"))


def add_ratios(df: DataFrame) -> DataFrame:
    """Trend and week-over-week ratios; NULL over a zero denominator.

    ``ratio_previous_7d_28d`` divides by the 28-day sum, not the mean.
    """
    previous = F.col("quantity_sum_previous_7d")
    return df.withColumns(
        {
            "trend_7d_vs_28d": ratio(F.col("quantity_mean_7d"), F.col("quantity_mean_28d")),
            "trend_14d_vs_28d": ratio(F.col("quantity_mean_14d"), F.col("quantity_mean_28d")),
            "ratio_previous_7d_28d": ratio(previous, F.col("quantity_sum_28d")),
            "ratio_previous_7d_recent_7d": ratio(previous, F.col("quantity_sum_7d")),
        }
    )


def add_calendar(df: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    return with_holiday_flag(df.withColumns(calendar_columns(F.col(DATE))), DATE, holidays)


def add_baseline_feature(df: DataFrame, features: Sequence[str] = (BASELINE_FEATURE,)) -> DataFrame:
    """The 28-day mean times seven, only where ``features`` asks for it."""
    if BASELINE_FEATURE not in features:
        return df
    return df.withColumn(BASELINE_FEATURE, F.col("quantity_mean_28d") * HORIZON_DAYS)


def feature_rows(dense: DataFrame, keys: Sequence[str] = KEYS, holidays: DataFrame | None = None) -> DataFrame:
    """All feature and target columns of the days with 28 days before and seven after."""
    shifted = add_targets(add_lags(dense, keys), keys)
    usable = add_rolling(shifted, keys).where(F.col(TARGETS[-1]).isNotNull())
    kept = [name for name in dense.columns if name not in FEATURES]
    return add_calendar(add_ratios(usable), holidays).select(*kept, *FEATURES, *ALL_TARGETS)


def feature_matrix(panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return panel.select(*keys, DATE, *FEATURES)


def target_matrix(panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return panel.select(*keys, DATE, *[F.col(t).cast("double") for t in ALL_TARGETS])
