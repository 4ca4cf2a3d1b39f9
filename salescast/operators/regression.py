"""Per-series linear regression of each target on the 28-day baseline.

The regression corrects the baseline's level and scale for its series: ``intercept +
slope * baseline``, by least squares. Its sums merge, so it is one grouped aggregate over
any number of series, and within a series' partition one window aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salescast.schema import ALL_TARGETS, HORIZON_DAYS, KEYS

REGRESSION = "regression"


def baseline() -> Column:
    """What the targets are regressed on: the 28-day mean times seven."""
    return F.col("quantity_mean_28d") * HORIZON_DAYS


def _line(target: str, learned: Column) -> tuple[Column, Column, Column]:
    """Slope, intercept and target mean over the ``learned`` rows, as aggregates."""
    truth = F.when(learned, F.col(target))
    return F.regr_slope(truth, baseline()), F.regr_intercept(truth, baseline()), F.avg(truth)


def series_regressions(
    rows: DataFrame, learned: Column, targets: Sequence[str] = ALL_TARGETS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Slope and intercept of each series and target, learned from the ``learned`` rows.

    Where the baseline is the same on all rows there is no slope: the mean of the target
    stands for the line (``is_mean``). A series without a learned row has neither.
    """
    lines = []
    for target in targets:
        slope, intercept, mean = _line(target, learned)
        parts = [slope.alias("slope"), intercept.alias("intercept"), mean.alias("mean"), F.count(F.when(learned, F.col(target))).alias("rows")]
        lines.append(F.struct(F.lit(target).alias("target"), *parts).alias(f"_{target}"))
    table = rows.groupBy(*keys).agg(*lines).select(*keys, F.inline(F.array(*[F.col(f"_{t}") for t in targets])))
    no_slope = F.col("slope").isNull()
    return table.select(
        *keys,
        "target",
        "rows",
        F.when(no_slope & F.col("mean").isNotNull(), 0.0).otherwise(F.col("slope")).alias("slope"),
        F.when(no_slope, F.col("mean")).otherwise(F.col("intercept")).alias("intercept"),
        no_slope.alias("is_mean"),
    )


def regression_forecast(target: str, learned: Column, keys: Sequence[str] = KEYS) -> Column:
    """The forecast of a row by its series' line over the ``learned`` rows of its partition."""
    series = Window.partitionBy(*keys)
    slope, intercept, mean = (part.over(series) for part in _line(target, learned))
    return F.coalesce(intercept + slope * baseline(), mean)
