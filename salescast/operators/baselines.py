"""Forecasts that need no training: feature columns carried forward."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescast.schema import DIRECT_TARGET, HORIZON_DAYS, TARGETS

# The level columns a baseline may carry forward, in order of preference.
LEVELS = {
    "mean_7d": "quantity_mean_7d",
    "mean_14d": "quantity_mean_14d",
    "mean_28d": "quantity_mean_28d",
    "lag_7": "quantity_lag_7",
}


def level_forecast(level: str, target: str) -> Column:
    """The level itself for one day, seven times it for the seven-day total."""
    return F.col(level) * HORIZON_DAYS if target == DIRECT_TARGET else F.col(level)


def baseline_forecasts(panel: DataFrame) -> DataFrame:
    """The moving averages models are compared with."""
    return panel.withColumns(
        {
            "baseline_horizon": level_forecast("quantity_mean_28d", TARGETS[0]),
            "baseline_7d": level_forecast("quantity_mean_7d", DIRECT_TARGET),
            "baseline_28d": level_forecast("quantity_mean_28d", DIRECT_TARGET),
        }
    )


def forecast_name(target: str) -> str:
    return f"forecast_{target}"


def multi_horizon_sum(targets: Sequence[str] = TARGETS) -> Column:
    """The seven-day total as the sum of the horizon forecasts."""
    return reduce(add, [F.col(forecast_name(target)) for target in targets])


def mean_forecast(rows: DataFrame) -> DataFrame:
    """The 28-day mean as forecast of every horizon and, times seven, of the total."""
    return rows.withColumns(
        {forecast_name(t): level_forecast("quantity_mean_28d", t) for t in [*TARGETS, DIRECT_TARGET]}
    )
