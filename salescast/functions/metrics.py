"""Forecast errors as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Comparison:
    """One truth column against one forecast column, and the labels of its row."""

    labels: tuple[tuple[str, object], ...]
    truth: str | Column
    forecast: str | Column


def compare(truth: str | Column, forecast: str | Column, **labels: object) -> Comparison:
    return Comparison(tuple(labels.items()), truth, forecast)


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def r2_score(rows: Column, squared_error: Column, variance: Column) -> Column:
    """Coefficient of determination from the row count, MSE and truth variance.

    A constant truth scores 1 when met exactly and 0 otherwise; fewer than two
    rows have no score.
    """
    return (
        F.when(rows < 2, F.lit(None).cast("double"))
        .when(variance == 0, F.when(squared_error == 0, 1.0).otherwise(0.0))
        .otherwise(1 - squared_error / F.nullif(variance, F.lit(0.0)))
    )


def improvement_percent(model_mae: Column, baseline_mae: Column) -> Column:
    """Percent by which the model's MAE is below the baseline's; NULL over a zero baseline."""
    return (1 - model_mae / F.nullif(baseline_mae, F.lit(0.0))) * 100


def forecast_errors(df: DataFrame, comparisons: Sequence[Comparison], by: Sequence[str] = ()) -> DataFrame:
    """Rows, MAE, RMSE and R2 of every comparison, per group of ``by``.

    Each row is expanded to its (truth, forecast) pairs and summed per group and
    pair number inside the task; only one row per group and pair is shuffled.
    """
    pairs = [
        F.struct(_column(c.truth).alias("_truth"), _column(c.forecast).alias("_forecast")) for c in comparisons
    ]
    expanded = df.select(*by, F.posexplode(F.array(*pairs)).alias("_pair", "_values"))
    truth, forecast = F.col("_values._truth"), F.col("_values._forecast")
    error = truth - forecast
    totals = expanded.groupBy(*by, "_pair").agg(
        F.count(error).alias("rows"),
        F.avg(F.abs(error)).alias("MAE"),
        F.avg(error * error).alias("_squared"),
        F.var_pop(F.when(error.isNotNull(), truth)).alias("_variance"),
    )
    labels = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.labels]) for c in comparisons])
    return totals.select(
        *by,
        *[F.get(labels, F.col("_pair"))[name].alias(name) for name, _ in comparisons[0].labels],
        "rows",
        "MAE",
        F.sqrt("_squared").alias("RMSE"),
        r2_score(F.col("rows"), F.col("_squared"), F.col("_variance")).alias("R2"),
    )
