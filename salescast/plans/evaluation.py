"""Choosing between baselines and scoring the choice on the test part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salescast.functions.metrics import compare, forecast_errors, improvement_percent
from salescast.operators.baselines import (
    LEVELS,
    baseline_forecasts,
    forecast_name,
    level_forecast,
    multi_horizon_sum,
)
from salescast.operators.regression import REGRESSION, regression_forecast
from salescast.operators.selection import is_tied
from salescast.operators.split import first_test_rows, temporal_split, validation_split
from salescast.schema import ALL_TARGETS, DATE, DIRECT_TARGET, KEYS, TARGETS

COMPARED = {
    "baseline_7d": "baseline_7d",
    "baseline_28d": "baseline_28d",
    "multi_model_7d": "forecast_multi",
    "direct_7d": forecast_name(DIRECT_TARGET),
}


# The forecasters chosen among without trees, in order of preference on equal error.
CANDIDATES = (*LEVELS, REGRESSION)


def baseline_tuning(split: DataFrame, by: Sequence[str] = KEYS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Validation errors of every level baseline and of the series' regression, for every target.

    The regression is learned from the series' rows before the validation part.
    """
    rows = validation_split(split, keys=keys)
    lines = {f"_{REGRESSION}_{t}": regression_forecast(t, F.col("tuning_part") == "fit", keys) for t in ALL_TARGETS}
    validation = rows.withColumns(lines).where(F.col("tuning_part") == "validation")
    candidates = []
    for target in ALL_TARGETS:
        forecasts = [level_forecast(level, target) for level in LEVELS.values()]
        forecasts.append(F.col(f"_{REGRESSION}_{target}"))
        for order, (name, forecast) in enumerate(zip(CANDIDATES, forecasts)):
            candidates.append(compare(target, forecast, target=target, config_order=order, configuration=name))
    return forecast_errors(validation, candidates, by)


def with_chosen_baselines(panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Test rows forecast with each series' own best candidate per target.

    One pass: the regressions and the validation errors of every candidate are aggregates
    over the series' partition, which the panel's rows are in already, so choosing adds
    neither a shuffle nor a join. A chosen regression is learned anew from the whole train
    part. A series too short for validation keeps the 28-day mean.
    """
    rows = validation_split(temporal_split(panel, keys), keys=keys)
    series = Window.partitionBy(*keys)
    judged = F.col("tuning_part") == "validation"
    default = F.lit(list(LEVELS).index("mean_28d"))
    lines, errors, forecasts = {}, {}, {}
    for target in ALL_TARGETS:
        lines[f"_fit_{target}"] = regression_forecast(target, F.col("tuning_part") == "fit", keys)
        lines[f"_train_{target}"] = regression_forecast(target, F.col("split") == "train", keys)
        levels = [level_forecast(level, target) for level in LEVELS.values()]
        candidates = [*levels, F.col(f"_fit_{target}")]
        error = [F.avg(F.when(judged, F.abs(F.col(target) - forecast))).over(series) for forecast in candidates]
        errors[f"_error_{target}"] = F.array(*error)
        found = F.col(f"_error_{target}")
        least = F.array_min(found)
        tied = F.filter(F.sequence(F.lit(0), F.lit(len(candidates) - 1)), lambda i: is_tied(F.get(found, i), least))  # noqa: B023
        choice = F.coalesce(F.get(tied, F.lit(0)), default)
        forecasts[forecast_name(target)] = F.get(F.array(*levels, F.col(f"_train_{target}")), choice)
    test = rows.withColumns(lines).withColumns(errors).where(F.col("split") == "test")
    return test.withColumns(forecasts).drop(*lines, *errors, "tuning_part", "tuning_status")


def with_totals(test: DataFrame) -> DataFrame:
    """Add the moving-average baselines and the sum of the horizon forecasts."""
    return baseline_forecasts(test).withColumn("forecast_multi", multi_horizon_sum())


def horizon_metrics(test: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per horizon: the 28-day baseline's errors, the model's, and the improvement."""
    comparisons = []
    for target in TARGETS:
        comparisons.append(compare(target, "quantity_mean_28d", horizon=target, source="baseline"))
        comparisons.append(compare(target, forecast_name(target), horizon=target, source="model"))
    errors = forecast_errors(test, comparisons, by)

    def of(source: str, metric: str) -> Column:
        return F.max(F.when(F.col("source") == source, F.col(metric)))

    table = errors.groupBy(*by, "horizon").agg(
        of("baseline", "MAE").alias("baseline_mae"),
        of("model", "MAE").alias("model_mae"),
        of("baseline", "RMSE").alias("baseline_rmse"),
        of("model", "RMSE").alias("model_rmse"),
        of("model", "R2").alias("model_r2"),
    )
    improvement = improvement_percent(F.col("model_mae"), F.col("baseline_mae"))
    return table.withColumn("improvement_percent", improvement)


def model_comparison(test: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Seven-day totals: two moving averages, the sum of the horizon models, the direct model."""
    comparisons = [compare(DIRECT_TARGET, column, model=model) for model, column in COMPARED.items()]
    return forecast_errors(with_totals(test), comparisons, by)


def prediction_examples(test: DataFrame, rows: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Actual seven-day total of each series' first test rows, next to the forecasts of it."""
    return with_totals(first_test_rows(test, rows, keys)).select(
        *keys,
        DATE,
        F.col(DIRECT_TARGET).alias("actual"),
        F.col(forecast_name(DIRECT_TARGET)).alias("direct"),
        F.col("forecast_multi").alias("multi"),
        "baseline_28d",
    )


def improvement_over_baseline(comparison: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Improvement of the direct model's MAE over the 28-day baseline's."""

    def mae(model: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col("MAE")))

    sides = comparison.groupBy(*by).agg(
        mae("direct_7d").alias("direct_mae"), mae("baseline_28d").alias("baseline_mae")
    )
    gain = improvement_percent(F.col("direct_mae"), F.col("baseline_mae"))
    return sides.withColumn("improvement_percent", gain)
