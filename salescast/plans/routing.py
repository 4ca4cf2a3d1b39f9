"""Models chosen per series, and forecasts in which each row is answered by its own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescast.functions.metrics import compare, forecast_errors
from salescast.operators.baselines import forecast_name
from salescast.operators.selection import best_configuration
from salescast.plans.configurations import CONFIGURATIONS, Configuration
from salescast.plans.training import MODEL_FEATURES, VALIDATION, in_parallel, stage_rows, with_vector
from salescast.schema import ALL_TARGETS, KEYS
from salescast.sources.ledger import TUNING, FitLedger

# Models by target and configuration.
Models = Mapping[tuple[str, str], GBTRegressionModel]


def _column(target: str, configuration: str) -> str:
    return f"_{target}_{configuration}"


def tuned_models(
    ledger: FitLedger,
    targets: Sequence[str] = ALL_TARGETS,
    configurations: Sequence[Configuration] = CONFIGURATIONS,
    parallelism: int = 8,
) -> Models:
    """The models of all tuning fits, read from the ledger."""
    names = [(target, c.name) for target in targets for c in configurations]
    return dict(zip(names, in_parallel(ledger.spark, lambda name: ledger.model((TUNING, *name)), names, parallelism)))


def with_all_forecasts(rows: DataFrame, models: Models, features: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """A column of forecasts for each model, in one pass over the rows."""
    scored = with_vector(rows, features)
    for name, model in models.items():
        scored = model.setPredictionCol(_column(*name)).transform(scored)
    return scored


def tuning_by_series(
    spark: SparkSession,
    rows_path: str,
    models: Models,
    configurations: Sequence[Configuration] = CONFIGURATIONS,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Validation errors of every series, target and configuration, from one pass over the validation rows."""
    order = {c.name: place for place, c in enumerate(configurations)}
    comparisons = [
        compare(target, _column(target, name), target=target, config_order=order[name], configuration=name)
        for target, name in models
    ]
    validation = stage_rows(spark, rows_path, VALIDATION)
    return forecast_errors(with_all_forecasts(validation, models), comparisons, keys)


def series_routes(errors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The configuration each series' target is forecast with: the one of least error, ties to the first."""
    return best_configuration(errors, [*keys, "target"])


def forecast_routed(
    rows: DataFrame,
    routes: DataFrame,
    models: Models,
    default: Mapping[str, str],
    keys: Sequence[str] = KEYS,
    features: Sequence[str] = MODEL_FEATURES,
) -> DataFrame:
    """Forecasts of every target, each row's by the model that ``routes`` names for its series.

    ``routes`` has keys, target and configuration; a series without a route takes the
    ``default`` of the target. One pass: the forecast of a model is an expression inside a
    branch, so that only the branch of a row's own model is evaluated.
    """
    targets = list(dict.fromkeys(target for target, _ in models))
    wide = routes.groupBy(*keys).agg(
        *[F.max(F.when(F.col("target") == t, F.col("configuration"))).alias(f"_route_{t}") for t in targets]
    )
    scored = with_all_forecasts(rows.join(wide, list(keys), "left"), models, features)
    forecasts = {}
    for target in targets:
        route = F.coalesce(F.col(f"_route_{target}"), F.lit(default[target]))
        names = [name for t, name in models if t == target]
        chosen = F.lit(None).cast("double")
        for name in names:
            chosen = F.when(route == name, F.col(_column(target, name))).otherwise(chosen)
        forecasts[forecast_name(target)] = chosen
    helpers = [*[_column(*name) for name in models], *[f"_route_{t}" for t in targets], "features"]
    return scored.withColumns(forecasts).drop(*helpers)
