"""The training and forecasting jobs, from a sales table to stored results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame

from salescast.operators.daily import sales_scan
from salescast.plans.configurations import CONFIGURATIONS, Configuration
from salescast.plans.evaluation import horizon_metrics, model_comparison, prediction_examples
from salescast.plans.panel import training_panel
from salescast.plans.routing import Models, forecast_routed, series_routes, tuned_models, tuning_by_series
from salescast.plans.scoring import answers_of_models
from salescast.plans.training import TEST, TrainedRun, final_fits, forecast_all, stage_rows, train
from salescast.schema import AMOUNT, DATE, HISTORY_START, KEYS, TIME_ZONE
from salescast.sources import registry
from salescast.sources.tables import REQUEST_KEYS, write_forecasts


def run_training(
    sales: DataFrame,
    root: str,
    run_id: str,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    amount: str = AMOUNT,
    start: str = HISTORY_START,
    time_zone: str = TIME_ZONE,
    holidays: DataFrame | None = None,
    configurations: Sequence[Configuration] = CONFIGURATIONS,
    parallelism: int = 4,
    cutoff: str | None = None,
    partitions: int | None = None,
    by_series: bool = False,
) -> TrainedRun:
    """Train on all series, evaluate on their test parts, and store everything under ``root``.

    How the panel was made is stored with the run, and forecasts are made in the same
    way. The test forecasts are written once; all reports read them from there. A run
    that has no train row is stored with its status and without models. A run that was
    broken off and is started again with the same settings goes on from its stored rows
    and finished fits.

    With ``by_series`` each series takes the configuration that was best for it, and its
    forecasts come from that configuration's models.
    """
    spark = sales.sparkSession
    kinds = dict(sales.select(*keys).dtypes)
    settings = registry.Settings(
        keys=tuple(keys),
        key_types=tuple(kinds[key] for key in keys),
        date=date,
        amount=amount,
        time_zone=time_zone,
        start=start,
        own_holidays=holidays is not None,
        cutoff=cutoff,
        by_series=by_series,
    )
    registry.start_run(spark, root, run_id, settings)
    panel = training_panel(sales, keys, date, amount, start, holidays, time_zone, partitions)
    run = train(
        panel,
        configurations=configurations,
        keys=keys,
        rows_path=f"{root}/training_rows/{run_id}",
        parallelism=parallelism,
        cutoff=cutoff,
        # The choice by series is made of the same fits.
        identity=repr(replace(settings, by_series=False)),
    )
    routes, routed = None, None
    if by_series and run.status == "ok":
        routes, routed = _routes(run, configurations, keys, parallelism)
    reports = {}
    if run.models:
        forecasts_path = f"{root}/test_forecasts/{run_id}"
        forecasts = run.test_forecasts(spark)
        if routes is not None:
            forecasts = forecast_routed(stage_rows(spark, run.rows_path, TEST), routes, routed, run.best, keys)
        forecasts.write.mode("overwrite").parquet(forecasts_path)
        test = spark.read.parquet(forecasts_path)
        reports = {
            "metrics": model_comparison(test),
            "horizons": horizon_metrics(test),
            "examples": prediction_examples(test, keys=keys),
        }
    settings = replace(
        settings,
        cutoff=run.cutoff,
        validation_start=run.validation_start,
        status=run.status,
        by_series=routes is not None,
    )
    registry.save_run(
        run, reports, root, run_id, settings, configurations=configurations, holidays=holidays, routes=routes, routed=routed
    )
    return run


def _routes(
    run: TrainedRun, configurations: Sequence[Configuration], keys: Sequence[str], parallelism: int
) -> tuple[DataFrame, Models]:
    """Each series' configurations by its own validation errors, and the final models that they and the default need."""
    spark = run.tuning.sparkSession
    tuned = tuned_models(run.ledger, list(run.models), configurations)
    errors = tuning_by_series(spark, run.rows_path, tuned, configurations, keys)
    path = f"{run.rows_path}_routes"
    series_routes(errors, keys).write.mode("overwrite").parquet(path)
    routes = spark.read.parquet(path)
    # At most a row for each target and configuration.
    used = {(r["target"], r["configuration"]) for r in routes.select("target", "configuration").distinct().collect()}
    by_name = {c.name: c for c in configurations}
    wanted = [(target, by_name[name]) for target, name in sorted(used | set(run.best.items()))]
    return routes, final_fits(spark, run.rows_path, wanted, run.variances, run.ledger, parallelism)


def forecasts_of_run(
    sales: DataFrame,
    requests: DataFrame,
    root: str,
    run_id: str,
    request_keys: Sequence[str] = REQUEST_KEYS,
    as_of: str = "last",
) -> DataFrame:
    """A stored run's forecasts for every request, from rows made as the run's settings say."""
    spark = sales.sparkSession
    settings = registry.run_settings(spark, root, run_id)
    models = registry.load_models(spark, root, run_id, settings)
    if not models:
        raise ValueError(f"run {run_id} has no models: {settings.status}")
    scan = sales_scan(sales, settings.keys, settings.date, settings.amount, settings.start, settings.time_zone)
    features = registry.model_features(spark, root, run_id)

    def forecast(rows: DataFrame) -> DataFrame:
        if not settings.by_series:
            return forecast_all(rows, models, features)
        return forecast_routed(rows, *registry.load_routed(spark, root, run_id), settings.keys, features)

    holidays = registry.run_holidays(spark, root, run_id, settings)
    return answers_of_models(scan, requests, forecast, settings.keys, request_keys, as_of, holidays)


def run_forecast(
    sales: DataFrame,
    requests: DataFrame,
    root: str,
    run_id: str,
    path: str,
    request_keys: Sequence[str] = REQUEST_KEYS,
    as_of: str = "last",
    publish_day: str | None = None,
) -> None:
    """Answer every request with a stored run's models and write the answers as JSON.

    With ``publish_day`` they become that day's partition of ``path``, and the answers of
    other days stay; a rerun replaces its own day.
    """
    answers = forecasts_of_run(sales, requests, root, run_id, request_keys, as_of)
    write_forecasts(answers, path, as_of=publish_day)
