"""Forecasts for requested series from their latest usable day."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salescast.functions.numeric import to_numbers
from salescast.operators.baselines import forecast_name, mean_forecast, multi_horizon_sum
from salescast.operators.daily import daily_sales, spread_by_series
from salescast.operators.features import LAGS, MONTH, add_calendar, add_ratios
from salescast.plans.training import MODEL_FEATURES, forecast_all
from salescast.schema import DATE, DIRECT_TARGET, FEATURES, HORIZON_DAYS, KEYS, QUANTITY, TARGETS
from salescast.sources.tables import REQUEST_KEYS

# Days between the last sale and the scored day. ``last`` starts from the last
# sale; ``labelled`` from the last day whose seven targets are known.
DAYS_BEFORE_LAST = {"last": 0, "labelled": HORIZON_DAYS}


def requested_daily(
    scan: DataFrame, requests: DataFrame, keys: Sequence[str] = KEYS, filter_first: bool = True
) -> DataFrame:
    """Daily sales of the requested series only, partitioned by series.

    ``filter_first`` drops other series' facts before the daily sum: right for a list
    that is short next to the series, which the planner then broadcasts. Otherwise the
    list is joined after the sum, where no series has more than one row per day.
    """
    wanted = requests.select(*keys).na.drop().distinct()
    if filter_first:
        return spread_by_series(daily_sales(scan.join(wanted, list(keys), "left_semi"), keys), keys)
    return spread_by_series(daily_sales(scan, keys), keys).join(wanted, list(keys), "left_semi")


def scoring_rows(
    daily: DataFrame,
    keys: Sequence[str] = KEYS,
    as_of: str = "last",
    holidays: DataFrame | None = None,
    spread: bool = True,
) -> DataFrame:
    """One row per series: the day it is forecast from, its features and ``status``.

    Once a series' last day is known, every lag and sum is a sum over its sold days
    by their distance from the scored day: no gap is filled and no day ordered. A
    series without 28 days before its scored day has ``insufficient_history``, and
    NULL features.
    """
    back = DAYS_BEFORE_LAST[as_of]
    series = Window.partitionBy(*keys)
    rows = spread_by_series(daily, keys) if spread else daily
    rows = rows.withColumns({"_first": F.min(DATE).over(series), "_last": F.max(DATE).over(series)})
    rows = rows.withColumn("_scored", F.greatest(F.col("_first"), F.date_sub("_last", back)))
    distance = F.datediff("_scored", DATE)
    quantity = F.coalesce(QUANTITY, F.lit(0.0))

    def total(first: int, last: int) -> Column:
        """Quantity of the days ``first`` to ``last`` before the scored day."""
        return F.coalesce(F.sum(F.when(distance.between(first, last), quantity)), F.lit(0.0))

    sums = {"quantity": total(0, 0)}
    sums |= {f"quantity_lag_{k}": total(k, k) for k in LAGS}
    sums |= {f"quantity_sum_{days}d": total(1, days) for days in (7, 14, 28, 56)}
    sums |= {f"quantity_sum_previous_{days}d": total(8, days + 7) for days in (7, 14, 28)}
    month = F.collect_list(F.when(distance.between(1, MONTH), quantity)).alias("_month")
    by_series = rows.groupBy(*keys, "_scored", "_first").agg(*[c.alias(name) for name, c in sums.items()], month)
    means = by_series.withColumns(
        {f"quantity_mean_{days}d": F.col(f"quantity_sum_{days}d") / days for days in (7, 14, 28)}
    )
    # Days without a sale are as far from the mean as the mean is from zero.
    centre = F.col("quantity_mean_28d")
    squares = F.aggregate(
        "_month", (MONTH - F.size("_month")) * centre * centre, lambda sum_, q: sum_ + (q - centre) * (q - centre)
    )
    means = means.withColumn("quantity_std_28d", F.sqrt(squares / (MONTH - 1))).withColumnRenamed("_scored", DATE)
    enough = F.datediff(DATE, "_first") >= MONTH
    values = [F.when(enough, F.col(name)).alias(name) for name in FEATURES]
    status = F.when(enough, "ok").otherwise("insufficient_history").alias("status")
    return add_calendar(add_ratios(means), holidays).select(*keys, DATE, *values, status)


def latest_features(
    daily: DataFrame,
    keys: Sequence[str] = KEYS,
    as_of: str = "last",
    holidays: DataFrame | None = None,
) -> DataFrame:
    """The latest usable feature row of each series that has one."""
    return scoring_rows(daily, keys, as_of, holidays).where(F.col("status") == "ok").drop("status")


def forecast_response(forecasts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per series: scored day, horizon forecasts by name, their sum, the direct forecast."""
    by_target = F.create_map(*[part for t in TARGETS for part in (F.lit(t), F.col(forecast_name(t)))])
    answers = {
        "last_date": F.date_format(DATE, "yyyy-MM-dd"),
        "predictions": by_target,
        "total_quantity_7d": multi_horizon_sum(),
        "direct_quantity_7d": F.col(forecast_name(DIRECT_TARGET)),
    }
    usable = F.col("status") == "ok"
    return forecasts.select(*keys, *[F.when(usable, c).alias(name) for name, c in answers.items()], "status")


def answer_requests(
    requests: DataFrame,
    responses: DataFrame,
    keys: Sequence[str] = KEYS,
    request_keys: Sequence[str] = REQUEST_KEYS,
) -> DataFrame:
    """Every request with its forecast.

    One for an unknown series has ``no_history``, one without all identifiers
    ``invalid_request``.
    """
    named = responses.withColumnsRenamed(dict(zip(keys, request_keys)))
    answered = requests.join(named, list(request_keys), "left")
    complete = reduce(and_, [F.col(key).isNotNull() for key in request_keys])
    unknown = F.when(complete, "no_history").otherwise("invalid_request")
    return answered.withColumn("status", F.coalesce("status", unknown))


def baseline_batch(
    daily: DataFrame, keys: Sequence[str] = KEYS, as_of: str = "last", spread: bool = True
) -> DataFrame:
    """Forecasts of the 28-day mean for every series."""
    return forecast_response(mean_forecast(scoring_rows(daily, keys, as_of, spread=spread)), keys)


def to_json_rows(answers: DataFrame) -> DataFrame:
    """Each answer as one JSON object; missing values are written as null."""
    options = {"ignoreNullFields": "false"}
    return answers.select(F.to_json(F.struct(*answers.columns), options).alias("response"))


def answers_of_models(
    scan: DataFrame,
    requests: DataFrame,
    forecast: Callable[[DataFrame], DataFrame],
    keys: Sequence[str] = KEYS,
    request_keys: Sequence[str] = REQUEST_KEYS,
    as_of: str = "last",
    holidays: DataFrame | None = None,
) -> DataFrame:
    """Answers to every request by ``forecast``, which adds every target's forecast to scoring rows."""
    wanted = requests.withColumnsRenamed(dict(zip(request_keys, keys)))
    rows = scoring_rows(requested_daily(scan, wanted, keys), keys, as_of, holidays, spread=False)
    forecasts = forecast(to_numbers(rows, FEATURES))
    return answer_requests(requests, forecast_response(forecasts, keys), keys, request_keys)


def predict_batch(
    scan: DataFrame,
    requests: DataFrame,
    models: dict[str, GBTRegressionModel],
    features: Sequence[str] = MODEL_FEATURES,
    keys: Sequence[str] = KEYS,
    request_keys: Sequence[str] = REQUEST_KEYS,
    as_of: str = "last",
    holidays: DataFrame | None = None,
) -> DataFrame:
    """The models' forecasts for every request, from the sales in ``scan``."""

    def forecast(rows: DataFrame) -> DataFrame:
        return forecast_all(rows, models, features)

    return answers_of_models(scan, requests, forecast, keys, request_keys, as_of, holidays)
