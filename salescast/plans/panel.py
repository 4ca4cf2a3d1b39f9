"""Transactions to training panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from salescast.operators.daily import daily_sales, dense_daily, only_series, sales_scan
from salescast.operators.features import feature_rows
from salescast.schema import AMOUNT, DATE, HISTORY_START, KEYS, TIME_ZONE


def training_panel(
    sales: DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    amount: str = AMOUNT,
    start: str = HISTORY_START,
    holidays: DataFrame | None = None,
    time_zone: str = TIME_ZONE,
    partitions: int | None = None,
) -> DataFrame:
    """Features and targets of every usable day of every series in ``sales``.

    ``partitions`` is the number of tasks that fill and window the series, the
    session's shuffle partitions if not named.
    """
    scan = sales_scan(sales, keys, date, amount, start, time_zone)
    return feature_rows(dense_daily(daily_sales(scan, keys), keys, partitions=partitions), keys, holidays)


def series_panel(
    sales: DataFrame,
    values: Mapping[str, object],
    date: str = DATE,
    amount: str = AMOUNT,
    start: str = HISTORY_START,
    holidays: DataFrame | None = None,
    time_zone: str = TIME_ZONE,
) -> DataFrame:
    """The panel of the one series named by its key values, in date order.

    The filter sits below everything else, so it reaches the scan.
    """
    panel = training_panel(only_series(sales, values), list(values), date, amount, start, holidays, time_zone)
    return panel.orderBy(DATE)
