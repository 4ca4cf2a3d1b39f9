"""From transactions to one row per series and day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from salescast.schema import AMOUNT, DATE, HISTORY_START, KEYS, QUANTITY, TIME_ZONE
from salescast.session import shuffle_partitions


def sales_scan(
    sales: DataFrame,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    amount: str = AMOUNT,
    start: str = HISTORY_START,
    time_zone: str = TIME_ZONE,
) -> DataFrame:
    """The columns a forecast needs, from ``start`` on; dates become DATE.

    A moment becomes the day it has in ``time_zone``, whatever the session's zone.
    """
    day = F.col(date)
    if isinstance(sales.schema[date].dataType, T.TimestampType):
        day = F.convert_timezone(None, F.lit(time_zone), day.cast("timestamp_ntz"))
    rows = sales.select(*keys, day.cast("date").alias(DATE), F.col(amount).alias(AMOUNT))
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    return rows.where(F.col(DATE) >= F.lit(start).cast("date"))


def only_series(sales: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows of the one series named by its key values."""
    for key, value in values.items():
        sales = sales.where(F.col(key) == F.lit(value))
    return sales


def daily_sales(scan: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Quantity per series and day.

    The shuffle key includes the day and each task sums its rows first, so one
    series holding much of the table is spread over all its days. Afterwards a
    series has at most one row per day. Integers and decimals are summed in
    their own type, then turned into double.
    """
    return scan.groupBy(*keys, DATE).agg(F.sum(AMOUNT).cast("double").alias(QUANTITY))


def series_bounds(daily: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return daily.groupBy(*keys).agg(F.min(DATE).alias("min_date"), F.max(DATE).alias("max_date"))


def calendar_spine(daily: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every day from the first to the last sale of each series."""
    days = F.sequence("min_date", "max_date", F.expr("INTERVAL 1 DAY"))
    return series_bounds(daily, keys).select(*keys, F.explode(days).alias(DATE))


def spread_by_series(daily: DataFrame, keys: Sequence[str] = KEYS, partitions: int | None = None) -> DataFrame:
    """Bring each series' days into one partition.

    The partition number is given outright (the session's, if none is named):
    filling the gaps multiplies the rows, and adaptive execution would merge
    partitions by the size before it.
    """
    return daily.repartition(partitions or shuffle_partitions(daily.sparkSession), *keys)


def dense_daily(
    daily: DataFrame, keys: Sequence[str] = KEYS, spread: bool = True, partitions: int | None = None
) -> DataFrame:
    """One row per series and day from first to last sale, zero where nothing sold.

    Each sold day is stretched to the day before the next one, so the facts are
    read once and no spine has to be joined. ``spread`` is off where the days are
    partitioned by series already.
    """
    by_day = Window.partitionBy(*keys).orderBy(DATE)
    following = F.lead(DATE).over(by_day)
    until = F.coalesce(F.date_sub(following, 1), F.col(DATE))
    sold = (spread_by_series(daily, keys, partitions) if spread else daily).withColumn("_until", until)
    days = sold.select(
        *keys,
        QUANTITY,
        F.col(DATE).alias("_sold"),
        F.explode(F.sequence(F.col(DATE), F.col("_until"), F.expr("INTERVAL 1 DAY"))).alias(DATE),
    )
    quantity = F.when(F.col(DATE) == F.col("_sold"), F.coalesce(F.col(QUANTITY), F.lit(0.0))).otherwise(0.0)
    return days.select(*keys, DATE, quantity.alias(QUANTITY))
