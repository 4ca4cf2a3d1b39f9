"""Fact, request and forecast tables in files or the catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescast.operators.daily import dense_daily
from salescast.operators.features import feature_rows
from salescast.schema import DATE, KEYS, QUANTITY

REQUEST_KEYS = ("operational_unit_id", "item_id")

REQUEST_SCHEMA = T.StructType([T.StructField(name, T.LongType()) for name in REQUEST_KEYS])

SAMPLE_SCHEMA = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in ("feature_1", "feature_2", "feature_3", "target")]
)


def read_sales(
    spark: SparkSession, path: str | None = None, table: str | None = None, source: str = "parquet"
) -> DataFrame:
    """The transaction fact, from files or from a catalog table."""
    if (path is None) == (table is None):
        raise ValueError("name either a path or a table")
    return spark.table(table) if table else spark.read.format(source).load(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = SAMPLE_SCHEMA) -> DataFrame:
    """A CSV file with a header, read by an explicit schema."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def read_requests(
    spark: SparkSession, path: str, source: str = "json", schema: T.StructType = REQUEST_SCHEMA
) -> DataFrame:
    """Forecast requests, all of them: one with a missing identifier is answered as such."""
    return spark.read.format(source).schema(schema).load(path)


# The folder a day's answers are written to.
AS_OF = "as_of"


def write_forecasts(
    forecasts: DataFrame, path: str, source: str = "json", partition: str | None = None, as_of: str | None = None
) -> None:
    """Write the answers; missing values are written as null.

    With ``as_of`` they are the answers of that day and become its partition; with
    ``partition`` that column says which partition a row belongs to. Only the partitions
    that the rows have are replaced, so other days stay as they are.
    """
    if as_of is not None:
        forecasts, partition = forecasts.withColumn(AS_OF, F.lit(as_of)), AS_OF
    writer = forecasts.write.format(source).mode("overwrite")
    if source == "json":
        writer = writer.option("ignoreNullFields", False)
    if partition:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition)
    writer.save(path)


def store_daily(
    daily: DataFrame, table: str, buckets: int, keys: Sequence[str] = KEYS, path: str | None = None, source: str = "parquet"
) -> None:
    """Write daily sums as a catalog table, bucketed by series and sorted by day within each bucket.

    The rows are dealt as the buckets are, so each bucket is one file and needs no sort
    when it is read. ``path`` makes the table an external one.
    """
    rows = daily.select(*keys, DATE, QUANTITY).repartition(buckets, *keys).sortWithinPartitions(*keys, DATE)
    writer = rows.write.format(source).mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, DATE)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def stored_daily(spark: SparkSession, table: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """A table of ``store_daily``, with a row per series and day and each series in one partition."""
    return dense_daily(spark.table(table), keys, spread=False)


def stored_panel(
    spark: SparkSession, table: str, keys: Sequence[str] = KEYS, holidays: DataFrame | None = None
) -> DataFrame:
    """The training panel from a table of ``store_daily``: no shuffle, since the buckets are the series'."""
    return feature_rows(stored_daily(spark, table, keys), keys, holidays)
