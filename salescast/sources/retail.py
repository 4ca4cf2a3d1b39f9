"""A sales fact over the order-line test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescast.schema import AMOUNT, DATE, KEYS

# Series keys to choose from: column of the unit and of the item.
UNITS = {"nation": "s_nationkey", "supplier": "s_suppkey"}
ITEMS = {"type": "p_type", "brand": "p_brand"}

# Before the first ship date, so that a panel covers the whole table.
FIRST_DAY = "1995-01-01"


def retail_sales(spark: SparkSession, sf_dir: str, unit: str = "nation", item: str = "type") -> DataFrame:
    """One row per order line; returned lines count as negative.

    The joins carry no hint: the dimensions grow with the data, so the planner
    broadcasts them only below its size threshold.
    """
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    joined = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(part, line.l_partkey == part.p_partkey)
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return joined.select(
        F.col(UNITS[unit]).cast("long").alias(KEYS[0]),
        F.col(ITEMS[item]).alias(KEYS[1]),
        F.col("l_shipdate").cast("date").alias(DATE),
        signed.alias(AMOUNT),
    )
