"""Division and casts that give NULL where ANSI mode would raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: decimal notation. The cast alone would also take the Java
# suffixes, as in "1d".
DECIMAL_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def ratio(numerator: Column, denominator: Column) -> Column:
    return numerator / F.nullif(denominator, F.lit(0.0))


def to_number(df: DataFrame, name: str) -> Column:
    """The column as double; text that is not a number becomes NULL."""
    column = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.when(column.rlike(DECIMAL_TEXT), F.trim(column).try_cast("double"))
    return column.try_cast("double")


def to_numbers(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({name: to_number(df, name) for name in names})
