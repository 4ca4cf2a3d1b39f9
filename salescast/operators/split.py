"""Time-ordered splits with a gap, by position inside each series."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salescast.schema import DATE, GAP_DAYS, KEYS

MIN_VALIDATION_ROWS = 60
# One row to fit on, the gap, and the smallest validation part.
MIN_TRAIN_ROWS = 1 + GAP_DAYS + MIN_VALIDATION_ROWS


def with_position(panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``position`` (0 is the oldest row) and ``series_rows``."""
    series = Window.partitionBy(*keys)
    return panel.select(
        "*",
        (F.row_number().over(series.orderBy(DATE)) - 1).alias("position"),
        F.count(F.lit(1)).over(series).cast("int").alias("series_rows"),
    )


def temporal_split(panel: DataFrame, keys: Sequence[str] = KEYS, cutoff: str | None = None) -> DataFrame:
    """First 80 % of each series train, the next seven rows gap, the rest test.

    With ``cutoff`` the train part of every series ends on that date instead,
    so that a model of all series sees no series' days after another's test
    days began; the gap is the seven days after it.
    """
    train_rows = F.expr("int(4 * series_rows div 5)")
    is_train = F.col("position") < F.col("train_rows")
    is_gap = F.col("position") < F.col("train_rows") + GAP_DAYS
    if cutoff is not None:
        end = F.lit(cutoff).cast("date")
        is_train, is_gap = F.col(DATE) <= end, F.col(DATE) <= F.date_add(end, GAP_DAYS)
        train_rows = F.count_if(is_train).over(Window.partitionBy(*keys)).cast("int")
    label = F.when(is_train, "train").when(is_gap, "gap").otherwise("test")
    return with_position(panel, keys).withColumn("train_rows", train_rows).withColumn("split", label)


def common_cutoff(panel: DataFrame) -> str | None:
    """Last train date for all series: where 80 % of the days from the first to the last end.

    For a single series it is the last of the first 80 % of its rows. None for an empty panel.
    """
    return cutoff_of_days(*panel.agg(F.min(DATE), F.max(DATE)).first())


def cutoff_of_days(first: datetime.date | None, last: datetime.date | None) -> str | None:
    """Where 80 % of the days from ``first`` to ``last`` end."""
    if first is None:
        return None
    days = (last - first).days + 1
    return (first + datetime.timedelta(days=4 * days // 5 - 1)).isoformat()


def common_validation_start(panel: DataFrame, cutoff: str) -> str:
    """First validation date for all series: the last 20 % of the days up to ``cutoff``, at least 60."""
    return validation_start_of_days(panel.agg(F.min(DATE)).first()[0], cutoff)


def validation_start_of_days(first: datetime.date, cutoff: str) -> str:
    end = datetime.date.fromisoformat(cutoff)
    days = (end - first).days + 1
    return (end - datetime.timedelta(days=max(MIN_VALIDATION_ROWS, days // 5) - 1)).isoformat()


def stage(split: Column, tuning_part: Column) -> Column:
    """What a row is for: a part of the split, and in the train part that of the tuning."""
    return F.concat_ws("_", split, F.when(split == "train", F.coalesce(tuning_part, F.lit("short"))))


def dated_split(cutoff: str) -> Column:
    """The part a row is in when all train parts end on ``cutoff``."""
    date, end = F.col(DATE), F.lit(cutoff).cast("date")
    return F.when(date <= end, "train").when(date <= F.date_add(end, GAP_DAYS), "gap").otherwise("test")


def dated_stage(first: Column, cutoff: str, start: str) -> Column:
    """The ``stage`` of a row under common dates, from its date and its series' first date alone."""
    date, day = F.col(DATE), F.lit(start).cast("date")
    fit_before = F.date_sub(day, GAP_DAYS)
    part = F.when(date < fit_before, "fit").when(date < day, "gap").otherwise("validation")
    return stage(dated_split(cutoff), F.when((first < fit_before) & (first <= F.lit(cutoff).cast("date")), part))


def validation_split(split: DataFrame, start: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Divide each train part: ``fit``, ``gap``, then ``validation`` (its last 20 %, at least 60 rows).

    A train part too short for a fit row, a gap and 60 validation rows gets no
    validation: its ``tuning_part`` is NULL and ``tuning_status`` says why. With
    ``start`` the validation of every series begins on that date instead, so that
    no fit row of one is later than a validation row of another less the gap; a
    series without a fit row then has no tuning part.
    """
    if start is None:
        validation_rows = F.greatest(F.lit(MIN_VALIDATION_ROWS), F.expr("int(train_rows div 5)"))
        first = F.col("train_rows") - validation_rows
        enough = F.col("train_rows") >= MIN_TRAIN_ROWS
        is_fit, is_gap = F.col("position") < first - GAP_DAYS, F.col("position") < first
    else:
        day = F.lit(start).cast("date")
        is_fit, is_gap = F.col(DATE) < F.date_sub(day, GAP_DAYS), F.col(DATE) < day
        enough = F.max(is_fit & (F.col("split") == "train")).over(Window.partitionBy(*keys))
    part = (
        F.when(~enough | (F.col("split") != "train"), F.lit(None).cast("string"))
        .when(is_fit, "fit")
        .when(is_gap, "gap")
        .otherwise("validation")
    )
    return split.withColumns(
        {
            "tuning_part": part,
            "tuning_status": F.when(enough, "ok").otherwise("insufficient_history"),
        }
    )


def split_summary(split: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows, first and last date of each part of each series."""
    return split.groupBy(*keys, "split").agg(
        F.count(F.lit(1)).alias("rows"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date")
    )


def head_and_tail(df: DataFrame, rows: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """The first and the last ``rows`` rows of each series; ``preview`` tells which."""
    placed = with_position(df, keys)
    ends = F.array_compact(
        F.array(
            F.when(F.col("position") < rows, "head"),
            F.when(F.col("position") >= F.col("series_rows") - rows, "tail"),
        )
    )
    return placed.where(F.size(ends) > 0).select(*df.columns, F.explode(ends).alias("preview"))


def first_test_rows(split: DataFrame, rows: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """The first ``rows`` test rows of each series."""
    test = split.where(F.col("split") == "test")
    first = F.min("position").over(Window.partitionBy(*keys))
    return test.withColumn("_first", first).where(F.col("position") < F.col("_first") + rows).drop("_first")
