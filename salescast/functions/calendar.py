"""Calendar columns and the public-holiday dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The season uses this approximation of pi and this year length.
PI = 3.14159265359
YEAR_LENGTH = 365.25

# Fixed values: (month, day) of the holidays with a fixed date, and the days
# after Easter Sunday of the movable ones.
FIXED_HOLIDAYS = [(1, 1), (5, 1), (5, 8), (7, 14), (8, 15), (11, 1), (11, 11), (12, 25)]
DAYS_AFTER_EASTER = [1, 39, 50]


def day_of_week(date: Column) -> Column:
    """Monday 0 to Sunday 6."""
    return F.weekday(date)


def is_weekend(date: Column) -> Column:
    return F.when(F.weekday(date) >= 5, 1).otherwise(0)


def season_angle(date: Column) -> Column:
    return F.lit(2 * PI) * F.dayofyear(date) / F.lit(YEAR_LENGTH)


def calendar_columns(date: Column) -> dict[str, Column]:
    return {
        "day_of_week": day_of_week(date),
        "month": F.month(date),
        "day_of_year": F.dayofyear(date),
        "sin_day_of_year": F.sin(season_angle(date)),
        "cos_day_of_year": F.cos(season_angle(date)),
        "is_weekend": is_weekend(date),
    }


def easter_sunday(year: Column) -> Column:
    """Date of Easter Sunday in the Gregorian calendar (Gauss's rule).

    ``moon`` is the days from 21 March to the Paschal full moon, ``sunday`` the
    days from there to the next Sunday.
    """
    century = F.floor(year / 100)
    lunar = F.pmod(15 + century - F.floor(century / 4) - F.floor((8 * century + 13) / 25), F.lit(30))
    solar = F.pmod(4 + century - F.floor(century / 4), F.lit(7))
    golden = F.pmod(year, F.lit(19))
    moon = F.pmod(19 * golden + lunar, F.lit(30))
    sunday = F.pmod(2 * F.pmod(year, F.lit(4)) + 4 * F.pmod(year, F.lit(7)) + 6 * moon + solar, F.lit(7))
    late = (sunday == 6) & ((moon == 29) | ((moon == 28) & (golden > 10)))
    days = moon + sunday + F.when(late, -7).otherwise(0)
    return F.date_add(F.make_date(year, F.lit(3), F.lit(22)), days.cast("int"))


def holidays_of_years(years: DataFrame, year: str = "year") -> DataFrame:
    """One row per holiday of each year in ``years`` (one row per year).

    Two rules can fall on the same day (8 May 1997 is also Ascension), so each
    year's dates are made distinct; otherwise a join would duplicate rows.
    """
    easter = easter_sunday(F.col(year))
    fixed = [F.make_date(F.col(year), F.lit(month), F.lit(day)) for month, day in FIXED_HOLIDAYS]
    movable = [F.date_add(easter, days) for days in DAYS_AFTER_EASTER]
    return years.select(F.explode(F.array_distinct(F.array(*fixed, *movable))).alias("holiday_date"))


def is_holiday(date: Column) -> Column:
    """1 on a holiday of the rule, in any year, else 0."""
    month_day = F.month(date) * 100 + F.dayofmonth(date)
    fixed = month_day.isin([month * 100 + day for month, day in FIXED_HOLIDAYS])
    movable = F.datediff(date, easter_sunday(F.year(date))).isin(DAYS_AFTER_EASTER)
    return F.when(fixed | movable, 1).otherwise(0)


def with_holiday_flag(df: DataFrame, date: str, holidays: DataFrame | None = None) -> DataFrame:
    """Add ``is_holiday``: by the rule, or 1 where ``date`` is in the caller's table (column ``holiday_date``).

    The planner broadcasts the caller's table if it is small.
    """
    if holidays is None:
        return df.withColumn("is_holiday", is_holiday(F.col(date)))
    dates = holidays.select(F.col("holiday_date").cast("date").alias("_holiday")).distinct()
    flagged = df.join(dates, df[date] == F.col("_holiday"), "left")
    return flagged.withColumn("is_holiday", F.col("_holiday").isNotNull().cast("int")).drop("_holiday")
