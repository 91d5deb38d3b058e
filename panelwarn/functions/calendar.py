"""Calendar and cyclical features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: the rainy-season months and the
# cyclical periods (12 for month, 365 for day of year; day 366 is not clamped).
RAINY_SEASON_MONTHS = (6, 7, 8, 9, 10)
MONTH_PERIOD = 12
DAY_OF_YEAR_PERIOD = 365
FIRST_WEATHER_YEAR = 1981


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_date(col) -> Column:
    """string / timestamp -> DATE; unparsable values become NULL (no ANSI error)."""
    return _c(col).try_cast("date")


def year_of(col) -> Column:
    return F.year(_c(col)).cast("int")


def month_of(col) -> Column:
    return F.month(_c(col)).cast("int")


def day_of_year(col) -> Column:
    return F.dayofyear(_c(col)).cast("int")


def iso_week(col) -> Column:
    """ISO-8601 week number (week 1 contains the first Thursday)."""
    return F.weekofyear(_c(col)).cast("int")


def quarter_of(month_col) -> Column:
    """(month - 1) // 3 + 1, computed from a month number."""
    return (F.floor((_c(month_col) - 1) / 3) + 1).cast("int")


def season_flag(month_col, months=RAINY_SEASON_MONTHS) -> Column:
    """1 when the month is in the season, 0 otherwise (also for NULL)."""
    return F.coalesce(_c(month_col).isin(*months).cast("int"), F.lit(0))


def cyclical(col, period: float) -> tuple[Column, Column]:
    """(sin, cos) of 2*pi*x/period."""
    angle = F.lit(2 * math.pi) * _c(col) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def year_clamp(col, lowest: int = FIRST_WEATHER_YEAR) -> Column:
    """max(lowest, year)."""
    return F.greatest(F.lit(lowest), _c(col))


def scenario_week_of_year(year_col, month_col) -> Column:
    """simplified week of the first day of the month: ceil(days/7) + 1."""
    first = F.make_date(_c(year_col), _c(month_col), F.lit(1))
    jan1 = F.make_date(_c(year_col), F.lit(1), F.lit(1))
    return (F.ceil(F.datediff(first, jan1) / F.lit(7.0)) + 1).cast("int")
