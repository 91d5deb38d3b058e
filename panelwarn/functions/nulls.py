"""Missing-value semantics: pandas NaN means 'missing'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Turn NaN into NULL in every float column (or the given ones)."""
    targets = cols or [f.name for f in df.schema.fields
                       if isinstance(f.dataType, (DoubleType, FloatType))]
    if not targets:
        return df
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType))
                           for c in targets})


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a float column."""
    c = F.col(name)
    float_like = isinstance(df.schema[name].dataType, (DoubleType, FloatType))
    return c.isNull() | F.isnan(c) if float_like else c.isNull()


def sum_or_zero(col) -> Column:
    """Sum over an all-missing group is 0, as in pandas groupby.sum."""
    return F.coalesce(F.sum(_c(col)), F.lit(0))


def positive_flag(col, above: float = 0) -> Column:
    """(x > above) as 0/1, with missing x giving 0."""
    present = ~F.isnan(_c(col).cast("double"))  # Spark orders NaN above every number
    return F.coalesce(((_c(col) > F.lit(above)) & present).cast("int"), F.lit(0))
