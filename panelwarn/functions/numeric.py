"""Scalar helpers: rounding for cross-engine equality, interaction, thresholds, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round6(col) -> Column:
    """floor(x * 1e6 + 0.5) / 1e6: half-up to 6 decimals, identical in DuckDB."""
    return (F.floor(_c(col) * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).cast("double")


def interaction(a, b) -> Column:
    """F8: product of the current exogenous values."""
    return _c(a) * _c(b)


def threshold_class(proba, threshold) -> Column:
    """1 when probability >= threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (_c(proba) >= t).cast("int")


def percent_text(proba, digits: int = 2) -> Column:
    """probability as a percent string with fixed decimals, e.g. '12.35%'."""
    return F.concat(F.format_string(f"%.{digits}f", _c(proba) * F.lit(100.0)), F.lit("%"))


# Fixed values shown by the reference's result card.
ALERT_POSITIVE = "Outbreak Likely"
ALERT_NEGATIVE = "No Outbreak"


def alert_label(pred, positive: str = ALERT_POSITIVE, negative: str = ALERT_NEGATIVE) -> Column:
    """label text for the predicted class."""
    return F.when(_c(pred) == 1, F.lit(positive)).otherwise(F.lit(negative))


def split_yyyymm(key) -> tuple[Column, Column, Column]:
    """'YYYYMM' -> (valid, year, month); keys not of length 6 are invalid."""
    k = _c(key)
    valid = F.length(k) == 6
    year = F.when(valid, F.substring(k, 1, 4).try_cast("int"))
    month = F.when(valid, F.substring(k, 5, 2).try_cast("int"))
    return valid & year.isNotNull() & month.isNotNull(), year, month
