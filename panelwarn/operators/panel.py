"""Panel assembly: joins, filters, missing-value handling.

Plus the two helpers the reference's semantics need (SURVEY 2.13):
``collapse_panel`` (one row per entity and period) and ``densify_panel``
(calendar spine so that empty months become explicit zero-count rows).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from panelwarn.functions.nulls import is_missing
from panelwarn.operators.features import DROP_COLUMNS


def drop_if_present(df: DataFrame, cols: Sequence[str] = DROP_COLUMNS) -> DataFrame:
    """``df.drop`` already ignores names that are absent."""
    return df.drop(*cols)


def since_year(df: DataFrame, date_col: str, first_year: int) -> DataFrame:
    """P4 on a raw date or timestamp column: a comparison with a constant, which Parquet can use to skip row groups."""
    return df.filter(F.col(date_col) >= F.lit(dt.datetime(first_year, 1, 1)).cast(df.schema[date_col].dataType))


def filter_min_year(df: DataFrame, year_col: str, first_year: int) -> DataFrame:
    """P4 on a year column; where the source has a date, ``since_year`` lets the scan skip."""
    return df.filter(F.col(year_col) >= F.lit(first_year))


def complete_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any missing value (NaN counts as missing)."""
    return df.filter(reduce(lambda a, b: a & b, [~is_missing(df, c) for c in cols or df.columns], F.lit(True)))


def completeness_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Initial / kept / dropped row counts in one pass."""
    incomplete = reduce(lambda a, b: a | b, [is_missing(df, c) for c in cols or df.columns], F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("initial_rows"),
                  F.sum((~incomplete).cast("long")).alias("kept_rows"),
                  F.sum(incomplete.cast("long")).alias("dropped_rows"))


def observed_counts(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, Observation]:
    """P7, A10, A11 without a scan of their own: ``df``, and the counts that its next action collects.

    Keys of the observation: ``initial_rows``, ``kept_rows``, and ``missing_<i>`` for column i (NaN counts as missing).
    Write the frame with narrow operators only after it, so that a lost shuffle file does not count rows again.
    """
    names, seen = cols or df.columns, Observation()
    missing = [is_missing(df, c) for c in names]
    incomplete = reduce(lambda a, b: a | b, missing, F.lit(False))
    counted = df.observe(seen, F.count(F.lit(1)).alias("initial_rows"), F.count_if(~incomplete).alias("kept_rows"),
                         *[F.count_if(m).alias(f"missing_{i}") for i, m in enumerate(missing)])
    return counted, seen


def split_by_dimension(df: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None):
    """(rows whose key has a dimension row, keys without one)."""
    dk = dim.select(F.col(dim_key or key).alias(key)).distinct()
    return df.join(dk, key, "left_semi"), df.select(key).distinct().join(dk, key, "left_anti")


def missing_cell_count(df: DataFrame, cols: Sequence[str], name: str = "missing_cells") -> DataFrame:
    """Number of missing cells over the given columns."""
    total = reduce(lambda a, b: a + b, [is_missing(df, c).cast("long") for c in cols])
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).alias(name))


def union_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenation by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def collapse_panel(df: DataFrame, entity: str, time: str, value_cols: Sequence[str]) -> DataFrame:
    """Sum to one row per (entity, period); missing-only groups sum to 0."""
    return (df.filter(F.col(entity).isNotNull() & F.col(time).isNotNull())
              .groupBy(entity, time)
              .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in value_cols]))


def densify_panel(df: DataFrame, entity: str, time: str, value_col: str,
                  step: str = "month", fill=0) -> DataFrame:
    """Calendar spine per entity from its first to its last period; gaps get ``fill``.

    The spine is generated per entity from its own (min, max) bounds, so its
    size is the panel's size and it is built in parallel across entities.
    """
    bounds = df.groupBy(entity).agg(F.min(time).alias("_pw_lo"), F.max(time).alias("_pw_hi"))
    spine = bounds.select(entity, F.explode(F.sequence("_pw_lo", "_pw_hi",
                                                       F.expr(f"interval 1 {step}"))).alias(time))
    out = spine.join(df, [entity, time], "left")
    return out.withColumn(value_col, F.coalesce(F.col(value_col), F.lit(fill)))


def with_history(df: DataFrame, entity: str, order: Sequence[str], start_col: str, start,
                 rows: int) -> DataFrame:
    """Rows from ``start`` on plus the ``rows`` rows before it per entity.

    A filter on the order column cannot be pushed below a window (it would
    change lags), so callers cut with this helper before computing features and
    filter to ``start`` afterwards.
    """
    from panelwarn.operators.ordering import exact_row_number  # local: avoid cycle
    first = (df.filter(F.col(start_col) >= F.lit(start))
               .groupBy(entity).agg(F.min(start_col).alias("_pw_first")))
    numbered = exact_row_number(df, [entity], list(order), out="_pw_rn")
    firsts = numbered.join(first, entity).filter(F.col(start_col) == F.col("_pw_first")) \
                     .groupBy(entity).agg(F.min("_pw_rn").alias("_pw_rn0"))
    return (numbered.join(firsts, entity)
                    .filter(F.col("_pw_rn") >= F.col("_pw_rn0") - rows)
                    .drop("_pw_rn", "_pw_rn0"))
