"""Scaling and class weights (M3, M6, M7).

Fitted statistics are a handful of scalars per column (bounded by the column
count); they are computed by one aggregate and inlined as literals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class StandardScalerModel:
    """(x - mean) / population std, std 0 -> 1 (sklearn StandardScaler semantics)."""
    columns: list[str]
    means: dict[str, float]
    stds: dict[str, float]

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        out = {}
        for c in self.columns:
            sd = self.stds[c]
            sd = 1.0 if sd is None or sd == 0 else sd
            out[f"{c}{suffix}"] = (F.col(c) - F.lit(self.means[c])) / F.lit(sd)
        return df.withColumns(out)


def fit_standard_scaler(df: DataFrame, cols: Sequence[str]) -> StandardScalerModel:
    """M3: fit on (training) rows only; one aggregate for all columns."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return StandardScalerModel(list(cols), {c: row[f"m{i}"] for i, c in enumerate(cols)},
                               {c: row[f"s{i}"] for i, c in enumerate(cols)})


def class_counts_map(df: DataFrame, label: str) -> dict:
    """Class -> count (number of classes is small)."""
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def balanced_weights(df: DataFrame, label: str, name: str = "weight",
                     counts_from: DataFrame | None = None) -> DataFrame:
    """M6: w_c = n / (k * n_c) (sklearn 'balanced'), as a column.

    ``counts_from`` (default ``df``) is the frame whose class counts define the
    weights, e.g. the training rows when validation rows ride along.
    """
    counts = class_counts_map(counts_from if counts_from is not None else df, label)
    n, k = sum(counts.values()), len(counts)
    expr = F.lit(None).cast("double")
    for c, nc in counts.items():
        expr = F.when(F.col(label) == F.lit(c), F.lit(n / (k * nc))).otherwise(expr)
    return df.withColumn(name, expr)


def positive_class_weight(df: DataFrame, label: str) -> DataFrame:
    """M7: neg / pos as one row (1.0 when there are no positives)."""
    g = df.agg(F.sum((F.col(label) == 0).cast("long")).alias("neg"),
               F.sum((F.col(label) == 1).cast("long")).alias("pos"))
    return g.select(F.coalesce(F.col("neg"), F.lit(0)).alias("neg"), F.coalesce(F.col("pos"), F.lit(0)).alias("pos"),
                    F.when(F.coalesce(F.col("pos"), F.lit(0)) > 0, F.col("neg") / F.col("pos"))
                    .otherwise(F.lit(1.0)).alias("scale_pos_weight"))
