"""Sinks: feature table (S6), predictions (S7), attributions (S10), feature names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwarn.operators.panel import complete_rows, observed_counts


def write_feature_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> None:
    """Parquet by default (CSV with header on request)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_complete_features(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> dict:
    """S6 of the complete rows (P6), and what was counted on the way (P7, A10, A11): the one scan is the write's."""
    counted, seen = observed_counts(df)
    write_feature_table(complete_rows(counted), path, fmt, partition_by)
    got = seen.get
    rows = int(got["initial_rows"])
    columns = [{"column": c, "dtype": t, "non_null": rows - int(got[f"missing_{i}"]), "missing": int(got[f"missing_{i}"])}
               for i, (c, t) in enumerate(df.dtypes)]
    return {"initial_rows": rows, "kept_rows": int(got["kept_rows"]), "dropped_rows": rows - int(got["kept_rows"]),
            "columns": columns}


def write_predictions(df: DataFrame, path: str, keys=(), fmt: str = "csv") -> None:
    """(keys..., prediction, threshold_used)."""
    out = df.select(*keys, "prediction", "threshold_used")
    if fmt == "csv":
        out.write.mode("overwrite").option("header", True).csv(path)
    else:
        out.write.mode("overwrite").parquet(path)


def write_attributions(long_df: DataFrame, path: str) -> None:
    """Long attribution table (row_id, feature, value) as parquet."""
    long_df.write.mode("overwrite").parquet(path)


def feature_names(spark: SparkSession, meta: dict) -> DataFrame:
    """Ordered feature list from the run metadata as (position, feature)."""
    arr = F.array(*[F.lit(n) for n in meta["feature_columns"]])
    return spark.range(1).select(F.posexplode(arr).alias("position", "feature"))
