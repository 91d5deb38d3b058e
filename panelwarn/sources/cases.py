"""Case tables: raw CSV scan (S1), feature tables (S2, S3), source guard (S14), entity dimension."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwarn.functions.calendar import parse_date
from panelwarn.functions.nulls import nan_to_null
from panelwarn.schemas import FEATURE_COLUMNS

# Fixed values of the reference: the entity dimension (ISO code -> lat, lon).
ENTITY_COORDINATES = {
    "BGD": (23.6850, 90.3563),
    "THA": (15.8700, 100.9925),
    "IDN": (-0.7893, 113.9213),
    "IND": (20.5937, 78.9629),
    "LKA": (7.8731, 80.7718),
    "MMR": (21.9162, 95.9560),
    "NPL": (28.3949, 84.1240),
    "MDV": (3.2028, 73.2207),
    "TLS": (-8.8742, 125.7275),
    "BTN": (27.5142, 90.4336),
}


def require_source(path: str) -> None:
    """Fail early with a clear message when the input is absent.

    Only local paths (with or without ``file:``) can be checked this way;
    other URIs are left to the reader.
    """
    local = re.sub(r"^file:(//)?", "", path)
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", local) and not os.path.exists(local):
        raise FileNotFoundError(f"Input not found: {path}")


def entity_dimension(spark: SparkSession, coords: dict | None = None) -> DataFrame:
    """(iso, lat, lon) literal dimension; join it with a broadcast hint (10 rows)."""
    rows = [(k, float(a), float(b)) for k, (a, b) in (coords or ENTITY_COORDINATES).items()]
    return spark.createDataFrame(rows, "iso string, lat double, lon double")


def read_raw_cases(spark: SparkSession, path: str, entity: str = "ISO_A0", time: str = "calendar_start_date",
                   target: str = "dengue_total") -> DataFrame:
    """Header CSV read as strings (no schema inference pass), then typed with try_cast.

    Unparsable dates or counts become NULL instead of failing the job (ANSI mode).
    """
    require_source(path)
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    typed = raw.withColumn(time, parse_date(time)).withColumn(target, F.col(target).try_cast("double"))
    return nan_to_null(typed, [target])


def read_feature_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Feature or scoring table; parquet by default, header CSV with typed numbers otherwise."""
    require_source(path)
    if fmt == "parquet":
        return nan_to_null(spark.read.parquet(path))
    raw = spark.read.option("header", True).csv(path)
    numbers = {*FEATURE_COLUMNS, "dengue_total", "outbreak_flag", "prediction", "threshold_used"}
    typed = raw.select(*[F.col(c).try_cast("double").alias(c) if c in numbers else F.col(c) for c in raw.columns])
    if "calendar_start_date" in typed.columns:
        typed = typed.withColumn("calendar_start_date", parse_date("calendar_start_date"))
    return nan_to_null(typed)
