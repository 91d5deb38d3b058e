"""Proxy panels derived from the driver tables (FIXTURES.md 2.1).

* cases: orders of customers counted per nation and order month
  (entity = nation name, time = month start, target = count).
* raw case rows: one row per order, tiebreak = o_orderkey.
* weather: lineitem of suppliers per nation and ship month, two covariates
  built from exact integer sums divided once.

Every join here is on a dimension key; the dimension sides (nation, customer,
supplier) are left to the planner: AQE broadcasts them when their measured size
is small and uses a shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwarn.operators.panel import since_year
from panelwarn.sources.tables import read_table


def order_rows(spark: SparkSession, sf_dir: str, first_year: int | None = None) -> DataFrame:
    """Raw case rows: (entity, order_date DATE, o_orderkey, o_totalprice), optionally from a year on."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    o = o if first_year is None else since_year(o, "o_orderdate", first_year)
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, c.c_nationkey == n.n_nationkey)
             .select(F.col("n_name").alias("entity"),
                     F.col("o_orderdate").cast("date").alias("order_date"),
                     "o_orderkey", "o_totalprice"))


def case_panel(spark: SparkSession, sf_dir: str, first_year: int | None = None) -> DataFrame:
    """Monthly count panel: (entity, month_start DATE, cases BIGINT)."""
    rows = order_rows(spark, sf_dir, first_year)
    return (rows.groupBy("entity", F.trunc("order_date", "month").alias("month_start"))
                .agg(F.count(F.lit(1)).alias("cases")))


def _weather_rows(spark: SparkSession, sf_dir: str, first_year: int | None = None) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity", "l_discount", "l_shipdate")
    li = li if first_year is None else since_year(li, "l_shipdate", first_year)
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)


def _weather_aggs():
    return [(F.sum(F.col("l_quantity").cast("long")).cast("double") / F.count(F.lit(1))).alias("temperature_c"),
            (F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double")
             / F.count(F.lit(1))).alias("precipitation_mm")]


def weather_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly covariates: (entity, year INT, month INT, temperature_c, precipitation_mm)."""
    j = _weather_rows(spark, sf_dir)
    return (j.groupBy(F.col("n_name").alias("entity"),
                      F.year("l_shipdate").cast("int").alias("year"),
                      F.month("l_shipdate").cast("int").alias("month"))
             .agg(*_weather_aggs()))


def weather_by_month(spark: SparkSession, sf_dir: str, first_year: int | None = None) -> DataFrame:
    """The same covariates keyed by (entity, month_start), the case panel's key."""
    j = _weather_rows(spark, sf_dir, first_year)
    return (j.groupBy(F.col("n_name").alias("entity"),
                      F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month_start"))
             .agg(*_weather_aggs()))


def sparse_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather with gaps: nations without any (key divisible by 9), months without (quantity divisible
    by 7), and months whose second covariate is NaN (remainder 1)."""
    j = _weather_rows(spark, sf_dir).filter(F.col("n_nationkey") % 9 != 0)
    g = (j.groupBy(F.col("n_name").alias("entity"),
                   F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month_start"))
          .agg(F.sum(F.col("l_quantity").cast("long")).alias("_q"), *_weather_aggs()).filter(F.col("_q") % 7 != 0))
    rain = F.when(F.col("_q") % 7 == 1, F.lit(float("nan"))).otherwise(F.col("precipitation_mm"))
    return g.withColumn("precipitation_mm", rain).drop("_q")


def sparse_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases LEFT JOIN the weather with gaps: rows with and without missing cells."""
    j = case_panel(spark, sf_dir).join(sparse_weather(spark, sf_dir), ["entity", "month_start"], "left")
    return j.select("entity", "month_start", "cases", "temperature_c", "precipitation_mm")


def joined_panel(spark: SparkSession, sf_dir: str, first_year: int | None = None) -> DataFrame:
    """J1 on the proxies: cases LEFT JOIN weather on (entity, year, month).

    Both sides are aggregated on (entity, month_start), which identifies the
    same (entity, year, month) cell; joining on it lets the join reuse the two
    aggregates' hash partitioning instead of shuffling both sides again.
    """
    c = case_panel(spark, sf_dir, first_year)
    w = weather_by_month(spark, sf_dir, first_year)
    j = c.join(w, ["entity", "month_start"], "left")
    return j.select("entity", F.year("month_start").cast("int").alias("year"),
                    F.month("month_start").cast("int").alias("month"), "month_start", "cases",
                    "temperature_c", "precipitation_mm")
