"""Distributed order primitives vs single-partition windows and numpy."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwarn.operators.ordering import exact_quantiles, exact_row_number, prefix_sums


def skewed(spark, n=6000):
    # one group holds a third of all rows
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 17).cast("string")))
        .alias("g"), F.col("id"), (F.xxhash64("id") % 1000).cast("double").alias("v"))


def test_exact_row_number(spark):
    df = skewed(spark)
    got = exact_row_number(df, ["g"], ["v", "id"], out="rn", num_partitions=7)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")).cast("long"))
    assert got.count() == df.count()
    assert got.exceptAll(ref.select(got.columns)).count() == 0


def test_exact_row_number_no_group(spark):
    df = skewed(spark, 2000)
    got = exact_row_number(df, [], ["id"], out="rn", num_partitions=5)
    assert got.filter(F.col("rn") != F.col("id") + 1).count() == 0


def test_prefix_sums(spark):
    df = skewed(spark)
    got = prefix_sums(df, ["g"], ["id"], ["v"], inclusive=False, num_partitions=6)
    ref = df.withColumn("v_cum", F.coalesce(F.sum("v").over(
        Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    assert got.exceptAll(ref.select(got.columns)).count() == 0


def test_exact_quantiles(spark):
    df = skewed(spark)
    probs = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {(r["g"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        for p in probs:
            assert abs(got[(g, p)] - np.quantile(part["v"].to_numpy(), p)) < 1e-9


def test_wide_quantiles(spark, monkeypatch):
    """All columns together equal numpy, whatever the limits; equal values, one value, none and missing ones."""
    import random

    from panelwarn.operators import ordering
    from panelwarn.operators import profile as A
    rnd = random.Random(4)
    rows = [(rnd.gauss(0, 5), float(rnd.choice([1, 1, 1, 2, 7])), 3.0, None if i % 3 else rnd.random() * 1e6, None,
             float("nan") if i % 5 == 0 else float(i)) for i in range(4001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    table = df.select(*[A._number(c).alias(c) for c in df.columns])
    for accuracy, limit in ((2000, 20_000), (50, 40), (30, 1)):
        monkeypatch.setattr(ordering, "ACCURACY", accuracy)
        monkeypatch.setattr(ordering, "BRACKET_VALUES", limit)
        got, row = ordering.wide_quantiles(table, df.columns, probs, {"m": F.avg("a")})
        for j, c in enumerate(df.columns):
            x = np.array([r[j] for r in rows if r[j] is not None and r[j] == r[j]])
            assert row[f"_n{j}"] == len(x)
            for p in probs:
                if len(x):
                    assert abs(got[c, p] - np.quantile(x, p)) < 1e-6
                else:
                    assert (c, p) not in got
    few = df.limit(0)
    assert A.describe(few, ["a", "b"]).count() == 0 and A.iqr_outliers(few, ["a"]).count() == 0
    assert {r["column"] for r in A.describe(df, ["a", "e"]).collect()} == {"a"}
