"""Profiling (A1-A22, T2): one-pass aggregates, exact quantiles, correlations.

Wide statistics are computed per column in a single aggregate and returned as
long tables (one row per column), the shape a report needs.  Exact quantiles of
whole columns come from ``ordering.wide_quantiles`` (counting passes over
brackets), those of groups from ``ordering.exact_quantiles``; no single task
holds all values of a column.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwarn.functions.nulls import is_missing
from panelwarn.operators.ordering import exact_quantiles, wide_quantiles

QUARTILES = (0.25, 0.5, 0.75)
# Fixed value of the reference: the percentiles of its target profile.
TARGET_PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
IQR_FACTOR = 1.5
HIST_BINS = 50


def _scalar(df: DataFrame, expr):
    return df.agg(expr.alias("v")).first()["v"]


def _number(col: str):
    """The column as DOUBLE with every missing value NULL."""
    return F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))


def to_long(df: DataFrame, cols: Sequence[str], name: str = "column", value: str = "value",
            ids: Sequence[str] = ()) -> DataFrame:
    """Unpivot numeric columns to (ids..., column, value DOUBLE); NaN becomes NULL."""
    casted = df.select(*ids, *[_number(c).alias(c) for c in cols])
    return casted.unpivot(list(ids), list(cols), name, value)


def total(df: DataFrame, col: str, name: str = "total") -> DataFrame:
    """A1: global total; an empty or all-missing column sums to 0."""
    return df.agg(F.coalesce(F.sum(col), F.lit(0)).alias(name))


def total_by(df: DataFrame, by: Sequence[str], col: str, name: str = "total") -> DataFrame:
    """A2/A4: totals per key (NULL keys dropped as pandas groupby does), largest first."""
    keyed = df
    for b in by:
        keyed = keyed.filter(F.col(b).isNotNull())
    return (keyed.groupBy(*by).agg(F.coalesce(F.sum(col), F.lit(0)).alias(name))
                 .orderBy(F.col(name).desc(), *by))


def share_by(df: DataFrame, by: Sequence[str], col: str, name: str = "share_pct") -> DataFrame:
    """A3: total per key and its percent of the grand total (scalar, no global window)."""
    grand = _scalar(df, F.sum(col)) or 0
    g = df.groupBy(*by).agg(F.coalesce(F.sum(col), F.lit(0)).alias("total"))
    return g.withColumn(name, F.col("total").cast("double") * 100.0 / F.lit(float(grand) or float("nan")))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """A5."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct()


def min_max(df: DataFrame, col: str) -> DataFrame:
    """A6."""
    return df.agg(F.min(col).alias(f"min_{col}"), F.max(col).alias(f"max_{col}"))


def describe(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = QUARTILES) -> DataFrame:
    """Count, mean, sample std, min, quantiles, max per column (long form).

    Moments come with the quantiles' first pass over the table; quantile
    columns are named ``p<100*q>`` (e.g. p25, p50, p75).  A column without
    values has no row.
    """
    table = df.select(*[_number(c).alias(f"c{i}") for i, c in enumerate(cols)])
    names = [f"c{i}" for i in range(len(cols))]
    extra = {f"{m}_{n}": f(n) for n in names for m, f in (("mean", F.avg), ("std", F.stddev_samp))}
    q, row = wide_quantiles(table, names, probs, extra)
    rows = [(c, row[f"_n{i}"], row[f"mean_c{i}"], row[f"std_c{i}"], row[f"_min{i}"], row[f"_max{i}"],
             *[q[f"c{i}", float(p)] for p in probs]) for i, c in enumerate(cols) if row[f"_n{i}"]]
    kinds = "column string, count long, mean double, std double, min double, max double"
    return df.sparkSession.createDataFrame(rows, kinds + "".join(f", p{round(p * 100)} double" for p in probs))


def describe_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, unique, top (most frequent, ties by smallest value), freq."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    long = long.filter(F.col("value").isNotNull())
    freq = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = freq.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v"))).alias("_top"))
    return best.select("column", "count", "unique", F.col("_top.v").alias("top"),
                       (-F.col("_top.neg")).alias("freq"))


def percentiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = TARGET_PERCENTILES) -> DataFrame:
    """(column, prob, quantile) with linear interpolation."""
    table = df.select(*[_number(c).alias(f"c{i}") for i, c in enumerate(cols)])
    q, _ = wide_quantiles(table, [f"c{i}" for i in range(len(cols))], probs)
    rows = [(c, float(p), q[f"c{i}", float(p)]) for i, c in enumerate(cols) for p in probs if (f"c{i}", float(p)) in q]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, quantile double")


def table_info(df: DataFrame) -> DataFrame:
    """A10: (position, column, dtype, non_null, rows) from one aggregate."""
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count(F.col(c)).alias(f"_nn{i}")
                                                  for i, c in enumerate(df.columns)]
    wide = df.agg(*aggs)
    entries = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                                 F.lit(t).alias("dtype"), F.col(f"_nn{i}").alias("non_null"))
                        for i, (c, t) in enumerate(df.dtypes)])
    return wide.select(F.col("_rows").alias("rows"), F.inline(entries))


def missing_per_column(df: DataFrame) -> DataFrame:
    """(column, missing) with NaN counted as missing for float columns."""
    wide = df.agg(*[F.sum(is_missing(df, c).cast("long")).alias(f"_m{i}") for i, c in enumerate(df.columns)])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"_m{i}"), F.lit(0)).alias("missing"))
                        for i, c in enumerate(df.columns)])
    return wide.select(F.inline(entries))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, count, share_pct)."""
    n = df.count()
    g = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("share_pct", F.col("count") * 100.0 / F.lit(float(n) if n else float("nan")))


def class_by_entity(df: DataFrame, entity: str, flag: str, digits: int | None = 2) -> DataFrame:
    """Counts of flag 0 / 1 per entity, total and percent positive."""
    g = df.groupBy(entity).agg(F.sum((F.col(flag) == 0).cast("long")).alias("n_0"),
                               F.sum((F.col(flag) == 1).cast("long")).alias("n_1"))
    g = g.withColumn("total", F.col("n_0") + F.col("n_1"))
    pct = F.col("n_1") * 100.0 / F.col("total")
    return g.withColumn("pct_1", F.bround(pct, digits) if digits is not None else pct)  # ties to even


def positive_rate(df: DataFrame, entity: str, flag: str) -> DataFrame:
    """Mean of the flag per entity, highest first."""
    return df.groupBy(entity).agg(F.avg(flag).alias("positive_rate")).orderBy(F.desc("positive_rate"), entity)


def seasonal_mean(df: DataFrame, period_col: str, col: str) -> DataFrame:
    """Mean per calendar period (e.g. month)."""
    return df.groupBy(period_col).agg(F.avg(col).alias(f"mean_{col}"))


def iqr_outliers(df: DataFrame, cols: Sequence[str], factor: float = IQR_FACTOR) -> DataFrame:
    """Q1, Q3, bounds, outlier count and share of all rows (missing included); none for a column without values."""
    table = df.select(*[_number(c).alias(f"c{i}") for i, c in enumerate(cols)])
    q, _ = wide_quantiles(table, [f"c{i}" for i in range(len(cols))], (0.25, 0.75))
    bounds = {}
    for i, c in enumerate(cols):
        if (f"c{i}", 0.25) in q:
            q1, q3 = q[f"c{i}", 0.25], q[f"c{i}", 0.75]
            bounds[i] = (c, q1, q3, q3 - q1, q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    far = [F.coalesce(F.sum(((F.col(f"c{i}") < b[4]) | (F.col(f"c{i}") > b[5])).cast("long")), F.lit(0)).alias(f"o{i}")
           for i, b in bounds.items()]
    row = table.agg(F.count(F.lit(1)).alias("rows"), *far).first()
    out = [(*b, row["rows"], row[f"o{i}"], row[f"o{i}"] * 100.0 / row["rows"]) for i, b in bounds.items()]
    return df.sparkSession.createDataFrame(out, "column string, q1 double, q3 double, iqr double, lower double, upper double, "
                                                "rows long, outliers long, outlier_pct double")


def correlation_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations as (a, b, corr), both triangles + diagonal."""
    pairs = list(combinations(range(len(cols)), 2))
    # missing values become NULL once, below the aggregate; corr itself leaves out a pair with a NULL
    table = df.select(*[_number(c).alias(f"c{i}") for i, c in enumerate(cols)])
    wide = table.agg(*[F.corr(f"c{i}", f"c{j}").alias(f"_c{i}_{j}") for i, j in pairs], F.lit(1).alias("_one"))
    entry = lambda a, b, v: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), v.alias("corr"))
    entries = [e for i, j in pairs for e in (entry(cols[i], cols[j], F.col(f"_c{i}_{j}")),
                                             entry(cols[j], cols[i], F.col(f"_c{i}_{j}")))]
    return wide.select(F.inline(F.array(*entries, *[entry(c, c, F.lit(1.0)) for c in cols])))


def top_correlated(df: DataFrame, cols: Sequence[str], target: str, k: int = 10) -> DataFrame:
    """Top-k features by |corr| with the target (the target itself ranks first)."""
    names = [c for c in cols if c != target]
    table = df.select(_number(target).alias("_y"), *[_number(c).alias(f"c{i}") for i, c in enumerate(names)])
    wide = table.agg(*[F.corr(f"c{i}", "_y").alias(f"_c{i}") for i in range(len(names))])
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"_c{i}").alias("corr")) for i, c in enumerate(names)]
    entries.append(F.struct(F.lit(target).alias("feature"), F.lit(1.0).alias("corr")))
    long = wide.select(F.inline(F.array(*entries))).withColumn("abs_corr", F.abs("corr"))
    return long.orderBy(F.desc("abs_corr"), "feature").limit(k)


def histogram(df: DataFrame, col: str, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width bins between min and max; the max falls in the last bin."""
    df = df.select(_number(col).alias(col)).filter(F.col(col).isNotNull())
    row = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, count long")
    width = (float(hi) - float(lo)) / bins if hi != lo else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(float(lo))) / F.lit(width)), F.lit(bins - 1)).cast("int")
    g = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return g.select("bin", (F.lit(float(lo)) + F.col("bin") * F.lit(width)).alias("lower"),
                    (F.lit(float(lo)) + (F.col("bin") + 1) * F.lit(width)).alias("upper"), "count")


def box_stats(df: DataFrame, group: str, col: str, factor: float = IQR_FACTOR) -> DataFrame:
    """Quartiles per group and whiskers = extreme values within factor*IQR."""
    vals = df.select(group, _number(col).alias("value")).filter(F.col("value").isNotNull())
    q = exact_quantiles(vals, [group], "value", QUARTILES)
    qq = q.groupBy(group).agg(*[F.first(F.when(F.col("prob") == p, F.col("quantile")), True).alias(n)
                                for p, n in zip(QUARTILES, ("q1", "median", "q3"))])
    qq = qq.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo = F.col("q1") - F.lit(factor) * F.col("iqr")
    hi = F.col("q3") + F.lit(factor) * F.col("iqr")
    j = vals.join(qq, group)
    inside = (F.col("value") >= lo) & (F.col("value") <= hi)
    w = j.groupBy(group).agg(F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
                             F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
                             F.sum((~inside).cast("long")).alias("n_outliers"))
    return qq.join(w, group)


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def compare_class_counts(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Class counts before and after resampling, side by side."""
    b = class_counts(before, label).withColumnRenamed("count", "before")
    a = class_counts(after, label).withColumnRenamed("count", "after")
    return b.join(a, label, "full").na.fill(0, ["before", "after"])


def top_k(df: DataFrame, order_desc: str, k: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Top-k rows by a value (TakeOrdered: k rows per task, merged)."""
    return df.orderBy(F.desc(order_desc), *tiebreak).limit(k)


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """Top-k rows per group; ``order`` must be unique.

    The rank limit is applied before the shuffle too (Spark plans a group limit
    below the exchange), so each task sends at most k rows of a group, however
    large the group is.
    """
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)
