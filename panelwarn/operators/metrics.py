"""Evaluation (E1-E5, E7, T4) as aggregations; no per-threshold passes.

Label ``y`` is 0/1, ``p`` the positive-class probability.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwarn.operators.ordering import prefix_sums

# Fixed values of the reference: thresholds 0.10, 0.11, ..., 0.90 (81 values,
# computed as 0.1 + i * 0.01 to equal numpy's linspace) and the default 0.5.
THRESHOLD_START, THRESHOLD_STEP, THRESHOLD_COUNT = 0.1, 0.01, 81
DEFAULT_THRESHOLD = 0.5


def threshold_grid() -> list[float]:
    return [THRESHOLD_START + i * THRESHOLD_STEP for i in range(THRESHOLD_COUNT)]


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _safe_div(2 * tp, 2 * tp + fp + fn)


def confusion_counts(df: DataFrame, y: str, pred: str) -> DataFrame:
    """One row: tn, fp, fn, tp (one conditional-sum aggregate)."""
    yy, pp = F.col(y), F.col(pred)
    return df.agg(*[F.coalesce(F.sum(((yy == a) & (pp == b)).cast("long")), F.lit(0)).alias(n)
                    for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    """E1 from (tn, fp, fn, tp): accuracy, precision, recall, f1 (class 1), macro F1."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    f1_1, f1_0 = _f1(tp, fp, fn), _f1(tn, fn, fp)
    return counts.select(
        _safe_div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _safe_div(tp, tp + fp).alias("precision"), _safe_div(tp, tp + fn).alias("recall"),
        f1_1.alias("f1"), ((f1_0 + f1_1) / 2).alias("macro_f1"))


def metric_set(df: DataFrame, y: str, pred: str) -> DataFrame:
    """E1."""
    return metrics_from_counts(confusion_counts(df, y, pred))


def confusion_long(df: DataFrame, y: str, pred: str) -> DataFrame:
    """(actual, predicted, count) for all four cells, zeros included."""
    c = confusion_counts(df, y, pred)
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(n).alias("count"))
                      for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])
    return c.select(F.inline(cells))


def classification_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Per class, macro avg and weighted avg: precision, recall, f1, support."""
    c = confusion_counts(df, y, pred)
    tn, fp, fn, tp = (F.col(n) for n in ("tn", "fp", "fn", "tp"))
    p1, r1, f1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn), _f1(tp, fp, fn)
    p0, r0, f0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp), _f1(tn, fn, fp)
    s0, s1 = tn + fp, tp + fn
    n = s0 + s1

    def wavg(a, b):
        return _safe_div(a * s0 + b * s1, n)

    rows = F.array(
        F.struct(F.lit("0").alias("label"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1"), s0.alias("support")),
        F.struct(F.lit("1").alias("label"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1"), s1.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
                 ((f0 + f1) / 2).alias("f1"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), wavg(p0, p1).alias("precision"), wavg(r0, r1).alias("recall"),
                 wavg(f0, f1).alias("f1"), n.alias("support")))
    return c.select(F.inline(rows))


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Tie-aware AUC = P(score+ > score-) + 0.5 P(=), from per-score counts.

    The running count of negatives below each distinct score is a distributed
    prefix sum (range partitioned), so the number of distinct scores does not
    have to fit one task.
    """
    g = (df.filter(F.col(p).isNotNull())
           .groupBy(F.col(p).alias("_s"))
           .agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"),
                F.sum((F.col(y) == 0).cast("long")).alias("neg")))
    cum = prefix_sums(g, [], ["_s"], ["neg"], inclusive=False)
    part = cum.agg(F.sum(F.col("pos") * (F.col("neg_cum") + F.col("neg") * 0.5)).alias("_u"),
                   F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return part.select(F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                              F.col("_u") / (F.col("_p") * F.col("_n"))).alias("roc_auc"))


def _thresholds_below(p, ts: Sequence[float]):
    """Number of thresholds <= p.  On an even grid: a division, set right by the two thresholds next to it."""
    step = (ts[-1] - ts[0]) / (len(ts) - 1) if len(ts) > 1 else 0.0
    even = step > 0 and all(abs(t - ts[0] - i * step) < step / 4 for i, t in enumerate(ts))
    grid = F.array(*[F.lit(float(t)) for t in ts])
    if not even:
        return F.size(F.filter(grid, lambda t: t <= p))
    at = F.least(F.greatest(F.round((p - F.lit(float(ts[0]))) / F.lit(step)), F.lit(0.0)), F.lit(float(len(ts) - 1))).cast("int")
    return at + (F.get(grid, at) <= p).cast("int")


def threshold_sweep(df: DataFrame, y: str, p: str, thresholds: Sequence[float] | None = None) -> DataFrame:
    """E5 helper: macro F1 for every threshold from one aggregate.

    bucket(p) = number of thresholds <= p, so a row is predicted positive at
    threshold i exactly when bucket > i; counts per bucket then give every
    threshold's confusion matrix by suffix sums over at most 82 rows.
    """
    ts = list(thresholds or threshold_grid())
    bucket = _thresholds_below(F.col(p), ts)
    g = df.groupBy(bucket.alias("b")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"),
                                          F.sum((F.col(y) == 0).cast("long")).alias("neg"))
    # g has at most len(ts) + 1 rows; each is expanded once per threshold index.
    t_arr = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold"))
                      for i, t in enumerate(ts)])
    j = g.select("b", "pos", "neg", F.explode(t_arr).alias("t")).select("b", "pos", "neg", "t.*")
    positive = F.col("b") > F.col("i")
    agg = j.groupBy("i", "threshold").agg(
        F.sum(F.when(positive, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(positive, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~positive, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~positive, F.col("neg")).otherwise(0)).alias("tn"))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return agg.withColumn("macro_f1", (_f1(tp, fp, fn) + _f1(tn, fn, fp)) / 2)


def best_threshold(df: DataFrame, y: str, p: str, thresholds: Sequence[float] | None = None,
                   default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """E5: lowest threshold among the maxima of macro F1 (strict improvement).

    Starting from (default, 0.0), a threshold is kept only when strictly better,
    so the winner is the first maximum in grid order; if no macro F1 exceeds 0
    the default is returned.
    """
    s = threshold_sweep(df, y, p, thresholds)
    best = s.agg(F.min_by(F.struct("i", "threshold", "macro_f1"),
                          F.struct(-F.col("macro_f1"), F.col("i"))).alias("b"))
    return best.select(F.when(F.col("b.macro_f1") > 0, F.col("b.threshold")).otherwise(F.lit(default))
                       .alias("best_threshold"),
                       F.when(F.col("b.macro_f1") > 0, F.col("b.macro_f1")).otherwise(F.lit(0.0))
                       .alias("best_macro_f1"))


def mean_abs_attribution(long_df: DataFrame, feature: str = "feature", value: str = "value",
                         k: int | None = 10) -> DataFrame:
    """Mean |attribution| per feature over samples (and time steps), top k."""
    g = long_df.groupBy(feature).agg(F.avg(F.abs(F.col(value))).alias("mean_abs"))
    g = g.orderBy(F.desc("mean_abs"), feature)
    return g.limit(k) if k else g


def select_best(metrics: DataFrame, metric: str = "macro_f1", position: str = "position") -> DataFrame:
    """T4: arg-max row (first in ``position`` order wins ties)."""
    return metrics.orderBy(F.desc(metric), F.asc(position)).limit(1)
