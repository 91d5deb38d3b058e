"""Metrics: the published confusion matrix, threshold sweep and AUC vs brute force."""

import math
import random

from pyspark.sql import functions as F

from panelwarn.operators import metrics as E


def counts_frame(spark, tn, fp, fn, tp):
    return spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")


def test_published_figures(spark):
    m = E.metrics_from_counts(counts_frame(spark, 287, 416, 323, 7338)).first()
    assert round(m["accuracy"], 5) == 0.91165
    assert round(m["macro_f1"], 5) == 0.69461
    assert round(m["precision"], 5) == 0.94635
    assert round(m["recall"], 5) == 0.95784
    assert round(m["f1"], 5) == 0.95206


def scored(spark, n=500, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = 1 if rnd.random() < 0.7 else 0
        p = round(min(1.0, max(0.0, rnd.gauss(0.6 if y else 0.4, 0.2))), 2)  # many ties
        rows.append((i, y, p))
    return rows, spark.createDataFrame(rows, "id long, y int, p double")


def brute_macro(rows, t):
    tp = sum(1 for _, y, p in rows if y == 1 and p >= t)
    fp = sum(1 for _, y, p in rows if y == 0 and p >= t)
    fn = sum(1 for _, y, p in rows if y == 1 and p < t)
    tn = sum(1 for _, y, p in rows if y == 0 and p < t)
    f1 = lambda a, b, c: 0.0 if 2 * a + b + c == 0 else 2 * a / (2 * a + b + c)
    return (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2


def test_best_threshold_equals_brute_force(spark):
    rows, df = scored(spark)
    best_t, best = 0.5, 0.0
    for i in range(81):
        t = 0.1 + i * 0.01
        m = brute_macro(rows, t)
        if m > best:
            best_t, best = t, m
    got = E.best_threshold(df, "y", "p").first()
    assert got["best_threshold"] == best_t
    assert math.isclose(got["best_macro_f1"], best)


def test_auc_with_ties(spark):
    rows, df = scored(spark)
    pos = [p for _, y, p in rows if y == 1]
    neg = [p for _, y, p in rows if y == 0]
    u = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    got = E.roc_auc(df, "y", "p").first()["roc_auc"]
    assert math.isclose(got, u / (len(pos) * len(neg)))


def test_report_and_confusion(spark):
    rows, df = scored(spark)
    pred = df.withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    cm = {(r["actual"], r["predicted"]): r["count"] for r in E.confusion_long(pred, "y", "pred").collect()}
    assert sum(cm.values()) == len(rows) and len(cm) == 4
    rep = {r["label"]: r for r in E.classification_report(pred, "y", "pred").collect()}
    assert rep["macro avg"]["support"] == len(rows)
    assert math.isclose(rep["macro avg"]["f1"], brute_macro(rows, 0.5))
