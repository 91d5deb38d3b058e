"""Training with patience, the saved encoding, and missing values."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelwarn.functions.nulls import positive_flag
from panelwarn.operators import models as M
from panelwarn.operators import panel as P
from panelwarn.operators import profile as A
from panelwarn.operators.features import engineer_features, fit_encoding
from panelwarn.operators.metrics import threshold_grid, threshold_sweep
from panelwarn.operators.scoring import OutbreakScorer
from panelwarn.operators.windows import PanelSpec


def test_patience():
    def best(losses, rounds):
        rule = M.Patience(rounds)
        return rule.add(losses), rule.best
    assert best([3, 2, 1, 1, 2, 3], 3) == (True, 3)
    assert best([3, 2, 1, 1, 2], 3) == (False, 3)
    assert best([5, 4, 3], 2) == (False, 3)
    assert best([3, 2, 2, 2, 1], 2) == (True, 2)  # what follows the stop is ignored
    rule = M.Patience(2)
    assert not rule.add([3, 2]) and not rule.add([4]) and rule.add([4, 0]) and rule.best == 2


@pytest.fixture(scope="module")
def learnable(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(700):
        x = [rnd.gauss(0, 1) for _ in range(4)]
        rows.append((i, *x, int(x[0] * x[1] + 0.4 * x[2] + 0.3 * rnd.gauss(0, 1) > 0)))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int").cache()


def test_boosting_keeps_many_trees(learnable):
    cfg = M.LearnerConfig("small", "gbt", dict(M.PRESETS["XGBoost"].params, maxIter=25, maxDepth=3, stepSize=0.2), early_stopping=True)
    r = M.train_and_select(learnable, "y", "id", ["a", "b", "c", "d"], [cfg])
    assert r.best_model.stages[-1].getNumTrees > 10
    assert r.metrics["roc_auc"] > 0.85 and sum(r.split_rows.values()) == 700


def test_fresh_forest_after_an_observation(learnable):
    """A forest is trained, compared and scored in a session that has observed a query."""
    counted, seen = P.observed_counts(learnable)
    assert len(counted.collect()) == seen.get["initial_rows"] == 700
    cfg = M.LearnerConfig("small", "rf", dict(numTrees=3, maxDepth=4, seed=1))
    names = ["a", "b", "c", "d"]
    r = M.train_and_select(learnable, "y", "id", names, [cfg])
    assert r.best_model.stages[-1].getNumTrees == 3 and sum(r.split_rows.values()) == 700
    fresh = M.Pipeline(stages=[M.VectorAssembler(inputCols=names, outputCol="features"),
                               M.RandomForestClassifier(labelCol="y", numTrees=3, seed=1)]).fit(learnable)
    scaler = M.StandardScalerModel(names, dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0))
    scorer = OutbreakScorer(fresh, scaler, {"feature_columns": names, "optimal_threshold": 0.5})
    assert scorer.score_features(learnable, keep=["id"]).filter("prediction in (0, 1)").count() == 700
    assert fresh.stages[-1].hasSummary  # the caller's model keeps its own


def test_boosting_keeps_the_best_round_and_equals_its_margins(spark, learnable, tmp_path):
    """The kept trees reproduce the losses that the stop rule saw, after a round trip through storage."""
    import math

    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.ml.feature import VectorAssembler
    rows = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(learnable)
    rows = rows.select("id", "features", F.col("y").cast("double").alias("label"))
    train, val = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    est = M.GBTClassifier(maxIter=30, stepSize=0.8, maxDepth=3, seed=3)
    model = M.fit_boosted(est, train, val, patience=3)
    kept = model.getNumTrees
    assert 2 < kept < 27 and model.treeWeights[:2] == [1.0, 0.8]
    model.write().overwrite().save(str(tmp_path / "m"))
    again = GBTClassificationModel.load(str(tmp_path / "m"))
    scored = again.transform(val).select("label", "rawPrediction").collect()
    loss = sum(math.log1p(math.exp(-(2 * r["label"] - 1) * r["rawPrediction"][1])) for r in scored) / len(scored)
    losses = model.evaluateEachIteration(val)
    # Spark's loss is 2 log(1 + exp(-2 y F)); raw predictions are F
    assert losses[-1] == min(losses)
    assert abs(losses[-1] - 2 * sum(math.log1p(math.exp(-2 * (2 * r["label"] - 1) * r["rawPrediction"][1]))
                                    for r in scored) / len(scored)) < 1e-9
    assert loss < 0.69
    rerun = M.fit_boosted(est, train, val, patience=3)
    assert rerun.getNumTrees == kept and rerun.toDebugString == model.toDebugString.replace(model.uid, rerun.uid)
    assert M.fit_boosted(est.copy({est.maxIter: 3}), train, val.filter("id < 0"), patience=1).getNumTrees == 3


def panel(spark, entities, years):
    rnd = random.Random(5)
    rows = [(e, dt.date(y, m, 1), float(rnd.randint(0, 50)), rnd.gauss(25, 3), rnd.random() * 9)
            for e in entities for y in years for m in range(1, 13)]
    return spark.createDataFrame(rows, "ISO_A0 string, calendar_start_date date, dengue_total double, "
                                       "temperature_c double, precipitation_mm double")


def test_scoring_uses_the_fitted_encoding(spark):
    whole = panel(spark, ["A", "B", "THA"], range(2000, 2005))
    encoding = fit_encoding(whole)
    assert encoding.years == (2000.0, 2004.0)
    full = {(r["ISO_A0"], r["calendar_start_date"]): r for r in engineer_features(whole, encoding=encoding).collect()}
    scorer = OutbreakScorer(None, None, {"feature_columns": [], "optimal_threshold": 0.5}, encoding)
    part = scorer.panel_features(whole.filter("ISO_A0 = 'THA' and year(calendar_start_date) >= 2002"), PanelSpec())
    for r in part.collect():
        same = full[r["ISO_A0"], r["calendar_start_date"]]
        assert (r["year_normalized"], r["ISO_A0_encoded"]) == (same["year_normalized"], 2)
    with pytest.raises(ValueError, match="unseen"):
        scorer.panel_features(panel(spark, ["NEW"], [2001]), PanelSpec())
    with pytest.raises(ValueError, match="dengue_total"):
        scorer.panel_features(whole.drop("dengue_total"), PanelSpec())
    calendar = whole.selectExpr("*", "year(calendar_start_date) as year", "month(calendar_start_date) as month",
                                "dayofyear(calendar_start_date) as dayofyear", "weekofyear(calendar_start_date) as weekofyear")
    dated = scorer.panel_features(calendar.drop("calendar_start_date"), PanelSpec())
    assert dated.count() == whole.count() and dated.select("calendar_start_date").exceptAll(
        whole.select("calendar_start_date")).count() == 0


def test_tiebreak_makes_the_order_certain(spark):
    base = panel(spark, ["A", "B"], [2000, 2001])
    twice = base.unionByName(base.withColumn("dengue_total", F.col("dengue_total") + 100)) \
                .withColumn("UUID", F.md5(F.concat_ws("-", "ISO_A0", "calendar_start_date", "dengue_total")))
    spec = PanelSpec(tiebreak=("UUID",))
    one = engineer_features(twice, spec, check_keys=True)
    two = engineer_features(twice.orderBy(F.rand(3)).repartition(5), spec)
    assert "UUID" not in one.columns
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    with pytest.raises(ValueError, match="tiebreak"):
        engineer_features(twice, PanelSpec(), check_keys=True)


def test_nan_is_missing_everywhere(spark):
    nan = float("nan")
    df = spark.createDataFrame([(float(i), float(2 * i)) for i in range(10)] + [(nan, 1.0), (None, 2.0)], "x double, y double")
    assert P.completeness_counts(df).first()["kept_rows"] == P.complete_rows(df).count() == 10
    assert P.missing_cell_count(df, ["x", "y"]).first()[0] == 2
    assert A.iqr_outliers(df, ["x"]).first()["outliers"] == 0
    assert {(r["a"], r["b"]): round(r["corr"], 9) for r in A.correlation_long(df, ["x", "y"]).collect()}[("x", "y")] == 1.0
    bins = A.histogram(df, "x", 3).collect()
    assert sum(b["count"] for b in bins) == 10 and min(b["lower"] for b in bins) == 0.0
    box = A.box_stats(df.withColumn("g", F.lit(1)), "g", "x").first()
    assert (box["n_outliers"], box["whisker_hi"]) == (0, 9.0)
    assert [r[0] for r in df.select(positive_flag("x")).collect()][-2:] == [0, 0]


def test_threshold_buckets_match_comparison(spark):
    grid = list(threshold_grid())
    ps = grid + [g + d for g in grid for d in (-1e-12, 1e-12, 0.004, 0.0051)] + [0.0, 1.0]
    df = spark.createDataFrame([(p, i % 2) for i, p in enumerate(ps)], "p double, y int")
    got = {r["threshold"]: r["tp"] + r["fp"] for r in threshold_sweep(df, "y", "p").collect()}
    assert got == {t: sum(p >= t for p in ps) for t in grid}


def test_quantiles_of_hot_values(spark):
    """Nine of ten values are equal; they are one counted row before any sort."""
    df = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, 5.0).otherwise(F.col("id") * 1.0).alias("v"),
                                    (F.col("id") % 3).alias("g"))
    pdf = df.toPandas()
    for q in A.percentiles(df.drop("g"), ["v"], (0.0, 0.03, 0.05, 0.5, 0.95, 0.951, 1.0)).collect():
        assert q["quantile"] == pytest.approx(pdf["v"].quantile(q["prob"]), abs=1e-9)
    for r in A.box_stats(df, "g", "v").collect():
        assert r["median"] == pdf[pdf.g == r["g"]]["v"].median()
