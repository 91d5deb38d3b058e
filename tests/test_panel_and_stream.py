"""Panel helpers (collapse, densify, with_history) and stream = batch scoring parity (C2 vs C4)."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from panelwarn.operators import panel as P


def test_collapse_and_densify(spark):
    rows = [("A", dt.date(2020, 1, 1), 2.0), ("A", dt.date(2020, 1, 1), 3.0), ("A", dt.date(2020, 4, 1), None),
            ("B", dt.date(2020, 2, 1), 1.0), (None, dt.date(2020, 2, 1), 9.0)]
    df = spark.createDataFrame(rows, "e string, t date, y double")
    c = {(r["e"], r["t"]): r["y"] for r in P.collapse_panel(df, "e", "t", ["y"]).collect()}
    assert c == {("A", dt.date(2020, 1, 1)): 5.0, ("A", dt.date(2020, 4, 1)): 0.0, ("B", dt.date(2020, 2, 1)): 1.0}
    d = P.densify_panel(P.collapse_panel(df, "e", "t", ["y"]), "e", "t", "y")
    got = sorted((r["e"], r["t"].month, r["y"]) for r in d.collect())
    assert got == [("A", 1, 5.0), ("A", 2, 0.0), ("A", 3, 0.0), ("A", 4, 0.0), ("B", 2, 1.0)]


def test_with_history(spark):
    rows = [("A", dt.date(2020, m, 1), float(m)) for m in range(1, 13)] + [("B", dt.date(2020, 11, 1), 1.0)]
    df = spark.createDataFrame(rows, "e string, t date, y double")
    out = P.with_history(df, "e", ["t"], "t", dt.date(2020, 6, 1), 3)
    got = sorted((r["e"], r["t"].month) for r in out.collect())
    assert got == [("A", m) for m in range(3, 13)] + [("B", 11)]


def test_stream_equals_batch(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from panelwarn.operators.models import StandardScalerModel
    from panelwarn.operators.scoring import OutbreakScorer
    from panelwarn.streaming.scoring_stream import start_scoring

    feats = ["a", "b"]
    train = spark.range(200).select(
        (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
        ((F.col("id") % 7) > 3).cast("double").alias("label"))
    model = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features"),
                             RandomForestClassifier(numTrees=5, seed=1)]).fit(train)
    scaler = StandardScalerModel(feats, {"a": 0.0, "b": 0.0}, {"a": 1.0, "b": 1.0})
    scorer = OutbreakScorer(model, scaler, {"feature_columns": feats, "optimal_threshold": 0.5,
                                            "model_type": "RandomForest"})
    req = spark.range(300).select(F.col("id").alias("request_id"), F.create_map(
        F.lit("a"), (F.col("id") % 7).cast("double"), F.lit("b"), (F.col("id") % 3).cast("double")).alias("features"))
    root = tempfile.mkdtemp(prefix="pw-stream-")
    src, sink, ck = (os.path.join(root, x) for x in ("src", "sink", "ck"))
    req.write.json(src)
    start_scoring(spark, scorer, src, sink, ck).awaitTermination()
    streamed = spark.read.parquet(sink).drop("scored_at")
    batch = scorer.score_maps(req, keep=["request_id"])
    assert streamed.count() == 300
    assert streamed.exceptAll(batch.select(streamed.columns)).count() == 0
