"""Model training, selection and persistence (M8-M15, S8, S9) on Spark ML.

Flow of ``train_and_select`` (the reference's trainer, as distributed jobs):
complete rows -> exact stratified split -> population-std scaler fitted on
train -> balanced weights -> fit every configured learner -> best threshold on
validation -> test metrics -> arg-max selection -> save pipeline + metadata.

Learner parity: Spark's GBT is neither XGBoost nor LightGBM; the presets carry
the reference's hyper-parameters where Spark has an equivalent (rounds,
learning rate, depth, row / feature subsampling, early stopping on a
validation set) and document the rest.
"""

from __future__ import annotations

import datetime as _dt
import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwarn.operators import metrics as E
from panelwarn.operators.panel import complete_rows
from panelwarn.operators.sampling import stratified_split
from panelwarn.operators.weighting import (
    StandardScalerModel, balanced_weights, fit_standard_scaler, positive_class_weight,
)
from panelwarn.session import checkpoint_dir, cut_lineage

SEED = 42


@dataclass
class LearnerConfig:
    """One learner: Spark ML class name, its params, and how rows are weighted.

    weighting: 'none' | 'balanced' | 'balanced_squared' (class weight and
    sample weight both applied, as the reference's forest does) |
    'balanced_pos' (balanced x neg/pos for positives, as its second booster).
    """
    name: str
    kind: str
    params: dict = field(default_factory=dict)
    weighting: str = "balanced"
    early_stopping: bool = False


# Fixed values of the reference's trainer, mapped onto Spark ML parameters.
PRESETS = {
    "RandomForest": LearnerConfig("RandomForest", "rf", dict(
        numTrees=200, maxDepth=20, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=SEED),
        weighting="balanced_squared"),
    "XGBoost": LearnerConfig("XGBoost", "gbt", dict(
        maxIter=500, stepSize=0.05, maxDepth=6, subsamplingRate=0.8, featureSubsetStrategy="0.8",
        seed=SEED), weighting="balanced", early_stopping=True),
    "LightGBM": LearnerConfig("LightGBM", "gbt", dict(
        maxIter=500, stepSize=0.05, maxDepth=6, subsamplingRate=0.8, featureSubsetStrategy="0.8",
        seed=SEED), weighting="balanced_pos", early_stopping=True),
    # Declared but unused in the reference's config.
    "GradientBoosting": LearnerConfig("GradientBoosting", "gbt", dict(
        maxIter=200, stepSize=0.05, maxDepth=5, minInstancesPerNode=2, subsamplingRate=0.8, seed=SEED),
        weighting="none"),
}


#: Rounds without a gain on validation after which boosting stops (the reference's rule).
PATIENCE = 20


def learner(cfg: LearnerConfig, features_col: str = "features", label_col: str = "label",
            weight_col: str | None = None):
    common = dict(featuresCol=features_col, labelCol=label_col)
    if cfg.kind == "rf":
        est = RandomForestClassifier(**common, **cfg.params)
    elif cfg.kind == "gbt":
        est = GBTClassifier(**common, checkpointInterval=10, maxMemoryInMB=512, **cfg.params)
    elif cfg.kind == "mlp":
        return MultilayerPerceptronClassifier(**common, **cfg.params)
    else:
        raise ValueError(f"unknown learner kind {cfg.kind}")
    if weight_col and cfg.weighting != "none":
        est = est.setWeightCol(weight_col)
    return est


class Patience:
    """The stop rule of boosting: ``rounds`` rounds without a lower loss than the best so far."""

    def __init__(self, rounds: int = PATIENCE):
        self.rounds, self.best, self.loss, self.seen = rounds, 0, float("inf"), 0

    def add(self, losses: Sequence[float]) -> bool:
        """Take further rounds' losses in order; whether the rule holds by then (later ones are ignored)."""
        for loss in losses:
            if self.settled:
                break
            self.seen += 1
            if loss < self.loss:
                self.best, self.loss = self.seen, loss
        return self.settled

    @property
    def settled(self) -> bool:
        return self.best > 0 and self.seen - self.best >= self.rounds


def _one_tree(est: GBTClassifier, target: str, seed: int) -> RandomForestRegressor:
    """A regression tree with the booster's own depth, row and feature sampling."""
    tree = RandomForestRegressor(
        featuresCol=est.getFeaturesCol(), labelCol=target, numTrees=1, bootstrap=False, seed=seed,
        maxDepth=est.getMaxDepth(), maxBins=est.getMaxBins(), minInstancesPerNode=est.getMinInstancesPerNode(),
        minInfoGain=est.getMinInfoGain(), subsamplingRate=est.getSubsamplingRate(),
        featureSubsetStrategy=est.getFeatureSubsetStrategy(), maxMemoryInMB=est.getMaxMemoryInMB())
    return tree.setWeightCol("_pw_weight")


def _ensemble(spark, trees: Sequence, weights: Sequence[float]) -> GBTClassificationModel:
    """A boosted classifier of given regression trees and weights."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    held = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    shares = gateway.new_array(jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        held[i], shares[i] = tree._java_obj, float(weight)
    uid = jvm.org.apache.spark.ml.util.Identifiable.randomUID("gbtc")
    return GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(uid, held, shares))


def fit_boosted(est: GBTClassifier, train: DataFrame, val: DataFrame, patience: int = PATIENCE) -> GBTClassificationModel:
    """Boosting that stops ``patience`` rounds after the last gain in validation log-loss; one tree fit a round.

    Training and validation rows are one frame that carries the margin as a
    column.  A round fits one regression tree to the gradient of the log-loss
    on the training rows, adds it to all margins and reads the (unweighted)
    loss of the validation rows.  The margins are cut to the checkpoint folder
    every round: every round has the same plan, whose code is compiled once,
    and neither plans nor recomputation grow with the rounds.  The model keeps
    the trees up to the best round.
    """
    label, step = est.getLabelCol(), est.getStepSize()
    sign, margin = F.col("_pw_sign"), F.col("_pw_margin")
    weight = F.col(est.getWeightCol()) if est.isSet(est.weightCol) else F.lit(1.0)

    def begun(rows: DataFrame, held_out: bool, share) -> DataFrame:
        return rows.select(est.getFeaturesCol(), share.cast("double").alias("_pw_weight"), F.lit(held_out).alias("_pw_val"),
                           (F.col(label) * 2 - 1).alias("_pw_sign"), F.lit(0.0).alias("_pw_margin"))

    rows = cut_lineage(compact(begun(train, False, weight).unionByName(begun(val, True, F.lit(1.0)))))
    loss = F.avg(2 * F.log1p(F.exp(-2 * sign * margin)))
    trees, weights, rule = [], [], Patience(patience)
    while len(trees) < est.getMaxIter() and not rule.settled:
        # the first tree fits the signs themselves, the others the gradient
        gradient = sign if not trees else 4 * sign / (1 + F.exp(2 * sign * margin))
        target = rows.filter(~F.col("_pw_val")).withColumn("_pw_gradient", gradient)
        tree = _one_tree(est, "_pw_gradient", est.getSeed() + len(trees)).fit(target).trees[0]
        weights.append(1.0 if not trees else step)
        trees.append(tree)
        grown = tree.setPredictionCol("_pw_tree").transform(rows)
        rows = cut_lineage(grown.withColumn("_pw_margin", margin + F.lit(weights[-1]) * F.col("_pw_tree")).drop("_pw_tree"))
        seen = rows.filter("_pw_val").agg(loss).first()[0]
        rule.add([seen if seen is not None else float(-len(trees))])  # without validation rows all rounds count
    return _ensemble(train.sparkSession, trees[:rule.best], weights[:rule.best])


def compact(df: DataFrame, rows_per_partition: int = 50_000) -> DataFrame:
    """Fewer partitions for a small training frame (iterative fits pay for each task)."""
    n = max(1, -(-df.count() // rows_per_partition))
    return df.coalesce(n) if n < df.rdd.getNumPartitions() else df


def add_weights(rows: DataFrame, label: str, mode: str, out: str = "weight",
                train: DataFrame | None = None) -> DataFrame:
    """Weight column for ``rows`` from the class counts of ``train`` (default ``rows``)."""
    train = train if train is not None else rows
    if mode == "none":
        return rows.withColumn(out, F.lit(1.0))
    w = balanced_weights(rows, label, out, counts_from=train)
    if mode == "balanced_squared":
        return w.withColumn(out, F.col(out) * F.col(out))
    if mode == "balanced_pos":
        spw = positive_class_weight(train, label).first()["scale_pos_weight"]
        return w.withColumn(out, F.when(F.col(label) == 1, F.col(out) * F.lit(spw)).otherwise(F.col(out)))
    return w


def positive_probability(df: DataFrame, prob_col: str = "probability", out: str = "proba") -> DataFrame:
    return df.withColumn(out, vector_to_array(F.col(prob_col)).getItem(1))


def numeric_features(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Numeric columns (int / long / float / double) not excluded, in table order."""
    keep = ("int", "bigint", "long", "double", "float", "smallint", "tinyint")
    return [c for c, t in df.dtypes if c not in set(exclude) and t in keep]


@dataclass
class TrainResult:
    best_name: str
    best_model: PipelineModel
    threshold: float
    metrics: dict
    all_models: dict
    feature_columns: list
    scaler: StandardScalerModel
    split_rows: dict = field(default_factory=dict)


def evaluate(scored: DataFrame, label: str, threshold: float, auc: bool = True) -> dict:
    """E1 (+ E4) at a threshold, as plain numbers (one small row each)."""
    pred = scored.withColumn("_pw_pred", (F.col("proba") >= F.lit(threshold)).cast("int"))
    m = E.metric_set(pred, label, "_pw_pred").first().asDict()
    if auc:
        m["roc_auc"] = E.roc_auc(scored, label, "proba").first()["roc_auc"]
    m["threshold"] = threshold
    return m


def train_and_select(df: DataFrame, label: str, id_col: str, feature_cols: Sequence[str],
                     configs: Sequence[LearnerConfig], select_on: str = "val",
                     test_size: float = 0.2, val_size: float = 0.2) -> TrainResult:
    """M15 + T4: fit every learner, tune its threshold on val, compare, keep the best."""
    checkpoint_dir(df.sparkSession)
    data = cut_lineage(complete_rows(df.select(id_col, label, *feature_cols)))
    split = stratified_split(data, label, id_col, test_size, val_size)
    train = split.filter(F.col("split") == "train")
    scaler = fit_standard_scaler(train, feature_cols)
    assembler = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="keep")
    scaled = assembler.transform(scaler.transform(split)).withColumn("_pw_y", F.col(label).cast("double"))
    scaled = cut_lineage(scaled.select(id_col, label, "_pw_y", "features", "split"))
    parts = {p: scaled.filter(F.col("split") == p) for p in ("train", "val", "test")}
    results = {}
    for pos, cfg in enumerate(configs):
        tr = add_weights(parts["train"], label, cfg.weighting)
        est = learner(cfg, label_col="_pw_y", weight_col="weight")
        if cfg.early_stopping:
            fitted = fit_boosted(est, tr, parts["val"])
        else:
            # a copy has no training summary: its session cannot be sent to tasks once it has observed a query
            fitted = est.fit(tr).copy()
        model = PipelineModel(stages=[assembler, fitted])
        # one pass through the trees; everything after reads three columns
        scored = positive_probability(fitted.transform(scaled.filter(F.col("split") != "train")))
        scored = cut_lineage(scored.select(label, "split", "proba"))
        val, test = (scored.filter(F.col("split") == p) for p in ("val", "test"))
        best_t = E.best_threshold(val, label, "proba").first()["best_threshold"]
        m_test = evaluate(test, label, best_t)
        m_val = evaluate(val, label, best_t, auc=select_on != "val")  # selection reads macro F1 only
        results[cfg.name] = dict(position=pos, model=model, threshold=best_t, test=m_test, val=m_val)
    key = "val" if select_on == "val" else "test"
    best = max(results, key=lambda n: (results[n][key]["macro_f1"], -results[n]["position"]))
    r = results[best]
    return TrainResult(best, r["model"], r["threshold"], r["test"],
                       {n: v[key]["macro_f1"] for n, v in results.items()}, list(feature_cols), scaler,
                       {p: parts[p].count() for p in parts})


# ------------------------------------------------------------ persistence
def save_artifacts(result: TrainResult, path: str, target: str = "outbreak_flag", encoding=None,
                   data: dict | None = None) -> dict:
    """PipelineModel + one JSON metadata document beside it.

    ``encoding`` (a fitted ``features.PanelEncoding``) is saved too: the year
    bounds in the document, the entity codes as a table.  ``data`` says what the
    feature table's write counted (``sinks.write_complete_features``).
    """
    if encoding is not None:
        encoding.codes.write.mode("overwrite").parquet(os.path.join(path, "encoder"))
    result.best_model.write().overwrite().save(os.path.join(path, "model"))
    meta = {
        "model_type": result.best_name, "target": target, "feature_columns": result.feature_columns,
        "optimal_threshold": result.threshold,
        **{f"test_{'f1_class1' if k == 'f1' else k}": v for k, v in result.metrics.items() if k != "threshold"},
        "training_date": _dt.datetime.now(_dt.timezone.utc).isoformat(),
        "n_features": len(result.feature_columns), "all_models": result.all_models,
        "scaler_means": result.scaler.means, "scaler_stds": result.scaler.stds,
        "year_bounds": list(encoding.years) if encoding is not None else None, "data": data,
    }
    _write_json(path, meta)
    return meta


def _write_json(path: str, meta: dict) -> None:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    doc = json.dumps(meta, default=float)
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.mode("overwrite").text(
        os.path.join(path, "metadata"))


def load_metadata(spark, path: str, default_threshold: float = 0.5) -> dict:
    """S8 read; a missing threshold falls back to the default (as the service does)."""
    txt = spark.read.text(os.path.join(path, "metadata")).first()["value"]
    meta = json.loads(txt)
    if meta.get("optimal_threshold") is None:
        meta["optimal_threshold"] = default_threshold
    return meta


def load_artifacts(spark, path: str):
    meta = load_metadata(spark, path)
    model = PipelineModel.load(os.path.join(path, "model"))
    scaler = StandardScalerModel(meta["feature_columns"], meta["scaler_means"], meta["scaler_stds"])
    return model, scaler, meta


def load_encoding(spark, path: str, meta: dict):
    """The fitted entity codes and year bounds of an artifact; None if it was saved without."""
    from panelwarn.operators.features import PanelEncoding
    if meta.get("year_bounds") is None:
        return None
    return PanelEncoding(spark.read.parquet(os.path.join(path, "encoder")), tuple(meta["year_bounds"]))


# --------------------------------------------------------------- regressors
def forest_importances(df: DataFrame, feature_cols: Sequence[str], target: str, trees: int = 100,
                       k: int | None = 15, max_depth: int = 20) -> DataFrame:
    """M12 + J5 + T2: random-forest regressor importances paired with names, top k.

    The reference's trees are unlimited in depth; Spark allows 30 levels, and
    20 leave no more than a millionth of the rows in a deepest leaf.
    """
    data = cut_lineage(complete_rows(df.select(target, *feature_cols)))
    asm = VectorAssembler(inputCols=list(feature_cols), outputCol="features")
    rf = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees,
                               maxDepth=max_depth, maxMemoryInMB=512, seed=SEED)
    model = Pipeline(stages=[asm, rf]).fit(data)
    imp = model.stages[-1].featureImportances.toArray().tolist()  # one value per feature
    spark = df.sparkSession
    out = spark.createDataFrame(list(zip(feature_cols, [float(v) for v in imp])), "feature string, importance double")
    out = out.orderBy(F.desc("importance"), "feature")
    return out.limit(k) if k else out


def boosted_regression_r2(df: DataFrame, feature_cols: Sequence[str], target: str, id_col: str,
                          max_iter: int = 100, test_fraction: float = 0.2) -> DataFrame:
    """GBT regressor on the count target, R^2 on a hash-held-out test part."""
    from panelwarn.operators.sampling import uniform_from_hash
    data = complete_rows(df.select(id_col, target, *feature_cols))
    data = data.withColumn("_pw_u", uniform_from_hash(id_col))
    train, test = data.filter(F.col("_pw_u") >= test_fraction), data.filter(F.col("_pw_u") < test_fraction)
    asm = VectorAssembler(inputCols=list(feature_cols), outputCol="features")
    gbt = GBTRegressor(featuresCol="features", labelCol=target, maxIter=max_iter, stepSize=0.05,
                       maxDepth=6, subsamplingRate=0.8, seed=SEED)
    model = Pipeline(stages=[asm, gbt]).fit(cut_lineage(compact(train)))
    r2 = RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName="r2").evaluate(
        model.transform(test))
    return df.sparkSession.createDataFrame([("GBTRegressor", float(r2), train.count(), test.count())],
                                           "model string, r2 double, n_train long, n_test long")
