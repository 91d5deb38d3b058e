"""Scoring-side projections (P9-P14) and scorers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, required: Sequence[str], what: str = "input") -> None:
    """Raise listing every missing column."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns in {what}: {missing}")


def require_rows(df: DataFrame, what: str = "input") -> None:
    """Raise when nothing is left to score."""
    if df.isEmpty():
        raise ValueError(f"No rows left in {what} after removing incomplete rows")


def align_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = (),
                   fill: float = 0.0) -> DataFrame:
    """Project to the frozen order; absent feature columns become ``fill``."""
    present = set(df.columns)
    cols = [F.col(n).cast("double").alias(n) if n in present else F.lit(float(fill)).alias(n)
            for n in names]
    return df.select(*keep, *cols)


def map_to_vector(map_col, names: Sequence[str], default: float = 0.0) -> Column:
    """MAP<STRING, DOUBLE> -> ARRAY<DOUBLE> in ``names`` order, absent keys = default."""
    m = F.col(map_col) if isinstance(map_col, str) else map_col
    return F.array(*[F.coalesce(F.try_element_at(m, F.lit(n)).cast("double"), F.lit(float(default)))
                     for n in names])


def linear_probability(vector_col: str, coefficients, intercept: float) -> Column:
    """Logistic score of a fixed linear model over an ARRAY<DOUBLE> (used for checks)."""
    z = F.lit(float(intercept))
    for i, w in enumerate(coefficients):
        z = z + F.lit(float(w)) * F.element_at(F.col(vector_col), i + 1)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def invalid_values_error(map_col, names) -> Column:
    """Text naming the keys whose value is NULL or not finite; NULL if the map can be scored.

    An absent key is no error: it counts as 0.0, as in :func:`map_to_vector`.
    """
    m = F.col(map_col) if isinstance(map_col, str) else map_col
    bad = []
    for n in names:
        v = F.try_element_at(m, F.lit(n)).cast("double")
        finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
        bad.append(F.when(F.map_contains_key(m, F.lit(n)) & ~finite, F.lit(n)))
    invalid = F.array_compact(F.array(*bad))
    return F.when(m.isNull(), F.lit("no features")).when(
        F.size(invalid) > 0, F.concat(F.lit("invalid features: "), F.array_join(invalid, ", ")))


def score_with_errors(df: DataFrame, map_col: str, names, score, threshold: float,
                      keep=()) -> DataFrame:
    """Per-row error capture for batch scoring of feature maps.

    Valid rows (no required key with a NULL or non-finite value; absent keys
    count as 0.0) are scored by ``score(df_with_vector) -> df with
    'probability'``; invalid rows keep their input and get an ``error`` text.
    Both kinds stay in the output.
    """
    checked = df.withColumn("error", invalid_values_error(map_col, names))
    good = checked.filter(F.col("error").isNull()).withColumn("_pw_vec", map_to_vector(map_col, names))
    scored = score(good).withColumn("prediction", (F.col("probability") >= F.lit(threshold)).cast("int"))
    bad = (checked.filter(F.col("error").isNotNull())
                  .withColumn("probability", F.lit(None).cast("double"))
                  .withColumn("prediction", F.lit(None).cast("int")))
    cols = [*keep, map_col, "probability", "prediction", "error"]
    return scored.select(*cols).unionByName(bad.select(*cols))


# ------------------------------------------------------------------ scorers
class OutbreakScorer:
    """Apply a saved pipeline (model + scaler + frozen feature list + fitted encoding)."""

    def __init__(self, model, scaler, meta: dict, encoding=None):
        self.model, self.scaler, self.meta, self.encoding = model, scaler, meta, encoding
        self.features = list(meta["feature_columns"])
        self.threshold = float(meta["optimal_threshold"])

    @classmethod
    def load(cls, spark, path: str) -> "OutbreakScorer":
        from panelwarn.operators.models import load_artifacts, load_encoding
        model, scaler, meta = load_artifacts(spark, path)
        return cls(model, scaler, meta, load_encoding(spark, path, meta))

    def score_features(self, df: DataFrame, keep=(), apply_threshold: bool = True) -> DataFrame:
        """Score rows that already carry the feature columns (absent ones = 0.0)."""
        from pyspark.ml.functions import vector_to_array
        aligned = align_features(df, self.features, keep=keep)
        scaled = self.scaler.transform(aligned)
        # a forest's copy has no training summary: its session cannot be sent to tasks once it has observed a query
        out = self.model.copy().transform(scaled)
        pair = F.col("probability")  # a vector, or an array from a SQL stage
        if out.schema["probability"].dataType.typeName() != "array":
            pair = vector_to_array(pair)
        out = out.withColumn("probability_1", pair.getItem(1))
        cols = [*keep, F.col("probability_1").alias("outbreak_probability")]
        if apply_threshold:
            cols.append((F.col("probability_1") >= F.lit(self.threshold)).cast("int").alias("prediction"))
        return out.select(*cols, F.lit(self.threshold).alias("threshold_used"),
                          F.lit(self.meta.get("model_type")).alias("model_type"))

    def panel_features(self, raw: DataFrame, spec) -> DataFrame:
        """C1 features: windows over the rows given, codes and year bounds as fitted in training.

        Without the date column, it is made of ``year`` and ``dayofyear``.  An
        entity that training has not seen is an error.
        """
        from panelwarn.operators.features import EXOG_COLUMNS, engineer_features
        from panelwarn.schemas import SCORING_REQUIRED
        if self.encoding is None:
            raise ValueError("the artifact holds no fitted encoding; save it with one to score panels")
        if spec.time in raw.columns:
            require_columns(raw, [spec.entity, *EXOG_COLUMNS, spec.target], "scoring input")
        else:
            own = {"ISO_A0": spec.entity}
            require_columns(raw, [*[own.get(c, c) for c in SCORING_REQUIRED], spec.target], "scoring input")
            first = F.make_date("year", F.lit(1), F.lit(1))
            raw = raw.withColumn(spec.time, F.date_add(first, F.col("dayofyear").cast("int") - 1))
        return engineer_features(raw, spec, encoding=self.encoding)

    def score_panel(self, raw: DataFrame, spec, apply_threshold: bool = True) -> DataFrame:
        """Raw panel rows -> training features -> complete rows -> scores, keys kept."""
        from panelwarn.operators.panel import complete_rows
        feats = self.panel_features(raw, spec)
        done = complete_rows(feats, [c for c in self.features if c in feats.columns])
        require_rows(done, "scoring input")
        return self.score_features(done, keep=[spec.entity, spec.time], apply_threshold=apply_threshold)

    def score_maps(self, df: DataFrame, map_col: str = "features", keep=()) -> DataFrame:
        """MAP<STRING, DOUBLE> rows -> probability, class, threshold, model type."""
        vec = df.select(*keep, *[F.coalesce(F.try_element_at(F.col(map_col), F.lit(n)).cast("double"),
                                            F.lit(0.0)).alias(n) for n in self.features])
        return self.score_features(vec, keep=keep)

    def score_maps_with_errors(self, df: DataFrame, map_col: str = "features", keep=()) -> DataFrame:
        """C3 with the saved model: invalid maps get an error text instead of a score."""
        checked = df.withColumn("error", invalid_values_error(map_col, self.features))
        good = self.score_maps(checked.filter(F.col("error").isNull()), map_col, keep=[*keep, map_col])
        good = good.select(*keep, map_col, F.col("outbreak_probability").alias("probability"), "prediction",
                           F.lit(None).cast("string").alias("error"))
        bad = checked.filter(F.col("error").isNotNull()).select(
            *keep, map_col, F.lit(None).cast("double").alias("probability"),
            F.lit(None).cast("int").alias("prediction"), "error")
        return good.unionByName(bad)
