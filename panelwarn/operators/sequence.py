"""Sequence trainer (M14): two networks on flattened look-back windows, tuned and compared.

Rows are split by position first; scaling statistics come from the training
rows only; sequences of the previous ``lookback`` rows are flattened; SMOTE
balances the training part (so that balanced class weights are 1 for every
class); each network is fitted with patience on validation, its threshold
tuned for macro F1 on validation and all measures taken on the test part.  The
first of the networks with the largest F1 is kept (``>=``, as the reference
compares).  Spark has no recurrent layers: both are multilayer perceptrons, one
narrow and deep, one wide.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwarn.operators import metrics as E
from panelwarn.operators.models import SEED, Patience, compact, evaluate, positive_probability
from panelwarn.operators.panel import complete_rows
from panelwarn.operators.sampling import flatten_sequences, lookback_sequences, positional_split, standardize_within
from panelwarn.operators.smote import smote
from panelwarn.operators.windows import PanelSpec
from panelwarn.session import cut_lineage

#: Hidden layers of the two networks.
NETWORKS = {"Deep": (64, 32), "Wide": (128,)}
#: Epochs without a lower validation loss after which training stops, and epochs between two looks at it.
PATIENCE, SLICE = 15, 5
#: Probabilities are kept this far from 0 and 1 in the loss.
CLIP = 1e-7


@dataclass
class SequenceResult:
    best_name: str
    models: dict
    metrics: dict
    split_rows: dict
    histories: dict


def log_loss(model, rows: DataFrame) -> float:
    """Mean unweighted cross-entropy of a binary classifier over rows with ``features`` and ``label``."""
    p = F.greatest(F.least(F.col("proba"), F.lit(1 - CLIP)), F.lit(CLIP))
    loss = F.when(F.col("label") == 1, -F.log(p)).otherwise(-F.log(1 - p))
    return positive_probability(model.transform(rows)).agg(F.avg(loss)).first()[0]


def fit_with_patience(train: DataFrame, val: DataFrame, layers: Sequence[int], epochs: int = 100,
                      patience: int = PATIENCE, slice_epochs: int = SLICE, seed: int = SEED):
    """(best model, validation losses by slice): warm-started slices of epochs, stopped by validation loss.

    Each slice starts from the weights of the one before; the optimiser's
    memory of gradients begins anew.  Training stops when ``patience`` epochs
    brought no lower loss, and the weights of the best slice are returned.
    Without validation rows all epochs run and the last weights are returned.
    """
    rule, model, best, history = Patience(-(-patience // slice_epochs)), None, None, []
    for at in range(0, epochs, slice_epochs):
        net = MultilayerPerceptronClassifier(layers=list(layers), maxIter=min(slice_epochs, epochs - at), seed=seed)
        model = (net if model is None else net.setInitialWeights(model.weights)).fit(train)
        loss = log_loss(model, val)
        if loss is None:
            best = model
            continue
        history.append(loss)
        settled = rule.add([loss])
        if rule.best == len(history):
            best = model
        if settled:
            break
    return best, history


def train_sequences(df: DataFrame, spec: PanelSpec, features: Sequence[str], label: str, lookback: int = 12,
                    networks: dict[str, tuple[int, ...]] | None = None, epochs: int = 100) -> SequenceResult:
    rows = complete_rows(df.select(spec.entity, *spec.order, label, *features))
    order = [spec.entity, *spec.order]
    placed = cut_lineage(positional_split(rows, order))
    scaled = standardize_within(placed.drop("split"), [spec.entity], list(features), fit_on=placed.filter("split = 'train'"))
    seq = lookback_sequences(scaled, spec, features, label, lookback)
    flat = seq.select(F.concat_ws("|", *[F.col(c).cast("string") for c in order]).alias("sid"), *order,
                      flatten_sequences("seq").alias("x"), F.col(label).alias("y"))
    split = cut_lineage(positional_split(flat, order).select("sid", "x", "y", "split"))
    train = smote(split.filter("split = 'train'"), "y", "sid", "x")
    fit_on = cut_lineage(compact(train.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))))
    held = split.filter("split <> 'train'").select("y", "split", array_to_vector("x").alias("features"))
    watched = cut_lineage(compact(held.filter("split = 'val'").select("features", F.col("y").cast("double").alias("label"))))
    width, models, measures, histories = lookback * len(features), {}, {}, {}
    for name, hidden in (networks or NETWORKS).items():
        model, histories[name] = fit_with_patience(fit_on, watched, [width, *hidden, 2], epochs)
        scored = cut_lineage(positive_probability(model.transform(held)).select("y", "split", "proba"))
        threshold = E.best_threshold(scored.filter("split = 'val'"), "y", "proba").first()["best_threshold"]
        models[name], measures[name] = model, evaluate(scored.filter("split = 'test'"), "y", threshold)
    best = max(models, key=lambda n: (measures[n]["f1"], -list(models).index(n)))
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    return SequenceResult(best, models, measures, {**counts, "balanced": fit_on.count()}, histories)
