"""Networks with patience: warm starts, the stop rule and the weights that are kept."""

import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from panelwarn.operators import sequence as S


@pytest.fixture(scope="module")
def parts(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        x = [rnd.gauss(0, 1) for _ in range(3)]
        y = int(x[0] + x[1] > 0) if rnd.random() > 0.25 else rnd.randint(0, 1)  # noise that a wide network learns by heart
        rows.append((i, *x, float(y)))
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
        spark.createDataFrame(rows, "id long, a double, b double, c double, label double").coalesce(1))
    return df.filter("id % 2 = 0").cache(), df.filter("id % 2 = 1").cache()


def test_best_weights_are_kept(parts):
    train, val = parts
    model, history = S.fit_with_patience(train, val, [3, 40, 2], epochs=200, patience=15, slice_epochs=5)
    best = history.index(min(history))
    assert len(history) == best + 1 + 3  # three slices of five epochs without a gain
    assert len(history) < 40
    assert S.log_loss(model, val) == pytest.approx(min(history), abs=1e-12)
    assert min(history) < 0.65 < 0.69


def test_slices_go_on_from_the_weights_before(parts):
    train, val = parts
    _, history = S.fit_with_patience(train, val, [3, 4, 2], epochs=12, patience=100, slice_epochs=4)
    _, longer = S.fit_with_patience(train, val, [3, 4, 2], epochs=14, patience=100, slice_epochs=4)
    assert len(history) == 3 and len(longer) == 4  # the last slice has two epochs
    assert longer[:3] == pytest.approx(history)
    assert history[1] != history[0]


def test_without_validation_rows(parts):
    train, val = parts
    model, history = S.fit_with_patience(train, val.filter(F.lit(False)), [3, 4, 2], epochs=4, slice_epochs=2)
    assert history == [] and model.weights.size == 3 * 4 + 4 + 4 * 2 + 2
