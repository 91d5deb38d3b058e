"""Sampled Shapley values against exact ones."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from panelwarn.operators.explain import background_rows, shapley_importance, shapley_values

FEATURES = ["a", "b", "c"]


def value(a, b, c):
    return 2 * a + a * b - 3 * max(c, 0.0)


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(i, float(i % 3), float(i % 5 - 2), float((-1) ** i * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    return df.filter("id < 6"), df.filter("id >= 6")


def score(df):
    return df.withColumn("f", 2 * F.col("a") + F.col("a") * F.col("b") - 3 * F.greatest(F.col("c"), F.lit(0.0)))


def exact(x, z):
    """Shapley values of x against one background row, over all orders."""
    phi = [0.0] * 3
    for order in itertools.permutations(range(3)):
        at = list(z)
        for i in order:
            before = value(*at)
            at[i] = x[i]
            phi[i] += (value(*at) - before) / math.factorial(3)
    return phi


def test_values_add_up_and_come_near_the_exact_ones(frames):
    test, train = frames
    got = {(r["id"], r["feature"]): r["shapley"] for r in shapley_values(test, train, "id", FEATURES, score, "f", 24).collect()}
    assert len(got) == 18
    z = [tuple(r["_pw_z"]) for r in background_rows(train, "id", FEATURES, 24).collect()]
    assert len(set(z)) > 10
    base = sum(value(*r) for r in z) / len(z)
    for r in test.collect():
        x = (r["a"], r["b"], r["c"])
        assert sum(got[r["id"], f] for f in FEATURES) == pytest.approx(value(*x) - base)
        want = [sum(exact(x, q)[i] for q in z) / len(z) for i in range(3)]
        assert got[r["id"], "c"] == pytest.approx(want[2])  # no interaction: the order does not matter
        for i, f in enumerate(FEATURES):
            assert abs(got[r["id"], f] - want[i]) < 1.5


def test_fewer_background_rows_than_asked_and_null_ids(frames, spark):
    test, train = frames
    few = train.filter("id < 9")
    got = shapley_values(test.withColumn("id", F.when(F.col("id") > 2, F.col("id"))), few, "id", FEATURES, score, "f", 50)
    assert {r["id"] for r in got.collect()} == {3, 4, 5}
    one = {(r["id"], r["feature"]): r["shapley"] for r in got.collect()}
    again = {(r["id"], r["feature"]): r["shapley"] for r in
             shapley_values(test, few, "id", FEATURES, score, "f", 50).collect()}
    assert all(again[k] == pytest.approx(v) for k, v in one.items())
    assert shapley_values(test, few.limit(0), "id", FEATURES, score, "f", 5).count() == 0


def test_importance(frames):
    test, train = frames
    values = shapley_values(test, train, "id", FEATURES, score, "f", 8)
    by = {}
    for r in values.collect():
        by.setdefault(r["feature"], []).append(r["shapley"])
    for r in shapley_importance(values).collect():
        assert r["mean_abs_shapley"] == pytest.approx(sum(map(abs, by[r["feature"]])) / 6)
        assert r["mean_shapley"] == pytest.approx(sum(by[r["feature"]]) / 6)
