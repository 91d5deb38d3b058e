"""Nearest neighbours in random-projection leaves, and SMOTE properties."""

import random

import numpy as np
from pyspark.sql import functions as F

from panelwarn.operators.smote import knn, smote


def points(n=160, d=6, seed=5):
    rnd = random.Random(seed)
    return [(i, [round(rnd.gauss(0, 1), 3) for _ in range(d)]) for i in range(n)]


def brute_knn(rows, k):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows])
    out = {}
    for a in range(len(rows)):
        d2 = ((x - x[a]) ** 2).sum(axis=1)
        order = sorted((d2[b], ids[b]) for b in range(len(rows)) if b != a)
        out[ids[a]] = [i for _, i in order[:k]]
    return out


def neighbours(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["id"], []).append((r["rank"], r["nb_id"]))
    return {i: [nb for _, nb in sorted(v)] for i, v in got.items()}


def test_one_leaf_is_exact(spark):
    rows = points()
    assert neighbours(knn(spark.createDataFrame(rows, "id long, vec array<double>"), k=5)) == brute_knn(rows, 5)


def test_leaves_are_bounded_and_merge(spark):
    rows = points(600, 3)
    ref = brute_knn(rows, 5)
    got = neighbours(knn(spark.createDataFrame(rows, "id long, vec array<double>"), k=5, leaf_rows=150))
    assert all(len(v) == 5 and len(set(v)) == 5 and i not in v for i, v in got.items()) and len(got) == 600
    assert sum(len(set(got[i]) & set(ref[i])) for i in ref) >= 0.7 * 5 * 600


def test_near_equal_points(spark):
    """Many points 1e-10 apart beside normal ones: no bucket width to break."""
    rnd = random.Random(1)
    rows = [(i, [1.0 + rnd.random() * 1e-10 for _ in range(4)]) for i in range(300)]
    rows += [(300 + i, [rnd.gauss(0, 5) for _ in range(4)]) for i in range(150)] + [(450 + i, [2.0] * 4) for i in range(100)]
    got = neighbours(knn(spark.createDataFrame(rows, "id long, vec array<double>"), k=5, leaf_rows=128))
    assert len(got) == 550 and all(len(v) == 5 for v in got.values())


def test_smote_balances_and_interpolates(spark):
    rows = [(i, v, 1 if i % 4 else 0) for i, v in points(120, 4)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, y int")
    out = smote(df, "y", "id", "vec")
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 90
    mins = {i: np.array(v) for i, v, y in rows if y == 0}
    syn = out.filter(F.col("synthetic")).collect()
    assert len(syn) == 60
    for r in syn:
        p = np.array(r["vec"])
        # on a segment between two minority points
        assert any(_on_segment(p, a, b) for a in mins.values() for b in mins.values())


def test_three_classes_and_a_single_row(spark):
    rows = [(i, v, {0: "a", 1: "b"}.get(i % 5, "c")) for i, v in points(50, 3)] + [(99, [7.0, 7.0, 7.0], "d")]
    out = smote(spark.createDataFrame(rows, "id long, vec array<double>, y string"), "y", "id", "vec")
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == dict.fromkeys("abcd", 30)
    assert all(r["vec"] == [7.0, 7.0, 7.0] for r in out.filter("y = 'd'").collect())


def _on_segment(p, a, b):
    ab, ap = b - a, p - a
    n = float(ab @ ab)
    if n == 0:
        return np.allclose(p, a)
    t = float(ap @ ab) / n
    return -1e-9 <= t <= 1 + 1e-9 and np.allclose(a + t * ab, p, atol=1e-9)


def test_many_leaves_are_exact(spark):
    """Classes of many leaves get exact neighbours: high dimensions, clusters, equal points, text ids."""
    rng = np.random.default_rng(7)
    gauss = rng.standard_normal((700, 24))
    centres = rng.standard_normal((12, 8)) * 20
    clusters = centres[rng.integers(0, 12, 700)] + rng.standard_normal((700, 8))
    equal = np.concatenate([np.ones((300, 3)), rng.standard_normal((200, 3)).round(1)])
    for x in (gauss, clusters, equal):
        rows = [(f"p{i:04}", [float(c) for c in v]) for i, v in enumerate(x)]
        got = neighbours(knn(spark.createDataFrame(rows, "id string, vec array<double>"), k=5, leaf_rows=64))
        assert got == brute_knn(rows, 5)
