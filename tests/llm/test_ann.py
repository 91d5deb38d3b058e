import numpy as np
import pytest

from panelwarn.llm import ann


def brute(ids, x, k, every):
    norms = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            s = x @ x[i] / (norms * norms[i])
            order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-s[j], ids[j]))[:k]
            out[q] = [(ids[j], s[j]) for j in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def recall(got, want, scores):
    hit = total = 0
    for q, near in want.items():
        found = got.get(q, [])
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1)) and len(found) == len(near)
        assert len({v for _, v, _ in found}) == len(found)
        for (_, a, s), (_, b, t) in zip(found, found[1:]):
            assert s > t or s == t and a < b
        for _, v, s in found:
            assert abs(s - scores(q, v)) < 1e-12
        hit += len({v for _, v, _ in found} & {v for v, _ in near})
        total += len(near)
    assert set(got) == set(want)
    return hit / total


def scorer(ids, x):
    at = {v: i for i, v in enumerate(ids)}
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return lambda q, v: float(unit[at[q]] @ unit[at[v]])


@pytest.mark.parametrize("cell_rows", [8192, 150])
def test_recall_on_whole_table(spark, cell_rows):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").limit(2500).cache()
    rows = table.collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    got = answers(ann.nearest(table, cell_rows=cell_rows))
    assert recall(got, brute(ids, x, 5, 50), scorer(ids, x)) >= 0.95


def test_clusters_and_copies(spark):
    """A vector with many copies, many scaled copies of one direction, and tight clusters."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 16))
    x = np.concatenate([np.repeat(centres[:1], 300, axis=0), centres[1] * rng.uniform(1, 9, (300, 1)),
                        centres[rng.integers(2, 8, 600)] + 0.05 * rng.standard_normal((600, 16))])
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = answers(ann.nearest(df, cell_rows=64))
    want = brute(ids, x, 5, 50)
    copies = sorted(i for i in ids[:300])
    for q in want:
        if q in copies:  # ties go to the smallest ids
            assert [v for _, v, _ in got[q]] == [c for c in copies if c != q][:5]
    at = {v: i for i, v in enumerate(ids)}
    close = sum(abs(got[q][-1][2] - want[q][-1][1]) < 1e-9 for q in want if 600 <= at[q])
    assert close >= 0.9 * sum(600 <= at[q] for q in want)
    assert all(got[q][-1][2] > 1 - 1e-9 for q in want if at[q] < 600)


def test_odd(spark):
    good = [(i, [float(i + 1), 1.0, float(i % 3)]) for i in range(8)]
    odd = [(50, None), (None, [1.0, 2.0, 3.0]), (100, [0.0, 0.0, 0.0]), (150, [1.0, None, 2.0]),
           (200, [1.0, float("nan"), 2.0]), (250, [float("inf"), 1.0, 1.0]), (300, [1.0, 2.0]), (350, [])]
    df = spark.createDataFrame(good + odd + good[:2], "vec_id long, embedding array<double>")
    df = df.selectExpr("*", "'x' as cell", "'y' as query_id", "'z' as score", "1 as rank")
    got = answers(ann.nearest(df))
    x = np.array([v for _, v in good])
    assert recall(got, brute([i for i, _ in good], x, 5, 50), scorer(range(8), x)) == 1
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0])], df.select("vec_id", "embedding").schema)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (3, [1e-300, 1e-300])], "vec_id long, embedding array<double>")
    assert [r[:2] for r in answers(ann.nearest(two))[0]] == [(1, 3)]


def test_chi_square():
    assert abs(ann.chi_square_cdf(15.507313, 8) - 0.95) < 1e-7
    assert abs(ann.chi_square_quantile(0.9, 2) - 4.605170) < 1e-6
