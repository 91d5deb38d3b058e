"""Splits, weights and scaling."""

import math

from pyspark.sql import functions as F

from panelwarn.operators import sampling as M
from panelwarn.operators import weighting as WT


def test_published_split_sizes():
    counts = {1: 38303, 0: 3517}
    test = M.stratified_quotas(counts, 0.2)
    assert sum(test.values()) == 8364
    rest = {c: counts[c] - test[c] for c in counts}
    val = M.stratified_quotas(rest, 0.2)
    assert sum(val.values()) == 6692
    assert sum(rest.values()) - sum(val.values()) == 26764


def test_stratified_split_exact(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    out = M.stratified_split(df, "y", "id")
    assert out.count() == 1000 and out.select("id").distinct().count() == 1000
    got = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    q_test = M.stratified_quotas({0: 900, 1: 100}, 0.2)
    assert got[(0, "test")] == q_test[0] and got[(1, "test")] == q_test[1]
    assert got[(0, "test")] + got[(1, "test")] == 200


def test_positional_split(spark):
    df = spark.range(101).withColumn("k", F.col("id") * 2)
    out = {r["split"]: r["count"] for r in M.positional_split(df, ["k"]).groupBy("split").count().collect()}
    assert out == {"train": int(0.8 * 101), "val": int(0.9 * 101) - int(0.8 * 101), "test": 101 - int(0.9 * 101)}


def test_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    model = WT.fit_standard_scaler(df, ["x"])
    assert math.isclose(model.stds["x"], 1.118033988749895)
    vals = [r["x"] for r in model.transform(df).collect()]
    assert math.isclose(sum(vals), 0.0, abs_tol=1e-12)


def test_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)] * 9, "y int")
    w = {r["y"]: r["weight"] for r in WT.balanced_weights(df, "y").distinct().collect()}
    assert math.isclose(w[0], 12 / 6) and math.isclose(w[1], 12 / 18)
    assert math.isclose(WT.positive_class_weight(df, "y").first()["scale_pos_weight"], 3 / 9)


def test_sequences_and_reshape(spark):
    import datetime as dt
    from panelwarn.operators.windows import PanelSpec
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i), i % 2) for i in range(15)]
    rows += [("b", dt.date(2020, 1, 1), 1.0, 1)]  # too short: no sequence
    df = spark.createDataFrame(rows, "e string, t date, x double, y int")
    seq = M.lookback_sequences(df, PanelSpec("e", "t"), ["x"], "y", lookback=12)
    got = seq.orderBy("t").collect()
    assert len(got) == 3 and got[0]["seq"] == [[float(i)] for i in range(12)]
    flat = seq.select(M.flatten_sequences("seq").alias("f"))
    back = flat.select(M.reshape_sequences("f", 12, 1).alias("s")).orderBy("s").first()["s"]
    assert back == [[float(i)] for i in range(12)]


def test_split_by_counting(spark, monkeypatch):
    """The counted bounds give the rows that a sort would, however many rounds they take; nothing is numbered."""
    import hashlib

    from pyspark.sql import functions as F

    from panelwarn.operators import sampling as S
    rows = [(i, i % 7 // 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, y int").repartition(5)

    def want(rows):
        counts = {y: sum(r[1] == y for r in rows) for y in {r[1] for r in rows}}
        test = S.stratified_quotas(counts, 0.2)
        val = S.stratified_quotas({y: counts[y] - test[y] for y in counts}, 0.2)
        out = {}
        for y in counts:
            mine = sorted((i for i, c in rows if c == y), key=lambda i: hashlib.md5(f"{i}-42".encode()).hexdigest())
            out.update({i: "test" if k < test[y] else "val" if k < test[y] + val[y] else "train" for k, i in enumerate(mine)})
        return out

    for limit in (1000, 40, 1):
        monkeypatch.setattr(S, "BRACKET_ROWS", limit)
        split = S.stratified_split(df, "y", "id")
        assert {r["id"]: r["split"] for r in split.collect()} == want(rows)
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "Repartition" not in plan.replace("Repartition 5", "").replace("Repartition", "", 1)
    # repeated and null ids, a null class, one row a class, an empty frame
    odd = spark.createDataFrame([(1, 0)] * 5 + [(2, 0)] * 5 + [(None, 0), (None, 1), (7, None), (8, 2)], "id long, y int")
    got = S.stratified_split(odd, "y", "id").groupBy("id", "y").agg(F.collect_set("split").alias("s")).collect()
    assert all(len(r["s"]) == 1 for r in got)
    assert S.stratified_split(df.limit(0), "y", "id").count() == 0
