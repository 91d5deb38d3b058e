"""Scenario features (F19/F20), feature maps (P14), error capture (C3), guards."""

import math

import pytest
from pyspark.sql import functions as F

from panelwarn.operators import scoring as SC
from panelwarn.operators.scenario import code_table, scenario_features


def test_scenario_example(spark):
    base = spark.createDataFrame([("BGD", 2024, 6, 28.5, 5.2, 25.0, 30.0, 20.0)],
                                 "country string, year int, month int, temperature_c double, "
                                 "precipitation_mm double, cases_lag_1 double, cases_lag_2 double, cases_lag_3 double")
    r = scenario_features(base, code_table(spark)).first()
    ma3 = (25 + 30 + 20) / 3
    assert r["dengue_lag_6"] == 16.0 and r["dengue_lag_12"] == 12.0
    assert math.isclose(r["dengue_ma_3"], ma3)
    assert math.isclose(r["dengue_std_3"], math.sqrt(((25 - ma3) ** 2 + (30 - ma3) ** 2 + (20 - ma3) ** 2) / 3))
    assert r["weekofyear"] == math.ceil(152 / 7) + 1  # 2024-06-01 is day 153
    assert r["dayofyear"] == 1 and r["time_index"] == 250 and r["ISO_A0_encoded"] == 0
    assert math.isclose(r["year_normalized"], (2024 - 1981) / 44)
    assert math.isclose(r["temperature_c_ma_6"], ((28.5 + 28.5 * 0.98 + 28.5 * 0.96) / 3 + 28.5 * 0.94 + 28.5 * 0.9) / 3)


def test_map_to_vector_and_errors(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, {"a": 1.0, "b": 2.0}), (2, {"a": 3.0})], "id int, m map<string,double>")
    damaged = spark.createDataFrame([(3, {"a": None}), (4, {"a": 1.0, "b": nan}), (5, {"a": -inf, "b": inf}), (6, None)],
                                    "id int, m map<string,double>")
    vec = {r["id"]: r["v"] for r in df.select("id", SC.map_to_vector("m", ["b", "a", "z"]).alias("v")).collect()}
    assert vec == {1: [2.0, 1.0, 0.0], 2: [0.0, 3.0, 0.0]}

    def score(d):
        return d.withColumn("probability", SC.linear_probability("_pw_vec", [1.0, 1.0], 0.0))
    both = df.unionByName(damaged)
    out = {r["id"]: r for r in SC.score_with_errors(both, "m", ["a", "b"], score, 0.5, keep=["id"]).collect()}
    assert out[2]["error"] is None and math.isclose(out[2]["probability"], 1 / (1 + math.exp(-3)))  # absent counts as 0.0
    assert out[1]["error"] is None and out[1]["prediction"] == 1
    assert {i: out[i]["error"] for i in (3, 4, 5, 6)} == {
        3: "invalid features: a", 4: "invalid features: b", 5: "invalid features: a, b", 6: "no features"}
    assert all(out[i]["probability"] is None and out[i]["prediction"] is None for i in (3, 4, 5, 6))


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="b"):
        SC.require_columns(df, ["a", "b"])
    with pytest.raises(ValueError):
        SC.require_rows(df.filter(F.lit(False)))
