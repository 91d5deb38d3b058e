"""Window features vs an independent pandas computation (D1-D7), blocked path, leakage."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelwarn.operators.features import lag_columns, past_rolling
from panelwarn.operators.windows import PanelSpec, apply_panel_window

SPEC = PanelSpec(entity="e", time="t", tiebreak=("uid",), target="y")


def hand_frame(spark):
    rows = []
    uid = 0
    for e, n in (("A", 30), ("B", 13), ("C", 1), ("D", 12)):
        for i in range(n):
            if e == "A" and i == 5:
                continue  # gap month
            uid += 1
            y = float((i * 7 + len(e)) % 11)
            if e == "A" and i == 9:
                y = None  # missing count
            if e == "B" and i == 2:
                y = 0.0
            rows.append((e, dt.date(2000 + i // 12, i % 12 + 1, 1), uid, y))
    # two rows with equal (entity, date): order decided by uid
    rows.append(("A", dt.date(2000, 3, 1), 999, 4.0))
    return spark.createDataFrame(rows, "e string, t date, uid long, y double")


def build(w, idx):
    cols = lag_columns("y", (1, 2, 3, 6, 12), w)
    cols.update(past_rolling("y", (3, 6, 12), w))
    cols["ti"] = idx
    return cols


def pandas_reference(pdf):
    pdf = pdf.sort_values(["e", "t", "uid"], kind="mergesort").reset_index(drop=True)
    g = pdf.groupby("e")["y"]
    for k in (1, 2, 3, 6, 12):
        pdf[f"y_lag_{k}"] = g.shift(k)
    for k in (3, 6, 12):
        pdf[f"y_ma_{k}"] = g.transform(lambda x: x.shift(1).rolling(k, min_periods=1).mean())
        pdf[f"y_std_{k}"] = g.transform(lambda x: x.shift(1).rolling(k, min_periods=1).std())
    pdf["ti"] = pdf.groupby("e").cumcount() + 1
    return pdf


def compare(spark_df, ref):
    got = spark_df.toPandas().sort_values(["e", "t", "uid"]).reset_index(drop=True)
    for c in ref.columns:
        a, b = got[c].to_numpy(), ref[c].to_numpy()
        if got[c].dtype.kind in "fi" and ref[c].dtype.kind in "fi":
            assert np.allclose(a.astype(float), b.astype(float), equal_nan=True, atol=1e-9), c
        else:
            assert (a == b).all(), c


def test_matches_pandas(spark):
    df = hand_frame(spark)
    ref = pandas_reference(df.toPandas())
    compare(apply_panel_window(df, SPEC, build, lookback=12), ref)


def test_blocked_path_equals_plain(spark):
    df = hand_frame(spark)
    ref = pandas_reference(df.toPandas())
    compare(apply_panel_window(df, SPEC, build, lookback=12, block_rows=13), ref)
    compare(apply_panel_window(df, SPEC, build, lookback=12, block_rows=14), ref)


def test_no_leakage(spark):
    df = hand_frame(spark)
    base = apply_panel_window(df, SPEC, build, lookback=12).toPandas().set_index("uid").sort_index()
    target_uid = int(base[base.e == "A"].index[10])
    changed = df.withColumn("y", F.when(F.col("uid") == target_uid, F.lit(1e6)).otherwise(F.col("y")))
    new = apply_panel_window(changed, SPEC, build, lookback=12).toPandas().set_index("uid").sort_index()
    feats = [c for c in base.columns if c not in ("e", "t", "y")]
    pd.testing.assert_frame_equal(base.loc[[target_uid], feats], new.loc[[target_uid], feats])
    later = base[(base.e == "A") & (base.ti == base.loc[target_uid, "ti"] + 1)].index[0]
    assert base.loc[later, "y_lag_1"] != new.loc[later, "y_lag_1"]


def test_order_insensitive(spark):
    df = hand_frame(spark)
    a = apply_panel_window(df, SPEC, build, lookback=12)
    b = apply_panel_window(df.orderBy(F.rand(7)).repartition(5), SPEC, build, lookback=12)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
