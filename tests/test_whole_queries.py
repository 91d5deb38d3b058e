"""Queries over all features, whole training and split entities."""

import __spark_entry__ as entry
from panelwarn.plans import proxy_queries as Q
from panelwarn.plans.fixed_model import LINEAR
from panelwarn.schemas import FEATURE_COLUMNS

SF = "/root/testdata/sf0.001"


def duck(sql):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "nation customer supplier orders lineitem".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con.execute(sql).fetchall()


def test_every_feature_has_an_importance(spark):
    got = {r["feature"]: r["importance"] for r in Q.e6_permutation_importance(spark, SF).collect()}
    assert sorted(got) == sorted(FEATURE_COLUMNS)
    assert got == dict(duck(entry.oracle_sql()["e6_permutation_importance"]))
    assert all(got[f] == 0 for f in FEATURE_COLUMNS if f not in LINEAR)


def test_sequence_training_has_the_operators_epochs(spark, monkeypatch):
    import inspect
    from panelwarn.operators import sequence
    asked = {}

    class Seen(Exception):
        pass

    def train(*args, **kw):
        asked.update(inspect.signature(real).bind(*args, **kw).arguments)
        raise Seen

    real = sequence.train_sequences
    monkeypatch.setattr(sequence, "train_sequences", train)
    try:
        Q.m14_sequence_mlp(spark, SF)
    except Seen:
        pass
    assert asked and asked.get("epochs", inspect.signature(real).parameters["epochs"].default) == 100


def test_sequences_of_every_feature(spark):
    rows = {}
    ft = Q._r6_doubles(Q.feature_table(spark, SF)).orderBy("ISO_A0", "calendar_start_date").collect()
    for r in ft:
        x = [r[c] for c in FEATURE_COLUMNS]
        if not any(v is None or v != v for v in x):
            rows.setdefault(r["ISO_A0"], []).append((r["calendar_start_date"], [float(v) for v in x], int(r["dengue_total"] > 8)))
    want = {(e, d): ([v for _, v, _ in of[i - 12:i]], y) for e, of in rows.items() for i, (d, _, y) in enumerate(of) if i >= 12}
    got = {(r[0], r[1]): (r["seq"], r["target"]) for r in Q.w10_lookback_sequences(spark, SF).collect()}
    assert got and got == want
    flat = {(r[0], r[1]): r["flat"] for r in Q.m5_flatten_sequences(spark, SF).collect()}
    assert flat == {k: [v for x in seq for v in x] for k, (seq, _) in want.items()}


def test_order_lags_split_a_nation(spark, monkeypatch):
    """Windows run per block of a nation, and give what SQL gives over whole nations."""
    monkeypatch.setattr(Q, "ORDER_BLOCK_ROWS", 7)
    out = Q.w6_ordered_row_lags(spark, SF)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.lstrip("+-: ").startswith("Window") and "lag(" in line]
    assert windows and all("_pw_blk" in line for line in windows)
    columns = ["entity", "order_date", "o_orderkey", "o_totalprice", *[f"price_lag_{k}" for k in (1, 2, 3)]]
    key = lambda r: r[2]
    want = duck(f"select {', '.join(columns)} from ({entry.oracle_sql()['w6_ordered_row_lags']})")
    assert sorted(map(tuple, out.select(*columns).collect()), key=key) == sorted(want, key=key)


def test_no_query_of_the_panel_is_without_sql():
    assert not set(Q.REGISTRY) - set(entry.oracle_sql())
