"""Driver contract: entry() runs, every query key is well formed, oracle keys are registered."""

import re

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 100 and "entity" in df.columns
    assert all(r["lag_12"] is not None and r["time_index"] > 12 for r in rows)


def test_keys():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    for k in qs:
        assert k == "pipeline" or re.match(r"^[a-z]+[0-9]*_[a-z0-9_]+$", k), k


HEAVY = ("m8_", "m9_", "m10_", "m12_", "m13_", "m14_", "m15_", "pipeline", "op")


def test_light_queries_match_sql(spark):
    """Every light query that has SQL gives the same number of rows and the same columns on the smallest tables."""
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
              "labels conversations").split():
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    sql = entry.oracle_sql()
    for k, fn in entry.queries().items():
        if k.startswith(HEAVY) or k not in sql:
            continue
        got = fn(spark, sf).toPandas()  # all columns are computed
        want = con.execute(sql[k]).df()
        assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want), k
        for c in got.columns:
            assert got[c].isna().sum() == want[c].isna().sum(), (k, c)
            if got[c].dtype.kind in "iufb" and want[c].dtype.kind in "iufb":
                assert abs(got[c].astype(float).sum() - want[c].astype(float).sum()) <= 1e-6 * max(1, abs(want[c].astype(float).sum())), (k, c)
