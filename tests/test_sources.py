"""Sources: weather documents (S4), weather store (S5), raw CSV (S1), guards."""

import json
import os
import tempfile

import pytest

from panelwarn.sources import cases as S
from panelwarn.sources import weather as WX


def write_docs(folder):
    docs = {
        "BGD": {"properties": {"parameter": {
            "T2M": {"198101": 19.5, "198102": 22.0, "198113": 26.0, "1981": 1.0, "198103": 25.0},
            "PRECTOTCORR": {"198101": 0.2, "198102": 0.5, "198113": 3.0}}}},
        "THA": {"properties": {"parameter": {"T2M": {"198101": 25.0}, "PRECTOT": {"198101": 1.5}}}},
        "NPL": {"properties": {"parameter": {"PRECTOTCORR": {"198101": 1.0}}}},
        "LKA": {"properties": {"parameter": {"T2M": {"198101": 27.0}, "PRECTOTCORR": {"198102": 1.0}}}},
    }
    for iso, d in docs.items():
        with open(os.path.join(folder, f"{iso}_1981_1981.json"), "w") as fh:
            json.dump(d, fh)


def test_weather_documents(spark):
    folder = tempfile.mkdtemp(prefix="pw-wx-")
    write_docs(folder)
    rows, errors = WX.documents_to_rows(WX.read_weather_documents(spark, folder))
    got = sorted(tuple(r) for r in rows.collect())
    assert got == [("BGD", 1981, 1, 19.5, 0.2), ("BGD", 1981, 2, 22.0, 0.5), ("THA", 1981, 1, 25.0, 1.5)]
    errs = {r["ISO_A0"]: r["error"] for r in errors.collect()}
    assert errs == {"NPL": "Missing T2M", "LKA": "No valid weather records extracted."}
    keep13, _ = WX.documents_to_rows(WX.read_weather_documents(spark, folder), months_only=False)
    assert keep13.filter("month = 13").count() == 1


def test_weather_store_roundtrip(spark):
    folder = tempfile.mkdtemp(prefix="pw-wxs-")
    write_docs(folder)
    rows, _ = WX.documents_to_rows(WX.read_weather_documents(spark, folder))
    store = os.path.join(tempfile.mkdtemp(prefix="pw-store-"), "wx")
    WX.write_weather_store(rows, store)
    back = WX.read_weather_store(spark, store, entities=["BGD"], first_year=1981)
    assert back.count() == 2


def test_raw_cases_and_guard(spark):
    folder = tempfile.mkdtemp(prefix="pw-raw-")
    path = os.path.join(folder, "raw.csv")
    with open(path, "w") as fh:
        fh.write("ISO_A0,calendar_start_date,dengue_total,UUID\n")
        fh.write("BGD,2001-01-01,12,u1\nBGD,not-a-date,x,u2\nTHA,2001-02-01,,u3\n")
    df = S.read_raw_cases(spark, path)
    got = sorted((r["UUID"], r["calendar_start_date"] is None, r["dengue_total"]) for r in df.collect())
    assert got == [("u1", False, 12.0), ("u2", True, None), ("u3", False, None)]
    with pytest.raises(FileNotFoundError):
        S.read_raw_cases(spark, os.path.join(folder, "absent.csv"))


def test_entity_dimension(spark):
    dim = S.entity_dimension(spark)
    assert dim.count() == 10 and dim.filter("iso = 'BGD'").first()["lat"] == 23.6850


def test_weather_reuse(spark, tmp_path):
    """Only missing entity-years are parsed; a document in error is tried again; nothing is stored twice."""
    import json

    from panelwarn.sources import weather as WS
    docs, store = tmp_path / "docs", str(tmp_path / "store")

    def land(entity, parameter, cut=0):
        (docs / f"ISO_A0={entity}").mkdir(parents=True, exist_ok=True)
        text = json.dumps({"properties": {"parameter": parameter}})
        (docs / f"ISO_A0={entity}" / "d.json").write_text(text[:len(text) - cut])

    heat = {"200001": 20.0, "200002": 21.0, "200013": 1.0, "200101": 22.0, "2001": 3.0}
    rain = {"200001": 1.0, "200101": 2.0, "200013": 1.0}
    land("AAA", {"T2M": heat, "PRECTOT": rain})
    land("BBB", {"T2M": heat, "PRECTOT": rain}, cut=5)
    land("CCC", {"PRECTOT": rain})

    def asked(*pairs):
        return spark.createDataFrame(list(pairs), "ISO_A0 string, year int")

    def got(df):
        return sorted((r["ISO_A0"], r["year"], r["month"], r["temperature_c"], r["precipitation_mm"]) for r in df.collect())

    both = asked(("AAA", 2000), ("BBB", 2000), ("CCC", 2000), ("DDD", 2000))
    assert got(WS.load_weather(spark, both, str(docs), store)) == [("AAA", 2000, 1, 20.0, 1.0)]
    assert {r["ISO_A0"]: r["error"] for r in WS.weather_errors(spark, store).collect()} == \
        {"BBB": WS.DAMAGED, "CCC": WS.NO_TEMPERATURE}
    # the stored year is not read again, also when its document changes or is gone
    assert got(WS.load_weather(spark, asked(("AAA", 2000)), str(docs / "gone"), store)) == [("AAA", 2000, 1, 20.0, 1.0)]
    land("AAA", {"T2M": {k: v + 5 for k, v in heat.items()}, "PRECTOT": rain})
    land("BBB", {"T2M": heat, "PRECTOTCORR": {"200002": 7.0}})
    more = asked(("AAA", 2000), ("AAA", 2001), ("BBB", 2000), ("BBB", 2000))
    assert got(WS.load_weather(spark, more, str(docs), store)) == \
        [("AAA", 2000, 1, 20.0, 1.0), ("AAA", 2001, 1, 27.0, 2.0), ("BBB", 2000, 2, 21.0, 7.0)]
    assert [r["ISO_A0"] for r in WS.weather_errors(spark, store).collect()] == ["CCC"]
    assert got(WS.load_weather(spark, asked(("AAA", 2001)), str(docs), store)) == [("AAA", 2001, 1, 27.0, 2.0)]


def test_counts_on_write(spark, tmp_path):
    from panelwarn.sources.sinks import write_complete_features
    rows = [("a", 1.0, None), ("b", float("nan"), 2), (None, 1.0, 3), ("c", 2.0, 4)]
    df = spark.createDataFrame(rows, "k string, x double, n long").repartition(3)
    got = write_complete_features(df, str(tmp_path / "f"))
    assert (got["initial_rows"], got["kept_rows"], got["dropped_rows"]) == (4, 1, 3)
    assert [(c["column"], c["dtype"], c["non_null"], c["missing"]) for c in got["columns"]] == [
        ("k", "string", 3, 1), ("x", "double", 3, 1), ("n", "bigint", 3, 1)]
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "f")).collect()] == ["c"]
    assert write_complete_features(df.limit(0), str(tmp_path / "e"))["initial_rows"] == 0
