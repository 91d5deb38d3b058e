"""Spark side of the registered queries: one function per SURVEY 2 operator.

Every function takes (spark, sf_dir) and reads whole driver tables (or panels
Spark derives from them).  Float outputs pass through ``round6`` so that the
DuckDB oracle (plans/oracle.py) can compare them bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwarn.functions import round6
from panelwarn.functions.calendar import MONTH_PERIOD, cyclical
from panelwarn.operators.features import lag_columns, past_rolling
from panelwarn.operators.windows import PanelSpec, apply_panel_window
from panelwarn.sources import proxy

CASE_SPEC = PanelSpec(entity="entity", time="month_start", target="cases")

REGISTRY: dict[str, object] = {}


def register(key: str):
    def deco(fn):
        REGISTRY[key] = fn
        return fn
    return deco


@register("slice_panel_features")
def slice_panel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum slice: monthly counts, covariate join, lags, rolling stats, index."""
    j = proxy.joined_panel(spark, sf_dir).select(
        "entity", "month_start", "cases", "temperature_c", "precipitation_mm")

    def build(w, idx):
        cols = lag_columns("cases", (1, 12), w, prefix="lag")
        cols = {k.replace("lag_lag_", "lag_"): v for k, v in cols.items()}
        roll = past_rolling("cases", (3,), w, prefix="c")
        cols["ma_3"], cols["std_3"] = roll["c_ma_3"], roll["c_std_3"]
        cols["t_ma_6"] = past_rolling("temperature_c", (6,), w, prefix="t", stats=("ma",))["t_ma_6"]
        cols["time_index"] = idx
        return cols

    f = apply_panel_window(j, CASE_SPEC, build, lookback=12)
    m_sin, _ = cyclical(F.month("month_start"), MONTH_PERIOD)
    f = f.filter(F.col("lag_12").isNotNull() & F.col("temperature_c").isNotNull()
                 & F.col("std_3").isNotNull())
    return f.select("entity", "month_start", "cases", "lag_1", "lag_12",
                    round6("ma_3").alias("ma_3"), round6("std_3").alias("std_3"),
                    round6("t_ma_6").alias("t_ma_6"), F.col("time_index").cast("long").alias("time_index"),
                    round6(m_sin).alias("month_sin"))


# ---------------------------------------------------------------- shared bits
from panelwarn.operators import panel as P  # noqa: E402
from panelwarn.operators import profile as A  # noqa: E402
from panelwarn.operators.features import (  # noqa: E402
    inclusive_rolling, surge_flag,
)
from panelwarn.sources.tables import read_table  # noqa: E402

EXOG = ("temperature_c", "precipitation_mm")
LI_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _r6_all(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: round6(c) for c in cols})


def _window_query(df: DataFrame, spec: PanelSpec, build, lookback: int) -> DataFrame:
    return apply_panel_window(df, spec, build, lookback=lookback)


# ------------------------------------------------------------ P: projections
@register("p1_drop_columns")
def p1_drop_columns(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return P.drop_if_present(o, ["o_orderpriority", "o_orderstatus", "o_comment", "not_a_column"])


@register("p4_year_filter")
def p4_year_filter(spark, sf_dir):
    return proxy.joined_panel(spark, sf_dir, first_year=1997).select("entity", "month_start", "cases", "temperature_c", "precipitation_mm")


@register("p5_entity_filter")
def p5_entity_filter(spark, sf_dir):
    return proxy.case_panel(spark, sf_dir).filter(F.col("entity") == "NATION_7")


@register("p6_complete_rows")
def p6_complete_rows(spark, sf_dir):
    return _r6_all(P.complete_rows(proxy.sparse_panel(spark, sf_dir)), EXOG)


@register("p7_completeness_counts")
def p7_completeness_counts(spark, sf_dir):
    return P.completeness_counts(proxy.sparse_panel(spark, sf_dir))


@register("p8_entities_without_weather")
def p8_entities_without_weather(spark, sf_dir):
    cases = proxy.case_panel(spark, sf_dir)
    _, skipped = P.split_by_dimension(cases, proxy.sparse_weather(spark, sf_dir), "entity")
    return skipped


@register("p11_fill_absent_features")
def p11_fill_absent_features(spark, sf_dir):
    from panelwarn.operators.scoring import align_features
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return align_features(li, ["l_tax", "l_quantity", "l_extendedprice_x", "l_rank"],
                          keep=["l_orderkey", "l_linenumber"])


@register("p12_target_if_absent")
def p12_target_if_absent(spark, sf_dir):
    from panelwarn.functions.nulls import positive_flag
    d = P.densify_panel(proxy.case_panel(spark, sf_dir), "entity", "month_start", "cases")
    return d if "outbreak_flag" in d.columns else d.withColumn("outbreak_flag", positive_flag("cases"))


@register("p14_map_to_vector")
def p14_map_to_vector(spark, sf_dir):
    from panelwarn.operators.scoring import map_to_vector
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    m = li.select("l_orderkey", "l_linenumber",
                  F.create_map(F.lit("qty"), F.col("l_quantity"), F.lit("disc"), F.col("l_discount"),
                               F.lit("tax"), F.col("l_tax")).alias("features"))
    return m.select("l_orderkey", "l_linenumber",
                    map_to_vector("features", ["tax", "qty", "price", "disc"]).alias("vector"))


# ---------------------------------------------------------------- J/U: joins
@register("j1_weather_join")
def j1_weather_join(spark, sf_dir):
    return _r6_all(proxy.joined_panel(spark, sf_dir), EXOG)


@register("j2_missing_weather_cells")
def j2_missing_weather_cells(spark, sf_dir):
    return P.missing_cell_count(proxy.sparse_panel(spark, sf_dir), EXOG)


@register("j3_region_lookup")
def j3_region_lookup(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    dim = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("entity"), "r_name")
    return proxy.case_panel(spark, sf_dir).join(dim, "entity", "left")


@register("u1_union_weather")
def u1_union_weather(spark, sf_dir):
    w = cut_lineage(proxy.weather_panel(spark, sf_dir))  # aggregated once for both parts
    early = w.filter(F.col("year") <= 1997)
    late = w.filter(F.col("year") > 1997)
    return _r6_all(P.union_frames([early, late]), EXOG)


# --------------------------------------------------------------- W: windows
@register("w1_target_lags")
def w1_target_lags(spark, sf_dir):
    c = proxy.case_panel(spark, sf_dir)
    return _window_query(c, CASE_SPEC, lambda w, _i: lag_columns("cases", (1, 2, 3, 6, 12), w), 12)


@register("w2_exog_lags")
def w2_exog_lags(spark, sf_dir):
    j = proxy.joined_panel(spark, sf_dir).select("entity", "month_start", *EXOG)

    def build(w, _i):
        out = {}
        for c in EXOG:
            out.update(lag_columns(c, (1, 2, 3, 6, 12), w))
        return out
    f = _window_query(j, CASE_SPEC, build, 12)
    return _r6_all(f, [c for c in f.columns if c not in ("entity", "month_start")])


@register("w3_rolling_mean")
def w3_rolling_mean(spark, sf_dir):
    c = proxy.case_panel(spark, sf_dir)
    f = _window_query(c, CASE_SPEC, lambda w, _i: past_rolling("cases", (3, 6, 12), w, stats=("ma",)), 12)
    return _r6_all(f, ["cases_ma_3", "cases_ma_6", "cases_ma_12"])


@register("w4_rolling_std")
def w4_rolling_std(spark, sf_dir):
    c = proxy.case_panel(spark, sf_dir)
    f = _window_query(c, CASE_SPEC, lambda w, _i: past_rolling("cases", (3, 6, 12), w, stats=("std",)), 12)
    return _r6_all(f, ["cases_std_3", "cases_std_6", "cases_std_12"])


@register("w5_exog_rolling")
def w5_exog_rolling(spark, sf_dir):
    j = proxy.joined_panel(spark, sf_dir).select("entity", "month_start", *EXOG)

    def build(w, _i):
        out = {}
        for c in EXOG:
            out.update(past_rolling(c, (3, 6), w))
        return out
    f = _window_query(j, CASE_SPEC, build, 6)
    return _r6_all(f, [c for c in f.columns if c not in ("entity", "month_start")])


#: Consecutive orders of a nation in a block.
ORDER_BLOCK_ROWS = 100_000


@register("w6_ordered_row_lags")
def w6_ordered_row_lags(spark, sf_dir):
    rows = proxy.order_rows(spark, sf_dir)
    spec = PanelSpec(entity="entity", time="order_date", tiebreak=("o_orderkey",), target="o_totalprice")
    # few entities, each with a large share of the rows
    f = apply_panel_window(rows, spec, lambda w, _i: lag_columns("o_totalprice", (1, 2, 3), w, prefix="price"), lookback=3,
                           block_rows=ORDER_BLOCK_ROWS)
    return _r6_all(f, ["o_totalprice", "price_lag_1", "price_lag_2", "price_lag_3"])


@register("w7_inclusive_rolling")
def w7_inclusive_rolling(spark, sf_dir):
    j = proxy.joined_panel(spark, sf_dir).select("entity", "month_start", *EXOG)
    f = _window_query(j, CASE_SPEC, lambda w, _i: {
        "temperature_c_roll_mean_3": inclusive_rolling("temperature_c", 3, w, "mean"),
        "precipitation_mm_roll_std_3": inclusive_rolling("precipitation_mm", 3, w, "std")}, 2)
    return _r6_all(f, [*EXOG, "temperature_c_roll_mean_3", "precipitation_mm_roll_std_3"])


@register("w8_time_index")
def w8_time_index(spark, sf_dir):
    return _window_query(proxy.case_panel(spark, sf_dir), CASE_SPEC, lambda _w, i: {"time_index": i}, 0)


@register("w9_surge_flag")
def w9_surge_flag(spark, sf_dir):
    c = proxy.case_panel(spark, sf_dir)
    return _window_query(c, CASE_SPEC, lambda w, _i: {"surge_flag": surge_flag("cases", w, min_count=8)}, 1)


@register("w10_lookback_sequences")
def w10_lookback_sequences(spark, sf_dir):
    """Sequences of all features, over complete rows as in training."""
    from panelwarn.operators.sampling import lookback_sequences
    ft = P.complete_rows(feature_table(spark, sf_dir).select("ISO_A0", "calendar_start_date", *FEATURE_COLUMNS,
                                                             (F.col("dengue_total") > 8).cast("int").alias("target")))
    return lookback_sequences(_r6_doubles(ft), PanelSpec(), FEATURE_COLUMNS, "target", lookback=12)


@register("w11_entity_standardize")
def w11_entity_standardize(spark, sf_dir):
    from panelwarn.operators.sampling import standardize_within
    c = proxy.case_panel(spark, sf_dir)
    out = standardize_within(c, ["entity"], ["cases"], suffix="_z")
    return _r6_all(out, ["cases_z"])


# ------------------------------------------------------------ T: sort/limit
@register("t1_sorted_panel")
def t1_sorted_panel(spark, sf_dir):
    return proxy.case_panel(spark, sf_dir).orderBy("entity", "month_start")


@register("t2_top_entities")
def t2_top_entities(spark, sf_dir):
    totals = A.total_by(proxy.case_panel(spark, sf_dir), ["entity"], "cases")
    return A.top_k(totals, "total", 10, tiebreak=["entity"])


@register("t5_latest_history")
def t5_latest_history(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    return A.top_k_per_group(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 10)


@register("t5_streamed_history")
def t5_streamed_history(spark, sf_dir):
    """T5 as requests arrive: four landings, the stream stopped and resumed after each."""
    from panelwarn.streaming.history import PredictionHistory, keep_history
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    root = _scratch(spark, "history")
    for i in range(4):
        e.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i).write.mode("append").parquet(f"{root}/events")
        kept = PredictionHistory(f"{root}/kept", ["user_id"], ts="ts", tiebreak="event_id", fanout=3)
        keep_history(spark.readStream.schema(e.schema).parquet(f"{root}/events"), kept, f"{root}/ckpt").awaitTermination()
    return kept.read(spark)


# ------------------------------------------------------------ A: profiling
@register("a1_total_cases")
def a1_total_cases(spark, sf_dir):
    return A.total(proxy.case_panel(spark, sf_dir), "cases", "total_cases")


@register("a2_total_by_entity")
def a2_total_by_entity(spark, sf_dir):
    return A.total_by(proxy.case_panel(spark, sf_dir), ["entity"], "cases")


@register("a3_share_by_entity")
def a3_share_by_entity(spark, sf_dir):
    s = A.share_by(proxy.case_panel(spark, sf_dir), ["entity"], "cases")
    return _r6_all(s, ["share_pct"])


@register("a4_series_by_entity_date")
def a4_series_by_entity_date(spark, sf_dir):
    rows = proxy.order_rows(spark, sf_dir)
    g = rows.groupBy("entity", "order_date").agg(F.count(F.lit(1)).alias("orders"),
                                                  F.sum("o_totalprice").alias("total_price"))
    return _r6_all(g, ["total_price"])


@register("a5_distinct_values")
def a5_distinct_values(spark, sf_dir):
    return A.distinct_values(read_table(spark, sf_dir, "events", "event_type"), "event_type")


@register("a6_year_range")
def a6_year_range(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderdate").select(F.year("o_orderdate").cast("int").alias("year"))
    return A.min_max(o, "year")


@register("a7_describe")
def a7_describe(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", *LI_MEASURES)
    d = A.describe(li, LI_MEASURES)
    return _r6_all(d, ["mean", "std", "min", "max", "p25", "p50", "p75"])


@register("a8_describe_categorical")
def a8_describe_categorical(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderstatus", "o_orderpriority")
    return A.describe_categorical(o, ["o_orderstatus", "o_orderpriority"])


@register("a9_percentiles")
def a9_percentiles(spark, sf_dir):
    c = proxy.case_panel(spark, sf_dir)
    return _r6_all(A.percentiles(c, ["cases"]), ["quantile"])


@register("a10_table_info")
def a10_table_info(spark, sf_dir):
    return A.table_info(read_table(spark, sf_dir, "lineitem"))


@register("a11_missing_per_column")
def a11_missing_per_column(spark, sf_dir):
    return A.missing_per_column(proxy.sparse_panel(spark, sf_dir))


@register("a12_value_counts")
def a12_value_counts(spark, sf_dir):
    v = A.value_counts(read_table(spark, sf_dir, "labels", "quality"), "quality")
    return _r6_all(v, ["share_pct"])


def _dense_flags(spark, sf_dir):
    from panelwarn.functions.nulls import positive_flag
    d = P.densify_panel(proxy.case_panel(spark, sf_dir), "entity", "month_start", "cases")
    return d.withColumn("flag", positive_flag("cases", 7))


@register("a13_class_by_entity")
def a13_class_by_entity(spark, sf_dir):
    return A.class_by_entity(_dense_flags(spark, sf_dir), "entity", "flag")


@register("a14_positive_rate")
def a14_positive_rate(spark, sf_dir):
    return _r6_all(A.positive_rate(_dense_flags(spark, sf_dir), "entity", "flag"), ["positive_rate"])


@register("a15_seasonal_mean")
def a15_seasonal_mean(spark, sf_dir):
    c = proxy.case_panel(spark, sf_dir).withColumn("month", F.month("month_start").cast("int"))
    return _r6_all(A.seasonal_mean(c, "month", "cases"), ["mean_cases"])


@register("a16_iqr_outliers")
def a16_iqr_outliers(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", *LI_MEASURES)
    li = li.withColumn("volume", F.col("l_extendedprice") * F.col("l_quantity"))  # skewed, so it has outliers
    return _r6_all(A.iqr_outliers(li, [*LI_MEASURES, "volume"]), ["q1", "q3", "iqr", "lower", "upper", "outlier_pct"])


@register("a17_correlation_matrix")
def a17_correlation_matrix(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", *LI_MEASURES)
    return _r6_all(A.correlation_long(li, LI_MEASURES), ["corr"])


@register("a19_histogram")
def a19_histogram(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", "l_extendedprice")
    return _r6_all(A.histogram(li, "l_extendedprice", 50), ["lower", "upper"])


@register("a20_box_stats")
def a20_box_stats(spark, sf_dir):
    c = proxy.case_panel(spark, sf_dir).withColumn("month", F.month("month_start").cast("int"))
    return _r6_all(A.box_stats(c, "month", "cases"), ["q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi"])


@register("a21_class_counts")
def a21_class_counts(spark, sf_dir):
    return A.class_counts(read_table(spark, sf_dir, "labels", "toxic"), "toxic")


# ---------------------------------------------------------- F: scalar funcs
from panelwarn import functions as FN  # noqa: E402
from panelwarn.operators import metrics as E  # noqa: E402
from panelwarn.operators import sampling as M  # noqa: E402
from panelwarn.operators import weighting as WT  # noqa: E402
from panelwarn.operators.features import engineer_features, label_codes, year_normalized  # noqa: E402
from panelwarn.plans.fixed_model import SHAPLEY_BACKGROUND, linear_log_odds_sql, linear_probability_sql  # noqa: E402
from panelwarn.session import cut_lineage  # noqa: E402
from panelwarn.schemas import CORRELATION_CANDIDATES, FEATURE_COLUMNS, PROFILE_EXCLUDED  # noqa: E402


def _orders(spark, sf_dir):
    return read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate") \
        .withColumn("order_date", F.col("o_orderdate").cast("date"))


@register("f1_parse_date")
def f1_parse_date(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    return o.select("o_orderkey", FN.parse_date(F.col("o_orderdate").cast("string")).alias("order_date"))


@register("f2_calendar_parts")
def f2_calendar_parts(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.select("o_orderkey", FN.year_of("order_date").alias("year"), FN.month_of("order_date").alias("month"),
                    FN.day_of_year("order_date").alias("dayofyear"))


@register("f3_iso_week")
def f3_iso_week(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", FN.iso_week("order_date").alias("weekofyear"))


@register("f4_quarter")
def f4_quarter(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", FN.quarter_of(FN.month_of("order_date")).alias("quarter"))


@register("f5_season_flag")
def f5_season_flag(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", FN.season_flag(FN.month_of("order_date")).alias("is_rainy_season"))


@register("f6_month_cyclical")
def f6_month_cyclical(spark, sf_dir):
    s, c = FN.cyclical(FN.month_of("order_date"), 12)
    return _orders(spark, sf_dir).select("o_orderkey", round6(s).alias("month_sin"), round6(c).alias("month_cos"))


@register("f7_dayofyear_cyclical")
def f7_dayofyear_cyclical(spark, sf_dir):
    s, c = FN.cyclical(FN.day_of_year("order_date"), 365)
    return _orders(spark, sf_dir).select("o_orderkey", round6(s).alias("dayofyear_sin"),
                                         round6(c).alias("dayofyear_cos"))


@register("f8_interaction")
def f8_interaction(spark, sf_dir):
    j = proxy.joined_panel(spark, sf_dir)
    return j.select("entity", "month_start", round6(FN.interaction("temperature_c", "precipitation_mm"))
                    .alias("temp_precip_interaction"))


@register("f9_year_normalized")
def f9_year_normalized(spark, sf_dir):
    c = proxy.case_panel(spark, sf_dir).withColumn("year", FN.year_of("month_start"))
    return _r6_all(year_normalized(c), ["year_normalized"])


@register("f10_label_encoding")
def f10_label_encoding(spark, sf_dir):
    return label_codes(proxy.case_panel(spark, sf_dir), "entity")


@register("f11_target_flag")
def f11_target_flag(spark, sf_dir):
    j = proxy.joined_panel(spark, sf_dir)
    return j.select("entity", "month_start", FN.positive_flag("temperature_c", 25).alias("warm_flag"))


@register("f12_split_yyyymm")
def f12_split_yyyymm(spark, sf_dir):
    """Year-month keys of the orders, some damaged by their order key."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    key = F.date_format("o_orderdate", "yyyyMM")
    damaged = F.when(F.col("o_orderkey") % 10 == 0, F.substring(key, 1, 5)).when(
        F.col("o_orderkey") % 10 == 1, F.concat(F.substring(key, 1, 4), F.lit("xx"))).when(
        F.col("o_orderkey") % 10 == 2, F.concat(key, F.lit("01"))).otherwise(key)
    valid, y, m = FN.split_yyyymm(damaged)
    return o.select("o_orderkey", valid.alias("valid"), y.alias("year"), m.alias("month"))


@register("f15_year_clamp")
def f15_year_clamp(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.select("o_orderkey", FN.year_clamp(FN.year_of("order_date"), 1996).alias("year"))


@register("f16_round_abs")
def f16_round_abs(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "value")
    return e.select("event_id", round6(F.abs(F.col("value") - F.lit(10.0))).alias("abs_dev"),
                    F.bround(F.col("value") / F.lit(3.0), 2).alias("third_2dp"))


def _scored_labels(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    docs = read_table(spark, sf_dir, "documents", "doc_id", "n_chars")
    return lab.join(docs, "doc_id").withColumn(
        "p", F.least(F.lit(1.0), F.col("n_chars") / F.lit(5000.0)))


@register("f17_threshold_class")
def f17_threshold_class(spark, sf_dir):
    s = _scored_labels(spark, sf_dir)
    return s.select("doc_id", round6("p").alias("p"), FN.threshold_class("p", 0.5).alias("prediction"))


@register("f18_alert_text")
def f18_alert_text(spark, sf_dir):
    s = _scored_labels(spark, sf_dir).withColumn("prediction", FN.threshold_class("p", 0.5))
    return s.select("doc_id", FN.alert_label("prediction").alias("alert"), FN.percent_text("p").alias("probability_text"))


@register("f19_scenario_features")
def f19_scenario_features(spark, sf_dir):
    from panelwarn.operators.scenario import scenario_features
    j = proxy.joined_panel(spark, sf_dir)
    base = _window_query(j, CASE_SPEC, lambda w, _i: lag_columns("cases", (1, 2, 3), w, prefix="cases"), 3)
    base = base.select(F.col("entity").alias("country"), "month_start", "year", "month", *EXOG,
                       *[F.col(f"cases_lag_{k}").cast("double").alias(f"cases_lag_{k}") for k in (1, 2, 3)])
    codes = read_table(spark, sf_dir, "nation", "n_name", "n_nationkey") \
        .select(F.col("n_name").alias("country"), F.col("n_nationkey").cast("int").alias("ISO_A0_encoded"))
    out = scenario_features(base, codes, keep=["month_start"])
    dbl = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    return _r6_all(out, dbl)


@register("f20_scenario_week")
def f20_scenario_week(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.select("o_orderkey", FN.scenario_week_of_year(FN.year_of("order_date"), FN.month_of("order_date"))
                    .alias("weekofyear"))


# ----------------------------------------------------- feature table (all W/F)
def feature_table(spark, sf_dir):
    j = proxy.joined_panel(spark, sf_dir)
    raw = j.select(F.col("entity").alias("ISO_A0"), F.col("month_start").alias("calendar_start_date"),
                   F.col("cases").cast("double").alias("dengue_total"), *EXOG)
    return engineer_features(raw)


def _r6_doubles(df):
    return _r6_all(df, [f.name for f in df.schema.fields
                        if f.dataType.typeName() == "double" and f.name != "dengue_total"])


@register("fe_feature_table")
def fe_feature_table(spark, sf_dir):
    return _r6_doubles(feature_table(spark, sf_dir))


@register("p10_frozen_projection")
def p10_frozen_projection(spark, sf_dir):
    from panelwarn.operators.scoring import align_features
    ft = feature_table(spark, sf_dir)
    return _r6_doubles(align_features(ft, FEATURE_COLUMNS, keep=["ISO_A0", "calendar_start_date"]))


@register("a18_top_target_correlations")
def a18_top_target_correlations(spark, sf_dir):
    ft = feature_table(spark, sf_dir)
    return _r6_all(A.top_correlated(ft, CORRELATION_CANDIDATES, "dengue_total", 10), ["corr", "abs_corr"])


# ------------------------------------------------------ M: splits & weights
@register("m1_stratified_split")
def m1_stratified_split(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    return M.stratified_split(lab, "quality", "doc_id")


@register("m2_positional_split")
def m2_positional_split(spark, sf_dir):
    c = proxy.case_panel(spark, sf_dir).select("entity", "month_start")
    return M.positional_split(c, ["entity", "month_start"])


@register("m2_temporal_split")
def m2_temporal_split(spark, sf_dir):
    return M.temporal_split(read_table(spark, sf_dir, "events", "event_id", "ts"), "ts")


@register("m3_standard_scaler")
def m3_standard_scaler(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    model = WT.fit_standard_scaler(li, ["l_quantity", "l_extendedprice"])
    out = model.transform(li, suffix="_z").drop("l_quantity", "l_extendedprice")
    return _r6_all(out, ["l_quantity_z", "l_extendedprice_z"])


@register("m5_flatten_sequences")
def m5_flatten_sequences(spark, sf_dir):
    s = w10_lookback_sequences(spark, sf_dir)
    return s.select("ISO_A0", "calendar_start_date", M.flatten_sequences("seq").alias("flat"))


@register("m6_balanced_weights")
def m6_balanced_weights(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    return _r6_all(WT.balanced_weights(lab, "quality"), ["weight"])


@register("m7_pos_weight")
def m7_pos_weight(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels", "quality")
    return _r6_all(WT.positive_class_weight(lab, "quality"), ["scale_pos_weight"])


# ------------------------------------------------------------ E: evaluation
def _pred(spark, sf_dir, label="quality", t=0.5):
    return _scored_labels(spark, sf_dir).withColumn("y", F.col(label)) \
        .withColumn("pred", FN.threshold_class("p", t))


@register("e1_metric_set")
def e1_metric_set(spark, sf_dir):
    m = E.metric_set(_pred(spark, sf_dir), "y", "pred")
    return _r6_all(m, m.columns)


@register("e2_confusion_matrix")
def e2_confusion_matrix(spark, sf_dir):
    return E.confusion_long(_pred(spark, sf_dir), "y", "pred")


@register("e3_classification_report")
def e3_classification_report(spark, sf_dir):
    return _r6_all(E.classification_report(_pred(spark, sf_dir), "y", "pred"), ["precision", "recall", "f1"])


@register("e4_roc_auc")
def e4_roc_auc(spark, sf_dir):
    return _r6_all(E.roc_auc(_pred(spark, sf_dir), "y", "p"), ["roc_auc"])


@register("e5_best_threshold")
def e5_best_threshold(spark, sf_dir):
    return _r6_all(E.best_threshold(_pred(spark, sf_dir), "y", "p"), ["best_threshold", "best_macro_f1"])


@register("e7_mean_abs_attribution")
def e7_mean_abs_attribution(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    long = emb.select("vec_id", F.posexplode("embedding").alias("pos", "value")) \
              .withColumn("feature", F.concat(F.lit("f"), F.col("pos").cast("string")))
    return _r6_all(E.mean_abs_attribution(long, k=10), ["mean_abs"])


@register("t4_best_candidate")
def t4_best_candidate(spark, sf_dir):
    rows = []
    for pos, label in enumerate(("quality", "toxic")):
        m = E.metric_set(_pred(spark, sf_dir, label), "y", "pred")
        rows.append(m.select(F.lit(label).alias("candidate"), F.lit(pos).alias("position"), "macro_f1"))
    metrics = P.union_frames(rows)
    return _r6_all(E.select_best(metrics), ["macro_f1"])


# --------------------------------------------------------- S/C: maps, scoring
def _event_maps(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "event_type", "value", "props")
    props = F.from_json("props", "map<string,double>")
    value = F.when(F.col("event_id") % 11 == 0, F.lit(None).cast("double")) \
             .when(F.col("event_id") % 13 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    with_value = F.map_concat(props, F.create_map(F.lit("value"), value))
    # error events lack the value (it counts as 0.0); some values are damaged on purpose, by id
    return e.select("event_id", F.when(F.col("event_type") == "error", props).otherwise(with_value)
                    .alias("features"))


@register("s12_feature_map_rows")
def s12_feature_map_rows(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "props")
    m = e.select("event_id", F.from_json("props", "map<string,double>").alias("features"))
    return m.select("event_id", F.explode("features").alias("key", "value"))


@register("c3_batch_error_capture")
def c3_batch_error_capture(spark, sf_dir):
    from panelwarn.operators.scoring import linear_probability, score_with_errors
    maps = _event_maps(spark, sf_dir)

    def score(df):
        return df.withColumn("probability", linear_probability("_pw_vec", [0.02, 0.05], -2.0))
    out = score_with_errors(maps, "features", ["k", "value"], score, 0.5, keep=["event_id"])
    return _r6_all(out.drop("features"), ["probability"])


# ------------------------------------------- models, scoring, streaming (rows)
def _model_frame(spark, sf_dir):
    ft = feature_table(spark, sf_dir)
    return ft.withColumn("row_id", F.concat_ws("|", "ISO_A0", F.col("calendar_start_date").cast("string"))) \
             .withColumn("label", (F.col("dengue_total") > F.col("dengue_ma_3")).cast("int"))


def _train(spark, sf_dir, names):
    from panelwarn.operators.models import PRESETS, train_and_select
    return train_and_select(_model_frame(spark, sf_dir), "label", "row_id", FEATURE_COLUMNS,
                            [PRESETS[n] for n in names])


def _result_frame(spark, res):
    """What SQL can know of a training run: split sizes, and that the model learnt: it has trees, ranks test rows
    better than chance and finds rows of both classes."""
    m = res.metrics
    trees = res.best_model.stages[-1].getNumTrees
    grid = any(abs(res.threshold - (0.1 + i * 0.01)) < 1e-9 for i in range(81))
    parts = [m[k] for k in ("accuracy", "precision", "recall", "f1", "macro_f1")]
    valid = all(0 <= v <= 1 for v in parts) and (m["roc_auc"] is None or 0 <= m["roc_auc"] <= 1)
    return spark.createDataFrame(
        [(res.best_name, *[int(res.split_rows[p]) for p in ("train", "val", "test")], grid, valid, trees > 1,
          m["roc_auc"] > 0.55, m["macro_f1"] > 0.5)],
        "model string, n_train long, n_val long, n_test long, threshold_on_grid boolean, metrics_in_range boolean, "
        "more_than_one_tree boolean, auc_above_chance boolean, both_classes_found boolean")


@register("m8_random_forest")
def m8_random_forest(spark, sf_dir):
    return _result_frame(spark, _train(spark, sf_dir, ["RandomForest"]))


@register("m9_boosted_trees")
def m9_boosted_trees(spark, sf_dir):
    return _result_frame(spark, _train(spark, sf_dir, ["XGBoost"]))


@register("m10_boosted_trees_pos_weight")
def m10_boosted_trees_pos_weight(spark, sf_dir):
    return _result_frame(spark, _train(spark, sf_dir, ["LightGBM"]))


@register("m12_forest_importances")
def m12_forest_importances(spark, sf_dir):
    """Names and order come from the fit; SQL checks that they are 15 of the 43 profiled features."""
    from panelwarn.operators.models import forest_importances, numeric_features
    table = feature_table(spark, sf_dir)
    names = numeric_features(table, PROFILE_EXCLUDED)
    top = forest_importances(table, names, "dengue_total", trees=100, k=15)
    inside = F.col("feature").isin(names) & F.col("importance").between(0, 1)
    order = Window.orderBy(F.desc("importance"), "feature")  # 15 rows
    sums = F.sum("importance").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return top.select(F.row_number().over(order).alias("rank"), inside.alias("valid"),
                      (sums <= 1 + 1e-9).alias("sum_at_most_one"), F.lit(len(names)).alias("candidates"))


@register("m13_boosted_regression_r2")
def m13_boosted_regression_r2(spark, sf_dir):
    from panelwarn.operators.models import boosted_regression_r2
    out = boosted_regression_r2(_model_frame(spark, sf_dir), FEATURE_COLUMNS, "dengue_total", "row_id")
    return out.select("model", "n_train", "n_test", (F.col("r2") <= 1).alias("r2_at_most_one"))


@register("m15_model_comparison")
def m15_model_comparison(spark, sf_dir):
    """The selected model is the first with the largest validation macro F1."""
    res = _train(spark, sf_dir, ["RandomForest", "XGBoost", "LightGBM"])
    best = max(res.all_models.values())
    first = next(n for n, v in res.all_models.items() if v == best)
    rows = [(n, i, 0 <= v <= 1, (n == res.best_name) == (n == first)) for i, (n, v) in enumerate(res.all_models.items())]
    return spark.createDataFrame(rows, "model string, position int, in_range boolean, selected_by_rule boolean")


def _saved_scorer(spark, sf_dir, data=None):
    """S8/S9 round trip: save the artifact with the panel's encoding, load the scorer from it."""
    import uuid
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer
    from panelwarn.operators.features import fit_encoding
    from panelwarn.operators.models import TrainResult, save_artifacts
    from panelwarn.operators.scoring import OutbreakScorer
    from panelwarn.operators.weighting import StandardScalerModel
    from panelwarn.session import checkpoint_dir
    stage = SQLTransformer(statement=f"select *, array(1 - p, p) as probability from (select *, {linear_probability_sql()} as p from __THIS__)")
    scaler = StandardScalerModel(list(FEATURE_COLUMNS), dict.fromkeys(FEATURE_COLUMNS, 0.0), dict.fromkeys(FEATURE_COLUMNS, 1.0))
    fixed = TrainResult("Linear", PipelineModel(stages=[stage]), 0.5, {}, {"Linear": 1.0}, list(FEATURE_COLUMNS), scaler)
    path = f"{checkpoint_dir(spark)}/artifacts/{uuid.uuid4().hex}"
    save_artifacts(fixed, path, encoding=fit_encoding(_raw_panel(spark, sf_dir)), data=data)
    return OutbreakScorer.load(spark, path), path


def _raw_panel(spark, sf_dir):
    return proxy.joined_panel(spark, sf_dir).select(
        F.col("entity").alias("ISO_A0"), F.col("month_start").alias("calendar_start_date"),
        F.col("cases").cast("double").alias("dengue_total"), *EXOG)


@register("c1_batch_panel_scoring")
def c1_batch_panel_scoring(spark, sf_dir):
    scorer, _ = _saved_scorer(spark, sf_dir)
    return _r6_all(scorer.score_panel(_raw_panel(spark, sf_dir), PanelSpec()), ["outbreak_probability"])


@register("c1_subset_features")
def c1_subset_features(spark, sf_dir):
    """Two entities scored alone get the features they have in the whole panel."""
    scorer, _ = _saved_scorer(spark, sf_dir)
    part = _raw_panel(spark, sf_dir).filter(F.col("ISO_A0").isin("NATION_7", "NATION_19"))
    return _r6_doubles(scorer.panel_features(part, PanelSpec()).select("ISO_A0", "calendar_start_date", *FEATURE_COLUMNS))


def _feature_maps(spark, sf_dir):
    """Feature maps; rows of even months lack the key ``temperature_c``, which then counts as 0.0."""
    ft = P.complete_rows(_model_frame(spark, sf_dir).select("row_id", *FEATURE_COLUMNS))
    whole = F.map_from_arrays(F.array(*[F.lit(c) for c in FEATURE_COLUMNS]),
                              F.array(*[F.col(c).cast("double") for c in FEATURE_COLUMNS]))
    lacking = F.map_filter(whole, lambda k, _: k != "temperature_c")
    return ft.select("row_id", F.when(F.col("month") % 2 == 0, lacking).otherwise(whole).alias("features"))


@register("c2_feature_map_scoring")
def c2_feature_map_scoring(spark, sf_dir):
    scorer, _ = _saved_scorer(spark, sf_dir)
    return _r6_all(scorer.score_maps(_feature_maps(spark, sf_dir), keep=["row_id"]), ["outbreak_probability"])


@register("c4_stream_scoring")
def c4_stream_scoring(spark, sf_dir):
    from pyspark.sql.types import StringType, StructField, StructType
    from panelwarn.schemas import REQUEST
    from panelwarn.streaming.scoring_stream import start_scoring
    scorer, path = _saved_scorer(spark, sf_dir)
    src, sink, ck = f"{path}/requests", f"{path}/scored", f"{path}/stream_ckpt"
    _feature_maps(spark, sf_dir).write.mode("overwrite").json(src)
    schema = StructType([StructField("row_id", StringType()), *REQUEST.fields])
    q = start_scoring(spark, scorer, src, sink, ck, keep=("row_id",), schema=schema)
    q.awaitTermination()
    return _r6_all(spark.read.parquet(sink).drop("scored_at"), ["outbreak_probability"])


@register("c4_streamed_history")
def c4_streamed_history(spark, sf_dir):
    """Requests scored as they land, in two landings, and the ten newest predictions of each entity kept."""
    from panelwarn.streaming.history import PredictionHistory, keep_history
    scorer, path = _saved_scorer(spark, sf_dir)
    parts = F.split("row_id", r"\|")
    asked = _feature_maps(spark, sf_dir).select("row_id", parts[0].alias("entity"), parts[1].alias("asked_on"), "features")
    for i in range(2):
        asked.filter(F.pmod(F.xxhash64("row_id"), F.lit(2)) == i).write.mode("append").json(f"{path}/asked")
        stream = spark.readStream.schema(asked.schema).json(f"{path}/asked")
        kept = PredictionHistory(f"{path}/kept", ["entity"], ts="asked_on", tiebreak="row_id")
        scored = scorer.score_maps(stream, keep=["row_id", "entity", "asked_on"])
        keep_history(scored, kept, f"{path}/history_ckpt").awaitTermination()
    return _r6_all(kept.read(spark), ["outbreak_probability"])


def _split_rows(spark, sf_dir):
    """Complete rows of the model frame with their part of the stratified split."""
    frame = cut_lineage(P.complete_rows(_model_frame(spark, sf_dir).select("row_id", "label", *FEATURE_COLUMNS)))
    return M.stratified_split(frame, "label", "row_id")


@register("e6_permutation_importance")
def e6_permutation_importance(spark, sf_dir):
    """Attribution of the fixed model on the test rows to all features; those outside its formula come out as 0."""
    from panelwarn.operators.explain import permutation_importance
    test = _split_rows(spark, sf_dir).filter("split = 'test'").drop("split")
    out = permutation_importance(test, "row_id", "label", FEATURE_COLUMNS, lambda d: d.withColumn("proba", F.expr(linear_probability_sql())), 0.5)
    return _r6_all(out, ["importance"])


def _shapley(spark, sf_dir):
    from panelwarn.operators.explain import shapley_values
    rows = _split_rows(spark, sf_dir)
    odds = F.expr(linear_log_odds_sql())
    return shapley_values(rows.filter("split = 'test'"), rows.filter("split = 'train'"), "row_id", FEATURE_COLUMNS,
                          lambda d: d.withColumn("value", odds), "value", background=SHAPLEY_BACKGROUND)


@register("e6_shapley_values")
def e6_shapley_values(spark, sf_dir):
    """Sampled Shapley values of the fixed model's log-odds: every test row, every feature."""
    return _r6_all(_shapley(spark, sf_dir), ["shapley"])


@register("e6_shapley_importance")
def e6_shapley_importance(spark, sf_dir):
    """Mean absolute Shapley value of every feature over the test rows."""
    from panelwarn.operators.explain import shapley_importance
    return _r6_all(shapley_importance(_shapley(spark, sf_dir)), ["mean_abs_shapley", "mean_shapley"])


# ------------------------------------------- larger panel: parts x ship days
def part_daily_panel(spark, sf_dir):
    """lineitem collapsed to one row per (part, ship day): the finer, wider panel."""
    li = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_shipdate", "l_quantity")
    li = li.withColumn("ship_day", F.col("l_shipdate").cast("date"))
    return P.collapse_panel(li, "l_partkey", "ship_day", ["l_quantity"])


def _part_daily_rolling(spark, sf_dir, block_rows=None):
    spec = PanelSpec(entity="l_partkey", time="ship_day", target="l_quantity")

    def build(w, idx):
        cols = lag_columns("l_quantity", (1, 3, 12), w, prefix="qty")
        cols.update(past_rolling("l_quantity", (3, 12), w, prefix="qty"))
        cols["time_index"] = idx
        return cols
    f = apply_panel_window(part_daily_panel(spark, sf_dir), spec, build, lookback=12, block_rows=block_rows)
    return _r6_all(f, ["qty_ma_3", "qty_std_3", "qty_ma_12", "qty_std_12"])


@register("w3_part_daily_rolling")
def w3_part_daily_rolling(spark, sf_dir):
    return _part_daily_rolling(spark, sf_dir)


@register("w3_part_daily_blocked")
def w3_part_daily_blocked(spark, sf_dir):
    """The same windows by the plan for hot entities: blocks of 20 rows with a halo."""
    return _part_daily_rolling(spark, sf_dir, block_rows=20)


# ------------------------------------------------------------- M4: SMOTE
def _embedding_classes(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select("vec_id", "embedding", F.when(F.col("label") == 0, 0).otherwise(1).alias("y"))


@register("m4_smote")
def m4_smote(spark, sf_dir):
    from panelwarn.operators.smote import smote
    out = smote(_embedding_classes(spark, sf_dir), "y", "vec_id", "embedding")
    return out.withColumn("embedding", F.transform("embedding", lambda x: round6(x)))


@register("a22_class_counts_before_after")
def a22_class_counts_before_after(spark, sf_dir):
    from panelwarn.operators.smote import smote
    before = _embedding_classes(spark, sf_dir)
    after = smote(before, "y", "vec_id", "embedding")
    return A.compare_class_counts(before, after, "y")


@register("m14_sequence_mlp")
def m14_sequence_mlp(spark, sf_dir):
    """Split sizes (SQL recomputes them), and that thresholds, measures and the choice obey the rules."""
    from panelwarn.operators.sequence import train_sequences
    ft = feature_table(spark, sf_dir).withColumn("high", (F.col("dengue_total") > 7).cast("int"))
    r = train_sequences(ft, PanelSpec(), FEATURE_COLUMNS, "high")
    first = max(r.metrics, key=lambda n: (r.metrics[n]["f1"], -list(r.metrics).index(n)))
    valid = all(0 <= m[k] <= 1 for m in r.metrics.values() for k in ("accuracy", "precision", "recall", "f1", "macro_f1"))
    grid = all(any(abs(m["threshold"] - (0.1 + i * 0.01)) < 1e-9 for i in range(81)) for m in r.metrics.values())
    rows = [(*[int(r.split_rows.get(p, 0)) for p in ("train", "balanced", "val", "test")], valid, grid, first == r.best_name)]
    return spark.createDataFrame(rows, "n_train long, n_balanced long, n_val long, n_test long, metrics_in_range boolean, "
                                       "threshold_on_grid boolean, selected_by_rule boolean")


# ------------------------------------------- S: sources and sinks, there and back
def _scratch(spark, name):
    import uuid
    from panelwarn.session import checkpoint_dir
    return f"{checkpoint_dir(spark)}/round_trips/{name}-{uuid.uuid4().hex}"


@register("s1_raw_cases_csv")
def s1_raw_cases_csv(spark, sf_dir):
    """Raw case rows as CSV text, some counts and dates damaged, read back typed."""
    from panelwarn.sources.cases import read_raw_cases
    path = _scratch(spark, "raw")
    o = proxy.order_rows(spark, sf_dir)
    k = F.col("o_orderkey")
    raw = o.select(F.col("entity").alias("ISO_A0"), k.cast("string").alias("UUID"),
                   F.when(k % 13 == 0, "not a date").otherwise(F.col("order_date").cast("string")).alias("calendar_start_date"),
                   F.when(k % 17 == 0, "n/a").otherwise((k % 100).cast("string")).alias("dengue_total"))
    raw.write.option("header", True).csv(path)
    return read_raw_cases(spark, path).select("ISO_A0", "UUID", "calendar_start_date", "dengue_total")


@register("s2_feature_csv")
def s2_feature_csv(spark, sf_dir):
    """S6 then S2: the feature table as CSV; text columns stay text, numbers come back as DOUBLE."""
    from panelwarn.sources.cases import read_feature_table
    from panelwarn.sources.sinks import write_feature_table
    path = _scratch(spark, "features")
    ft = feature_table(spark, sf_dir).withColumn("adm_0_name", F.concat(F.lit("name of "), "ISO_A0"))
    columns = ["ISO_A0", "adm_0_name", "calendar_start_date", "dengue_total", "dengue_lag_1", "dengue_ma_3", "month"]
    write_feature_table(ft.select(*columns), path, fmt="csv")
    return _r6_all(read_feature_table(spark, path, fmt="csv").select(*columns), ["dengue_ma_3"])


def _weather_documents(spark, sf_dir, damaged=False):
    """Folder of one JSON document an entity, by entity; ``damaged``: by the number n of a nation, n % 7 = 0 lacks
    the temperature, 1 all precipitation, 2 that of months 5 and 10, and 3 is cut short."""
    w = proxy.weather_panel(spark, sf_dir)
    key = F.date_format(F.make_date("year", "month", F.lit(1)), "yyyyMM")
    entry = lambda v: F.map_from_entries(F.sort_array(F.collect_list(F.when(v.isNotNull(), F.struct(key, v)))))
    fault = F.pmod(F.regexp_extract("entity", r"(\d+)$", 1).cast("int"), F.lit(7)) if damaged else F.lit(-1)
    rain = F.when((fault == 1) | ((fault == 2) & F.col("month").isin(5, 10)), None).otherwise(F.col("precipitation_mm"))
    # a document is one entity's months, bounded by the calendar
    docs = w.groupBy(F.col("entity").alias("ISO_A0"), fault.alias("fault")).agg(
        entry(F.col("temperature_c")).alias("t"), entry(rain).alias("p"))
    name = F.when(F.length("ISO_A0") % 2 == 0, F.lit("PRECTOTCORR")).otherwise(F.lit("PRECTOT"))
    heat = F.when(F.col("fault") == 0, F.lit("T2M_MAX")).otherwise(F.lit("T2M"))
    doc = F.to_json(F.struct(F.struct(F.map_concat(F.create_map(heat, "t"), F.create_map(name, "p")).alias("parameter"))
                             .alias("properties")))
    landed = _scratch(spark, "documents")
    docs.select("ISO_A0", "fault", doc.alias("doc")).select(
        "ISO_A0", F.when(F.col("fault") == 3, F.expr("left(doc, length(doc) - 3)")).otherwise(F.col("doc")).alias("doc")) \
        .write.partitionBy("ISO_A0").text(landed)
    return landed


def _asked(spark, sf_dir):
    return proxy.weather_panel(spark, sf_dir).select(F.col("entity").alias("ISO_A0"), "year").distinct()


@register("s4_weather_documents")
def s4_weather_documents(spark, sf_dir):
    """One JSON document an entity, landed and exploded to rows; S5: stored by entity and read pruned."""
    from panelwarn.sources import weather as WS
    landed, store = _weather_documents(spark, sf_dir), _scratch(spark, "weather")
    rows, _ = WS.documents_to_rows(spark.read.schema(WS.DOC_SCHEMA).json(landed))
    WS.write_weather_store(rows, store)
    back = WS.read_weather_store(spark, store, first_year=1997)
    return _r6_all(back.select(F.col("ISO_A0").alias("entity"), "year", "month", "temperature_c", "precipitation_mm"), EXOG)


@register("s4_weather_outcomes")
def s4_weather_outcomes(spark, sf_dir):
    """Good rows and error rows of damaged documents, from one parse; F14: months without precipitation are left out."""
    from panelwarn.sources import weather as WS
    store = _scratch(spark, "weather")
    rows = WS.load_weather(spark, _asked(spark, sf_dir), _weather_documents(spark, sf_dir, damaged=True), store)
    both = rows.withColumn("error", F.lit(None).cast("string")).unionByName(WS.weather_errors(spark, store), allowMissingColumns=True)
    return _r6_all(both.select(F.col("ISO_A0").alias("entity"), "year", "month", "temperature_c", "precipitation_mm", "error"), EXOG)


@register("s5_weather_reuse")
def s5_weather_reuse(spark, sf_dir):
    """A first call stores the years before 1996, a second adds the others; a third finds all there.

    ``by_call`` is the call that parsed a row: the third reads from a folder that does not exist.
    """
    from panelwarn.sources import weather as WS
    landed, store, asked = _weather_documents(spark, sf_dir), _scratch(spark, "weather"), _asked(spark, sf_dir)
    first = WS.load_weather(spark, asked.filter("year < 1996"), landed, store)
    early = cut_lineage(first.select("ISO_A0", "year", "month", F.lit(1).alias("by_call")))
    WS.load_weather(spark, asked, landed, store)
    back = WS.load_weather(spark, asked, f"{landed}-gone", store).join(early, ["ISO_A0", "year", "month"], "left")
    return _r6_all(back.select(F.col("ISO_A0").alias("entity"), "year", "month", "temperature_c", "precipitation_mm",
                               F.coalesce("by_call", F.lit(2)).alias("by_call")), EXOG)


@register("s7_prediction_sink")
def s7_prediction_sink(spark, sf_dir):
    """Predictions of the fixed model, written as CSV and read back."""
    from panelwarn.sources.sinks import write_predictions
    scorer, path = _saved_scorer(spark, sf_dir)
    scored = scorer.score_maps(_feature_maps(spark, sf_dir), keep=["row_id"])
    write_predictions(scored, f"{path}/predictions", keys=["row_id"])
    return spark.read.option("header", True).schema("row_id string, prediction int, threshold_used double").csv(f"{path}/predictions")


@register("s8_run_metadata")
def s8_run_metadata(spark, sf_dir):
    """What the saved run says of the panel: features in order, and the fitted year bounds."""
    from panelwarn.operators.models import load_metadata
    from panelwarn.sources.sinks import feature_names
    _, path = _saved_scorer(spark, sf_dir)
    meta = load_metadata(spark, path)
    low, high = meta["year_bounds"]
    return feature_names(spark, meta).select("position", "feature", F.lit(int(low)).alias("first_year"),
                                             F.lit(int(high)).alias("last_year"))


@register("p7_counts_on_write")
def p7_counts_on_write(spark, sf_dir):
    """Counted while the complete rows are written, kept in the run's document, read from there."""
    from panelwarn.operators.models import load_metadata
    from panelwarn.sources.sinks import write_complete_features
    data = write_complete_features(proxy.sparse_panel(spark, sf_dir), _scratch(spark, "complete"))
    _, path = _saved_scorer(spark, sf_dir, data=data)
    data = load_metadata(spark, path)["data"]
    rows = [(data["initial_rows"], data["kept_rows"], data["dropped_rows"], *[c[k] for k in ("column", "dtype", "non_null", "missing")])
            for c in data["columns"]]
    return spark.createDataFrame(rows, "initial_rows long, kept_rows long, dropped_rows long, column string, dtype string, "
                                       "non_null long, missing long")


@register("s10_attributions")
def s10_attributions(spark, sf_dir):
    """The long attribution table, written and read back."""
    from panelwarn.sources.sinks import write_attributions
    path = _scratch(spark, "attributions")
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    write_attributions(emb.select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("pos", "value"))
                          .select("row_id", F.concat(F.lit("f"), "pos").alias("feature"), "value"), path)
    return spark.read.parquet(path)


@register("s12_batch_items")
def s12_batch_items(spark, sf_dir):
    """A batch request holds an array of maps; each item becomes a row to score."""
    maps = _event_maps(spark, sf_dir)
    requests = maps.groupBy((F.col("event_id") / 8).cast("long").alias("request_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("event_id", F.map_entries("features").alias("e")))),
                    lambda x: F.map_from_entries(x["e"])).alias("items"))  # eight items a request
    items = requests.select("request_id", F.posexplode("items").alias("item", "features"))
    return items.select("request_id", F.col("item").cast("long").alias("item"),
                        F.try_element_at("features", F.lit("k")).alias("k"))


@register("t3_first_rows")
def t3_first_rows(spark, sf_dir):
    """First k rows in a stated order (a report)."""
    return proxy.case_panel(spark, sf_dir).orderBy("entity", "month_start").limit(5)


# ------------------------------------------- measures and splits on the larger tables
def _scored_lines(spark, sf_dir):
    """Returned or not, and a score, for every line: many rows, many distinct scores."""
    li = read_table(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice")
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("y"),
                     F.least(F.lit(1.0), F.col("l_extendedprice") / F.lit(60000.0)).alias("p"))


@register("e4_line_roc_auc")
def e4_line_roc_auc(spark, sf_dir):
    return _r6_all(E.roc_auc(_scored_lines(spark, sf_dir), "y", "p"), ["roc_auc"])


@register("e5_line_best_threshold")
def e5_line_best_threshold(spark, sf_dir):
    return _r6_all(E.best_threshold(_scored_lines(spark, sf_dir), "y", "p"), ["best_threshold", "best_macro_f1"])


@register("m1_event_split")
def m1_event_split(spark, sf_dir):
    events = read_table(spark, sf_dir, "events", "event_id", "event_type")
    return M.stratified_split(events, "event_type", "event_id")
