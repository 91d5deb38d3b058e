"""DuckDB oracle SQL for the registered queries (same keys as proxy_queries)."""

from __future__ import annotations

from panelwarn.plans.fixed_model import LINEAR, SHAPLEY_BACKGROUND, linear_probability_sql
from panelwarn.schemas import CORRELATION_CANDIDATES, FEATURE_COLUMNS

# Shared CTEs: the proxy panels of FIXTURES.md 2.1.
CASES = """c as (
  select n.n_name as entity, cast(date_trunc('month', o.o_orderdate) as date) as month_start,
         count(*) as cases
  from orders o join customer cu on o.o_custkey = cu.c_custkey
  join nation n on cu.c_nationkey = n.n_nationkey group by 1, 2)"""

WEATHER = """w as (
  select n.n_name as entity, cast(year(l.l_shipdate) as int) as year,
         cast(month(l.l_shipdate) as int) as month,
    cast(sum(cast(l.l_quantity as bigint)) as double) / count(*) as temperature_c,
    cast(sum(cast(round(l.l_discount * 100) as bigint)) as double) / count(*) as precipitation_mm
  from lineitem l join supplier s on l.l_suppkey = s.s_suppkey
  join nation n on s.s_nationkey = n.n_nationkey group by 1, 2, 3)"""

JOINED = """j as (
  select c.entity, c.month_start, c.cases, w.temperature_c, w.precipitation_mm
  from c left join w on c.entity = w.entity and year(c.month_start) = w.year
   and month(c.month_start) = w.month)"""


# weather with gaps and NaN cells
SPARSE = WEATHER.replace("group by 1, 2, 3", "where n.n_nationkey % 9 <> 0 group by 1, 2, 3 "
                         "having sum(cast(l.l_quantity as bigint)) % 7 <> 0").replace(
    "/ count(*) as precipitation_mm", "/ count(*) * case when sum(cast(l.l_quantity as bigint)) % 7 = 1 "
    "then cast('nan' as double) else 1 end as precipitation_mm")


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


SQL: dict[str, str] = {}

SQL["slice_panel_features"] = f"""
with {CASES}, {WEATHER}, {JOINED},
f as (
  select *, lag(cases, 1) over g as lag_1, lag(cases, 12) over g as lag_12,
    avg(cases) over (partition by entity order by month_start rows between 3 preceding and 1 preceding) as ma_3,
    stddev_samp(cases) over (partition by entity order by month_start rows between 3 preceding and 1 preceding) as std_3,
    avg(temperature_c) over (partition by entity order by month_start rows between 6 preceding and 1 preceding) as t_ma_6,
    row_number() over g as time_index, sin(2 * pi() * month(month_start) / 12) as month_sin
  from j window g as (partition by entity order by month_start))
select entity, month_start, cases, lag_1, lag_12,
  {r6('ma_3')} as ma_3, {r6('std_3')} as std_3, {r6('t_ma_6')} as t_ma_6,
  cast(time_index as bigint) as time_index, {r6('month_sin')} as month_sin
from f where lag_12 is not null and temperature_c is not null and std_3 is not null
"""

ORDER_ROWS = """r as (
  select n.n_name as entity, cast(o.o_orderdate as date) as order_date, o.o_orderkey, o.o_totalprice
  from orders o join customer cu on o.o_custkey = cu.c_custkey
  join nation n on cu.c_nationkey = n.n_nationkey)"""

# Dense calendar per entity from its first to its last month; empty months get 0.
DENSE = """b as (select entity, min(month_start) as lo, max(month_start) as hi from c group by 1),
d as (select entity, cast(unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp),
        interval 1 month)) as date) as month_start from b),
dd as (select d.entity, d.month_start, coalesce(c.cases, 0) as cases
       from d left join c on d.entity = c.entity and d.month_start = c.month_start)"""

G = "window g as (partition by entity order by month_start)"
EXOG = ("temperature_c", "precipitation_mm")
LI = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LI_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
LI_TYPES = ("bigint",) * 3 + ("int",) + ("double",) * 4 + ("string",) * 2 + ("timestamp_ntz",)


def dbl(x: str) -> str:
    return f"cast({x} as double)"


def roll(fn: str, col: str, lo: int, hi: str = "1 preceding", order: str = "month_start") -> str:
    return f"{fn}({col}) over (partition by entity order by {order} rows between {lo} preceding and {hi})"


def unpivot_long(cols, table: str) -> str:
    sel = ", ".join(f"cast({c} as double) as {c}" for c in cols)
    return f"""long as (unpivot (select {sel} from {table}) on {", ".join(cols)}
  into name "column" value value)"""


SQL["p1_drop_columns"] = "select * exclude (o_orderpriority, o_orderstatus) from orders"

SQL["p4_year_filter"] = f"""with {CASES}, {WEATHER}, {JOINED}
select * from j where cast(year(month_start) as int) >= 1997"""

SQL["p5_entity_filter"] = f"with {CASES} select * from c where entity = 'NATION_7'"

SQL["p6_complete_rows"] = f"""with {CASES}, {SPARSE}, {JOINED}
select entity, month_start, cases, {r6("temperature_c")} as temperature_c, {r6("precipitation_mm")} as precipitation_mm
from j where entity is not null and month_start is not null and cases is not null
  and temperature_c is not null and not isnan(temperature_c)
  and precipitation_mm is not null and not isnan(precipitation_mm)"""

SQL["p7_completeness_counts"] = f"""with {CASES}, {SPARSE}, {JOINED}
select count(*) as initial_rows,
  sum(case when temperature_c is null or precipitation_mm is null or isnan(precipitation_mm) then 0 else 1 end) as kept_rows,
  sum(case when temperature_c is null or precipitation_mm is null or isnan(precipitation_mm) then 1 else 0 end) as dropped_rows
from j"""

SQL["p8_entities_without_weather"] = f"""with {CASES}, {SPARSE}
select distinct c.entity from c where not exists (select 1 from w where w.entity = c.entity)"""

SQL["p11_fill_absent_features"] = """select l_orderkey, l_linenumber, cast(l_tax as double) as l_tax,
  cast(l_quantity as double) as l_quantity, cast(0 as double) as l_extendedprice_x,
  cast(0 as double) as l_rank from lineitem"""

SQL["p12_target_if_absent"] = f"""with {CASES}, {DENSE}
select *, coalesce(cast(cases > 0 as int), 0) as outbreak_flag from dd"""

SQL["p14_map_to_vector"] = """select l_orderkey, l_linenumber,
  [coalesce(cast(l_tax as double), 0), coalesce(cast(l_quantity as double), 0), cast(0 as double),
   coalesce(cast(l_discount as double), 0)] as vector from lineitem"""

SQL["j1_weather_join"] = f"""with {CASES}, {WEATHER}, {JOINED}
select entity, cast(year(month_start) as int) as year, cast(month(month_start) as int) as month,
  month_start, cases, {r6('temperature_c')} as temperature_c, {r6('precipitation_mm')} as precipitation_mm
from j"""

SQL["j2_missing_weather_cells"] = f"""with {CASES}, {SPARSE}, {JOINED}
select coalesce(sum(cast(temperature_c is null as bigint)
  + cast(precipitation_mm is null or isnan(precipitation_mm) as bigint)), 0)
  as missing_cells from j"""

SQL["j3_region_lookup"] = f"""with {CASES}
select c.*, x.r_name from c left join (select n_name, r_name from nation join region
  on n_regionkey = r_regionkey) x on c.entity = x.n_name"""

SQL["u1_union_weather"] = f"""with {WEATHER}
select entity, year, month, {r6('temperature_c')} as temperature_c,
  {r6('precipitation_mm')} as precipitation_mm from w"""

SQL["w1_target_lags"] = f"""with {CASES}
select *, {", ".join(f"lag(cases, {k}) over g as cases_lag_{k}" for k in (1, 2, 3, 6, 12))}
from c {G}"""

SQL["w2_exog_lags"] = f"""with {CASES}, {WEATHER}, {JOINED}
select entity, month_start, {r6('temperature_c')} as temperature_c, {r6('precipitation_mm')} as precipitation_mm,
  {", ".join(f"{r6(f'lag({c}, {k}) over g')} as {c}_lag_{k}" for c in EXOG for k in (1, 2, 3, 6, 12))}
from j {G}"""

SQL["w3_rolling_mean"] = f"""with {CASES}
select *, {", ".join(f"{r6(roll('avg', 'cases', k))} as cases_ma_{k}" for k in (3, 6, 12))} from c"""

SQL["w4_rolling_std"] = f"""with {CASES}
select *, {", ".join(f"{r6(roll('stddev_samp', 'cases', k))} as cases_std_{k}" for k in (3, 6, 12))} from c"""

SQL["w5_exog_rolling"] = f"""with {CASES}, {WEATHER}, {JOINED}
select entity, month_start, {r6('temperature_c')} as temperature_c, {r6('precipitation_mm')} as precipitation_mm,
  {", ".join(f"{r6(roll(fn, c, k))} as {c}_{nm}_{k}" for c in EXOG for k in (3, 6)
             for fn, nm in (("avg", "ma"), ("stddev_samp", "std")))}
from j"""

SQL["w6_ordered_row_lags"] = f"""with {ORDER_ROWS}
select entity, order_date, o_orderkey, {r6('o_totalprice')} as o_totalprice,
  {", ".join(f"{r6(f'lag(o_totalprice, {k}) over g')} as price_lag_{k}" for k in (1, 2, 3))}
from r window g as (partition by entity order by order_date, o_orderkey)"""

SQL["w7_inclusive_rolling"] = f"""with {CASES}, {WEATHER}, {JOINED}
select entity, month_start, {r6('temperature_c')} as temperature_c, {r6('precipitation_mm')} as precipitation_mm,
  {r6(roll('avg', 'temperature_c', 2, 'current row'))} as temperature_c_roll_mean_3,
  {r6(roll('stddev_samp', 'precipitation_mm', 2, 'current row'))} as precipitation_mm_roll_std_3
from j"""

SQL["w8_time_index"] = f"""with {CASES}
select *, cast(row_number() over g as bigint) as time_index from c {G}"""

SQL["w9_surge_flag"] = f"""with {CASES}
select *, coalesce(cast(cases > 8 and cases > cast(1.5 as double) * lag(cases, 1) over g as int), 0)
  as surge_flag from c {G}"""

SQL["w11_entity_standardize"] = f"""with {CASES}
select entity, month_start, cases,
  {r6("(cases - avg(cases) over e) / case when stddev_pop(cases) over e is null or stddev_pop(cases) over e = 0 then 1 else stddev_pop(cases) over e end")} as cases_z
from c window e as (partition by entity)"""

SQL["t1_sorted_panel"] = f"with {CASES} select * from c order by entity, month_start"

SQL["t2_top_entities"] = f"""with {CASES}
select entity, coalesce(sum(cases), 0) as total from c group by 1 order by total desc, entity limit 10"""

SQL["t5_latest_history"] = """select * from (select event_id, ts, user_id, value,
  row_number() over (partition by user_id order by ts desc, event_id desc) as rank from events)
where rank <= 10"""

SQL["t5_streamed_history"] = SQL["t5_latest_history"]

SQL["a1_total_cases"] = f"with {CASES} select coalesce(sum(cases), 0) as total_cases from c"

SQL["a2_total_by_entity"] = f"""with {CASES}
select entity, coalesce(sum(cases), 0) as total from c where entity is not null group by 1"""

SQL["a3_share_by_entity"] = f"""with {CASES}
select entity, coalesce(sum(cases), 0) as total,
  {r6("cast(sum(cases) as double) * cast(100 as double) / (select cast(sum(cases) as double) from c)")} as share_pct
from c group by 1"""

SQL["a4_series_by_entity_date"] = f"""with {ORDER_ROWS}
select entity, order_date, count(*) as orders, {r6('sum(o_totalprice)')} as total_price from r group by 1, 2"""

SQL["a5_distinct_values"] = "select distinct event_type from events where event_type is not null"

SQL["a6_year_range"] = """select min(cast(year(o_orderdate) as int)) as min_year,
  max(cast(year(o_orderdate) as int)) as max_year from orders"""

SQL["a7_describe"] = f"""with {unpivot_long(LI, 'lineitem')}
select "column", count(value) as count, {r6('avg(value)')} as mean, {r6('stddev_samp(value)')} as std,
  {r6('min(value)')} as min, {r6('max(value)')} as max,
  {r6('quantile_cont(value, 0.25)')} as p25, {r6('quantile_cont(value, 0.5)')} as p50,
  {r6('quantile_cont(value, 0.75)')} as p75
from long where value is not null and not isnan(value) group by 1"""

SQL["a8_describe_categorical"] = """with long as (unpivot (select cast(o_orderstatus as varchar) as o_orderstatus,
    cast(o_orderpriority as varchar) as o_orderpriority from orders)
  on o_orderstatus, o_orderpriority into name "column" value value),
f as (select "column", value, count(*) as n from long where value is not null group by 1, 2),
r as (select "column", value, n, row_number() over (partition by "column" order by n desc, value) as rk,
  sum(n) over (partition by "column") as cnt, count(*) over (partition by "column") as uniq from f)
select "column", cnt as "count", uniq as "unique", value as top, n as freq from r where rk = 1"""

SQL["a9_percentiles"] = f"with {CASES} " + " union all ".join(
    f"select 'cases' as \"column\", cast({p} as double) as prob, "
    f"{r6(f'quantile_cont(cast(cases as double), {p})')} as quantile from c"
    for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))

SQL["a10_table_info"] = "select * from (" + " union all ".join(
    f"select (select count(*) from lineitem) as rows, {i} as position, '{c}' as \"column\", "
    f"(select count({c}) from lineitem) as non_null, '{t}' as dtype" for i, (c, t) in enumerate(zip(LI_COLS, LI_TYPES))) + ")"

SQL["a11_missing_per_column"] = f"with {CASES}, {SPARSE}, {JOINED} " + " union all ".join(
    f"select '{c}' as \"column\", count(*) - count({c})"
    + (f" + count(*) filter (where isnan({c}))" if c in EXOG else "") + " as missing from j"
    for c in ("entity", "month_start", "cases", *EXOG))

SQL["a12_value_counts"] = f"""select quality, count(*) as count,
  {r6("count(*) * cast(100 as double) / (select count(*) from labels)")} as share_pct
from labels where quality is not null group by 1"""

FLAGS = f"""with {CASES}, {DENSE}, fl as (select *, coalesce(cast(cases > 7 as int), 0) as flag from dd)"""

SQL["a13_class_by_entity"] = f"""{FLAGS}
select entity, n_0, n_1, n_0 + n_1 as total, round_even(cast(n_1 as double) * 100 / (n_0 + n_1), 2) as pct_1
from (select entity, sum(cast(flag = 0 as bigint)) as n_0, sum(cast(flag = 1 as bigint)) as n_1
      from fl group by 1)"""

SQL["a14_positive_rate"] = f"""{FLAGS}
select entity, {r6('avg(flag)')} as positive_rate from fl group by 1"""

SQL["a15_seasonal_mean"] = f"""with {CASES}
select cast(month(month_start) as int) as month, {r6('avg(cases)')} as mean_cases from c group by 1"""

SQL["a16_iqr_outliers"] = f"""with {unpivot_long((*LI, 'volume'), '(select *, l_extendedprice * l_quantity as volume from lineitem)')},
q as (select "column", quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3
      from long where value is not null and not isnan(value) group by 1),
b as (select *, q3 - q1 as iqr, q1 - cast(1.5 as double) * (q3 - q1) as lower,
      q3 + cast(1.5 as double) * (q3 - q1) as upper from q),
k as (select l."column", count(*) as rows, sum(cast(l.value < b.lower or l.value > b.upper as bigint)) as outliers
      from long l join b on l."column" = b."column" group by 1)
select b."column", {r6('q1')} as q1, {r6('q3')} as q3, {r6('iqr')} as iqr, {r6('lower')} as lower,
  {r6('upper')} as upper, k.rows, k.outliers, {r6('k.outliers * cast(100 as double) / k.rows')} as outlier_pct
from b join k on b."column" = k."column\""""

SQL["a17_correlation_matrix"] = " union all ".join(
    [f"select '{a}' as a, '{b}' as b, {r6(f'corr({a}, {b})')} as corr from lineitem"
     for a in LI for b in LI if a != b]
    + [f"select '{a}' as a, '{a}' as b, cast(1 as double) as corr" for a in LI])

SQL["a19_histogram"] = f"""with m as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
wd as (select lo, case when hi = lo then cast(1 as double) else (hi - lo) / 50 end as width from m),
h as (select cast(least(floor((l_extendedprice - lo) / width), 49) as int) as bin, count(*) as count
      from lineitem, wd where l_extendedprice is not null group by 1)
select bin, {r6('lo + bin * width')} as lower, {r6('lo + (bin + 1) * width')} as upper, count from h, wd"""

SQL["a20_box_stats"] = f"""with {CASES},
v as (select cast(month(month_start) as int) as month, cast(cases as double) as value from c),
q as (select month, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
      quantile_cont(value, 0.75) as q3 from v group by 1),
s as (select v.month, min(case when value >= q1 - cast(1.5 as double) * (q3 - q1)
        and value <= q3 + cast(1.5 as double) * (q3 - q1) then value end) as whisker_lo,
      max(case when value >= q1 - cast(1.5 as double) * (q3 - q1)
        and value <= q3 + cast(1.5 as double) * (q3 - q1) then value end) as whisker_hi,
      sum(case when value >= q1 - cast(1.5 as double) * (q3 - q1)
        and value <= q3 + cast(1.5 as double) * (q3 - q1) then 0 else 1 end) as n_outliers
      from v join q on v.month = q.month group by 1)
select q.month, {r6('q1')} as q1, {r6('median')} as median, {r6('q3')} as q3, {r6('q3 - q1')} as iqr,
  {r6('whisker_lo')} as whisker_lo, {r6('whisker_hi')} as whisker_hi, n_outliers
from q join s on q.month = s.month"""

SQL["a21_class_counts"] = "select toxic, count(*) as count from labels group by 1"

# ------------------------------------------------------------------ F: scalars
OD = "o_orderdate"
SQL["f1_parse_date"] = f"select o_orderkey, cast({OD} as date) as order_date from orders"
SQL["f2_calendar_parts"] = f"""select o_orderkey, cast(year({OD}) as int) as year, cast(month({OD}) as int) as month,
  cast(dayofyear({OD}) as int) as dayofyear from orders"""
SQL["f3_iso_week"] = f"select o_orderkey, cast(weekofyear({OD}) as int) as weekofyear from orders"
SQL["f4_quarter"] = f"select o_orderkey, cast(floor((month({OD}) - 1) / 3) + 1 as int) as quarter from orders"
SQL["f5_season_flag"] = f"""select o_orderkey, coalesce(cast(month({OD}) in (6, 7, 8, 9, 10) as int), 0)
  as is_rainy_season from orders"""
SQL["f6_month_cyclical"] = f"""select o_orderkey, {r6(f'sin(2 * pi() * month({OD}) / cast(12 as double))')} as month_sin,
  {r6(f'cos(2 * pi() * month({OD}) / cast(12 as double))')} as month_cos from orders"""
SQL["f7_dayofyear_cyclical"] = f"""select o_orderkey,
  {r6(f'sin(2 * pi() * dayofyear({OD}) / cast(365 as double))')} as dayofyear_sin,
  {r6(f'cos(2 * pi() * dayofyear({OD}) / cast(365 as double))')} as dayofyear_cos from orders"""
SQL["f8_interaction"] = f"""with {CASES}, {WEATHER}, {JOINED}
select entity, month_start, {r6('temperature_c * precipitation_mm')} as temp_precip_interaction from j"""
SQL["f9_year_normalized"] = f"""with {CASES},
y as (select *, cast(year(month_start) as int) as year from c),
mm as (select min(year) as lo, max(year) as hi from y)
select y.*, {r6('cast(year - lo as double) / cast(hi - lo + 1 as double)')} as year_normalized from y, mm"""
SQL["f10_label_encoding"] = f"""with {CASES}
select entity, cast(row_number() over (order by entity) - 1 as int) as entity_encoded
from (select distinct entity from c where entity is not null)"""
SQL["f11_target_flag"] = f"""with {CASES}, {WEATHER}, {JOINED}
select entity, month_start, coalesce(cast(temperature_c > 25 as int), 0) as warm_flag from j"""
SQL["f12_split_yyyymm"] = """with d as (select o_orderkey, strftime(o_orderdate, '%Y%m') as s0 from orders),
k as (select o_orderkey, case o_orderkey % 10 when 0 then substr(s0, 1, 5) when 1 then substr(s0, 1, 4) || 'xx'
  when 2 then s0 || '01' else s0 end as s from d)
select o_orderkey,
  length(s) = 6 and try_cast(substr(s, 1, 4) as int) is not null and try_cast(substr(s, 5, 2) as int) is not null
    as valid,
  case when length(s) = 6 then try_cast(substr(s, 1, 4) as int) end as year,
  case when length(s) = 6 then try_cast(substr(s, 5, 2) as int) end as month
from k"""
SQL["f15_year_clamp"] = f"select o_orderkey, greatest(1996, cast(year({OD}) as int)) as year from orders"
SQL["f16_round_abs"] = f"""select event_id, {r6('abs(value - cast(10 as double))')} as abs_dev,
  round_even(value / cast(3 as double), 2) as third_2dp from events"""

SCORED = """s as (select l.doc_id, l.quality, l.toxic, d.n_chars,
  least(cast(1 as double), d.n_chars / cast(5000 as double)) as p
  from labels l join documents d on l.doc_id = d.doc_id)"""

SQL["f17_threshold_class"] = f"""with {SCORED}
select doc_id, {r6('p')} as p, cast(p >= cast(0.5 as double) as int) as prediction from s"""
SQL["f18_alert_text"] = f"""with {SCORED}
select doc_id, case when p >= cast(0.5 as double) then 'Outbreak Likely' else 'No Outbreak' end as alert,
  printf('%.2f', p * cast(100 as double)) || '%' as probability_text from s"""
SQL["f20_scenario_week"] = f"""select o_orderkey,
  cast(ceil(datediff('day', make_date(cast(year({OD}) as int), 1, 1),
    make_date(cast(year({OD}) as int), cast(month({OD}) as int), 1)) / cast(7 as double)) + 1 as int)
  as weekofyear from orders"""


def _scenario_sql() -> str:
    d = "cast({} as double)".format
    l1, l2, l3 = "cases_lag_1", "cases_lag_2", "cases_lag_3"
    l6 = f"cast(floor({l3} * {d(0.8)} + {d(0.5)}) as double)"
    l12 = f"cast(floor({l3} * {d(0.6)} + {d(0.5)}) as double)"
    ma3 = f"(({l1} + {l2} + {l3}) / {d(3)})"
    ma6 = f"(({ma3} + {l6}) / {d(2)})"
    ma12 = f"(({ma6} + {l12}) / {d(2)})"

    def sq(x):
        return f"(({x}) * ({x}))"
    cols = {
        "year": "year", "month": "month", "dayofyear": "1",
        "weekofyear": "cast(ceil(datediff('day', make_date(year, 1, 1), make_date(year, month, 1)) "
                      f"/ {d(7)}) + 1 as int)",
        "quarter": "cast(floor((month - 1) / 3) + 1 as int)",
        "is_rainy_season": "cast(month >= 6 and month <= 10 as int)",
        "month_sin": f"sin(2 * pi() * month / {d(12)})", "month_cos": f"cos(2 * pi() * month / {d(12)})",
        "dayofyear_sin": f"sin(2 * pi() * 1 / {d(365)})", "dayofyear_cos": f"cos(2 * pi() * 1 / {d(365)})",
        "temperature_c": "temperature_c", "precipitation_mm": "precipitation_mm",
        "temp_precip_interaction": "temperature_c * precipitation_mm",
        "dengue_lag_1": l1, "dengue_lag_2": l2, "dengue_lag_3": l3, "dengue_lag_6": l6, "dengue_lag_12": l12,
        "dengue_ma_3": ma3, "dengue_std_3": f"sqrt(({sq(f'{l1} - {ma3}')} + {sq(f'{l2} - {ma3}')} + {sq(f'{l3} - {ma3}')}) / {d(3)})",
        "dengue_ma_6": ma6, "dengue_std_6": f"sqrt(({sq(f'{ma3} - {ma6}')} + {sq(f'{l6} - {ma6}')}) / {d(2)})",
        "dengue_ma_12": ma12, "dengue_std_12": f"sqrt(({sq(f'{ma6} - {ma12}')} + {sq(f'{l12} - {ma12}')}) / {d(2)})",
    }
    for name, factors, s3, s6 in (("temperature_c", (0.98, 0.96, 0.94, 0.90, 0.85), 0.8, 0.9),
                                  ("precipitation_mm", (0.9, 0.8, 0.7, 0.5, 0.3), 0.5, 0.6)):
        lags = {k: f"({name} * {d(f)})" for k, f in zip((1, 2, 3, 6, 12), factors)}
        for k, e in lags.items():
            cols[f"{name}_lag_{k}"] = e
        m3 = f"(({name} + {lags[1]} + {lags[2]}) / {d(3)})"
        cols[f"{name}_ma_3"] = m3
        cols[f"{name}_std_3"] = d(s3)
        cols[f"{name}_ma_6"] = f"(({m3} + {lags[3]} + {lags[6]}) / {d(3)})"
        cols[f"{name}_std_6"] = d(s6)
    cols["time_index"] = "250"
    cols["year_normalized"] = f"cast(year - 1981 as double) / {d(44)}"
    cols["ISO_A0_encoded"] = "coalesce(x.ISO_A0_encoded, 0)"
    ints = {"year", "month", "dayofyear", "weekofyear", "quarter", "is_rainy_season", "time_index", "ISO_A0_encoded"}
    sel = ",\n  ".join((e if k in ints else r6(e)) + f" as {k}" for k, e in cols.items())
    return f"""with {CASES}, {WEATHER}, {JOINED},
bl as (select entity as country, month_start, cast(year(month_start) as int) as year,
  cast(month(month_start) as int) as month, temperature_c, precipitation_mm,
  cast(lag(cases, 1) over g as double) as cases_lag_1, cast(lag(cases, 2) over g as double) as cases_lag_2,
  cast(lag(cases, 3) over g as double) as cases_lag_3 from j {G}),
x as (select n_name as country, cast(n_nationkey as int) as ISO_A0_encoded from nation)
select bl.month_start, bl.country,
  {sel}
from bl left join x on bl.country = x.country"""


SQL["f19_scenario_features"] = _scenario_sql()

# ------------------------------------------------------ the 45-feature table
FEATURES = FEATURE_COLUMNS
INT_FEATURES = {"month", "year", "dayofyear", "weekofyear", "quarter", "is_rainy_season", "ISO_A0_encoded"}


def _feature_sql() -> str:
    cd = "calendar_start_date"
    fr = "rows between {} preceding and 1 preceding"
    win = f"partition by ISO_A0 order by {cd}"
    ex = {
        "year": f"cast(year({cd}) as int)", "month": f"cast(month({cd}) as int)",
        "dayofyear": f"cast(dayofyear({cd}) as int)", "weekofyear": f"cast(weekofyear({cd}) as int)",
        "quarter": f"cast(floor((month({cd}) - 1) / 3) + 1 as int)",
        "is_rainy_season": f"coalesce(cast(month({cd}) in (6, 7, 8, 9, 10) as int), 0)",
        "month_sin": f"sin(2 * pi() * month({cd}) / cast(12 as double))",
        "month_cos": f"cos(2 * pi() * month({cd}) / cast(12 as double))",
        "dayofyear_sin": f"sin(2 * pi() * dayofyear({cd}) / cast(365 as double))",
        "dayofyear_cos": f"cos(2 * pi() * dayofyear({cd}) / cast(365 as double))",
    }
    for col, pre, lags, wins in (("dengue_total", "dengue", (1, 2, 3, 6, 12), (3, 6, 12)),
                                 ("temperature_c", "temperature_c", (1, 2, 3, 6, 12), (3, 6)),
                                 ("precipitation_mm", "precipitation_mm", (1, 2, 3, 6, 12), (3, 6))):
        for k in lags:
            ex[f"{pre}_lag_{k}"] = f"lag({col}, {k}) over ({win})"
        for k in wins:
            ex[f"{pre}_ma_{k}"] = f"avg({col}) over ({win} {fr.format(k)})"
            ex[f"{pre}_std_{k}"] = f"stddev_samp({col}) over ({win} {fr.format(k)})"
    ex["time_index"] = f"cast(row_number() over ({win}) as bigint)"
    ex["temp_precip_interaction"] = "temperature_c * precipitation_mm"
    inner = ",\n    ".join(f"{e} as {k}" for k, e in ex.items())
    return f"""with {CASES}, {WEATHER}, {JOINED},
raw as (select entity as ISO_A0, month_start as {cd}, cast(cases as double) as dengue_total,
  temperature_c, precipitation_mm from j),
f0 as (select *,
    {inner}
  from raw),
mm as (select min(year) as lo, max(year) as hi from f0),
codes as (select ISO_A0, cast(row_number() over (order by ISO_A0) - 1 as int) as ISO_A0_encoded
  from (select distinct ISO_A0 from f0 where ISO_A0 is not null)),
ft as (select f0.*, cast(year - lo as double) / cast(hi - lo + 1 as double) as year_normalized,
  codes.ISO_A0_encoded, coalesce(cast(dengue_total > 0 as int), 0) as outbreak_flag
  from f0 cross join mm left join codes on f0.ISO_A0 = codes.ISO_A0)"""


FT = _feature_sql()
_FT_DOUBLE = [c for c in FEATURES if c not in INT_FEATURES and c != "time_index"]
SQL["fe_feature_table"] = FT + "\nselect " + ", ".join(
    ["ISO_A0", "calendar_start_date", "dengue_total", "outbreak_flag", "time_index",
     *[c for c in INT_FEATURES]] + [f"{r6(c)} as {c}" for c in _FT_DOUBLE]) + " from ft"
SQL["p10_frozen_projection"] = FT + "\nselect ISO_A0, calendar_start_date, " + ", ".join(
    f"{r6(f'cast({c} as double)')} as {c}" for c in FEATURES) + " from ft"

SQL["a18_top_target_correlations"] = FT + ",\nk as (" + " union all ".join(
    [f"select '{c}' as feature, corr({c}, dengue_total) as corr from ft" for c in CORRELATION_CANDIDATES]
    + ["select 'dengue_total' as feature, cast(1 as double) as corr"]) + """)
select feature, """ + r6("corr") + " as corr, " + r6("abs(corr)") + """ as abs_corr
from k order by abs(corr) desc, feature limit 10"""

# ------------------------------------------------------ M: splits and weights
SQL["m1_stratified_split"] = """with lab as (select doc_id, quality from labels),
cnt as (select quality, count(*) as n_c from lab group by 1),
tot as (select sum(n_c) as n, cast(ceil(cast(0.2 as double) * sum(n_c)) as bigint) as t from cnt),
qa as (select cnt.quality, cnt.n_c, (tot.t * cnt.n_c) // tot.n as base, (tot.t * cnt.n_c) % tot.n as rem, tot.t
       from cnt, tot),
qb as (select *, row_number() over (order by rem desc, quality) as rk, t - sum(base) over () as left_ from qa),
qt as (select quality, n_c, base + case when rk <= left_ then 1 else 0 end as q_test from qb),
tot2 as (select sum(n_c - q_test) as n, cast(ceil(cast(0.2 as double) * sum(n_c - q_test)) as bigint) as t from qt),
va as (select qt.quality, qt.q_test, (tot2.t * (qt.n_c - qt.q_test)) // tot2.n as base,
       (tot2.t * (qt.n_c - qt.q_test)) % tot2.n as rem, tot2.t from qt, tot2),
vb as (select *, row_number() over (order by rem desc, quality) as rk, t - sum(base) over () as left_ from va),
vq as (select quality, q_test, base + case when rk <= left_ then 1 else 0 end as q_val from vb),
r as (select lab.*, row_number() over (partition by quality
        order by md5(concat(cast(doc_id as varchar), '-42')), doc_id) as rn from lab)
select r.doc_id, r.quality, case when rn <= q_test then 'test' when rn <= q_test + q_val then 'val'
  else 'train' end as split
from r join vq on r.quality = vq.quality"""

SQL["m2_positional_split"] = f"""with {CASES},
p as (select entity, month_start, row_number() over (order by entity, month_start) - 1 as pos,
      count(*) over () as n from c)
select entity, month_start, case when pos < floor(cast(0.8 as double) * n) then 'train'
  when pos < floor(cast(0.9 as double) * n) then 'val' else 'test' end as split from p"""

SQL["m2_temporal_split"] = """with t as (select event_id, ts, epoch_us(ts) / cast(1000000 as double) as t from events),
q as (select quantile_cont(t, 0.8) as a, quantile_cont(t, 0.9) as b from t)
select event_id, ts, case when t < a then 'train' when t < b then 'val' else 'test' end as split from t, q"""

SQL["m3_standard_scaler"] = f"""with st as (select avg(l_quantity) as m1, stddev_pop(l_quantity) as s1,
  avg(l_extendedprice) as m2, stddev_pop(l_extendedprice) as s2 from lineitem)
select l_orderkey, l_linenumber,
  {r6('(l_quantity - m1) / case when s1 = 0 or s1 is null then 1 else s1 end')} as l_quantity_z,
  {r6('(l_extendedprice - m2) / case when s2 = 0 or s2 is null then 1 else s2 end')} as l_extendedprice_z
from lineitem, st"""

SQL["m6_balanced_weights"] = f"""with cnt as (select quality, count(*) as n_c from labels group by 1),
tot as (select sum(n_c) as n, count(*) as k from cnt)
select l.doc_id, l.quality, {r6('cast(n as double) / (k * n_c)')} as weight
from labels l join cnt on l.quality = cnt.quality, tot"""

SQL["m7_pos_weight"] = f"""with k as (select sum(cast(quality = 0 as bigint)) as neg, sum(cast(quality = 1 as bigint)) as pos
  from labels)
select coalesce(neg, 0) as neg, coalesce(pos, 0) as pos,
  {r6('case when coalesce(pos, 0) > 0 then cast(neg as double) / pos else 1 end')} as scale_pos_weight from k"""

# --------------------------------------------------------------- E: metrics


def _sd(a: str, b: str) -> str:
    return f"case when ({b}) = 0 then cast(0 as double) else cast({a} as double) / ({b}) end"


def _confusion(label: str, t: str = "cast(0.5 as double)") -> str:
    return f"""k as (select
  coalesce(sum(case when {label} = 0 and not (p >= {t}) then 1 else 0 end), 0) as tn,
  coalesce(sum(case when {label} = 0 and p >= {t} then 1 else 0 end), 0) as fp,
  coalesce(sum(case when {label} = 1 and not (p >= {t}) then 1 else 0 end), 0) as fn,
  coalesce(sum(case when {label} = 1 and p >= {t} then 1 else 0 end), 0) as tp from s)"""


F1_1 = _sd("2 * tp", "2 * tp + fp + fn")
F1_0 = _sd("2 * tn", "2 * tn + fn + fp")
MACRO = f"(({F1_0}) + ({F1_1})) / 2"

SQL["e1_metric_set"] = f"""with {SCORED}, {_confusion('quality')}
select {r6(_sd('tp + tn', 'tp + tn + fp + fn'))} as accuracy, {r6(_sd('tp', 'tp + fp'))} as precision,
  {r6(_sd('tp', 'tp + fn'))} as recall, {r6(F1_1)} as f1, {r6(MACRO)} as macro_f1 from k"""

SQL["e2_confusion_matrix"] = f"""with {SCORED}, {_confusion('quality')}
select 0 as actual, 0 as predicted, tn as count from k union all
select 0, 1, fp from k union all select 1, 0, fn from k union all select 1, 1, tp from k"""

_P1, _R1 = _sd("tp", "tp + fp"), _sd("tp", "tp + fn")
_P0, _R0 = _sd("tn", "tn + fn"), _sd("tn", "tn + fp")


def _w(a, b):
    return _sd(f"({a}) * (tn + fp) + ({b}) * (tp + fn)", "tn + fp + tp + fn")


SQL["e3_classification_report"] = f"""with {SCORED}, {_confusion('quality')}
select '0' as label, {r6(_P0)} as precision, {r6(_R0)} as recall, {r6(F1_0)} as f1, tn + fp as support from k
union all select '1', {r6(_P1)}, {r6(_R1)}, {r6(F1_1)}, tp + fn from k
union all select 'macro avg', {r6(f'(({_P0}) + ({_P1})) / 2')}, {r6(f'(({_R0}) + ({_R1})) / 2')},
  {r6(MACRO)}, tn + fp + tp + fn from k
union all select 'weighted avg', {r6(_w(_P0, _P1))}, {r6(_w(_R0, _R1))}, {r6(_w(F1_0, F1_1))},
  tn + fp + tp + fn from k"""

SQL["e4_roc_auc"] = f"""with {SCORED},
g as (select p, sum(case when quality = 1 then 1 else 0 end) as pos, sum(case when quality = 0 then 1 else 0 end) as neg
      from s where p is not null group by p),
c as (select *, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding), 0) as below
      from g)
select {r6('case when sum(pos) > 0 and sum(neg) > 0 then sum(pos * (below + neg * cast(0.5 as double))) / (sum(pos) * sum(neg)) end')}
  as roc_auc from c"""

SQL["e5_best_threshold"] = f"""with {SCORED},
t as (select i, cast(0.1 as double) + i * cast(0.01 as double) as threshold from range(81) r(i)),
k as (select t.i, t.threshold,
  sum(case when s.quality = 1 and s.p >= t.threshold then 1 else 0 end) as tp,
  sum(case when s.quality = 0 and s.p >= t.threshold then 1 else 0 end) as fp,
  sum(case when s.quality = 1 and not (s.p >= t.threshold) then 1 else 0 end) as fn,
  sum(case when s.quality = 0 and not (s.p >= t.threshold) then 1 else 0 end) as tn
  from t, s group by 1, 2),
m as (select i, threshold, {MACRO} as macro_f1 from k),
b as (select * from m order by macro_f1 desc, i limit 1)
select {r6('case when macro_f1 > 0 then threshold else cast(0.5 as double) end')} as best_threshold,
  {r6('case when macro_f1 > 0 then macro_f1 else cast(0 as double) end')} as best_macro_f1 from b"""

SQL["e7_mean_abs_attribution"] = f"""with x as (select 'f' || cast(generate_subscripts(embedding, 1) - 1 as varchar) as feature,
  unnest(embedding) as value from embeddings)
select feature, {r6('avg(abs(value))')} as mean_abs from x group by 1 order by avg(abs(value)) desc, feature limit 10"""

SQL["t4_best_candidate"] = f"""with {SCORED},
cq as (select 'quality' as candidate, 0 as position, quality as y, p from s
       union all select 'toxic', 1, toxic, p from s),
k as (select candidate, position,
  coalesce(sum(case when y = 0 and not (p >= cast(0.5 as double)) then 1 else 0 end), 0) as tn,
  coalesce(sum(case when y = 0 and p >= cast(0.5 as double) then 1 else 0 end), 0) as fp,
  coalesce(sum(case when y = 1 and not (p >= cast(0.5 as double)) then 1 else 0 end), 0) as fn,
  coalesce(sum(case when y = 1 and p >= cast(0.5 as double) then 1 else 0 end), 0) as tp from cq group by 1, 2),
m as (select candidate, position, {MACRO} as macro_f1 from k)
select candidate, position, {r6('macro_f1')} as macro_f1 from m order by macro_f1 desc, position limit 1"""

# --------------------------------------------------------- S/C: feature maps
SQL["s12_feature_map_rows"] = """with m as (select event_id, json_transform(props, '"MAP(VARCHAR, DOUBLE)"') as f
  from events)
select event_id, unnest(map_keys(f)) as key, unnest(map_values(f)) as value from m"""

SQL["c3_batch_error_capture"] = f"""with e as (select event_id, event_type,
  coalesce(json_transform(props, '"MAP(VARCHAR, DOUBLE)"')['k'], 0) as k,
  case when event_type = 'error' then 0 when event_id % 11 = 0 then null when event_id % 13 = 0 then cast('inf' as double)
    else value end as v from events),
z as (select *, cast(-2.0 as double) + cast(0.02 as double) * k + cast(0.05 as double) * v as z,
  false as bad_k, v is null or isinf(v) or isnan(v) as bad_v from e)
select event_id,
  case when bad_k or bad_v then null else {r6('cast(1 as double) / (cast(1 as double) + exp(-z))')} end as probability,
  case when bad_k or bad_v then null
    else cast(cast(1 as double) / (cast(1 as double) + exp(-z)) >= cast(0.5 as double) as int) end as prediction,
  case when bad_k or bad_v then 'invalid features: ' || concat_ws(', ', case when bad_k then 'k' end,
    case when bad_v then 'value' end) end as error
from z"""

SQL["w3_part_daily_rolling"] = f"""with p as (select l_partkey, cast(l_shipdate as date) as ship_day,
  coalesce(sum(l_quantity), 0) as l_quantity from lineitem
  where l_partkey is not null and l_shipdate is not null group by 1, 2)
select l_partkey, ship_day, l_quantity,
  {", ".join(f"lag(l_quantity, {k}) over g as qty_lag_{k}" for k in (1, 3, 12))},
  {", ".join(f"{r6(f'{fn}(l_quantity) over (partition by l_partkey order by ship_day rows between {k} preceding and 1 preceding)')} as qty_{nm}_{k}" for k in (3, 12) for fn, nm in (("avg", "ma"), ("stddev_samp", "std")))},
  cast(row_number() over g as bigint) as time_index
from p window g as (partition by l_partkey order by ship_day)"""


def _u(col: str, tag: str) -> str:
    return (f"cast(cast(('0x' || substr(md5(cast({col} as varchar) || '-42-{tag}'), 1, 8)) as bigint) as double)"
            " / cast(4294967296 as double)")


_R6L = "list_transform({}, lambda x: floor(x * 1e6 + 0.5) / 1e6)"
SMOTE_CTE = f"""e as (select vec_id, cast(embedding as double[]) as vec,
    case when label = 0 then 0 else 1 end as y from embeddings),
cnt as (select y, count(*) as n from e group by y),
mn as (select y as my, n as n_min from cnt order by n, y limit 1),
mj as (select sum(n) as n_maj from cnt, mn where cnt.y <> mn.my),
m as (select vec_id as id, vec, row_number() over (order by vec_id) - 1 as base_i from e, mn where e.y = mn.my),
d as (select a.id as q, b.id as nb_id,
    list_sum(list_transform(list_zip(a.vec, b.vec), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as d2
    from m a join m b on a.id <> b.id),
knn as (select q, nb_id, row_number() over (partition by q order by d2, nb_id) as rank from d),
s as (select range as sid from range((select cast(n_maj - n_min as bigint) from mj, mn))),
sp as (select sid, cast(floor({_u('sid', 'base')} * n_min) as bigint) as base_i,
    cast(floor({_u('sid', 'nb')} * least(5, n_min - 1)) + 1 as int) as rank, {_u('sid', 'gap')} as gap
    from s, mn),
syn as (select sp.sid, b.vec as base_vec, nb.vec as nb_vec, sp.gap from sp
    join m b on sp.base_i = b.base_i join knn on knn.q = b.id and knn.rank = sp.rank
    join m nb on nb.id = knn.nb_id)"""

SQL["m4_smote"] = f"""with {SMOTE_CTE}
select vec_id, {_R6L.format('vec')} as embedding, y, false as synthetic, cast(null as bigint) as synthetic_id from e
union all
select cast(null as bigint), {_R6L.format('list_transform(list_zip(base_vec, nb_vec), lambda x: x[1] + gap * (x[2] - x[1]))')},
  (select my from mn), true, sid from syn"""

SQL["a22_class_counts_before_after"] = f"""with {SMOTE_CTE},
b as (select y, count(*) as before from e group by y),
a as (select y, count(*) as after from (select y from e union all select (select my from mn) from syn) group by y)
select coalesce(b.y, a.y) as y, coalesce(before, 0) as before, coalesce(after, 0) as after
from b full join a on b.y = a.y"""

SQL["w3_part_daily_blocked"] = SQL["w3_part_daily_rolling"]

# ------------------------------------- training runs, scoring, attribution
_WHOLE = " and ".join(f"{c} is not null" for c in FEATURES)
MODEL_ROWS = f"""{FT},
mr as (select concat(ISO_A0, '|', cast(calendar_start_date as varchar)) as row_id,
  cast(dengue_total > dengue_ma_3 as int) as label, ft.* from ft where {_WHOLE})"""


def _run_sizes(model: str) -> str:
    return f"""{MODEL_ROWS},
n as (select count(*) as n, cast(ceil(cast(0.2 as double) * count(*)) as bigint) as t from mr),
v as (select n, t, cast(ceil(cast(0.2 as double) * (n - t)) as bigint) as v from n)
select '{model}' as model, n - t - v as n_train, v as n_val, t as n_test, true as threshold_on_grid,
  true as metrics_in_range, true as more_than_one_tree, true as auc_above_chance, true as both_classes_found from v"""


_SEQUENCES = f"""{MODEL_ROWS},
s as (select ISO_A0, calendar_start_date, cast(dengue_total > 8 as int) as target,
  list([{", ".join(r6(f"cast({c} as double)") if c in _FT_DOUBLE else f"cast({c} as double)" for c in FEATURES)}])
    over (w rows between 12 preceding and 1 preceding) as seq, row_number() over w as rn
  from mr window w as (partition by ISO_A0 order by calendar_start_date))"""
SQL["w10_lookback_sequences"] = f"""{_SEQUENCES}
select ISO_A0, calendar_start_date, seq, target from s where rn > 12"""
SQL["m5_flatten_sequences"] = f"""{_SEQUENCES}
select ISO_A0, calendar_start_date, flatten(seq) as flat from s where rn > 12"""


SQL["m8_random_forest"] = _run_sizes("RandomForest")
SQL["m9_boosted_trees"] = _run_sizes("XGBoost")
SQL["m10_boosted_trees_pos_weight"] = _run_sizes("LightGBM")
SQL["m15_model_comparison"] = f"""{MODEL_ROWS},
names as (select unnest(['RandomForest', 'XGBoost', 'LightGBM']) as model, unnest([0, 1, 2]) as position)
select model, cast(position as int) as position, true as in_range, true as selected_by_rule from names
where (select count(*) from mr) > 0"""
SQL["m12_forest_importances"] = f"""{FT},
r as (select unnest(range(1, 16)) as rank)
select cast(rank as int) as rank, true as valid, true as sum_at_most_one, {len(FEATURES) - 2} as candidates from r
where (select count(*) from ft) > 0"""
SQL["m13_boosted_regression_r2"] = f"""{MODEL_ROWS},
u as (select cast('0x' || substr(md5(concat(row_id, '-42')), 1, 8) as bigint) / cast(4294967296 as double) as u from mr)
select 'GBTRegressor' as model, count(*) filter (where u >= 0.2) as n_train, count(*) filter (where u < 0.2) as n_test,
  true as r2_at_most_one from u"""

_P = linear_probability_sql()
SQL["c1_batch_panel_scoring"] = f"""{MODEL_ROWS}
select ISO_A0, calendar_start_date, {r6(_P)} as outbreak_probability, cast({_P} >= 0.5 as int) as prediction,
  cast(0.5 as double) as threshold_used, 'Linear' as model_type from mr"""
SQL["c1_subset_features"] = FT + "\nselect ISO_A0, calendar_start_date, " + ", ".join(
    c if c in INT_FEATURES or c == "time_index" else f"{r6(c)} as {c}" for c in FEATURES) + """
from ft where ISO_A0 in ('NATION_7', 'NATION_19')"""
SQL["c2_feature_map_scoring"] = f"""{MODEL_ROWS},
z as (select row_id, * exclude (temperature_c, row_id), case when month % 2 = 0 then 0 else temperature_c end as temperature_c from mr)
select row_id, {r6(_P)} as outbreak_probability, cast({_P} >= 0.5 as int) as prediction,
  cast(0.5 as double) as threshold_used, 'Linear' as model_type from z"""
SQL["c4_stream_scoring"] = SQL["c2_feature_map_scoring"]
SQL["c4_streamed_history"] = f"""with s as ({SQL["c2_feature_map_scoring"]}),
k as (select split_part(row_id, '|', 1) as entity, split_part(row_id, '|', 2) as asked_on, * from s)
select * from (select *, row_number() over (partition by entity order by asked_on desc, row_id desc) as rank from k)
where rank <= 10"""


def _split_sql() -> str:
    """CTEs ending in sp (doc_id, split): the stratified split of the model rows."""
    split = SQL["m1_stratified_split"].replace("with lab as (select doc_id, quality from labels)",
                                               "lab as (select row_id as doc_id, label as quality from mr)")
    split = split.replace("cast(doc_id as varchar)", "doc_id")
    return f"{MODEL_ROWS},\nsp as (select * from ({split.replace('lab as (', 'with lab as (', 1)}))"


def _importance_sql() -> str:
    names = list(LINEAR)
    copies = []
    for f in FEATURES:
        if f not in LINEAR:  # the formula does not read the permuted column
            copies.append(f"select '{f}' as feature, label, {', '.join(names)} from test")
            continue
        kept = ", ".join(f"t.{c}" for c in names if c != f)
        copies.append(f"""select '{f}' as feature, t.label, {kept}, s.{f} as {f}
  from (select *, row_number() over (order by row_id) as k from test) t
  join (select {f}, row_number() over (order by md5(concat_ws('-', row_id, '{f}', '42')), row_id) as k from test) s
  on t.k = s.k""")
    base = f"select '<none>' as feature, label, {', '.join(names)} from test"
    columns = ", ".join(["feature", "label", *names])
    union = "\nunion all\n".join(f"select {columns} from ({q})" for q in [base, *copies])
    return f"""{_split_sql()},
test as (select mr.* from mr join sp on mr.row_id = sp.doc_id where sp.split = 'test'),
every as ({union}),
p as (select feature, label = 1 as y, {_P} >= 0.5 as pred from every),
g as (select feature, count(*) filter (where y and pred) as tp, count(*) filter (where not y and pred) as fp,
  count(*) filter (where y and not pred) as fn, count(*) filter (where not y and not pred) as tn from p group by 1),
m as (select feature, (case when 2 * tp + fp + fn = 0 then cast(0 as double) else cast(2 * tp as double) / (2 * tp + fp + fn) end
  + case when 2 * tn + fn + fp = 0 then cast(0 as double) else cast(2 * tn as double) / (2 * tn + fn + fp) end) / 2 as f1 from g)
select feature, {r6("(select f1 from m where feature = '<none>') - f1")} as importance from m where feature <> '<none>'"""


SQL["e6_permutation_importance"] = _importance_sql()


def _shapley_sql() -> str:
    """Exact values: a linear model's Shapley value is the weight times the distance from the background's mean."""
    means = ", ".join(f"avg(cast({c} as double)) as {c}" for c in FEATURES)
    values = ", ".join(f"cast({LINEAR.get(c, 0)} as double) * (cast(t.{c} as double) - z.{c})" for c in FEATURES)
    return f"""{_split_sql()},
test as (select mr.* from mr join sp on mr.row_id = sp.doc_id where sp.split = 'test'),
bg as (select mr.* from mr join sp on mr.row_id = sp.doc_id where sp.split = 'train'
  order by md5(concat_ws('-', row_id, '42')), row_id limit {SHAPLEY_BACKGROUND}),
z as (select {means} from bg),
phi as (select t.row_id, unnest([{", ".join(f"'{c}'" for c in FEATURES)}]) as feature, unnest([{values}]) as shapley
  from test t, z)"""


SQL["e6_shapley_values"] = f"""{_shapley_sql()}
select row_id, feature, {r6("shapley")} as shapley from phi"""
SQL["e6_shapley_importance"] = f"""{_shapley_sql()}
select feature, {r6("avg(abs(shapley))")} as mean_abs_shapley, {r6("avg(shapley)")} as mean_shapley from phi group by 1"""

SQL["m14_sequence_mlp"] = f"""{MODEL_ROWS},
q as (select ISO_A0, calendar_start_date, cast(dengue_total > 7 as int) as y,
  row_number() over (partition by ISO_A0 order by calendar_start_date) as i from mr),
p as (select y, row_number() over (order by ISO_A0, calendar_start_date) - 1 as pos, count(*) over () as n from q where i > 12),
s as (select y, case when pos < floor(cast(0.8 as double) * n) then 'train'
  when pos < floor(cast(0.9 as double) * n) then 'val' else 'test' end as part from p),
per as (select part, y, count(*) as n from s group by 1, 2)
select cast(sum(n) filter (where part = 'train') as bigint) as n_train,
  cast(max(n) filter (where part = 'train') * count(*) filter (where part = 'train') as bigint) as n_balanced,
  cast(sum(n) filter (where part = 'val') as bigint) as n_val, cast(sum(n) filter (where part = 'test') as bigint) as n_test,
  true as metrics_in_range, true as threshold_on_grid, true as selected_by_rule from per"""

SQL["s1_raw_cases_csv"] = """select n.n_name as ISO_A0, cast(o_orderkey as varchar) as UUID,
  case when o_orderkey % 13 = 0 then null else cast(o_orderdate as date) end as calendar_start_date,
  case when o_orderkey % 17 = 0 then null else cast(o_orderkey % 100 as double) end as dengue_total
from orders join customer on o_custkey = c_custkey join nation n on c_nationkey = n_nationkey"""
SQL["s2_feature_csv"] = f"""{FT}
select ISO_A0, 'name of ' || ISO_A0 as adm_0_name, calendar_start_date, dengue_total, cast(dengue_lag_1 as double) as dengue_lag_1,
  {r6('dengue_ma_3')} as dengue_ma_3, cast(month as double) as month from ft"""
SQL["s4_weather_documents"] = f"""with {WEATHER}
select entity, year, month, {r6('temperature_c')} as temperature_c, {r6('precipitation_mm')} as precipitation_mm
from w where year >= 1997"""
SQL["s4_weather_outcomes"] = f"""with {WEATHER},
n as (select *, cast(regexp_extract(entity, '(\\d+)$', 1) as int) % 7 as fault from w)
select entity, year, month, {r6('temperature_c')} as temperature_c, {r6('precipitation_mm')} as precipitation_mm,
  cast(null as varchar) as error
from n where not (fault in (0, 1, 3)) and not (fault = 2 and month in (5, 10)) and precipitation_mm is not null
union all
select distinct entity, cast(null as int), cast(null as int), cast(null as double), cast(null as double),
  case fault when 0 then 'Missing T2M' when 1 then 'No valid weather records extracted.' else 'Document cannot be read.' end
from n where fault in (0, 1, 3)"""
SQL["s5_weather_reuse"] = f"""with {WEATHER}
select entity, year, month, {r6('temperature_c')} as temperature_c, {r6('precipitation_mm')} as precipitation_mm,
  case when year < 1996 then 1 else 2 end as by_call from w"""
SQL["s7_prediction_sink"] = f"""select row_id, prediction, threshold_used from ({SQL["c2_feature_map_scoring"]})"""
SQL["s8_run_metadata"] = f"""{FT},
names as (select unnest(range({len(FEATURES)})) as position, unnest([{", ".join(f"'{c}'" for c in FEATURES)}]) as feature)
select cast(position as int) as position, feature, (select cast(min(year) as int) from ft) as first_year,
  (select cast(max(year) as int) from ft) as last_year from names"""
SQL["p7_counts_on_write"] = f"""select p.*, m.*, t.dtype, p.initial_rows - m.missing as non_null
from ({SQL["p7_completeness_counts"]}) p, ({SQL["a11_missing_per_column"]}) m
join (select unnest(['entity', 'month_start', 'cases', 'temperature_c', 'precipitation_mm']) as "column",
  unnest(['string', 'date', 'bigint', 'double', 'double']) as dtype) t on t."column" = m."column" """
SQL["s10_attributions"] = """select vec_id as row_id, 'f' || (generate_subscripts(embedding, 1) - 1) as feature,
  unnest(embedding) as value from embeddings"""
SQL["s12_batch_items"] = """select event_id // 8 as request_id, row_number() over (partition by event_id // 8 order by event_id) - 1 as item,
  json_transform(props, '"MAP(VARCHAR, DOUBLE)"')['k'] as k from events"""
SQL["t3_first_rows"] = f"with {CASES} select * from c order by entity, month_start limit 5"

_LINES = """s as (select cast(l_returnflag = 'R' as int) as quality,
  least(cast(1 as double), l_extendedprice / cast(60000 as double)) as p from lineitem)"""
SQL["e4_line_roc_auc"] = SQL["e4_roc_auc"].replace(SCORED, _LINES)
SQL["e5_line_best_threshold"] = SQL["e5_best_threshold"].replace(SCORED, _LINES)
SQL["m1_event_split"] = SQL["m1_stratified_split"].replace("doc_id, quality from labels", "event_id, event_type from events") \
    .replace("doc_id", "event_id").replace("quality", "event_type")
