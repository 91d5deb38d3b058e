"""Feature engineering (W1-W9, F1-F11, F9, F10) with one shared entity window.

All window features of one call are planned as a single ``Window`` operator
(one sort, one exchange) because they share ``PanelSpec.window()``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwarn.functions.calendar import (
    DAY_OF_YEAR_PERIOD, MONTH_PERIOD, cyclical, day_of_year, iso_week, month_of,
    parse_date, quarter_of, season_flag, year_of,
)
from panelwarn.functions.nulls import positive_flag
from panelwarn.operators.ordering import exact_row_number
from panelwarn.operators.windows import PanelSpec, apply_panel_window
from panelwarn.session import cut_lineage

# Fixed values of the reference: lag offsets, rolling windows and the
# exogenous covariates it uses.
TARGET_LAGS = (1, 2, 3, 6, 12)
TARGET_WINDOWS = (3, 6, 12)
EXOG_LAGS = (1, 2, 3, 6, 12)
EXOG_WINDOWS = (3, 6)
EXOG_COLUMNS = ("temperature_c", "precipitation_mm")
TARGET_PREFIX = "dengue"

# The columns the reference drops before engineering features.
DROP_COLUMNS = (
    "adm_0_name", "adm_1_name", "adm_2_name", "full_name",
    "FAO_GAUL_code", "RNE_iso_code", "IBGE_code",
    "calendar_end_date", "Year", "case_definition_standardised",
    "S_res", "T_res", "UUID", "region",
)


# ---------------------------------------------------------------- expressions
def lag_columns(col: str, lags: Sequence[int], w, prefix: str | None = None) -> dict[str, Column]:
    """Value k rows earlier in the entity's order."""
    p = prefix or col
    return {f"{p}_lag_{k}": F.lag(F.col(col), k).over(w) for k in lags}


def past_rolling(col: str, windows: Sequence[int], w, prefix: str | None = None,
                 stats: Sequence[str] = ("ma", "std")) -> dict[str, Column]:
    """Statistics of the k rows before the current one (no leakage).

    mean needs one present value, sample std two (pandas min_periods=1).
    """
    p = prefix or col
    out: dict[str, Column] = {}
    for k in windows:
        frame = w.rowsBetween(-k, -1)
        if "ma" in stats:
            out[f"{p}_ma_{k}"] = F.avg(F.col(col)).over(frame)
        if "std" in stats:
            out[f"{p}_std_{k}"] = F.stddev_samp(F.col(col)).over(frame)
    return out


def inclusive_rolling(col: str, window: int, w, stat: str = "mean") -> Column:
    """Rolling statistic that includes the current row (scoring-time variant)."""
    frame = w.rowsBetween(-(window - 1), 0)
    fn = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum}[stat]
    return fn(F.col(col)).over(frame)


def surge_flag(col: str, w, min_count: float = 100.0, ratio: float = 1.5) -> Column:
    """Stricter target: y > min_count and y > ratio * previous row's y."""
    prev = F.lag(F.col(col), 1).over(w)
    cond = (F.col(col) > F.lit(min_count)) & (F.col(col) > F.lit(ratio) * prev) & ~F.isnan(F.col(col).cast("double"))
    return F.coalesce(cond.cast("int"), F.lit(0))


def calendar_columns(date_col: str) -> dict[str, Column]:
    """F2-F7 from the period start date."""
    d = F.col(date_col)
    m_sin, m_cos = cyclical(month_of(d), MONTH_PERIOD)
    d_sin, d_cos = cyclical(day_of_year(d), DAY_OF_YEAR_PERIOD)
    return {
        "year": year_of(d), "month": month_of(d), "dayofyear": day_of_year(d),
        "weekofyear": iso_week(d), "quarter": quarter_of(month_of(d)),
        "is_rainy_season": season_flag(month_of(d)),
        "month_sin": m_sin, "month_cos": m_cos,
        "dayofyear_sin": d_sin, "dayofyear_cos": d_cos,
    }


# ------------------------------------------------------------------ operators
def add_lag_features(df: DataFrame, spec: PanelSpec, col: str, lags=TARGET_LAGS,
                     prefix: str | None = None, **kw) -> DataFrame:
    return apply_panel_window(df, spec, lambda w, _i: lag_columns(col, lags, w, prefix),
                              lookback=max(lags), **kw)


def add_rolling_features(df: DataFrame, spec: PanelSpec, col: str, windows=TARGET_WINDOWS,
                         prefix: str | None = None, **kw) -> DataFrame:
    return apply_panel_window(df, spec, lambda w, _i: past_rolling(col, windows, w, prefix),
                              lookback=max(windows), **kw)


def add_time_index(df: DataFrame, spec: PanelSpec, name: str = "time_index", **kw) -> DataFrame:
    """Per-entity running index from 1."""
    return apply_panel_window(df, spec, lambda _w, i: {name: i}, lookback=0, **kw)


@dataclass(frozen=True)
class PanelEncoding:
    """What training learns about a panel's keys: entity codes and year bounds."""
    codes: DataFrame
    years: tuple[float | None, float | None]


def fit_encoding(df: DataFrame, spec: PanelSpec = PanelSpec()) -> PanelEncoding:
    """F9/F10 fit on the training panel, from one aggregate with one row an entity."""
    year = F.year(parse_date(spec.time))
    entities = cut_lineage(df.groupBy(spec.entity).agg(F.min(year).alias("lo"), F.max(year).alias("hi")))
    row = entities.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    bounds = (None, None) if row["lo"] is None else (float(row["lo"]), float(row["hi"]))
    return PanelEncoding(label_codes(entities, spec.entity), bounds)


def year_normalized(df: DataFrame, year_col: str = "year", name: str = "year_normalized",
                    bounds: tuple[float | None, float | None] | None = None) -> DataFrame:
    """(year - min) / (max - min + 1) with min/max over all entities.

    The two scalars are the fitted ``bounds``, or come from one global aggregate
    (partial aggregation on every partition), and are inlined as literals.
    """
    if bounds is None:
        bounds = tuple(df.agg(F.min(year_col), F.max(year_col)).first())
    if bounds[0] is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    lo, hi = map(float, bounds)
    return df.withColumn(name, (F.col(year_col) - F.lit(lo)) / F.lit(hi - lo + 1.0))


def require_unique_order(df: DataFrame, spec: PanelSpec) -> None:
    """Raise if two rows of an entity share their place in time: lags would depend on chance."""
    twice = df.groupBy(spec.entity, *spec.order).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    found = twice.limit(3).collect()
    if found:
        raise ValueError(f"rows not ordered by {spec.order}: {[tuple(r)[:-1] for r in found]}; add a tiebreak column")


def label_codes(df: DataFrame, col: str, code: str | None = None) -> DataFrame:
    """F10 fit: sorted distinct labels -> code 0..n-1 (sklearn LabelEncoder order)."""
    code = code or f"{col}_encoded"
    distinct = df.select(col).filter(F.col(col).isNotNull()).distinct()
    ranked = exact_row_number(distinct, [], [col], out="_pw_code")
    return ranked.select(col, (F.col("_pw_code") - 1).cast("int").alias(code))


def apply_label_codes(df: DataFrame, codes: DataFrame, col: str, code: str | None = None,
                      strict: bool = True) -> DataFrame:
    """F10 transform: join the fitted codes; unseen labels raise when ``strict``."""
    code = code or codes.columns[1]
    out = df.join(codes, col, "left")
    if strict:
        unseen = out.filter(F.col(col).isNotNull() & F.col(code).isNull()).select(col).limit(5)
        bad = [r[0] for r in unseen.collect()]
        if bad:
            raise ValueError(f"y contains previously unseen labels: {bad}")
    return out


def engineer_features(df: DataFrame, spec: PanelSpec = PanelSpec(),
                      exog: Sequence[str] = EXOG_COLUMNS, target_prefix: str = TARGET_PREFIX,
                      target_lags=TARGET_LAGS, target_windows=TARGET_WINDOWS,
                      exog_lags=EXOG_LAGS, exog_windows=EXOG_WINDOWS,
                      label_col: str = "outbreak_flag", encode_entity: bool = True,
                      encoding: PanelEncoding | None = None, check_keys: bool = False,
                      **window_kw) -> DataFrame:
    """The reference's full feature table: 45 features + keys + target + flag.

    Exogenous columns that are absent are skipped, as in the reference.
    ``encoding`` applies codes and year bounds fitted on other (training) rows
    and raises on an entity it has not seen; without it they are fitted here.
    The spec's tiebreak column is kept until the windows are done;
    ``check_keys`` refuses a panel whose order is not unique.
    """
    y = spec.target
    late = [c for c in DROP_COLUMNS if c in spec.tiebreak]
    df = df.drop(*[c for c in DROP_COLUMNS if c not in late]).withColumn(spec.time, parse_date(spec.time))
    if check_keys:
        require_unique_order(df, spec)
    fitted = encoding is None
    if fitted:
        encoding = fit_encoding(df, spec)
    present = [c for c in exog if c in df.columns]
    df = df.withColumns(calendar_columns(spec.time))

    def build(w, idx):
        cols: dict[str, Column] = {}
        cols.update(lag_columns(y, target_lags, w, target_prefix))
        cols.update(past_rolling(y, target_windows, w, target_prefix))
        for c in present:
            cols.update(lag_columns(c, exog_lags, w))
            cols.update(past_rolling(c, exog_windows, w))
        cols["time_index"] = idx
        return cols

    lookback = max([*target_lags, *target_windows, *(exog_lags if present else ()),
                    *(exog_windows if present else ())])
    out = apply_panel_window(df, spec, build, lookback=lookback, **window_kw).drop(*late)
    if len(present) == 2:
        out = out.withColumn("temp_precip_interaction", F.col(present[0]) * F.col(present[1]))
    out = year_normalized(out, bounds=encoding.years)
    if encode_entity:
        out = apply_label_codes(out, encoding.codes, spec.entity, strict=not fitted)
    if label_col not in out.columns:
        out = out.withColumn(label_col, positive_flag(y))
    return out
