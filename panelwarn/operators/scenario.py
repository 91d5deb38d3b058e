"""What-if scenario features (F19, F20): the 45 model inputs from 8 base inputs.

These are the closed-form approximations of the reference's scenario form,
kept separate from the window features on purpose (decay factors stand in for
missing history; std of the case history is the population std here).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwarn.functions.calendar import scenario_week_of_year

# Fixed values of the reference's scenario form.
ENTITY_CODES = {"BGD": 0, "BTN": 1, "IND": 2, "IDN": 3, "MDV": 4, "MMR": 5, "NPL": 6, "LKA": 7,
                "THA": 8, "TLS": 9}
CASE_LAG6_FACTOR, CASE_LAG12_FACTOR = 0.8, 0.6
TEMP_LAG_FACTORS = (0.98, 0.96, 0.94, 0.90, 0.85)
TEMP_STD_3, TEMP_STD_6 = 0.8, 0.9
PRECIP_LAG_FACTORS = (0.9, 0.8, 0.7, 0.5, 0.3)
PRECIP_STD_3, PRECIP_STD_6 = 0.5, 0.6
SCENARIO_TIME_INDEX = 250
SCENARIO_FIRST_YEAR, SCENARIO_LAST_YEAR = 1981, 2025
LAG_STEPS = (1, 2, 3, 6, 12)


def code_table(spark, mapping: dict | None = None) -> DataFrame:
    m = mapping or ENTITY_CODES
    return spark.createDataFrame(sorted(m.items()), "country string, ISO_A0_encoded int")


def _js_round(x):
    return F.floor(x + F.lit(0.5))


def _sq(x):
    return x * x


def scenario_features(df: DataFrame, codes: DataFrame, keep=()) -> DataFrame:
    """base (country, year, month, temperature_c, precipitation_mm, cases_lag_1..3).

    ``codes`` maps country -> ISO_A0_encoded; unknown countries get 0.
    """
    y, m = F.col("year"), F.col("month")
    t, p = F.col("temperature_c"), F.col("precipitation_mm")
    l1, l2, l3 = F.col("cases_lag_1"), F.col("cases_lag_2"), F.col("cases_lag_3")
    l6 = _js_round(l3 * F.lit(CASE_LAG6_FACTOR)).cast("double")
    l12 = _js_round(l3 * F.lit(CASE_LAG12_FACTOR)).cast("double")
    ma3 = (l1 + l2 + l3) / F.lit(3.0)
    ma6 = (ma3 + l6) / F.lit(2.0)
    ma12 = (ma6 + l12) / F.lit(2.0)
    two_pi = F.lit(2 * math.pi)
    cols = {
        "year": y, "month": m, "dayofyear": F.lit(1),
        "weekofyear": scenario_week_of_year(y, m),
        "quarter": (F.floor((m - 1) / 3) + 1).cast("int"),
        "is_rainy_season": ((m >= 6) & (m <= 10)).cast("int"),
        "month_sin": F.sin(two_pi * m / F.lit(12.0)), "month_cos": F.cos(two_pi * m / F.lit(12.0)),
        "dayofyear_sin": F.sin(two_pi * F.lit(1) / F.lit(365.0)),
        "dayofyear_cos": F.cos(two_pi * F.lit(1) / F.lit(365.0)),
        "temperature_c": t, "precipitation_mm": p, "temp_precip_interaction": t * p,
        "dengue_lag_1": l1, "dengue_lag_2": l2, "dengue_lag_3": l3, "dengue_lag_6": l6, "dengue_lag_12": l12,
        "dengue_ma_3": ma3,
        "dengue_std_3": F.sqrt((_sq(l1 - ma3) + _sq(l2 - ma3) + _sq(l3 - ma3)) / F.lit(3.0)),
        "dengue_ma_6": ma6,
        "dengue_std_6": F.sqrt((_sq(ma3 - ma6) + _sq(l6 - ma6)) / F.lit(2.0)),
        "dengue_ma_12": ma12,
        "dengue_std_12": F.sqrt((_sq(ma6 - ma12) + _sq(l12 - ma12)) / F.lit(2.0)),
    }
    for name, base, factors, s3, s6 in (("temperature_c", t, TEMP_LAG_FACTORS, TEMP_STD_3, TEMP_STD_6),
                                        ("precipitation_mm", p, PRECIP_LAG_FACTORS, PRECIP_STD_3, PRECIP_STD_6)):
        lags = {k: base * F.lit(f) for k, f in zip(LAG_STEPS, factors)}
        for k, e in lags.items():
            cols[f"{name}_lag_{k}"] = e
        ma_3 = (base + lags[1] + lags[2]) / F.lit(3.0)
        cols[f"{name}_ma_3"] = ma_3
        cols[f"{name}_std_3"] = F.lit(s3)
        cols[f"{name}_ma_6"] = (ma_3 + lags[3] + lags[6]) / F.lit(3.0)
        cols[f"{name}_std_6"] = F.lit(s6)
    cols["time_index"] = F.lit(SCENARIO_TIME_INDEX)
    cols["year_normalized"] = (y - F.lit(SCENARIO_FIRST_YEAR)) / F.lit(float(SCENARIO_LAST_YEAR - SCENARIO_FIRST_YEAR))
    base = df.join(codes, "country", "left")
    cols["ISO_A0_encoded"] = F.coalesce(F.col("ISO_A0_encoded"), F.lit(0))
    return base.select(*keep, "country", *[e.alias(k) for k, e in cols.items()])
