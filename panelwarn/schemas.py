"""Schemas and the frozen feature list."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

# Fixed values of the reference: the 45 model features in their frozen order
# ('month' precedes 'year').
FEATURE_COLUMNS = [
    "month", "year", "temperature_c", "precipitation_mm", "dayofyear", "weekofyear", "quarter",
    "is_rainy_season", "month_sin", "month_cos", "dayofyear_sin", "dayofyear_cos",
    "dengue_lag_1", "dengue_lag_2", "dengue_lag_3", "dengue_lag_6", "dengue_lag_12",
    "dengue_ma_3", "dengue_std_3", "dengue_ma_6", "dengue_std_6", "dengue_ma_12", "dengue_std_12",
    "temperature_c_lag_1", "temperature_c_lag_2", "temperature_c_lag_3", "temperature_c_lag_6",
    "temperature_c_lag_12", "temperature_c_ma_3", "temperature_c_std_3", "temperature_c_ma_6",
    "temperature_c_std_6", "precipitation_mm_lag_1", "precipitation_mm_lag_2",
    "precipitation_mm_lag_3", "precipitation_mm_lag_6", "precipitation_mm_lag_12",
    "precipitation_mm_ma_3", "precipitation_mm_std_3", "precipitation_mm_ma_6",
    "precipitation_mm_std_6", "temp_precip_interaction", "time_index", "year_normalized",
    "ISO_A0_encoded",
]
# Fixed values of the reference: the features that it correlates with the target.
CORRELATION_CANDIDATES = [
    "dengue_lag_1", "dengue_lag_2", "dengue_lag_3", "dengue_lag_6", "dengue_lag_12",
    "dengue_ma_3", "dengue_ma_6", "dengue_ma_12",
    "temperature_c", "temperature_c_lag_1", "temperature_c_lag_2", "temperature_c_lag_3",
    "precipitation_mm", "precipitation_mm_lag_1", "precipitation_mm_lag_2", "precipitation_mm_lag_3",
    "temp_precip_interaction", "month_sin", "month_cos", "is_rainy_season",
]
# Numeric columns that its feature profile leaves out.
PROFILE_EXCLUDED = ["dengue_total", "outbreak_flag", "Year", "time_index", "year_normalized"]
# Columns the batch scorer requires (plus the target for lag history).
SCORING_REQUIRED = ["ISO_A0", "year", "month", "dayofyear", "weekofyear", "temperature_c",
                    "precipitation_mm"]

REQUEST = StructType([StructField("features", MapType(StringType(), DoubleType()))])
