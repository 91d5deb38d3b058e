"""A fixed linear model, saved and scored like a trained one, so that SQL can recompute every score."""

LINEAR = {"dengue_lag_1": 0.02, "temperature_c": 0.03, "year_normalized": 0.5, "ISO_A0_encoded": -0.04}
INTERCEPT = -1.5


#: Background rows that the Shapley queries replace features from (one permutation each).
SHAPLEY_BACKGROUND = 10


def linear_log_odds_sql() -> str:
    """The log-odds as an expression that Spark and DuckDB both read."""
    return " + ".join([f"cast({INTERCEPT} as double)"] + [f"cast({w} as double) * {c}" for c, w in LINEAR.items()])


def linear_probability_sql() -> str:
    """The probability as an expression that Spark and DuckDB both read."""
    return f"cast(1 as double) / (cast(1 as double) + exp(-({linear_log_odds_sql()})))"
