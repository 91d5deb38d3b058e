"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from panelwarn.functions.calendar import (  # noqa: F401
    cyclical, day_of_year, iso_week, month_of, parse_date, quarter_of,
    scenario_week_of_year, season_flag, year_clamp, year_of,
)
from panelwarn.functions.nulls import (  # noqa: F401
    nan_to_null, positive_flag, sum_or_zero,
)
from panelwarn.functions.numeric import (  # noqa: F401
    alert_label, interaction, percent_text, round6, split_yyyymm,
    threshold_class,
)
