"""Column expressions shared by the reports."""

from vendora.functions.calendar import (  # noqa: F401
    calendar_days_between, day_name_padded, dow_sunday0, elapsed_days, elapsed_us,
    month_start, month_year_label, whole_days_elapsed)
from vendora.functions.exact import (  # noqa: F401
    BIG, US_PER_DAY, big, cents, days_avg, idiv, pct, round_div, total)
