"""Calendar column expressions (all JVM-side built-ins)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
# Day-of-week code (Sunday = 0, as strftime('%w')) to English day name.
DAY_NAMES = {
    "0": "Sunday", "1": "Monday", "2": "Tuesday", "3": "Wednesday",
    "4": "Thursday", "5": "Friday", "6": "Saturday",
}
# Trend-based forecast shape: seasonal amplitude over a 365-day period and the
# weekend multiplier.
SEASONAL_AMPLITUDE = 0.1
SEASONAL_PERIOD_DAYS = 365
WEEKEND_FACTOR = 0.8
# Weekday numbers (Monday = 0) counted as weekend.
WEEKEND_DAYS = (5, 6)
# -----------------------------------------------------------------------------

CALENDAR_FEATURES = ["Year", "Month", "DayOfWeek", "DayOfYear", "WeekOfYear",
                     "Quarter", "IsWeekend"]


def _c(d) -> Column:
    return F.col(d) if isinstance(d, str) else d


def day_of_week_mon0(d) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(d))


def is_weekend(d) -> Column:
    return F.weekday(_c(d)).isin(*WEEKEND_DAYS).cast("int")


def calendar_columns(d="datum") -> dict[str, Column]:
    """The seven calendar features, in training column order."""
    d = _c(d)
    return {
        "Year": F.year(d),
        "Month": F.month(d),
        "DayOfWeek": F.weekday(d),
        "DayOfYear": F.dayofyear(d),
        "WeekOfYear": F.weekofyear(d),  # ISO-8601 week number
        "Quarter": F.quarter(d),
        "IsWeekend": is_weekend(d),
    }


def month_key(d="datum") -> Column:
    """'yyyy-MM' text key."""
    return F.date_format(_c(d), "yyyy-MM")


def dow_code_sun0(d="datum") -> Column:
    """Day-of-week code as text, Sunday = '0' ... Saturday = '6'."""
    return (F.dayofweek(_c(d)) - 1).cast("string")


def day_name(code: Column) -> Column:
    """Look a Sunday-0 code up in a literal map (no locale, no join)."""
    m = F.create_map(*[F.lit(x) for kv in DAY_NAMES.items() for x in kv])
    return F.element_at(m, code)


def seasonal_factor(d="datum") -> Column:
    return 1.0 + SEASONAL_AMPLITUDE * F.sin(
        2.0 * math.pi * F.dayofyear(_c(d)) / SEASONAL_PERIOD_DAYS)


def weekend_factor(d="datum") -> Column:
    return F.when(F.weekday(_c(d)).isin(*WEEKEND_DAYS), F.lit(WEEKEND_FACTOR)).otherwise(F.lit(1.0))
