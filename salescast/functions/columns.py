"""Scalar helpers: clamps, rounding, direction labels, alert text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
# Period-over-period change (percent) beyond which a trend is not 'stable'.
DIRECTION_THRESHOLD_PCT = 5.0
# Anomaly rule: flag beyond 2 sample standard deviations, 'high' beyond 3,
# only with at least 5 baseline rows.
ALERT_SIGMA = 2.0
HIGH_SEVERITY_SIGMA = 3.0
ALERT_MIN_ROWS = 5
# -----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp_nonneg(x) -> Column:
    return F.greatest(F.lit(0.0), _c(x))


def round2(x) -> Column:
    return F.round(_c(x), 2)


def pct_change(recent, previous) -> Column:
    """100 * (recent - previous) / previous; null when previous is 0 or null."""
    r, p = _c(recent), _c(previous)
    return F.try_divide(r - p, p) * 100.0


def direction3(recent, previous) -> Column:
    """increasing / decreasing / stable; stable unless both periods exist.

    A zero previous period with a positive recent one counts as increasing
    (an infinite change), as with float division.
    """
    r, p = _c(recent), _c(previous)
    pct = pct_change(r, p)
    t = DIRECTION_THRESHOLD_PCT
    return (
        F.when(r.isNull() | p.isNull(), "stable")
        .when((p == 0) & (r > 0), "increasing")
        .when((p == 0) & (r < 0), "decreasing")
        .when(pct > t, "increasing")
        .when(pct < -t, "decreasing")
        .otherwise("stable")
    )


def direction2(slope) -> Column:
    return F.when(_c(slope) > 0, "increasing").otherwise("decreasing")


def alert_type(x, mean) -> Column:
    return F.when(_c(x) > _c(mean), "high_sales").otherwise("low_sales")


def alert_severity(x, mean, std) -> Column:
    return F.when(F.abs(_c(x) - _c(mean)) > HIGH_SEVERITY_SIGMA * _c(std), "high").otherwise("medium")


def alert_message(x, mean, series="series") -> Column:
    side = F.when(_c(x) > _c(mean), "above").otherwise("below")
    return F.format_string("%s: %.2f lies far %s the mean %.2f of its recent days", _c(series), _c(x), side, _c(mean))
