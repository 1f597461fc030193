"""Anomaly baseline and alerts against a trailing window of calendar days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescast.functions import columns as col
from salescast.operators.series import DEFAULT_BUCKET_DAYS, bucketed_window
from salescast.operators.trends import as_of_date

# --- fixed values ---------------------------------------------------------------
BASELINE_DAYS = 30
# -----------------------------------------------------------------------------


def anomaly_baseline(daily: DataFrame, as_of=None, days: int = BASELINE_DAYS) -> DataFrame:
    """Mean, sample stddev and count of each series over datum >= as_of - days
    (no upper bound), and whether the baseline is usable (>= 5 rows)."""
    a = as_of_date(daily, as_of)
    return daily.where(F.col("datum") >= F.date_sub(a, days)).groupBy("series").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean_sales"),
        F.stddev_samp("value").alias("std_sales"),
    ).withColumn("usable", F.col("n") >= col.ALERT_MIN_ROWS)


def score_anomalies(daily: DataFrame, days: int = BASELINE_DAYS,
                    bucket_days: int | None = DEFAULT_BUCKET_DAYS) -> DataFrame:
    """Every row against the `days` calendar days before it and itself.

    The frame is a RANGE over the day number, so duplicate days and gaps are
    handled as a date predicate would.  Runs in calendar buckets with a
    `days` halo, so a long or hot series is split across tasks.
    """
    def compute(x: DataFrame, w: Window) -> DataFrame:
        wr = Window.partitionBy(*[c for c in ("series", "_bkt") if c in x.columns]) \
            .orderBy(F.unix_date("datum")).rangeBetween(-days, 0)
        return x.withColumns({
            "n": F.count("value").over(wr),
            "baseline_mean": F.avg("value").over(wr),
            "baseline_std": F.stddev_samp("value").over(wr),
        })

    s = bucketed_window(daily, days, compute, bucket_days)
    dev = F.abs(F.col("value") - F.col("baseline_mean"))
    return s.withColumn(
        "is_alert",
        (F.col("n") >= col.ALERT_MIN_ROWS) & (dev > col.ALERT_SIGMA * F.col("baseline_std")))


def anomaly_alerts(daily: DataFrame, days: int = BASELINE_DAYS,
                   bucket_days: int | None = DEFAULT_BUCKET_DAYS, with_message: bool = True) -> DataFrame:
    """Rows that break the 2-sigma rule, with type, severity and message."""
    s = score_anomalies(daily, days, bucket_days).where("is_alert")
    out = s.select(
        "series", "datum", "value", "n", "baseline_mean", "baseline_std",
        col.alert_type("value", "baseline_mean").alias("alert_type"),
        col.alert_severity("value", "baseline_mean", "baseline_std").alias("severity"),
    )
    if with_message:
        out = out.withColumn("message", col.alert_message("value", "baseline_mean"))
    return out


def alerts_table(alerts: DataFrame, ts=None) -> DataFrame:
    """Shape alerts like the alerts store (ts, series, datum, type, message, severity)."""
    ts = F.col("datum").cast("timestamp") if ts is None else ts
    return alerts.select(ts.alias("ts"), "series", "datum", "alert_type", "message", "severity")
