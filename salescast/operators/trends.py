"""Trend and seasonality aggregates (monthly, weekly, period-over-period)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescast.functions import calendar as cal
from salescast.functions import columns as col
from salescast.operators.series import last_day


def as_of_date(daily: DataFrame, as_of=None) -> Column:
    """Explicit reference date; default is the latest datum (scalar subquery)."""
    if as_of is None:
        return daily.agg(last_day()).scalar()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def monthly_trends(daily: DataFrame) -> DataFrame:
    """Average and day count per series and 'yyyy-MM' month."""
    return daily.groupBy("series", cal.month_key("datum").alias("month")).agg(
        F.avg("value").alias("avg_sales"), F.count(F.lit(1)).alias("days_count"))


def weekly_pattern(daily: DataFrame) -> DataFrame:
    """Average per Sunday-0 day-of-week code, with the day's name."""
    g = daily.groupBy("series", cal.dow_code_sun0("datum").alias("day_of_week")).agg(
        F.avg("value").alias("avg_sales"))
    return g.withColumn("day_name", cal.day_name(F.col("day_of_week")))


def peak_low_day(daily: DataFrame) -> DataFrame:
    """Best and worst weekday by average; the lowest day code wins ties."""
    wp = weekly_pattern(daily).withColumn("dow", F.col("day_of_week").cast("int"))
    return wp.groupBy("series").agg(
        F.max_by("day_name", F.struct(F.col("avg_sales"), -F.col("dow"))).alias("peak_day"),
        F.min_by("day_name", F.struct(F.col("avg_sales"), F.col("dow"))).alias("low_day"),
    )


def trend_direction(daily: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Recent N days vs the N days before, per series, in one pass.

    recent: datum >= as_of - N (no upper bound); previous: as_of - 2N <= datum
    < as_of - N.  The date predicate is pushed to the scan.
    """
    a = as_of_date(daily, as_of)
    recent_lo = F.date_sub(a, days)
    prev_lo = F.date_sub(a, 2 * days)
    f = daily.where(F.col("datum") >= prev_lo)
    period = F.when(F.col("datum") >= recent_lo, "recent").otherwise("previous")
    g = f.withColumn("period", period).groupBy("series").agg(
        F.avg(F.when(F.col("period") == "recent", F.col("value"))).alias("recent_avg"),
        F.avg(F.when(F.col("period") == "previous", F.col("value"))).alias("previous_avg"),
    )
    return g.select(
        "series", "recent_avg", "previous_avg",
        col.pct_change("recent_avg", "previous_avg").alias("change_pct"),
        col.direction3("recent_avg", "previous_avg").alias("direction"),
    )


def _monthly(daily: DataFrame) -> DataFrame:
    """(series, month start, sum, day count): the one aggregate of the daily
    frame that both the resample and the month-of-year profile derive from,
    so the facts are scanned once."""
    return daily.groupBy("series", F.trunc("datum", "month").alias("month")).agg(
        F.sum("value").alias("total"), F.count("value").alias("n_days"))


def _resample(m: DataFrame) -> DataFrame:
    """Fill empty months with 0 in one window pass over the monthly frame:
    each month also emits the empty months up to the series' next month;
    the series' first month (for the index) comes from the same window."""
    w = Window.partitionBy("series").orderBy("month")
    end = F.coalesce(F.add_months(F.lead("month").over(w), -1), F.col("month"))
    x = m.select("series", "month", "total", "n_days", F.first("month").over(w).alias("_lo"),
                 F.greatest(F.col("month"), end).alias("_end"))
    x = x.select("series", "total", "n_days", "_lo",
                 F.posexplode(F.sequence("month", "_end", F.expr("INTERVAL 1 MONTH"))).alias("_i", "_m"))
    own = F.col("_i") == 0
    return x.select(
        "series", F.col("_m").alias("month"),
        F.when(own, F.col("total")).otherwise(F.lit(0.0)).alias("total"),
        F.months_between("_m", "_lo").cast("int").alias("month_idx"),
        F.when(own, F.col("n_days")).otherwise(F.lit(0)).cast("long").alias("n_days"),
    )


def monthly_resample(daily: DataFrame) -> DataFrame:
    """Calendar-month sums per series with empty months as 0, plus the month
    index 0..n-1 from the series' first month."""
    return _resample(_monthly(daily))


def seasonal_profile(daily: DataFrame) -> DataFrame:
    """Average daily value per calendar month (1..12), long form."""
    return daily.groupBy("series", F.month("datum").alias("month")).agg(
        F.avg("value").alias("avg_value"))


def seasonal_profile_map(daily: DataFrame) -> DataFrame:
    """Same profile kept as one MAP<month, avg> per series."""
    p = seasonal_profile(daily)
    return p.groupBy("series").agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct("month", "avg_value")))).alias("monthly_pattern"))


def trend_seasonality(daily: DataFrame) -> DataFrame:
    """Per series: slope of monthly sums over the month index, direction,
    seasonal strength (sample stddev / mean of the month-of-year averages),
    peak and low month (earliest month on ties)."""
    m = _monthly(daily)
    # Both branches read the same monthly aggregate (sum and day count), so
    # its shuffle -- and the fact scan below it -- is shared.
    trend = _resample(m).groupBy("series").agg(
        F.regr_slope("total", "month_idx").alias("trend_slope"),
        F.count(F.lit(1)).alias("n_months"),
        F.sum("n_days").alias("n_days"))
    moy = m.groupBy("series", F.month("month").alias("month")).agg(
        (F.sum("total") / F.sum("n_days")).alias("avg_value"))
    season = moy.groupBy("series").agg(
        F.try_divide(F.stddev_samp("avg_value"), F.avg("avg_value")).alias("seasonal_strength"),
        F.max_by("month", F.struct(F.col("avg_value"), -F.col("month"))).alias("peak_month"),
        F.min_by("month", F.struct(F.col("avg_value"), F.col("month"))).alias("low_month"),
    )
    return trend.join(season, "series").select(
        "series", "trend_slope", col.direction2("trend_slope").alias("trend_direction"),
        "seasonal_strength", "peak_month", "low_month", "n_months")
