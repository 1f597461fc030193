import math

from conftest import consecutive, daily_df

from salescast.operators import trends


def test_peak_low_month_ties_pick_earliest(spark):
    # Jan and Feb both average 10; Mar and Apr both 5 -> peak 1, low 3
    rows = (consecutive("A", "2020-01-01", [10.0] * 31) + consecutive("A", "2020-02-01", [10.0] * 29)
            + consecutive("A", "2020-03-01", [5.0] * 31) + consecutive("A", "2020-04-01", [5.0] * 30))
    r = trends.trend_seasonality(daily_df(spark, rows)).first()
    assert (r.peak_month, r.low_month) == (1, 3)


def test_resample_fills_missing_month_with_zero(spark):
    rows = [("A", "2020-01-05", 3.0), ("A", "2020-03-02", 4.0)]
    out = {r.month.month: (r.total, r.month_idx)
           for r in trends.monthly_resample(daily_df(spark, rows)).collect()}
    assert out == {1: (3.0, 0), 2: (0.0, 1), 3: (4.0, 2)}


def test_slope_and_strength_match_numpy(spark):
    import numpy as np
    vals = [float((i * 7) % 13) for i in range(400)]
    df = daily_df(spark, consecutive("A", "2021-01-01", vals))
    r = trends.trend_seasonality(df).first()
    import pandas as pd
    s = pd.Series(vals, index=pd.date_range("2021-01-01", periods=400))
    m = s.resample("MS").sum()
    slope = np.polyfit(np.arange(len(m)), m.values, 1)[0]
    moy = s.groupby(s.index.month).mean()
    assert math.isclose(r.trend_slope, slope, rel_tol=1e-9)
    assert math.isclose(r.seasonal_strength, moy.std() / moy.mean(), rel_tol=1e-9)
    assert r.peak_month == int(moy.idxmax()) and r.low_month == int(moy.idxmin())


def test_all_zero_series_strength_null_direction_stable(spark):
    df = daily_df(spark, consecutive("Z", "2022-01-01", [0.0] * 90))
    r = trends.trend_seasonality(df).first()
    assert r.seasonal_strength is None
    t = trends.trend_direction(df).first()
    assert t.change_pct is None and t.direction == "stable"


def test_direction_needs_both_periods(spark):
    df = daily_df(spark, consecutive("A", "2022-01-01", [5.0] * 10))
    assert trends.trend_direction(df).first().direction == "stable"


def test_direction_thresholds(spark):
    vals = [100.0] * 30 + [110.0] * 31
    df = daily_df(spark, consecutive("A", "2022-01-01", vals))
    r = trends.trend_direction(df).first()
    assert r.direction == "increasing" and abs(r.change_pct - 10.0) < 1e-9


def test_weekly_pattern_sunday_zero_and_names(spark):
    # 2024-01-07 is a Sunday
    df = daily_df(spark, [("A", "2024-01-07", 1.0), ("A", "2024-01-08", 5.0)])
    got = {r.day_of_week: r.day_name for r in trends.weekly_pattern(df).collect()}
    assert got == {"0": "Sunday", "1": "Monday"}
    pl = trends.peak_low_day(df).first()
    assert (pl.peak_day, pl.low_day) == ("Monday", "Sunday")


def test_calendar_iso_week_edges(spark):
    from pyspark.sql import functions as F
    from salescast.functions.calendar import calendar_columns
    df = daily_df(spark, [("A", "2024-12-30", 1.0), ("A", "2021-01-03", 1.0)])
    got = {r.datum.isoformat(): (r.WeekOfYear, r.DayOfWeek, r.IsWeekend)
           for r in df.withColumns(calendar_columns(F.col("datum"))).collect()}
    assert got == {"2024-12-30": (1, 0, 0), "2021-01-03": (53, 6, 1)}
