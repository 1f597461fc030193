"""Analysis report: data overview, trend line of one target, forecast summary.

Built as one-row DataFrames; the trend and forecast figures enter as scalar
subqueries, so nothing is collected until the caller writes or shows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescast.schemas import TOTAL_SERIES


def data_overview(daily: DataFrame) -> DataFrame:
    """Row count, date range and the sorted series list."""
    return daily.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min("datum").alias("first_date"),
        F.max("datum").alias("last_date"),
        F.array_join(F.array_sort(F.collect_set("series")), ", ").alias("products"),
    )


def analysis_report(daily: DataFrame, trends: DataFrame, forecast: DataFrame | None = None,
                    target: str = TOTAL_SERIES, forecast_col: str = "predicted") -> DataFrame:
    """One row: overview + the target's trend figures (+ forecast mean)."""
    # One struct-valued subquery per source, so each pipeline runs once.
    tr = trends.where(F.col("series") == target).select(F.struct(
        "trend_slope", F.initcap("trend_direction").alias("trend_direction"),
        "seasonal_strength", "peak_month", "low_month").alias("t")).scalar()
    cols = [tr[c].alias(c) for c in ("trend_slope", "trend_direction", "seasonal_strength",
                                      "peak_month", "low_month")]
    if forecast is not None:
        fc = forecast.where(F.col("series") == target).select(F.struct(
            F.avg(forecast_col).alias("m"), F.count(F.lit(1)).alias("n")).alias("f")).scalar()
        cols += [fc["m"].alias("forecast_mean"), fc["n"].alias("forecast_days")]
    return data_overview(daily).select("*", *cols)


def report_lines(report: DataFrame, target: str = TOTAL_SERIES) -> DataFrame:
    """The report as text lines (one column `value`), ready for write.text."""
    r = report
    lines = [
        F.lit(f"Sales analysis report - {target}"),
        F.format_string("Records: %d", "n_records"),
        F.format_string("Date range: %s to %s", F.col("first_date").cast("string"), F.col("last_date").cast("string")),
        F.format_string("Products: %s", "products"),
        F.format_string("Trend: %s (%.2f units/month)", "trend_direction", "trend_slope"),
        F.format_string("Seasonal strength: %.2f", "seasonal_strength"),
        F.format_string("Peak month: %d, low month: %d", "peak_month", "low_month"),
    ]
    if "forecast_mean" in r.columns:
        lines.append(F.format_string("Forecast (%d days) mean: %.2f", "forecast_days", "forecast_mean"))
    return r.select(F.explode(F.array(*lines)).alias("value"))


def write_report(report: DataFrame, path: str, target: str = TOTAL_SERIES) -> None:
    """Write the report's text lines as one text file (a one-row report)."""
    report_lines(report, target).coalesce(1).write.mode("overwrite").text(path)
