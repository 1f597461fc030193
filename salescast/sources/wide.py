"""Wide daily history file (header CSV, one column per product) -> long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescast import schemas


def read_wide_history(spark: SparkSession, path: str) -> DataFrame:
    """Scan the header CSV with an explicit schema; `datum` parsed M/d/yyyy."""
    df = (
        spark.read.schema(schemas.WIDE_HISTORY)
        .option("header", True)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return df.withColumn("datum", F.to_date("datum", schemas.WIDE_DATE_PATTERN))


def wide_to_long(wide: DataFrame, products: list[str] | None = None) -> DataFrame:
    """Unpivot product columns to (series, datum, value)."""
    products = products or schemas.WIDE_PRODUCTS
    return wide.unpivot(["datum"], products, "series", "value").select(
        "series", "datum", F.col("value").cast("double").alias("value"))


def long_to_wide(daily: DataFrame, series: list[str]) -> DataFrame:
    """Pivot (series, datum, value) to one row per datum, one column per series.

    The series list is given explicitly so the pivot needs no extra pass to
    discover its values.
    """
    return daily.groupBy("datum").pivot("series", series).agg(F.first("value"))
