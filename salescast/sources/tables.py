"""Bindings of the driver's parquet tables to the canonical daily long form.

Scans select only the columns they use so the parquet reader prunes the
rest; date filters given to these readers become pushed parquet filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def daily_sales(spark: SparkSession, sf_dir: str, series_col: str = "p_type") -> DataFrame:
    """lineitem ⋈ part rolled up to (series, datum, value=sum(l_quantity)).

    The part side is joined as-is: AQE broadcasts it when its measured size
    is under the broadcast threshold and falls back to a sort-merge join
    (with skew splitting) when it is not.  The aggregation is partial on the
    map side, so only (series, day) partials cross the shuffle.
    """
    # Null keys have no place in a daily roll-up; stating that here (rather
    # than leaving it to filters the optimizer infers per use) keeps every
    # plan branch over this binding identical, so its shuffle is shared.
    li = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity", "l_shipdate") \
        .withColumn("datum", F.to_date("l_shipdate")).where(F.col("datum").isNotNull())
    pt = read_table(spark, sf_dir, "part", "p_partkey", series_col).where(F.col(series_col).isNotNull())
    return (
        li.join(pt, li.l_partkey == pt.p_partkey)
        .groupBy(F.col(series_col).alias("series"), "datum")
        .agg(F.sum("l_quantity").alias("value"))
    )


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events rolled up to (series=event_type, datum, value=sum(value))."""
    ev = read_table(spark, sf_dir, "events", "event_type", "ts", "value") \
        .withColumn("datum", F.to_date("ts")) \
        .where(F.col("event_type").isNotNull() & F.col("datum").isNotNull())
    return (
        ev.groupBy(F.col("event_type").alias("series"), "datum")
        .agg(F.sum("value").alias("value"))
    )


def part_catalog(spark: SparkSession, sf_dir: str, series_col: str = "p_type") -> DataFrame:
    """Product dimension for the test binding: one row per distinct series."""
    return (
        read_table(spark, sf_dir, "part", series_col)
        .groupBy(F.col(series_col).alias("code"))
        .agg(F.count(F.lit(1)).alias("n_parts"))
    )
