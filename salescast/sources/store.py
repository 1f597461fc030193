"""The Parquet store: facts (`sales_data`), `predictions`, `alerts` and `quarantine`.

One layout for every writer.  Facts, predictions and alerts are partitioned by
the 'yyyy-MM' month of their day, so date filters prune partitions; quarantined
records by groups of batches.  The micro-batch a row came with is a column (null
for appended history), not a directory: a stream adds files to months, never a
directory per batch, and `compact` merges the files of months that have many.

A micro-batch is written by `write_batch`.  If its rows are already there (it is a
replay), the partitions it touches are rewritten without them, in one dynamic
partition overwrite; otherwise they are appended.  Append, stream, backfill and
compaction may follow each other in any order.  The store root lives in the
shared checkpoint folder (or any shared path given).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salescast import schemas

TABLES = {
    "sales_data": schemas.SALES_STORE,
    "predictions": schemas.PREDICTIONS,
    "alerts": schemas.ALERTS,
    "quarantine": schemas.QUARANTINE,
}
PARTITIONS = {"sales_data": "month", "predictions": "month", "alerts": "month", "quarantine": "batches"}
MANY_FILES = 16          # of a partition, from which it is compacted
BATCHES_A_PARTITION = 1000


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def init_store(spark: SparkSession, root: str) -> None:
    """Create the tables empty (schema only) unless they exist."""
    for name, schema in TABLES.items():
        if _read(spark, root, name) is None:
            spark.createDataFrame([], schema).write.mode("ignore").partitionBy(PARTITIONS[name]).parquet(
                table_path(root, name))


def _read(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    try:  # a missing path fails when the read is defined, not in a job
        return spark.read.schema(TABLES[name]).parquet(table_path(root, name))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(table_path(root, name))


def read_or_empty(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table, or no rows before its first write."""
    df = _read(spark, root, name)
    return spark.createDataFrame([], TABLES[name]) if df is None else df


def month_of(day: Column | str) -> Column:
    return F.date_format(day, "yyyy-MM")


def _column(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def as_fact_rows(df: DataFrame, source: str = "realtime") -> DataFrame:
    """Fill store defaults: predicted and batch (null), source, ingest time and month."""
    return df.select(
        "series", "datum", F.col("value").cast("double").alias("value"),
        _column(df, "predicted", F.lit(None)).cast("double").alias("predicted"),
        _column(df, "source", F.lit(source)).alias("source"),
        _column(df, "ingest_ts", F.current_timestamp()).alias("ingest_ts"),
        _column(df, "batch", F.lit(None)).cast("long").alias("batch"),
        month_of("datum").alias("month"))


def as_prediction_rows(df: DataFrame) -> DataFrame:
    """df: (prediction_date, target_product, predicted_value, model_used[, ts, batch])."""
    return df.select(_column(df, "ts", F.current_timestamp()).alias("ts"), "prediction_date", "target_product",
                     F.col("predicted_value").cast("double").alias("predicted_value"), "model_used",
                     _column(df, "batch", F.lit(None)).cast("long").alias("batch"), month_of("prediction_date").alias("month"))


def as_alert_rows(df: DataFrame) -> DataFrame:
    """df: (series, datum, alert_type, message, severity[, ts, value, n, baseline_mean, baseline_std, batch])."""
    none = F.lit(None)
    return df.select(_column(df, "ts", F.current_timestamp()).alias("ts"), "series", "datum",
                     *[_column(df, c, none).cast("double").alias(c) for c in ("value", "baseline_mean", "baseline_std")],
                     _column(df, "n", none).cast("long").alias("n"), "alert_type", "message", "severity",
                     _column(df, "batch", none).cast("long").alias("batch"), month_of("datum").alias("month"))


def as_quarantine_rows(df: DataFrame) -> DataFrame:
    """df: (raw, reason, batch)."""
    return df.select("raw", "reason", F.col("batch").cast("long").alias("batch"),
                     F.expr(f"batch div {BATCHES_A_PARTITION}").cast("long").alias("batches"))


ROWS = {"sales_data": as_fact_rows, "predictions": as_prediction_rows, "alerts": as_alert_rows,
        "quarantine": as_quarantine_rows}


def append(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("append").partitionBy(PARTITIONS[name]).parquet(table_path(root, name))


def _replace(df: DataFrame, root: str, name: str) -> None:
    """Replace exactly the partitions present in `df`; others are untouched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITIONS[name]).parquet(
        table_path(root, name))


def append_facts(df: DataFrame, root: str, source: str = "realtime") -> None:
    append(as_fact_rows(df, source), root, "sales_data")


def append_predictions(df: DataFrame, root: str) -> None:
    append(as_prediction_rows(df), root, "predictions")


def append_alerts(df: DataFrame, root: str) -> None:
    append(as_alert_rows(df), root, "alerts")


def overwrite_months(df: DataFrame, root: str) -> None:
    """Replace exactly the months present in `df`.  Rows keep their batch."""
    _replace(as_fact_rows(df), root, "sales_data")


def write_batch(df: DataFrame, root: str, name: str, batch: int, source: str | None = None) -> None:
    """Write a micro-batch's rows so that writing it again changes nothing.

    The rows of a batch are those of its number (and `source`, for facts: streams that share a store have
    sources of their own).  Whether it is a replay is asked of the partitions it touches only.
    """
    spark, part = df.sparkSession, PARTITIONS[name]
    df = df.withColumn("batch", F.lit(batch).cast("long"))
    if source is not None:
        df = df.withColumn("source", F.lit(source))
    rows = ROWS[name](df).persist()
    try:
        old = _read(spark, root, name)
        if old is not None:
            touched = [r[0] for r in rows.select(part).distinct().collect()]  # the months (or group) of one micro-batch
            old = old.where(F.col(part).isin(touched))
            mine = F.col("batch") == batch
            if source is not None:
                mine = mine & (F.col("source") == source)
            if not old.where(mine).isEmpty():
                # what stays is read from files that the commit replaces only after the new ones are written
                _replace(old.where(~F.coalesce(mine, F.lit(False))).unionByName(rows), root, name)
                return
        append(rows, root, name)
    finally:
        rows.unpersist()


def compact(spark: SparkSession, root: str, name: str = "sales_data", many: int = MANY_FILES) -> int:
    """Rewrite the partitions of more than `many` files in files of the advisory size; how many there were."""
    part = PARTITIONS[name]
    table = read_table(spark, root, name)
    files = table.select(part, F.input_file_name().alias("file")).distinct().groupBy(part).count()
    todo = [r[0] for r in files.where(F.col("count") > many).select(part).collect()]  # names of partitions
    if todo:
        _replace(table.where(F.col(part).isin(todo)).hint("rebalance", part), root, name)
    return len(todo)
