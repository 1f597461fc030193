"""Explicit schemas.  Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical long form every operator works on.
DAILY = T.StructType([
    T.StructField("series", T.StringType(), False),
    T.StructField("datum", T.DateType(), False),
    T.StructField("value", T.DoubleType(), True),
])

# --- fixed values: the wide history file layout -----------------------------
# Product codes of the wide daily history file, in file order, and the name of
# the series holding their row total.
WIDE_PRODUCTS = ["M01AB", "M01AE", "N02BA", "N02BE", "N05B", "N05C", "R03", "R06"]
TOTAL_SERIES = "Total_Sales"
# Date pattern of the wide file's `datum` column (month/day unpadded).
WIDE_DATE_PATTERN = "M/d/yyyy"
# -----------------------------------------------------------------------------

WIDE_HISTORY = T.StructType(
    [T.StructField("datum", T.StringType(), True)]
    + [T.StructField(p, T.DoubleType(), True) for p in WIDE_PRODUCTS]
    + [
        T.StructField("Year", T.IntegerType(), True),
        T.StructField("Month", T.IntegerType(), True),
        T.StructField("Hour", T.IntegerType(), True),
        T.StructField("Weekday Name", T.StringType(), True),
    ]
)

# Store tables (long form of the fact store; month partition column for pruning).
SALES_STORE = T.StructType([
    T.StructField("series", T.StringType(), False),
    T.StructField("datum", T.DateType(), False),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("predicted", T.DoubleType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("ingest_ts", T.TimestampType(), True),
    T.StructField("batch", T.LongType(), True),
    T.StructField("month", T.StringType(), True),
])

PREDICTIONS = T.StructType([
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("prediction_date", T.DateType(), True),
    T.StructField("target_product", T.StringType(), True),
    T.StructField("predicted_value", T.DoubleType(), True),
    T.StructField("model_used", T.StringType(), True),
    T.StructField("batch", T.LongType(), True),
    T.StructField("month", T.StringType(), True),
])

ALERTS = T.StructType([
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("series", T.StringType(), True),
    T.StructField("datum", T.DateType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("baseline_mean", T.DoubleType(), True),
    T.StructField("baseline_std", T.DoubleType(), True),
    T.StructField("n", T.LongType(), True),
    T.StructField("alert_type", T.StringType(), True),
    T.StructField("message", T.StringType(), True),
    T.StructField("severity", T.StringType(), True),
    T.StructField("batch", T.LongType(), True),
    T.StructField("month", T.StringType(), True),
])

# Records that a stream set aside, with the reason; `batches` numbers groups of micro-batches.
QUARANTINE = T.StructType([
    T.StructField("raw", T.StringType(), True),
    T.StructField("reason", T.StringType(), True),
    T.StructField("batch", T.LongType(), True),
    T.StructField("batches", T.LongType(), True),
])

MODEL_REGISTRY = T.StructType([
    T.StructField("target", T.StringType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("path", T.StringType(), True),
    T.StructField("mae", T.DoubleType(), True),
    T.StructField("rmse", T.DoubleType(), True),
    T.StructField("r2", T.DoubleType(), True),
    T.StructField("is_best", T.BooleanType(), True),
    T.StructField("saved_at", T.TimestampType(), True),
])
