"""Read paths over the store: recent rows, latest rows, actual vs predicted,
backfill of missing predictions, product catalog, store status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescast.operators.series import bucketed_window, tail_n
from salescast.operators.trends import as_of_date

# --- fixed values ---------------------------------------------------------------
MAX_DAYS = 365           # bounds of the `days` argument of the read paths
NAME_MAX_CHARS = 50      # product label truncation
BACKFILL_LIMIT = 50
# -----------------------------------------------------------------------------


def check_days(days: int) -> int:
    if not isinstance(days, int) or days < 1 or days > MAX_DAYS:
        raise ValueError(f"days: expected a whole number from 1 to {MAX_DAYS}, got {days!r}")
    return days


def naive_predictions(dense: DataFrame, lag: int = 7) -> DataFrame:
    """Same-weekday-last-week scorer on a dense grid: predicted = value `lag`
    rows back (calendar-bucketed window, see series.bucketed_window)."""
    return bucketed_window(dense, lag, lambda x, w: x.withColumn("predicted", F.lag("value", lag).over(w)))


def recent_rows(store: DataFrame, days: int = 7, as_of=None) -> DataFrame:
    """Rows with datum >= as_of - days (inclusive, no upper bound)."""
    check_days(days)
    a = as_of_date(store, as_of)
    lo = F.date_sub(a, days)
    cond = F.col("datum") >= lo
    if "month" in store.columns:
        # The store is partitioned by 'yyyy-MM'; the same bound on the
        # partition column lets the scan skip whole months.
        cond = (F.col("month") >= F.date_format(lo, "yyyy-MM")) & cond
    return store.where(cond)


def actual_vs_predicted(actuals: DataFrame, predictions: DataFrame, n: int = 30) -> DataFrame:
    """Pair actual and predicted on (series, datum); keep rows with a positive
    prediction; newest n per series."""
    j = actuals.select("series", "datum", F.col("value").alias("actual")).join(
        predictions.select("series", "datum", "predicted"), ["series", "datum"])
    j = j.where(F.col("predicted").isNotNull() & (F.col("predicted") > 0))
    return tail_n(j, n)


def prediction_range(pairs: DataFrame) -> DataFrame:
    """Axis range over actual and predicted per series."""
    return pairs.groupBy("series").agg(
        F.least(F.min("actual"), F.min("predicted")).alias("range_min"),
        F.greatest(F.max("actual"), F.max("predicted")).alias("range_max"),
        F.count(F.lit(1)).alias("n_pairs"))


def latest_rows(store: DataFrame, n: int = 10, ts_col: str = "ingest_ts") -> DataFrame:
    """Newest n stored rows; ties broken by datum desc, series asc.
    A global top-n: each partition keeps n rows before the final merge."""
    return store.orderBy(F.col(ts_col).desc(), F.col("datum").desc(), F.col("series").asc()).limit(n)


def recent_alerts(alerts: DataFrame, days: int = 7, as_of_ts=None) -> DataFrame:
    """All alerts with ts >= as_of_ts - days, newest first."""
    a = alerts.agg(F.max("ts")).scalar() if as_of_ts is None else F.lit(as_of_ts).cast("timestamp")
    return alerts.where(F.col("ts") >= a - F.make_dt_interval(F.lit(days))).orderBy(
        F.col("ts").desc(), F.col("series").asc(), F.col("alert_type").asc())


def latest_alerts(alerts: DataFrame, n: int = 20) -> DataFrame:
    """The newest n alerts, however old."""
    return alerts.orderBy(F.col("ts").desc(), F.col("series").asc(), F.col("alert_type").asc()).limit(n)


def recent_predictions(predictions: DataFrame, days: int = 7, as_of_ts=None) -> DataFrame:
    """Predictions with ts >= as_of_ts - days, newest first (no row cap)."""
    a = predictions.agg(F.max("ts")).scalar() if as_of_ts is None else F.lit(as_of_ts).cast("timestamp")
    return predictions.where(F.col("ts") >= a - F.make_dt_interval(F.lit(days))).orderBy(
        F.col("ts").desc(), F.col("target_product").asc(), F.col("model_used").asc())


def needs_prediction(store: DataFrame) -> DataFrame:
    return store.where(F.col("predicted").isNull() | (F.col("predicted") == 0))


def backfill_predictions(store: DataFrame, scorer: Callable[[DataFrame], DataFrame],
                         limit: int = BACKFILL_LIMIT, key=("series", "datum")) -> DataFrame:
    """Score the newest `limit` rows per series that lack a prediction and
    write the scores back by key: left join + coalesce(new, old).

    `scorer` maps the selected rows to (key..., new_pred); rows that share a
    key get one score (the largest, should they differ), so the join never
    multiplies stored rows.  Returns the whole
    store with updated predictions; persisting it is a dynamic overwrite of
    the touched month partitions (``sources.store.overwrite_months``).
    """
    key = list(key)
    todo = tail_n(needs_prediction(store), limit)
    scores = scorer(todo).groupBy(*key).agg(F.max("new_pred").alias("new_pred"))
    return store.join(scores, key, "left").withColumn(
        "predicted", F.coalesce("new_pred", "predicted")).drop("new_pred")


def product_catalog(dim: DataFrame, registry: DataFrame) -> DataFrame:
    """Product dimension with a has_model flag (left join on the registry's
    distinct targets), the full name and a label cut to 50 characters."""
    targets = registry.select(F.col("target").alias("code")).distinct()
    return dim.join(targets.withColumn("_m", F.lit(True)), "code", "left").select(
        "code", "name", F.substring("name", 1, NAME_MAX_CHARS).alias("label"),
        F.coalesce("_m", F.lit(False)).alias("has_model"))


def products_with_models(dim: DataFrame, registry: DataFrame) -> DataFrame:
    return dim.join(registry.select(F.col("target").alias("code")), "code", "left_semi")


def catalog_summary(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count(F.lit(1)).alias("n_products"),
                       F.count_if("has_model").alias("n_with_models"))


def store_status(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("total_records"),
                     F.max("datum").alias("last_datum"),
                     F.count_if(F.col("predicted").isNotNull() & (F.col("predicted") > 0))
                     .alias("rows_with_prediction"))
