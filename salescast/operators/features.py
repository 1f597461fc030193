"""Lag / rolling features, the wide feature matrix, time-ordered splits.

All row-positional features run on a dense daily grid (one row per series
and day), so "k rows back" is "k days back".  They share one window spec, so
Spark evaluates them after a single shuffle + sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescast.functions.calendar import calendar_columns, CALENDAR_FEATURES
from salescast.operators.series import DEFAULT_BUCKET_DAYS, bucketed_window, pivot_wide, total_series
from salescast.schemas import TOTAL_SERIES

# --- fixed values: feature layout -----------------------------------------------
LAGS = [1, 3, 7, 14, 30]
WINDOWS = [3, 7, 14, 30]
N_SPLITS = 5  # expanding time-series folds; the last one is the holdout
# -----------------------------------------------------------------------------


def lag_names(lags=LAGS):
    return [f"lag_{k}" for k in lags]


def rolling_names(windows=WINDOWS):
    return [f"rolling_{k}" for k in windows]


def lag_rolling(dense: DataFrame, lags=LAGS, windows=WINDOWS, include_current: bool = True,
                bucket_days: int | None = DEFAULT_BUCKET_DAYS) -> DataFrame:
    """Add lag_k (row-positional) and rolling_w means per series.

    Rolling means include the current row by default and are null until the
    window is full; include_current=False uses the w rows before instead.
    """
    lags, windows = list(lags), list(windows)
    halo = max(lags + [w if not include_current else w - 1 for w in windows] + [0])

    def compute(x: DataFrame, w: Window) -> DataFrame:
        cols: dict[str, Column] = {}
        for k in lags:
            cols[f"lag_{k}"] = F.lag("value", k).over(w)
        for k in windows:
            wk = w.rowsBetween(-(k - 1), 0) if include_current else w.rowsBetween(-k, -1)
            cols[f"rolling_{k}"] = F.when(F.count("value").over(wk) == k, F.avg("value").over(wk))
        return x.withColumns(cols)

    return bucketed_window(dense, max(halo, 1), compute, bucket_days)


def features_asof(history: DataFrame, points: DataFrame, lags=LAGS, windows=WINDOWS,
                  block_rows: int | None = None) -> DataFrame:
    """Serving-time features for new points from the rows before them.

    Each point sees the history and the earlier points (the store's state
    when points are applied in date order).  lag_k = the value k rows before
    the point, or the mean of all earlier rows when there are fewer than k;
    rolling_w = mean of the (up to) w rows before the point.  Look-backs count
    rows, whatever the gaps between their dates: of what lies before a series'
    earliest point, its newest rows enter, as many as the longest look-back
    (a partial limit per task before the shuffle), and all rows since.

    With `block_rows` no task windows a whole series: rows are numbered
    (`row_numbers`), and windowed in blocks of so many rows, each with the
    rows that the look-back needs from the block before.
    """
    lags, windows = list(lags), list(windows)
    look = max(lags + windows)
    first = points.groupBy("series").agg(F.min("datum").alias("_first"))
    h = history.select("series", "datum", "value").join(first, "series")
    since = h.where(F.col("datum") >= F.col("_first"))
    back = Window.partitionBy("series").orderBy(F.col("datum").desc(), F.col("value").desc())
    before = h.where(F.col("datum") < F.col("_first")) \
        .withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= look).drop("_n")
    h = before.unionByName(since).select("series", "datum", "value", F.lit(False).alias("_new"))
    p = points.select("series", "datum", "value", F.lit(True).alias("_new"))
    rows = h.unionByName(p)
    if block_rows is None:
        w = Window.partitionBy("series").orderBy("datum", "_new", "value")
    else:
        if block_rows < look:
            raise ValueError(f"a block of {block_rows} rows is shorter than the look-back of {look}")
        at = F.col("_pos")
        own = F.floor(at / block_rows)
        rows = row_numbers(rows, ["datum", "_new", "value"]).withColumn("_own", own).withColumn("_block", F.explode(
            F.when(at % block_rows >= block_rows - look, F.array(own, own + 1)).otherwise(F.array(own))))
        w = Window.partitionBy("series", "_block").orderBy("_pos")
    # fewer than k earlier rows are there only in a series' first block, which begins with its first row
    mean_before = F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cols: dict[str, Column] = {}
    for k in lags:
        cols[f"lag_{k}"] = F.coalesce(F.lag("value", k).over(w), mean_before)
    for k in windows:
        cols[f"rolling_{k}"] = F.avg("value").over(w.rowsBetween(-k, -1))
    out = rows.withColumns(cols).where("_new")
    if block_rows is not None:
        out = out.where("_block = _own").drop("_pos", "_own", "_block")
    return out.drop("_new")


def row_numbers(rows: DataFrame, order: list[str], bucket_days: int = DEFAULT_BUCKET_DAYS) -> DataFrame:
    """`_pos`: a row's place (from 0) in its series by `order`, which begins with the date.

    No task orders a whole series: rows are ranked within calendar buckets, and a bucket's rows come after
    those of all buckets before it, whose counts are summed in a frame of one row per series and bucket.
    """
    x = rows.withColumn("_bucket", F.floor(F.unix_date(order[0]) / bucket_days))
    n = x.groupBy("series", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("series").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select("series", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("series", "_bucket").orderBy(*order))
    return x.withColumn("_rank", rank).join(n, ["series", "_bucket"]) \
        .withColumn("_pos", F.col("_before") + F.col("_rank") - 1).drop("_bucket", "_rank", "_before")


def feature_matrix(dense_global: DataFrame, series: list[str], target: str = TOTAL_SERIES,
                   bucket_days: int | None = DEFAULT_BUCKET_DAYS) -> DataFrame:
    """Wide training matrix: calendar + {series}_lag_k + {series}_rolling_w,
    plus sibling series values for single-series targets, plus the target.

    `dense_global` is the dense grid over one shared calendar; rows with any
    missing feature (the warm-up days) are dropped.  A listed series that the
    grid does not hold (a product never sold) is a series of zeros.
    """
    f = lag_rolling(dense_global, bucket_days=bucket_days)
    names = lag_names() + rolling_names()
    # Drop warm-up rows in long form first: the pivot then only sees complete
    # rows, and the optimizer does not have to reason about 50+ nullable
    # pivoted columns.
    complete = F.lit(True)
    for c in names:
        complete = complete & F.col(c).isNotNull()
    wide = f.where(complete).groupBy("datum").pivot("series", series).agg(
        *[F.first(c).alias(c) for c in names])
    if target == TOTAL_SERIES:
        tgt = total_series(dense_global).select("datum", F.col("value").alias(TOTAL_SERIES))
        out = wide.join(tgt, "datum")
    else:
        out = wide.join(pivot_wide(dense_global, series), "datum")
    feats = feature_columns(series, target)
    # On one shared calendar a hole is a listed series without any rows: it counts as a zero series.
    out = out.fillna(0.0, [c for c in [*feats, target] if c not in CALENDAR_FEATURES])
    out = out.withColumns(calendar_columns("datum"))
    keep = F.lit(True)
    for c in feats:
        keep = keep & F.col(c).isNotNull()
    return out.select("datum", *feats, target).where(keep)


def feature_columns(series: list[str], target: str = TOTAL_SERIES) -> list[str]:
    """Training column order: calendar, all lags, all rolling means, siblings."""
    feat = ([f"{s}_lag_{k}" for s in series for k in LAGS]
            + [f"{s}_rolling_{k}" for s in series for k in WINDOWS])
    sib = [] if target == TOTAL_SERIES else [s for s in series if s != target]
    return CALENDAR_FEATURES + feat + sib


def _positions(df: DataFrame, dense: bool) -> DataFrame:
    """0-based row position and row count per series.

    dense=True: position = days since the series' first day; the count and
    first day come from a small per-series aggregate joined back, so no task
    holds a whole series.  dense=False: row_number over the series.
    """
    if dense:
        st = df.groupBy("series").agg(F.min("datum").alias("_lo"), F.count(F.lit(1)).alias("_n"))
        return df.join(st, "series").withColumn("_pos", F.datediff("datum", "_lo")).drop("_lo")
    w = Window.partitionBy("series")
    return df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn(
        "_pos", F.row_number().over(w.orderBy("datum")) - 1)


def time_split(df: DataFrame, n_splits: int = N_SPLITS, dense: bool = False) -> DataFrame:
    """Holdout = last fold of an expanding time-series split: the last
    n // (n_splits + 1) rows of each series are 'test', the rest 'train'."""
    x = _positions(df, dense)
    t = F.floor(F.col("_n") / (n_splits + 1))
    return x.withColumn("split", F.when(F.col("_pos") >= F.col("_n") - t, "test").otherwise("train")
                        ).drop("_pos", "_n")


def time_split_panel(df: DataFrame, n_splits: int = N_SPLITS) -> DataFrame:
    """Panel holdout cut by date, so every series shares the boundary: over
    the panel's calendar of D consecutive days the last D // (n_splits + 1)
    days are 'test'.  The calendar bounds are one scalar subquery."""
    b = df.agg(F.struct(F.min("datum").alias("lo"), F.max("datum").alias("hi"))).scalar()
    n_days = F.datediff(b["hi"], b["lo"]) + 1
    t = F.floor(n_days / (n_splits + 1))
    return df.withColumn("split", F.when(F.datediff(b["hi"], F.col("datum")) < t, "test").otherwise("train"))


def time_folds(df: DataFrame, n_splits: int = N_SPLITS, dense: bool = False) -> DataFrame:
    """Expanding folds, compactly: `test_fold` = i when the row is in fold i's
    test block, null when it is only ever training data.  Fold i trains on
    every row before its test block (test_fold < i or null)."""
    x = _positions(df, dense)
    t = F.floor(F.col("_n") / (n_splits + 1))
    start = F.col("_n") - n_splits * t
    fold = F.when((t > 0) & (F.col("_pos") >= start),
                  F.floor((F.col("_pos") - start) / t).cast("int"))
    return x.withColumn("test_fold", fold).drop("_pos", "_n")


def fold_frames(folds: DataFrame, i: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) of fold i from the compact `time_folds` output."""
    tf = F.col("test_fold")
    train = folds.where(tf.isNull() | (tf < i))
    test = folds.where(tf == i)
    return train, test
