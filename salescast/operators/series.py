"""Shape operators on (series, datum, value): dense grid, totals, reshaping,
date spines, tails, unions and the time-bucketed window helper.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescast.schemas import TOTAL_SERIES

# Rows of one series are windowed in calendar buckets of this many days, each
# bucket carrying a halo of the days before it.  This bounds a window task by
# the bucket length, however long or hot a single series is.
DEFAULT_BUCKET_DAYS = 366


def first_day(c: str = "datum", v: str = "value") -> Column:
    """min(datum) written over (datum, value).  Referencing the aggregated
    value keeps the optimizer from rewriting a bound of a rolled-up frame
    into a bound over the raw fact rows -- which would scan the facts a
    second time instead of sharing the rolled-up shuffle."""
    return F.min(F.struct(c, v))[c]


def last_day(c: str = "datum", v: str = "value") -> Column:
    """max(datum), see first_day."""
    return F.max(F.struct(c, v))[c]


def series_bounds(daily: DataFrame) -> DataFrame:
    return daily.groupBy("series").agg(first_day().alias("lo"), last_day().alias("hi"))


def dense_grid(daily: DataFrame, span: str = "series", fill: float | None = 0.0) -> DataFrame:
    """One row per series and calendar day, missing days filled with `fill`.

    span='series': each series from its own first to last day.
    span='global': every series over the overall first..last day (the bounds
    enter as one struct-valued scalar subquery, not a join).

    The calendar comes from a small per-series bounds aggregate, is exploded
    and joined back on (series, datum) -- the key the roll-up is already
    partitioned by -- so no task ever holds a whole series.
    """
    if span == "series":
        cal = series_bounds(daily).select(
            "series", F.explode(F.sequence("lo", "hi")).alias("datum"))
    elif span == "global":
        b = daily.agg(F.struct(first_day().alias("lo"), last_day().alias("hi"))).scalar()
        cal = daily.groupBy("series").agg(F.count(F.lit(1)).alias("_n")).select(
            "series", F.explode(F.sequence(b["lo"], b["hi"])).alias("datum"))
    else:
        raise ValueError(f"span must be 'series' or 'global', got {span!r}")
    out = cal.join(daily.select("series", "datum", "value"), ["series", "datum"], "left")
    v = F.col("value") if fill is None else F.coalesce("value", F.lit(float(fill)))
    return out.select("series", "datum", v.alias("value"))


def total_series(daily: DataFrame, name: str = TOTAL_SERIES) -> DataFrame:
    """Row total across series per day (missing series count as 0)."""
    return daily.groupBy("datum").agg(
        F.sum(F.coalesce("value", F.lit(0.0))).alias("value")
    ).select(F.lit(name).alias("series"), "datum", "value")


def all_targets(daily: DataFrame, name: str = TOTAL_SERIES) -> DataFrame:
    """Series plus their total as one more series."""
    return daily.select("series", "datum", "value").unionByName(total_series(daily, name))


def pivot_wide(daily: DataFrame, series: list[str]) -> DataFrame:
    """(series, datum, value) -> one row per datum, one column per series."""
    return daily.groupBy("datum").pivot("series", series).agg(F.sum("value"))


def unpivot_long(wide: DataFrame, series: list[str]) -> DataFrame:
    return wide.unpivot(["datum"], series, "series", "value").select("series", "datum", "value")


def future_dates(daily: DataFrame, days: int, as_of: Column | None = None) -> DataFrame:
    """N consecutive days after each series' last date (or after `as_of`)."""
    if days < 1:
        raise ValueError("days must be >= 1")
    b = daily.groupBy("series").agg(last_day().alias("last"))
    start = F.col("last") if as_of is None else as_of
    return b.select(
        "series",
        F.posexplode(F.sequence(F.date_add(start, 1), F.date_add(start, days))).alias("step0", "datum"),
    ).select("series", (F.col("step0") + 1).alias("step"), "datum")


def tail_n(daily: DataFrame, n: int, order_col: str = "datum") -> DataFrame:
    """Last N rows per series.  The rank filter lets Spark insert a partial
    window-group limit before the shuffle, so only N rows per series per
    input partition move."""
    w = Window.partitionBy("series").orderBy(F.col(order_col).desc())
    return daily.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def history_union_new(history: DataFrame, new: DataFrame) -> DataFrame:
    """UNION ALL by name; columns missing on one side become null."""
    return history.unionByName(new, allowMissingColumns=True)


def product_mix(daily: DataFrame, total_name: str = TOTAL_SERIES) -> DataFrame:
    """Share of each series in the total: mean(series) / mean(total per day).

    Means are over the days each frame has; for a dense grid that is
    sum(series) / sum(total) on the same calendar.
    """
    per = daily.groupBy("series").agg(F.avg("value").alias("mean_value"))
    tot_mean = total_series(daily, total_name).agg(F.avg("value")).scalar()
    return per.select("series", "mean_value",
                      F.try_divide(F.col("mean_value"), tot_mean).alias("share"))


def bucketed_window(dense: DataFrame, halo_days: int, compute: Callable[[DataFrame, Window], DataFrame],
                    bucket_days: int | None = DEFAULT_BUCKET_DAYS) -> DataFrame:
    """Run row-positional window logic on a dense daily grid in bounded pieces.

    Each row is assigned to its calendar bucket and, when it lies in the last
    `halo_days` days of that bucket, also to the next one.  `compute` gets the
    exploded frame and a window spec partitioned by (series, bucket) ordered
    by datum; afterwards only rows in their own bucket are kept.  On a dense
    grid every row still sees its `halo_days` predecessors, so results equal
    a window over the whole series.  bucket_days=None windows whole series.
    """
    if bucket_days is None:
        w = Window.partitionBy("series").orderBy("datum")
        return compute(dense, w)
    if halo_days > bucket_days:
        raise ValueError("halo_days must not exceed bucket_days")
    d = F.unix_date("datum")
    b = F.floor(d / bucket_days).cast("long")
    in_halo = (d - b * bucket_days) >= (bucket_days - halo_days)
    x = dense.withColumn("_own", b).withColumn(
        "_bkt", F.explode(F.when(in_halo, F.array(b, b + 1)).otherwise(F.array(b))))
    w = Window.partitionBy("series", "_bkt").orderBy("datum")
    out = compute(x, w)
    return out.where(F.col("_bkt") == F.col("_own")).drop("_bkt", "_own")
