"""Recursive forecasts of every target by a model of its own, in one plan.

A target's model (``linear.fit_targets``) weighs the features of all series, but only the target's own buffer
takes its predictions; what its siblings add is known beforehand:

* ``sibling_start``: siblings repeat their last value, so their lags and rolling means move through their last
  rows, and a sibling's value feature is the mean of those rows.  What they add differs by step.
* ``constant_start``: a sibling's lags and rolling means count with their historical mean and its value with
  its last one.  What they add is the same for every step.

Both are joins of (target, sibling) weights with (sibling, step) features, summed per target; then every
target's forecast is one fold over its own buffer, whatever the number of series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescast.functions.calendar import CALENDAR_FEATURES
from salescast.operators import features as feat
from salescast.operators.forecast import BUFFER_DAYS, FoldModel, own_buffers
from salescast.operators.linear import vector

N_CAL, N_LAGS, N_ROLLS = len(CALENDAR_FEATURES), len(feat.LAGS), len(feat.WINDOWS)


def _dot(w: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def sibling_weights(coefs: DataFrame, names: Column) -> DataFrame:
    """(series, model, sibling, w_lag, w_roll, w_value): a target's weights series by series, its own included."""
    w, p = F.col("weights"), F.size("names")
    x = coefs.withColumn("names", names).select("series", "model", "weights", "names", F.posexplode("names").alias("at", "sibling"))
    return x.select("series", "model", "sibling",
                    F.slice(w, N_CAL + 1 + F.col("at") * N_LAGS, N_LAGS).alias("w_lag"),
                    F.slice(w, N_CAL + 1 + p * N_LAGS + F.col("at") * N_ROLLS, N_ROLLS).alias("w_roll"),
                    F.get(w, N_CAL + p * (N_LAGS + N_ROLLS) + F.col("at")).alias("w_value"))


def fold_model(feed_clamped: bool) -> FoldModel:
    """The fold whose weights are the row's: w_cal, w_lag, w_roll and intercept; ``adds`` comes on top."""
    cal, lag, roll = F.col("w_cal"), F.col("w_lag"), F.col("w_roll")
    return FoldModel(intercept=F.col("intercept"), calendar=[cal[i] for i in range(N_CAL)],
                     lags=[{k: lag[j] for j, k in enumerate(feat.LAGS)}],
                     rolls=[{k: roll[j] for j, k in enumerate(feat.WINDOWS)}], share=[1.0], feed_clamped=feed_clamped)


def _start(coefs: DataFrame, parts: DataFrame, adds: DataFrame, buffers: DataFrame) -> DataFrame:
    """Start rows: own weights and buffer of each target; a target that is no series (the total) has neither."""
    own = parts.where("series = sibling").drop("sibling", "w_value")
    last = buffers.agg(F.max("last")).scalar()
    none = F.array(F.array_repeat(F.lit(0.0), BUFFER_DAYS))
    return coefs.select("series", "model", "intercept", F.slice("weights", 1, N_CAL).alias("w_cal")) \
        .join(adds, ["series", "model"], "left").join(own, ["series", "model"], "left") \
        .join(buffers.select("series", "buf"), "series", "left") \
        .select("series", "model", "intercept", "w_cal", last.alias("last"), F.coalesce("adds", F.array(F.lit(0.0))).alias("adds"),
                F.when(F.col("buf").isNull(), none).otherwise(F.array("buf")).alias("bufs"),
                F.coalesce("w_lag", F.array_repeat(F.lit(0.0), N_LAGS)).alias("w_lag"),
                F.coalesce("w_roll", F.array_repeat(F.lit(0.0), N_ROLLS)).alias("w_roll"))


def _names(buffers: DataFrame) -> Column:
    return buffers.agg(F.array_sort(F.collect_list("series"))).scalar()


def sibling_start(dense_global: DataFrame, coefs: DataFrame, horizon: int = 30) -> DataFrame:
    """Start rows of the forecast in which siblings repeat their last value (targets: the series)."""
    buffers = own_buffers(dense_global)
    parts = sibling_weights(coefs, _names(buffers))
    buf = F.col("buf")

    def moved(i: Column) -> Column:
        b = F.slice(F.concat(buf, F.array_repeat(F.element_at(buf, -1), i)), -BUFFER_DAYS, BUFFER_DAYS)

        def mean(x: Column, n: Column | int) -> Column:
            return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n

        return F.struct(F.array(*[F.element_at(b, -k) for k in feat.LAGS]).alias("lag"),
                        F.array(*[mean(F.slice(b, -k, k), k) for k in feat.WINDOWS]).alias("roll"),
                        mean(b, F.size(b)).alias("value"))

    steps = buffers.select(F.col("series").alias("sibling"), F.posexplode(
        F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), moved)).alias("step", "x"))
    added = parts.where("series <> sibling").join(steps, "sibling").groupBy("series", "model", "step").agg(F.sum(
        _dot(F.col("w_lag"), F.col("x.lag")) + _dot(F.col("w_roll"), F.col("x.roll")) + F.col("w_value") * F.col("x.value"))
        .alias("add"))
    adds = added.groupBy("series", "model").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "add"))),
                                                            lambda s: s["add"]).alias("adds"))
    return _start(coefs, parts, adds, buffers)


def constant_start(dense_global: DataFrame, coefs: DataFrame) -> DataFrame:
    """Start rows of the forecast with constant siblings (targets: the series and the total)."""
    buffers = own_buffers(dense_global)
    parts = sibling_weights(coefs, _names(buffers))
    f = feat.lag_rolling(dense_global)
    past = f.where(complete_row()).groupBy("series").agg(vector_mean(feat.lag_names()).alias("lag"),
                                                         vector_mean(feat.rolling_names()).alias("roll"))
    x = past.join(buffers, "series").select(F.col("series").alias("sibling"), "lag", "roll",
                                            F.element_at("buf", -1).alias("value"))
    adds = parts.where("series <> sibling").join(x, "sibling").groupBy("series", "model").agg(F.array(F.sum(
        _dot(F.col("w_lag"), F.col("lag")) + _dot(F.col("w_roll"), F.col("roll")) + F.col("w_value") * F.col("value")))
        .alias("adds"))
    return _start(coefs, parts, adds, buffers)


def complete_row() -> Column:
    z = vector(feat.lag_names() + feat.rolling_names())
    return F.forall(z, lambda v: v.isNotNull())


def vector_mean(cols: list[str]) -> Column:
    return F.array(*[F.avg(c) for c in cols])
