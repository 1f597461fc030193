"""Forecasts: trend-based (set-based), summaries, and recursive model folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescast.functions import calendar as cal
from salescast.functions import columns as col
from salescast.operators.series import future_dates
from salescast.operators.serving import check_days
from salescast.operators.trends import as_of_date

# --- fixed values ---------------------------------------------------------------
LEVEL_DAYS = 30          # trailing window for the trend-based level
FALLBACK_LEVEL = 50.0    # level when a series has no recent rows
TREND_MODEL = "trend_based"
# -----------------------------------------------------------------------------


def trend_forecast(daily: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    """level(series) x seasonal(d) x weekend(d) for the N days after as_of.

    level = mean over datum >= as_of - 30, 50.0 when there is none.  The level
    is one aggregate per series joined onto the date spine on `series` -- it
    is computed once, not per forecast day.
    """
    check_days(days)
    a = as_of_date(daily, as_of)
    level = daily.where(F.col("datum") >= F.date_sub(a, LEVEL_DAYS)).groupBy("series").agg(
        F.avg("value").alias("level"))
    spine = future_dates(daily, days, as_of=a)
    pred = F.coalesce("level", F.lit(FALLBACK_LEVEL)) * cal.seasonal_factor("datum") * cal.weekend_factor("datum")
    return spine.join(level, "series", "left").select(
        "series", "datum", "step",
        col.round2(col.clamp_nonneg(pred)).alias("predicted_sales"),
        F.lit(TREND_MODEL).alias("model_used"))


def forecast_summary(fc: DataFrame, value_col: str = "predicted_sales") -> DataFrame:
    """Per series: mean forecast, 'up' if the last step exceeds the first,
    horizon length."""
    return fc.groupBy("series").agg(
        F.avg(value_col).alias("mean_forecast"),
        F.when(F.max_by(value_col, "step") > F.min_by(value_col, "step"), "up")
        .otherwise("down").alias("direction"),
        F.count(F.lit(1)).alias("horizon"))


# --- recursive forecasts as one Catalyst fold -------------------------------------

from dataclasses import dataclass, field  # noqa: E402

from pyspark.sql import Column  # noqa: E402

from salescast.functions.calendar import CALENDAR_FEATURES, calendar_columns  # noqa: E402
from salescast.operators.series import tail_n  # noqa: E402

BUFFER_DAYS = 30


@dataclass
class FoldModel:
    """A linear one-step model over rolling buffers.

    Buffers are indexed 0..P-1.  For buffer p: `lags[p]` {k: weight of the
    value k steps back}, `rolls[p]` {w: weight of the mean of the last w
    values}, `last_w[p]` weight of the buffer's last value, `mean_w[p]` weight
    of the buffer mean.  `calendar` weights the seven calendar features of the
    forecast day.
    After each step buffer p receives share[p] * prediction + hold[p] * its
    own last value.
    """
    intercept: float
    n_buffers: int = 1
    calendar: list = field(default_factory=lambda: [0.0] * 7)
    lags: list = field(default_factory=list)
    rolls: list = field(default_factory=list)
    last_w: list = field(default_factory=list)
    mean_w: list = field(default_factory=list)
    share: list = field(default_factory=list)
    hold: list = field(default_factory=list)
    feed_clamped: bool = False

    def _p(self, lst, p, default):
        return lst[p] if p < len(lst) else default


def _wt(w):
    """Weight as a Column (per-row coefficient) or None for a literal zero."""
    if isinstance(w, Column):
        return w
    return F.lit(float(w)) if w else None


def _mean(buf: Column) -> Column:
    return F.aggregate(buf, F.lit(0.0), lambda a, x: a + x) / F.size(buf)


def _tail_mean(buf: Column, w: int) -> Column:
    """Mean of the last w values; mean of all when fewer exist."""
    s = F.slice(buf, -w, w)
    return F.when(F.size(buf) >= w, F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / w).otherwise(_mean(buf))


def _lag(buf: Column, k: int) -> Column:
    return F.when(F.size(buf) >= k, F.element_at(buf, -k)).otherwise(_mean(buf))


def _push(buf: Column, x: Column, length: int) -> Column:
    c = F.concat(buf, F.array(x))
    return F.slice(c, F.greatest(F.size(c) - length + 1, F.lit(1)), F.lit(length))


def recursive_forecast(start: DataFrame, model: FoldModel, horizon: int = 30,
                       buffer_len: int = BUFFER_DAYS, model_name: str = "linear") -> DataFrame:
    """Roll `model` forward `horizon` days for every row of `start`.

    start: (series, last DATE, bufs ARRAY<ARRAY<DOUBLE>> oldest first
    [, adds ARRAY<DOUBLE>, model STRING]).  `adds` is added to the prediction:
    one number for every step, or one per step.  `model` names the row's model.
    The whole recursion is one `aggregate` over the step sequence -- a per-row
    fold, so rows (series) run in parallel and nothing is collected.  The prediction of a step is bound once (a
    one-element `transform`) and used for the output (clamped at 0) and the
    buffer feedback.  Output: (series, step, datum, predicted, model_used).
    """
    P = model.n_buffers
    longest = max((k for d in [*model.lags, *model.rolls] for k in d), default=0)
    if longest > buffer_len:
        raise ValueError(f"the model looks back {longest} days, its buffers hold {buffer_len}")
    adds = "adds" in start.columns

    def step(acc, i):
        bufs = acc["bufs"]
        d = F.date_add(F.col("last"), i)
        cal = calendar_columns(d)
        pred = _wt(model.intercept)
        pred = F.lit(0.0) if pred is None else pred

        def add(acc_expr, w, x):
            wc = _wt(w)
            return acc_expr if wc is None else acc_expr + wc * x

        for name, w in zip(CALENDAR_FEATURES, model.calendar):
            pred = add(pred, w, cal[name].cast("double"))
        for p in range(P):
            b = F.element_at(bufs, p + 1)
            for k, w in sorted(model._p(model.lags, p, {}).items()):
                pred = add(pred, w, _lag(b, k))
            for k, w in sorted(model._p(model.rolls, p, {}).items()):
                pred = add(pred, w, _tail_mean(b, k))
            pred = add(pred, model._p(model.last_w, p, 0.0), F.element_at(b, -1))
            pred = add(pred, model._p(model.mean_w, p, 0.0), _mean(b))
        if adds:
            pred = pred + F.element_at("adds", F.least(i, F.size("adds")))

        def advance(y):
            fb = F.greatest(F.lit(0.0), y) if model.feed_clamped else y
            new_bufs = []
            for p in range(P):
                b = F.element_at(bufs, p + 1)
                sh = _wt(model._p(model.share, p, 1.0 if P == 1 else 0.0))
                x = F.lit(0.0) if sh is None else sh * fb
                h = _wt(model._p(model.hold, p, 0.0))
                if h is not None:
                    x = x + h * F.element_at(b, -1)
                new_bufs.append(_push(b, x, buffer_len))
            return F.struct(F.array(*new_bufs).alias("bufs"),
                            F.concat(acc["out"], F.array(F.greatest(F.lit(0.0), y))).alias("out"))

        return F.element_at(F.transform(F.array(pred), advance), 1)

    init = F.struct(F.col("bufs").alias("bufs"),
                    F.array().cast("array<double>").alias("out"))
    steps = F.sequence(F.lit(1), F.lit(horizon))
    named = F.col("model") if "model" in start.columns else F.lit(model_name)
    folded = start.withColumn("_fc", F.aggregate(steps, init, step))
    return folded.select(
        "series", "last", named.alias("model_used"), F.posexplode("_fc.out").alias("step0", "predicted")
    ).select("series", (F.col("step0") + 1).alias("step"),
             F.date_add("last", F.col("step0") + 1).alias("datum"), "predicted", "model_used")


def start_buffers(daily: DataFrame, series: list[str], unit: str, length: int = BUFFER_DAYS) -> DataFrame:
    """One start row for `unit`: the last `length` values of each listed
    series as buffers and the last date.  There is one buffer per listed
    series, in list order; a series without rows has a buffer of zeros.  Only
    the tails (length rows per series) are gathered."""
    order = F.create_map(*[x for i, s in enumerate(series) for x in (F.lit(s), F.lit(i))])
    t = tail_n(daily.where(F.col("series").isin(series)), length)
    per = t.groupBy("series").agg(
        F.array_sort(F.collect_list(F.struct("datum", "value"))).alias("pts"),
        F.max("datum").alias("last"))
    per = per.select(F.element_at(order, F.col("series")).alias("i"), "last",
                     F.transform("pts", lambda x: x["value"]).alias("buf"))
    one = per.groupBy(F.lit(unit).alias("series")).agg(
        F.map_from_entries(F.collect_list(F.struct("i", "buf"))).alias("b"), F.max("last").alias("last"))
    slots = F.transform(F.array(*[F.lit(i) for i in range(len(series))]), lambda i: F.coalesce(
        F.try_element_at(F.col("b"), i), F.array_repeat(F.lit(0.0), length)))
    return one.select("series", "last", slots.alias("bufs"))


def own_buffers(daily: DataFrame, length: int = BUFFER_DAYS) -> DataFrame:
    """(series, last, buf): each series' last date and last `length` values, oldest first."""
    per = tail_n(daily, length).groupBy("series").agg(
        F.array_sort(F.collect_list(F.struct("datum", "value"))).alias("pts"), F.max("datum").alias("last"))
    return per.select("series", "last", F.transform("pts", lambda x: x["value"]).alias("buf"))


def univariate_start(daily: DataFrame, length: int = BUFFER_DAYS) -> DataFrame:
    """Start rows for per-series folds: each series' own last `length` values."""
    return own_buffers(daily, length).select("series", "last", F.array("buf").alias("bufs"))


def total_fold_model(intercept: float, weights: list[float], series: list[str], shares: list[float],
                     lags=(1, 3, 7, 14, 30), windows=(3, 7, 14, 30)) -> FoldModel:
    """Map raw-feature weights in training order (calendar, all lags, all
    rolling means) onto a FoldModel for the total forecast: each series
    buffer is fed back with share * (unclamped) prediction."""
    P, nl, nw = len(series), len(lags), len(windows)
    cal = list(weights[:7])
    lag_w = weights[7:7 + P * nl]
    roll_w = weights[7 + P * nl:7 + P * nl + P * nw]
    return FoldModel(
        intercept=intercept, n_buffers=P, calendar=cal,
        lags=[{k: lag_w[p * nl + j] for j, k in enumerate(lags)} for p in range(P)],
        rolls=[{w: roll_w[p * nw + j] for j, w in enumerate(windows)} for p in range(P)],
        share=list(shares), hold=[0.0] * P, feed_clamped=False)


def per_series_fold_model(lags=(1, 3, 7, 14, 30), windows=(3, 7, 14, 30),
                          feed_clamped: bool = True) -> FoldModel:
    """Univariate fold whose coefficients come from each row's `intercept`
    and `weights` (calendar, own lags, own rolling means) -- e.g. the output
    of models.per_series_ridge -- so every series runs its own model."""
    w = F.col("weights")
    nl = len(lags)
    return FoldModel(
        intercept=F.col("intercept"), n_buffers=1,
        calendar=[w[i] for i in range(7)],
        lags=[{k: w[7 + j] for j, k in enumerate(lags)}],
        rolls=[{k: w[7 + nl + j] for j, k in enumerate(windows)}],
        share=[1.0], feed_clamped=feed_clamped)


def product_fold_model(intercept: float, weights: list[float], target_idx: int, n_series: int,
                       lags=(1, 3, 7, 14, 30), windows=(3, 7, 14, 30)) -> FoldModel:
    """Single-product recursive forecast over all series buffers: the
    target's buffer gets the (unclamped) prediction, sibling buffers repeat
    their last value, and sibling value features use the buffer mean.
    Weights in training order: calendar, all lags, all rolling, siblings."""
    P, nl, nw = n_series, len(lags), len(windows)
    lag_w = weights[7:7 + P * nl]
    roll_w = weights[7 + P * nl:7 + P * nl + P * nw]
    sib_w = weights[7 + P * nl + P * nw:]
    sibs = [p for p in range(P) if p != target_idx]
    mean_w = [0.0] * P
    for j, p in enumerate(sibs):
        mean_w[p] = sib_w[j] if j < len(sib_w) else 0.0
    return FoldModel(
        intercept=intercept, n_buffers=P, calendar=list(weights[:7]),
        lags=[{k: lag_w[p * nl + j] for j, k in enumerate(lags)} for p in range(P)],
        rolls=[{w: roll_w[p * nw + j] for j, w in enumerate(windows)} for p in range(P)],
        mean_w=mean_w,
        share=[1.0 if p == target_idx else 0.0 for p in range(P)],
        hold=[0.0 if p == target_idx else 1.0 for p in range(P)], feed_clamped=False)


def recursive_forecast_pipeline(start: DataFrame, model, series: list[str], shares: list[float],
                                horizon: int = 30, lags=(1, 3, 7, 14, 30), windows=(3, 7, 14, 30),
                                checkpoint_every: int = 1, buffer_len: int = BUFFER_DAYS,
                                model_name: str = "model") -> DataFrame:
    """Recursive total forecast with any fitted pipeline (e.g. a tree model).

    A non-linear model cannot be folded into one expression, so this is a
    loop over horizon *steps* (not rows): each step derives the feature
    columns of every start row from its buffers, runs one distributed
    `transform` over all rows, and pushes share * prediction into each
    buffer.  Lineage is cut with a reliable `checkpoint()` (to the session's
    checkpoint folder) every `checkpoint_every` steps -- by default every
    step: the state is one small row per series, while an uncut chain lets
    each step's expressions be inlined into the next and grow with depth.
    """
    from salescast.session import checkpoint_dir
    checkpoint_dir(start.sparkSession)
    state = start.select("series", "last", "bufs", F.array().cast("array<double>").alias("out"),
                         F.lit(1).alias("_step"))
    P = len(series)
    # Feature and update expressions are built once (the step number is a
    # column), so each step only re-plans, it does not rebuild them.
    d = F.date_add(F.col("last"), F.col("_step"))
    cols = {k: v.cast("double") for k, v in calendar_columns(d).items()}
    for p, s in enumerate(series):
        b = F.element_at(F.col("bufs"), p + 1)
        for k in lags:
            cols[f"{s}_lag_{k}"] = _lag(b, k)
        for w in windows:
            cols[f"{s}_rolling_{w}"] = _tail_mean(b, w)
    y = F.col("prediction")
    new_bufs = F.array(*[_push(F.element_at(F.col("bufs"), p + 1), F.lit(float(shares[p])) * y, buffer_len)
                         for p in range(P)]).alias("bufs")
    new_out = F.concat(F.col("out"), F.array(F.greatest(F.lit(0.0), y))).alias("out")
    next_step = (F.col("_step") + 1).alias("_step")
    for i in range(1, horizon + 1):
        scored = model.transform(state.withColumns(cols))
        state = scored.select("series", "last", new_bufs, new_out, next_step)
        if checkpoint_every and i % checkpoint_every == 0 and i < horizon:
            state = state.checkpoint(eager=True)
    return state.select("series", "last", F.posexplode("out").alias("step0", "predicted")).select(
        "series", (F.col("step0") + 1).alias("step"), F.date_add("last", F.col("step0") + 1).alias("datum"),
        "predicted", F.lit(model_name).alias("model_used"))
