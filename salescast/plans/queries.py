"""Named queries over the driver's tables: binding -> operators -> output.

Each callable takes (spark, sf_dir) and returns a lazy DataFrame whose
columns match the oracle SQL of the same name.  Floats that are not exact
(standard deviations, slopes, trigonometry) are rounded to 6 places here,
at the output edge, never inside the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescast.operators import trends
from salescast.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _daily(spark, sf_dir):
    return tables.daily_sales(spark, sf_dir)


# --- scans and trends --------------------------------------------------------

@query
def scan_daily_sales(spark, sf_dir):
    return _daily(spark, sf_dir)


@query
def trend_seasonality(spark, sf_dir):
    t = trends.trend_seasonality(_daily(spark, sf_dir))
    return t.select("series", r6("trend_slope").alias("trend_slope"), "trend_direction",
                    r6("seasonal_strength").alias("seasonal_strength"),
                    "peak_month", "low_month", "n_months")


@query
def monthly_resample(spark, sf_dir):
    return trends.monthly_resample(_daily(spark, sf_dir))


@query
def seasonal_profile(spark, sf_dir):
    return trends.seasonal_profile(_daily(spark, sf_dir))


@query
def monthly_trends(spark, sf_dir):
    return trends.monthly_trends(_daily(spark, sf_dir))


@query
def weekly_pattern(spark, sf_dir):
    return trends.weekly_pattern(_daily(spark, sf_dir))


@query
def peak_low_day(spark, sf_dir):
    return trends.peak_low_day(_daily(spark, sf_dir))


@query
def trend_direction(spark, sf_dir):
    return trends.trend_direction(_daily(spark, sf_dir))


# --- shapes, calendar, features ----------------------------------------------

from salescast.functions.calendar import calendar_columns  # noqa: E402
from salescast.operators import features, series as ser  # noqa: E402


def _dense(spark, sf_dir):
    return ser.dense_grid(_daily(spark, sf_dir))


def series_list(codes: DataFrame) -> list[str]:
    """Distinct codes of a small dimension frame (column `series`), sorted,
    for wide layouts that need their column list up front."""
    return [r[0] for r in codes.select("series").distinct().orderBy("series").collect()]


def _series_domain(spark, sf_dir):
    """Series codes of the p_type binding, read from the part dimension (a
    small column scan) rather than from the rolled-up facts."""
    return series_list(tables.read_table(spark, sf_dir, "part", "p_type")
                       .where(F.col("p_type").isNotNull()).select(F.col("p_type").alias("series")))


@query
def daily_sales_dense(spark, sf_dir):
    return _dense(spark, sf_dir)


@query
def total_sales(spark, sf_dir):
    return ser.total_series(_daily(spark, sf_dir))


@query
def all_targets(spark, sf_dir):
    return ser.all_targets(_daily(spark, sf_dir))


@query
def pivot_daily(spark, sf_dir):
    d = _daily(spark, sf_dir)
    return ser.pivot_wide(d, _series_domain(spark, sf_dir))


@query
def unpivot_roundtrip(spark, sf_dir):
    d = _daily(spark, sf_dir)
    s = _series_domain(spark, sf_dir)
    return ser.unpivot_long(ser.pivot_wide(d, s), s).where(F.col("value").isNotNull())


@query
def calendar_features(spark, sf_dir):
    t = ser.total_series(_daily(spark, sf_dir))
    return t.select("datum").withColumns(calendar_columns("datum"))


@query
def future_dates(spark, sf_dir):
    return ser.future_dates(_daily(spark, sf_dir), 30)


@query
def tail_n(spark, sf_dir):
    return ser.tail_n(_daily(spark, sf_dir), 30)


@query
def history_union_new(spark, sf_dir):
    d = _daily(spark, sf_dir)
    a = trends.as_of_date(d)
    hist = d.where(F.col("datum") <= F.date_sub(a, 30))
    new = d.where(F.col("datum") > F.date_sub(a, 30)).withColumn("source", F.lit("new"))
    return ser.history_union_new(hist, new)


@query
def product_mix(spark, sf_dir):
    return ser.product_mix(_daily(spark, sf_dir))


@query
def lag_features(spark, sf_dir):
    return features.lag_rolling(_dense(spark, sf_dir), windows=[])


@query
def rolling_features(spark, sf_dir):
    return features.lag_rolling(_dense(spark, sf_dir), lags=[])


@query
def feature_matrix(spark, sf_dir):
    d = _daily(spark, sf_dir)
    return features.feature_matrix(ser.dense_grid(d, span="global"), _series_domain(spark, sf_dir))


ASOF_BLOCK = 1024  # rows of a series that one window task holds


@query
def score_features_asof(spark, sf_dir):
    dense = _dense(spark, sf_dir)
    a = trends.as_of_date(dense)
    hist = dense.where(F.col("datum") <= F.date_sub(a, 7))
    pts = dense.where(F.col("datum") > F.date_sub(a, 7))
    return features.features_asof(hist, pts, block_rows=ASOF_BLOCK)


@query
def time_split(spark, sf_dir):
    return features.time_split(_dense(spark, sf_dir), dense=True)


@query
def time_split_panel(spark, sf_dir):
    return features.time_split_panel(_dense(spark, sf_dir))


@query
def time_folds(spark, sf_dir):
    return features.time_folds(_dense(spark, sf_dir), dense=True)


# --- anomalies, store read paths, catalog -------------------------------------

from salescast.operators import anomaly, forecast, metrics, serving  # noqa: E402
from salescast.sources import ingest  # noqa: E402


def _targets(spark, sf_dir):
    return ser.all_targets(_daily(spark, sf_dir))


def _store(spark, sf_dir):
    """Deterministic store view: dense history scored by the same-weekday
    naive model, ingest time = the day itself."""
    s = serving.naive_predictions(_dense(spark, sf_dir), 7)
    return s.select("series", "datum", "value", "predicted",
                    F.lit("history").alias("source"),
                    F.col("datum").cast("timestamp").alias("ingest_ts"))


def _registry(spark, sf_dir):
    """The registry of a store with one fitted model per series: trained, saved and read back."""
    root = scratch_path(spark, "models")
    models.save_coefficients(_series_coefs(spark, sf_dir), root, "Ridge")
    return models.load_coefficients(spark, root).select("target")


def _catalog_dim(spark, sf_dir):
    dim = tables.part_catalog(spark, sf_dir).select("code")
    return dim.withColumn("name", F.concat(F.initcap(F.lower("code")), F.lit(" product line (part type "),
                                           F.col("code"), F.lit(")")))


@query
def anomaly_baseline(spark, sf_dir):
    b = anomaly.anomaly_baseline(_targets(spark, sf_dir))
    return b.select("series", "n", "mean_sales", r6("std_sales").alias("std_sales"), "usable")


@query
def anomaly_alerts(spark, sf_dir):
    a = anomaly.anomaly_alerts(_targets(spark, sf_dir), with_message=False)
    return a.select("series", "datum", "value", "n", "baseline_mean",
                    r6("baseline_std").alias("baseline_std"), "alert_type", "severity")


@query
def recent_alerts(spark, sf_dir):
    al = anomaly.alerts_table(anomaly.anomaly_alerts(_targets(spark, sf_dir)))
    return serving.recent_alerts(al, days=7).select("ts", "series", "datum", "alert_type", "severity")


@query
def latest_alerts(spark, sf_dir):
    al = anomaly.alerts_table(anomaly.anomaly_alerts(_targets(spark, sf_dir)))
    return serving.latest_alerts(al, n=20).select("ts", "series", "datum", "alert_type", "severity")


@query
def recent_data(spark, sf_dir):
    return serving.recent_rows(_store(spark, sf_dir), days=7).select("series", "datum", "value", "predicted")


@query
def store_status(spark, sf_dir):
    return serving.store_status(_store(spark, sf_dir))


@query
def latest_predictions(spark, sf_dir):
    return serving.latest_rows(_store(spark, sf_dir), 10).select(
        "series", "datum", "value", "predicted", "ingest_ts")


@query
def actual_vs_predicted(spark, sf_dir):
    d = _daily(spark, sf_dir)
    preds = serving.naive_predictions(_dense(spark, sf_dir), 7)
    return serving.actual_vs_predicted(d, preds, 30)


@query
def actual_vs_predicted_range(spark, sf_dir):
    d = _daily(spark, sf_dir)
    preds = serving.naive_predictions(_dense(spark, sf_dir), 7)
    pairs = d.select("series", "datum", F.col("value").alias("actual")).join(
        preds.select("series", "datum", "predicted"), ["series", "datum"])
    return serving.prediction_range(pairs.where(F.col("predicted") > 0))


@query
def backfill_predictions(spark, sf_dir):
    store = _store(spark, sf_dir)
    means = store.groupBy("series").agg(F.round(F.avg("value"), 2).alias("new_pred"))

    def scorer(rows):
        return rows.join(means, "series")

    return serving.backfill_predictions(store, scorer, limit=50).select(
        "series", "datum", "value", "predicted")


@query
def product_catalog(spark, sf_dir):
    return serving.product_catalog(_catalog_dim(spark, sf_dir), _registry(spark, sf_dir))


@query
def products_with_models(spark, sf_dir):
    return serving.products_with_models(_catalog_dim(spark, sf_dir), _registry(spark, sf_dir))


@query
def catalog_summary(spark, sf_dir):
    return serving.catalog_summary(
        serving.product_catalog(_catalog_dim(spark, sf_dir), _registry(spark, sf_dir)))


# --- forecasts, metrics -------------------------------------------------------

@query
def trend_forecast(spark, sf_dir):
    return forecast.trend_forecast(_targets(spark, sf_dir), days=30)


@query
def forecast_summary(spark, sf_dir):
    s = forecast.forecast_summary(forecast.trend_forecast(_targets(spark, sf_dir), days=30))
    return s.select("series", r6("mean_forecast").alias("mean_forecast"), "direction", "horizon")


@query
def forecast_metrics(spark, sf_dir):
    dense = _dense(spark, sf_dir)
    f = features.lag_rolling(dense, lags=[1, 7], windows=[7])
    sp = features.time_split(f, dense=True).where(F.col("split") == "test")
    long = sp.select("series", "datum", F.col("value").alias("actual"),
                     F.expr("stack(3, 'naive_lag1', lag_1, 'naive_lag7', lag_7, 'mean_7', rolling_7)")
                     .alias("model", "predicted"))
    m = metrics.regression_metrics(long)
    return m.select("series", "model", "n", r6("mae").alias("mae"), r6("rmse").alias("rmse"),
                    r6("r2").alias("r2"))


@query
def standardize(spark, sf_dir):
    sp = features.time_split(_dense(spark, sf_dir), dense=True)
    z = metrics.standardize(sp, ["value"])
    return z.select("series", "datum", "value", "split", r6("value_z").alias("value_z"))


# --- ingest payloads ------------------------------------------------------------

def _event_payloads(spark, sf_dir):
    ed = tables.events_daily(spark, sf_dir).withColumn("value", F.round("value", 2))
    return ingest.payloads_from_daily(ed)


def _event_products(spark, sf_dir):
    return tables.read_table(spark, sf_dir, "events", "event_type").select(
        F.col("event_type").alias("code")).distinct()


@query
def ingest_validate(spark, sf_dir):
    """Good payloads and, of each day, one with each kind of fault."""
    good = _event_payloads(spark, sf_dir)
    day, sales = (F.get_json_object("value", x) for x in ("$.datum", "$.sales"))
    bad = good.select(F.explode(F.array(
        F.format_string("not json %s", day),
        F.format_string('{"sales":%s}', sales),
        F.format_string('{"datum":"%s noon","sales":%s}', day, sales),
        F.format_string('{"datum":"%s"}', day))).alias("value"))
    v = ingest.parse_payloads(good.union(bad))
    return v.select("datum", F.when(F.col("sales").isNotNull(), F.size("sales")).alias("n_products"), "reason")


@query
def ingest_explode(spark, sf_dir):
    valid, _ = ingest.split_valid(ingest.parse_payloads(_event_payloads(spark, sf_dir)))
    return ingest.explode_payloads(valid, series_list(_event_products(spark, sf_dir)
                                                      .withColumnRenamed("code", "series")))


@query
def ingest_unknown_codes(spark, sf_dir):
    """Entries whose code the product dimension lacks: here it lacks the first event type."""
    codes = _event_products(spark, sf_dir)
    known = codes.where(F.col("code") > codes.agg(F.min("code")).scalar())
    u = ingest.unknown_codes(ingest.parse_payloads(_event_payloads(spark, sf_dir)), known)
    return u.select("datum", "code", "value")


@query
def records_json(spark, sf_dir):
    return ingest.records_json(_daily(spark, sf_dir).select("series", "datum", "value"))


# --- models and recursive forecasts ---------------------------------------------

from salescast.functions.calendar import CALENDAR_FEATURES  # noqa: E402
from salescast.operators import linear, models, registry, targets  # noqa: E402
from salescast.schemas import TOTAL_SERIES  # noqa: E402
from salescast.session import scratch_path  # noqa: E402

SERIES_FEATURES = CALENDAR_FEATURES + features.lag_names() + features.rolling_names()

# --- fixed values: coefficients of the fixed-model queries ------------------------
# recursive_forecast: 2 - 3*IsWeekend + 0.5*lag_1 + 0.2*lag_7 + 0.1*rolling_3
FIXED_FOLD = {"intercept": 2.0, "is_weekend": -3.0, "lags": {1: 0.5, 7: 0.2}, "rolls": {3: 0.1}}
# recursive_forecast_total: 5 - 2*IsWeekend + the sum over all series of 0.3*lag_1 + 0.2*lag_7 + 0.1*rolling_3
FIXED_TOTAL = {"intercept": 5.0, "is_weekend": -2.0, "lags": {1: 0.3, 7: 0.2}, "rolls": {3: 0.1}}
# recursive_forecast_sibling: 2 - IsWeekend + 0.4*lag_1 + 0.2*lag_7 + 0.2*rolling_7 of the series itself
# + 0.05*lag_1 + 0.02 * the level of each sibling
FIXED_SIBLING = {"intercept": 2.0, "is_weekend": -1.0, "lags": {1: 0.4, 7: 0.2}, "rolls": {7: 0.2},
                 "sibling_lag_1": 0.05, "sibling_value": 0.02}
# score_new_points: 1 + 0.3*lag_1 + 0.3*lag_7 + 0.2*rolling_7 + 0.1*rolling_30
FIXED_SCORER = {"intercept": 1.0, "features": ["lag_1", "lag_7", "rolling_7", "rolling_30"],
                "weights": [0.3, 0.3, 0.2, 0.1]}
# -----------------------------------------------------------------------------


LINEAR_SPECS = [s for s in models.DEFAULT_SPECS if s.kind in models.LINEAR]
REGISTRY_SPECS = [s for s in models.DEFAULT_SPECS if s.kind in models.LINEAR or s.name == "GradientBoosting"]


def _series_training(spark, sf_dir):
    """Per-series training frame: own calendar, lags and rolling means on the
    dense grid, warm-up rows dropped, last-fold holdout split."""
    f = features.lag_rolling(_dense(spark, sf_dir)).withColumns(calendar_columns("datum"))
    keep = F.lit(True)
    for c in SERIES_FEATURES:
        keep = keep & F.col(c).isNotNull()
    return features.time_split(f.where(keep), dense=True)


def _series_coefs(spark, sf_dir):
    return models.per_series_ridge(_series_training(spark, sf_dir), SERIES_FEATURES, "value", alpha=1.0)


def _total_matrix(spark, sf_dir, target="Total_Sales"):
    d = _daily(spark, sf_dir)
    s = _series_domain(spark, sf_dir)
    fm = features.feature_matrix(ser.dense_grid(d, span="global"), s, target=target)
    return features.time_split(fm.withColumn("series", F.lit(target)), dense=True), s


@query
def recursive_forecast(spark, sf_dir):
    c = FIXED_FOLD
    m = forecast.FoldModel(intercept=c["intercept"], calendar=[0, 0, 0, 0, 0, 0, c["is_weekend"]],
                           lags=[c["lags"]], rolls=[c["rolls"]], share=[1.0], feed_clamped=True)
    fc = forecast.recursive_forecast(forecast.univariate_start(_dense(spark, sf_dir)), m, 30,
                                     model_name="fixed_linear")
    return fc.select("series", "step", "datum", r6("predicted").alias("predicted"), "model_used")


@query
def recursive_forecast_total(spark, sf_dir):
    """Total forecast over the buffers of all series; each step's prediction goes back into every buffer by
    its series' share of the warmed-up days' total."""
    s = _series_domain(spark, sf_dir)
    g = ser.dense_grid(_daily(spark, sf_dir), span="global")
    first = g.agg(ser.first_day().alias("d")).scalar()
    mix = ser.product_mix(g.where(F.col("datum") >= F.date_add(first, max(features.LAGS))))
    shares = mix.agg(F.map_from_entries(F.collect_list(F.struct("series", "share"))).alias("m")).scalar()
    start = forecast.start_buffers(g, s, "Total_Sales").withColumn("mix", shares).withColumn("shares", F.array(
        *[F.coalesce(F.try_element_at("mix", F.lit(x)), F.lit(0.0)) for x in s]))
    c = FIXED_TOTAL
    m = forecast.FoldModel(intercept=c["intercept"], n_buffers=len(s), calendar=[0, 0, 0, 0, 0, 0, c["is_weekend"]],
                           lags=[c["lags"]] * len(s), rolls=[c["rolls"]] * len(s),
                           share=[F.element_at("shares", p + 1) for p in range(len(s))])
    fc = forecast.recursive_forecast(start, m, 30, model_name="fixed_linear")
    return fc.select("series", "step", "datum", r6("predicted").alias("predicted"), "model_used")


@query
def recursive_forecast_sibling(spark, sf_dir):
    """Every product's forecast (R2): its own buffer takes the predictions, its siblings' buffers repeat their
    last value, and a sibling's value feature is its buffer's mean."""
    g = ser.dense_grid(_daily(spark, sf_dir), span="global")
    c = FIXED_SIBLING
    own = F.array(*[F.lit(c["lags"].get(k, 0.0)) for k in features.LAGS])
    other = F.array(*[F.lit(c["sibling_lag_1"] if k == 1 else 0.0) for k in features.LAGS])
    rolls = F.array(*[F.lit(c["rolls"].get(k, 0.0)) for k in features.WINDOWS])
    none, i = F.transform(rolls, lambda x: F.lit(0.0)), F.col("series")
    names = g.agg(F.array_sort(F.collect_set("series"))).scalar()
    coefs = g.select("series").distinct().withColumn("names", names).select(
        "series", F.lit("fixed_linear").alias("model"), F.lit(c["intercept"]).alias("intercept"),
        F.concat(F.array(*[F.lit(0.0)] * 6, F.lit(c["is_weekend"])),
                 F.flatten(F.transform("names", lambda x: F.when(x == i, own).otherwise(other))),
                 F.flatten(F.transform("names", lambda x: F.when(x == i, rolls).otherwise(none))),
                 F.transform("names", lambda x: F.when(x == i, 0.0).otherwise(c["sibling_value"]))).alias("weights"))
    fc = forecast.recursive_forecast(targets.sibling_start(g, coefs), targets.fold_model(feed_clamped=False), 30)
    return fc.select("series", "step", "datum", r6("predicted").alias("predicted"), "model_used")


@query
def score_new_points(spark, sf_dir):
    dense = _dense(spark, sf_dir)
    a = trends.as_of_date(dense)
    pts = features.features_asof(dense.where(F.col("datum") <= F.date_sub(a, 7)),
                                 dense.where(F.col("datum") > F.date_sub(a, 7)))
    c = FIXED_SCORER
    coefs = dense.select("series").distinct().select(
        "series", F.lit(c["intercept"]).alias("intercept"),
        F.array(*[F.lit(w) for w in c["weights"]]).alias("weights"))
    s = models.score_linear(pts, coefs, c["features"], out="raw_pred")
    return s.select("series", "datum", "value",
                    F.round(F.greatest(F.lit(0.0), F.col("raw_pred")), 2).alias("predicted"))


@query
def per_series_ridge(spark, sf_dir):
    tr = _series_training(spark, sf_dir)
    coefs = models.per_series_ridge(tr, SERIES_FEATURES, "value", alpha=1.0)
    scored = models.score_linear(tr.where(F.col("split") == "test"), coefs, SERIES_FEATURES)
    m = metrics.regression_metrics(scored.select(
        "series", F.lit("ridge").alias("model"), F.col("value").alias("actual"), "predicted"))
    return m.select("series", "model", "n", r6("mae").alias("mae"), r6("rmse").alias("rmse"),
                    r6("r2").alias("r2"))


def _series_folds(spark, sf_dir):
    """Per-series panel: own calendar, lags and rolling means on the dense grid, complete rows, expanding folds."""
    f = features.lag_rolling(_dense(spark, sf_dir)).withColumns(calendar_columns("datum"))
    return features.time_folds(f.where(linear.complete(linear.vector(SERIES_FEATURES))), dense=True)


@query
def cross_validation(spark, sf_dir):
    """Metrics of every fold of the expanding split, all folds of all series from one pass of statistics."""
    p = _series_folds(spark, sf_dir)
    specs = [models.ModelSpec(n, "ridge", {"alpha": 0.0, "features": [f]})
             for n, f in (("Lag1", "lag_1"), ("Lag7", "lag_7"), ("Mean7", "rolling_7"))]
    coefs = linear.fit_series(linear.series_moments(p, SERIES_FEATURES), SERIES_FEATURES, specs)
    m = linear.cross_validate(p, coefs, SERIES_FEATURES)
    return m.select("series", "model", "fold", "n", r6("mae").alias("mae"), r6("rmse").alias("rmse"), r6("r2").alias("r2"))


@query
def linear_optimality(spark, sf_dir):
    """How far each weight of each series' ridge and elastic net is from its condition of optimality, measured on
    the training rows: 0 up to rounding."""
    p = _series_folds(spark, sf_dir)
    coefs = linear.fit_series(linear.series_moments(p, SERIES_FEATURES), SERIES_FEATURES, LINEAR_SPECS, [linear.HOLDOUT])
    l1 = F.lit(0.0)
    for s in LINEAR_SPECS:
        if s.kind == "elasticnet":
            l1 = F.when(F.col("model") == s.name, s.params["alpha"] * s.params["l1_ratio"]).otherwise(l1)
    g, w = F.col("gradient"), F.col("weight")
    off = F.when(w == 0, F.greatest(F.abs(g) - l1, F.lit(0.0))).otherwise(F.abs(g + l1 * F.signum(w)))
    return linear.stationarity(p, coefs, SERIES_FEATURES, LINEAR_SPECS).select(
        "series", "model", "feature", r6(off).alias("violation"))


def _vectors(spark, sf_dir):
    return linear.day_vectors(ser.dense_grid(_daily(spark, sf_dir), span="global"))


@query
def target_ridge(spark, sf_dir):
    """Holdout metrics of every target's ridge (each product and the total, siblings included), from one matrix."""
    v = _vectors(spark, sf_dir)
    m = linear.target_metrics(v, linear.fit_targets(v, LINEAR_SPECS[:1], [linear.HOLDOUT]))
    return m.select("series", "model", "n", r6("mae").alias("mae"), r6("rmse").alias("rmse"), r6("r2").alias("r2"))


def _best_targets(spark, sf_dir):
    """The coefficients of every target's best linear model on the holdout."""
    v = _vectors(spark, sf_dir)
    coefs = linear.fit_targets(v, LINEAR_SPECS, [linear.HOLDOUT])
    return coefs.join(linear.best_models(linear.target_metrics(v, coefs)), ["series", "model"], "left_semi")


@query
def forecast_product(spark, sf_dir):
    """Forecast of every product and the total by its best linear model, siblings constant (R3)."""
    g = ser.dense_grid(_daily(spark, sf_dir), span="global")
    start = targets.constant_start(g, _best_targets(spark, sf_dir))
    fc = forecast.recursive_forecast(start, targets.fold_model(feed_clamped=True), 30)
    return fc.select("series", "step", "datum", F.round("predicted", 2).alias("predicted"), "model_used")


@query
def forecast_product_summary(spark, sf_dir):
    s = forecast.forecast_summary(forecast_product(spark, sf_dir), "predicted")
    return s.select("series", r6("mean_forecast").alias("mean_forecast"), "direction", "horizon")


@query
def score_recent(spark, sf_dir):
    tr = _series_training(spark, sf_dir)
    recent = ser.tail_n(tr, 30)
    s = models.score_linear(recent, _series_coefs(spark, sf_dir), SERIES_FEATURES)
    return s.select("series", "datum", F.col("value").alias("actual"),
                    F.round(F.greatest(F.lit(0.0), F.col("predicted")), 2).alias("predicted"))


@query
def recursive_forecast_product(spark, sf_dir):
    """Every product's forecast by a ridge of its own over the features of all products (R2)."""
    g = ser.dense_grid(_daily(spark, sf_dir), span="global")
    coefs = linear.fit_targets(linear.day_vectors(g), LINEAR_SPECS[:1], [linear.HOLDOUT]) \
        .where(F.col("series") != TOTAL_SERIES)
    fc = forecast.recursive_forecast(targets.sibling_start(g, coefs), targets.fold_model(feed_clamped=False), 30)
    return fc.select("series", "step", "datum", r6("predicted").alias("predicted"), "model_used")


def _all_models(spark, sf_dir, specs):
    """Fits every spec for every target, each tree kind in one fit over all targets; the root of their registry."""
    f = features.lag_rolling(ser.all_targets(_dense(spark, sf_dir))).withColumns(calendar_columns("datum"))
    p = features.time_folds(f.where(linear.complete(linear.vector(SERIES_FEATURES))), dense=True)
    fitted, coefs, metrics = registry.train_all(p, specs)
    root = scratch_path(spark, "models")
    registry.save_linear(coefs, metrics, SERIES_FEATURES, root)
    registry.save_pipelines(fitted, metrics, root)
    return root


@query
def model_leaderboard(spark, sf_dir):
    """Holdout metrics of every model kind for every target, and each target's best."""
    reg = registry.load(spark, _all_models(spark, sf_dir, models.DEFAULT_SPECS))
    best = registry.best(reg).select("target", F.col("model").alias("best_model"))
    return reg.join(best, "target").select(
        "target", "model", "n", r6("mae").alias("mae"), r6("rmse").alias("rmse"), r6("r2").alias("r2"),
        (F.col("model") == F.col("best_model")).alias("is_best"))


@query
def forecast_best_model(spark, sf_dir):
    """Recursive forecast of every target by the best of ridge, elastic net and default boosting, in one loop of steps."""
    best = registry.best(registry.load(spark, _all_models(spark, sf_dir, REGISTRY_SPECS)))
    buffers = forecast.own_buffers(ser.all_targets(_dense(spark, sf_dir)))
    return registry.forecast_best(buffers, best, 30)


@query
def feature_importance(spark, sf_dir):
    fm, s = _total_matrix(spark, sf_dir)
    cols = features.feature_columns(s)
    spec = [x for x in models.DEFAULT_SPECS if x.kind == "forest"]
    res = models.train_models(fm, cols, "Total_Sales", specs=spec)
    return models.feature_importance(spark, res.models[spec[0].name], cols, 10)


@query
def model_registry(spark, sf_dir):
    """The total's models of all kinds over the features of all products as saved and read back: pipelines, which must
    score the holdout as they did before, registry rows and metrics JSON."""
    fm, s = _total_matrix(spark, sf_dir)
    root = scratch_path(spark, "models")
    fm.write.parquet(f"{root}/_matrix")  # the same rows for both scorings
    fm = spark.read.schema(fm.schema).parquet(f"{root}/_matrix")
    res = models.train_models(fm, features.feature_columns(s), "Total_Sales")
    models.save_models(spark, res, root)
    reg = models.load_registry(spark, root)
    models.check_loaded(res, fm, models.load_models(reg))
    met = models.read_metrics_json(spark, root).select("target", "model", r6("rmse").alias("rmse"))
    return reg.select("target", "model", "is_best").join(met, ["target", "model"])


@query
def predictions_long(spark, sf_dir):
    """Forecasts of two models (trend-based for every target, the fixed
    linear fold per series) unioned long, appended to the predictions store
    and read back."""
    tf = forecast.trend_forecast(_targets(spark, sf_dir), days=30).select(
        "series", "datum", F.col("predicted_sales").alias("predicted"), "model_used")
    rf = recursive_forecast(spark, sf_dir).select("series", "datum", "predicted", "model_used")
    u = tf.unionByName(rf).select(F.col("datum").alias("prediction_date"),
                                  F.col("series").alias("target_product"),
                                  F.col("predicted").alias("predicted_value"), "model_used",
                                  F.col("datum").cast("timestamp").alias("ts"))
    root = scratch_path(spark, "store")
    store_io.append_predictions(u, root)
    return store_io.read_table(spark, root, "predictions").select(
        "prediction_date", "target_product", "predicted_value", "model_used")


# --- streaming ----------------------------------------------------------------

from salescast.streaming import alerts as stream_alerts  # noqa: E402
from salescast.streaming import pipeline as stream  # noqa: E402


def _stream_fixture(spark, sf_dir):
    """Payload files from the events table, one file per week of days, in one
    write: the (one a day) payloads pass one task in date order, so the files'
    times, by which the file source replays them, are in order too."""
    root = scratch_path(spark, "stream")
    in_dir = f"{root}/incoming"
    ed = tables.events_daily(spark, sf_dir).withColumn("value", F.round("value", 2))
    pay = ingest.payloads_from_daily(ed).withColumn(
        "wk", F.floor(F.unix_date(F.to_date(F.get_json_object("value", "$.datum"))) / 7))
    pay.repartition(1).sortWithinPartitions("wk", "value").write.partitionBy("wk").text(in_dir)
    return root, in_dir


def _fixed_predictor(history, batch_facts):
    """Score each batch day from the rows before it (history and earlier
    days of the batch) with the fixed linear scorer."""
    c = FIXED_SCORER
    # a series' first day has nothing before it: its features count as 0
    pts = features.features_asof(history, batch_facts).fillna(0.0, c["features"])
    coefs = batch_facts.select("series").distinct().select(
        "series", F.lit(c["intercept"]).alias("intercept"),
        F.array(*[F.lit(w) for w in c["weights"]]).alias("weights"))
    s = models.score_linear(pts, coefs, c["features"], out="raw_pred")
    return s.select(F.col("datum").alias("prediction_date"), F.col("series").alias("target_product"),
                    F.greatest(F.lit(0.0), F.col("raw_pred")).alias("predicted_value"),
                    F.lit("fixed_linear").alias("model_used"))


STREAM_FEATURES = ["lag_1", "lag_7", "rolling_7"]


def _event_facts(spark, sf_dir):
    """What the payload stream stores: every type on every day, and the day's total."""
    valid, _ = ingest.split_valid(ingest.parse_payloads(_event_payloads(spark, sf_dir)))
    codes = series_list(_event_products(spark, sf_dir).withColumnRenamed("code", "series"))
    return ser.all_targets(ingest.explode_payloads(valid, codes))


def _stream_registry(spark, sf_dir, root):
    """Three regressions for each target on the features of the days before, fitted, measured and saved."""
    f = features.lag_rolling(_event_facts(spark, sf_dir), [1, 7], [7], include_current=False)
    p = features.time_folds(f.where(linear.complete(linear.vector(STREAM_FEATURES))), dense=True)
    specs = [models.ModelSpec(n, "ridge", {"alpha": 0.0, "features": [x]})
             for n, x in (("Lag1", "lag_1"), ("Lag7", "lag_7"), ("Mean7", "rolling_7"))]
    coefs = linear.fit_series(linear.series_moments(p, STREAM_FEATURES), STREAM_FEATURES, specs, [linear.HOLDOUT])
    m = linear.cross_validate(p, coefs, STREAM_FEATURES, fold=linear.HOLDOUT)
    registry.save_linear(coefs, m, STREAM_FEATURES, root)


def _run_stream_process(spark, sf_dir, scored=False):
    root, in_dir = _stream_fixture(spark, sf_dir)
    prods = _event_products(spark, sf_dir)
    codes = series_list(prods.withColumnRenamed("code", "series"))
    scorer = None
    if scored:
        _stream_registry(spark, sf_dir, f"{root}/models")
        scorer = registry.BestModelScorer(spark, f"{root}/models")
    proc = stream.BatchProcessor(f"{root}/store", prods, codes, predictor=_fixed_predictor, scorer=scorer)
    q = stream.run_ingest(spark, f"{in_dir}/*", f"{root}/store", f"{root}/_ckpt", proc,
                          max_files_per_trigger=1)
    q.awaitTermination()
    return root


@query
def stream_process(spark, sf_dir):
    """Streamed facts, each scored by its target's best registered model."""
    root = _run_stream_process(spark, sf_dir, scored=True)
    f = stream.read_facts(spark, f"{root}/store")
    return f.select("series", "datum", r6("value").alias("value"), "predicted")


@query
def stream_anomaly(spark, sf_dir):
    root = _run_stream_process(spark, sf_dir)
    a = store_io.read_table(spark, f"{root}/store", "alerts")
    return a.select("series", "datum", r6("value").alias("value"), "n",
                    r6("baseline_mean").alias("baseline_mean"), r6("baseline_std").alias("baseline_std"),
                    "alert_type", "severity")


@query
def stream_anomaly_state(spark, sf_dir):
    """The same alerts from keyed state: no read of the fact store."""
    root, in_dir = _stream_fixture(spark, sf_dir)
    codes = series_list(_event_products(spark, sf_dir).withColumnRenamed("code", "series"))
    valid, _ = ingest.split_valid(ingest.parse_payloads(stream.payload_stream(spark, f"{in_dir}/*", 1)))
    facts = ingest.explode_with_total(valid, codes, TOTAL_SERIES)
    stream_alerts.write_alerts(stream_alerts.alert_stream(facts), f"{root}/alerts", f"{root}/_ckpt").awaitTermination()
    a = stream_alerts.read_alerts(spark, f"{root}/alerts")
    return a.select("series", "datum", r6("value").alias("value"), "n", r6("baseline_mean").alias("baseline_mean"),
                    r6("baseline_std").alias("baseline_std"), "alert_type", "severity")


@query
def stream_predictions(spark, sf_dir):
    root = _run_stream_process(spark, sf_dir)
    p = store_io.read_table(spark, f"{root}/store", "predictions")
    return p.select("prediction_date", "target_product", r6("predicted_value").alias("predicted_value"),
                    "model_used")


@query
def stream_daily_rollup(spark, sf_dir):
    root = scratch_path(spark, "rollup")
    src = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(src).schema
    # The file source takes a table of one file only by way of a glob; this one also matches a directory of part files.
    ev = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src[:-1]}[{src[-1]}]")
    q = stream.write_rollup(stream.daily_rollup_stream(ev), f"{root}/out", f"{root}/_ckpt", "complete")
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.select("series", "datum", r6("value").alias("value"), "n_events")


# --- report and store round trips ---------------------------------------------

from salescast.operators import report  # noqa: E402
from salescast.sources import store as store_io  # noqa: E402


@query
def analysis_report(spark, sf_dir):
    d = _daily(spark, sf_dir)
    t = ser.all_targets(d)
    rep = report.analysis_report(d, trends.trend_seasonality(t),
                                 forecast.trend_forecast(t, days=30), forecast_col="predicted_sales")
    return rep.select("n_records", "first_date", "last_date", "products",
                      r6("trend_slope").alias("trend_slope"), "trend_direction",
                      r6("seasonal_strength").alias("seasonal_strength"), "peak_month", "low_month",
                      r6("forecast_mean").alias("forecast_mean"), "forecast_days")


@query
def store_roundtrip(spark, sf_dir):
    root = scratch_path(spark, "store")
    store_io.init_store(spark, root)
    store_io.append_facts(_store(spark, sf_dir), root)
    back = store_io.read_table(spark, root, "sales_data")
    return back.select("series", "datum", "value", "predicted", "source", "ingest_ts", "month")


@query
def backfill_store(spark, sf_dir):
    root = scratch_path(spark, "store")
    store_io.append_facts(_store(spark, sf_dir), root)
    st = store_io.read_table(spark, root, "sales_data")
    means = st.groupBy("series").agg(F.round(F.avg("value"), 2).alias("new_pred"))
    filled = serving.backfill_predictions(st, lambda rows: rows.join(means, "series"), limit=50)
    touched = serving.tail_n(serving.needs_prediction(st), 50).select("month").distinct()
    # rewrite only the month partitions that received a prediction
    store_io.overwrite_months(filled.join(touched, "month", "left_semi").drop("month"), root)
    back = store_io.read_table(spark, root, "sales_data")
    return back.select("series", "datum", "value", "predicted")


@query
def recursive_forecast_tree(spark, sf_dir):
    """Total forecast with a tree model: step loop + periodic checkpoints."""
    d = _daily(spark, sf_dir)
    fm, s = _total_matrix(spark, sf_dir)
    cols = features.feature_columns(s)
    spec = [x for x in models.DEFAULT_SPECS if x.kind == "forest"]
    res = models.train_models(fm, cols, "Total_Sales", specs=spec)
    g = ser.dense_grid(d, span="global")
    shares = {r["series"]: r["share"] for r in ser.product_mix(g).collect()}
    start = forecast.start_buffers(g, s, "Total_Sales")
    return forecast.recursive_forecast_pipeline(start, res.models[spec[0].name], s, [shares[x] for x in s],
                                                30, model_name=spec[0].name)
