import os

import pytest
from conftest import WIDE_FILE, consecutive, daily_df
from pyspark.sql import functions as F

from salescast.operators import forecast


def _py_fold(buf, last, n, b, lag_w, roll_w, weekend_w, clamp_feed):
    import datetime as dt
    out = []
    buf = list(buf)
    for i in range(1, n + 1):
        day = last + dt.timedelta(days=i)
        x = b + weekend_w * (1.0 if day.weekday() >= 5 else 0.0)
        for k, w in sorted(lag_w.items()):
            x += w * (buf[-k] if len(buf) >= k else sum(buf) / len(buf))
        for k, w in sorted(roll_w.items()):
            x += w * (sum(buf[-k:]) / k if len(buf) >= k else sum(buf) / len(buf))
        out.append(max(0.0, x))
        buf = (buf + [max(0.0, x) if clamp_feed else x])[-30:]
    return out


def test_fold_matches_python_recursion(spark):
    vals = [float((i * 11) % 17) for i in range(40)]
    df = daily_df(spark, consecutive("A", "2022-03-01", vals))
    m = forecast.FoldModel(intercept=-4.0, calendar=[0, 0, 0, 0, 0, 0, 2.0], lags=[{1: 0.6, 7: 0.3}],
                           rolls=[{3: 0.2, 14: -0.1}], share=[1.0], feed_clamped=True)
    got = [r.predicted for r in forecast.recursive_forecast(forecast.univariate_start(df), m, 20)
           .orderBy("step").collect()]
    import datetime as dt
    exp = _py_fold(vals[-30:], dt.date(2022, 4, 9), 20, -4.0, {1: 0.6, 7: 0.3}, {3: 0.2, 14: -0.1}, 2.0, True)
    assert len(got) == 20
    for a, b in zip(got, exp):
        assert abs(a - b) < 1e-9


def test_fold_step_one_equals_plain_scoring(spark):
    vals = [float(i) for i in range(30)]
    df = daily_df(spark, consecutive("A", "2022-01-01", vals))
    m = forecast.FoldModel(intercept=1.0, lags=[{1: 0.5}], rolls=[{7: 0.25}], share=[1.0])
    r = forecast.recursive_forecast(forecast.univariate_start(df), m, 1).first()
    assert abs(r.predicted - (1.0 + 0.5 * 29 + 0.25 * sum(range(23, 30)) / 7)) < 1e-12


def test_short_history_uses_buffer_mean(spark):
    df = daily_df(spark, consecutive("A", "2022-01-01", [2.0, 4.0]))
    m = forecast.FoldModel(intercept=0.0, lags=[{7: 1.0}], share=[1.0])
    r = forecast.recursive_forecast(forecast.univariate_start(df), m, 1).first()
    assert r.predicted == 3.0


def test_trend_forecast_shape_and_rules(spark):
    df = daily_df(spark, consecutive("A", "2023-01-01", [10.0] * 40))
    fc = forecast.trend_forecast(df, days=7).orderBy("step").collect()
    assert [r.step for r in fc] == list(range(1, 8)) and all(r.model_used == "trend_based" for r in fc)
    import math
    for r in fc:
        doy = r.datum.timetuple().tm_yday
        exp = 10.0 * (1 + 0.1 * math.sin(2 * math.pi * doy / 365)) * (0.8 if r.datum.weekday() >= 5 else 1.0)
        assert abs(r.predicted_sales - round(exp, 2)) < 1e-9
    with pytest.raises(ValueError):
        forecast.trend_forecast(df, days=0)
    with pytest.raises(ValueError):
        forecast.trend_forecast(df, days=366)


def test_trend_forecast_fallback_level(spark):
    df = daily_df(spark, [("A", "2020-01-01", 5.0), ("B", "2023-01-01", 7.0)])
    fc = forecast.trend_forecast(df, days=1).where("series = 'A'").first()
    assert abs(fc.predicted_sales / 50.0 - 1) < 0.2


@pytest.mark.skipif(not WIDE_FILE or not os.path.exists(WIDE_FILE), reason="SALESCAST_WIDE_HISTORY not set")
def test_total_forecast_golden(spark):
    from salescast import schemas
    from salescast.operators import features, models, series as ser
    from salescast.sources import wide
    long = wide.wide_to_long(wide.read_wide_history(spark, WIDE_FILE))
    prods = schemas.WIDE_PRODUCTS
    fm = features.feature_matrix(ser.dense_grid(long, span="global"), prods)
    fm = features.time_split(fm.withColumn("series", F.lit("T")), dense=True)
    cols = features.feature_columns(prods)
    res = models.train_models(fm, cols, "Total_Sales",
                              specs=[s for s in models.DEFAULT_SPECS if s.kind in ("ridge", "elasticnet")])
    met = {r.model: r for r in res.metrics.collect()}
    assert abs(met["Ridge"].mae - 9.760) < 5e-3 and abs(met["Ridge"].rmse - 13.537) < 5e-3
    assert abs(met["Ridge"].r2 - 0.675) < 5e-3
    assert abs(met["ElasticNet"].rmse - 16.094) < 5e-3 and abs(met["ElasticNet"].r2 - 0.541) < 5e-3
    assert res.best == "Ridge"
    b, ws = models.linear_coefficients(res.models["Ridge"], cols)
    lo = fm.agg(F.min("datum")).first()[0]
    proc = long.where(F.col("datum") >= F.lit(lo))
    shares = {r.series: r.share for r in ser.product_mix(proc).collect()}
    fmod = forecast.total_fold_model(b, ws, prods, [shares[p] for p in prods])
    fc = [r.predicted for r in forecast.recursive_forecast(
        forecast.start_buffers(proc, prods, "Total_Sales"), fmod, 30).orderBy("step").collect()]
    assert abs(sum(fc) / 30 - 69.7438) < 1e-3
    assert abs(fc[0] - 71.0254) < 1e-3 and abs(fc[-1] - 67.0802) < 1e-3
    # trend goldens of the report on the feature-warmed frame
    from salescast.operators import trends
    tot = ser.total_series(proc)
    t = trends.trend_seasonality(tot).first()
    assert abs(t.trend_slope - (-0.8257)) < 1e-3 and abs(t.seasonal_strength - 0.1704) < 1e-3
    assert (t.peak_month, t.low_month) == (1, 7)


def test_start_buffers_have_one_slot_per_listed_series(spark):
    rows = consecutive("A", "2024-01-01", [1.0] * 40) + consecutive("C", "2024-01-01", [3.0] * 40)
    r = forecast.start_buffers(daily_df(spark, rows), ["A", "B", "C"], "T").first()
    assert [b[-1] for b in r.bufs] == [1.0, 0.0, 3.0] and [len(b) for b in r.bufs] == [30, 30, 30]


def test_model_that_looks_back_beyond_its_buffers_is_refused(spark):
    start = forecast.univariate_start(daily_df(spark, consecutive("A", "2024-01-01", [1.0] * 50)))
    with pytest.raises(ValueError, match="looks back 31"):
        forecast.recursive_forecast(start, forecast.FoldModel(intercept=0.0, lags=[{31: 1.0}]), 3)


def test_product_forecast_covers_every_product(spark):
    from conftest import SF001
    from salescast.plans.queries import QUERIES, _series_domain
    got = QUERIES["recursive_forecast_product"](spark, SF001).groupBy("series").count().collect()
    assert {r["series"]: r["count"] for r in got} == {x: 30 for x in _series_domain(spark, SF001)}


def test_tree_forecast_trains_the_library_forest(spark, monkeypatch):
    from conftest import SF001
    from salescast.operators import models
    from salescast.plans.queries import QUERIES

    class Seen(Exception):
        pass

    def train(fm, cols, target, specs):
        raise Seen(specs)

    monkeypatch.setattr(models, "train_models", train)
    with pytest.raises(Seen) as seen:
        QUERIES["recursive_forecast_tree"](spark, SF001)
    assert seen.value.args[0] == [x for x in models.DEFAULT_SPECS if x.kind == "forest"]
