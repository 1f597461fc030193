import datetime as dt
import random


import pytest
from conftest import consecutive, daily_df
from pyspark.sql import functions as F

from salescast.operators import features, series as ser


def _rand_dense(spark, n_series=3, days=200, seed=7):
    rnd = random.Random(seed)
    rows = []
    for s in range(n_series):
        rows += consecutive(f"S{s}", "2019-12-01", [float(rnd.randint(0, 50)) for _ in range(days)])
    return daily_df(spark, rows)


def test_lags_and_rolling_match_pandas(spark):
    import pandas as pd
    df = _rand_dense(spark)
    got = features.lag_rolling(df, bucket_days=None).toPandas().sort_values(["series", "datum"])
    for s, g in got.groupby("series"):
        v = g["value"].reset_index(drop=True)
        for k in features.LAGS:
            pd.testing.assert_series_equal(g[f"lag_{k}"].reset_index(drop=True), v.shift(k), check_names=False)
        for w in features.WINDOWS:
            exp = v.rolling(w).mean()
            pd.testing.assert_series_equal(g[f"rolling_{w}"].reset_index(drop=True), exp, check_names=False)


def test_bucketed_window_equals_whole_series(spark):
    df = _rand_dense(spark, days=400)
    a = features.lag_rolling(df, bucket_days=None)
    b = features.lag_rolling(df, bucket_days=45)
    cols = ["series", "datum"] + features.lag_names() + features.rolling_names()
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0
    assert b.select(cols).exceptAll(a.select(cols)).count() == 0


def test_dense_grid_fills_missing_day(spark):
    df = daily_df(spark, [("A", "2020-01-01", 1.0), ("A", "2020-01-03", 2.0)])
    got = [(r.datum.day, r.value) for r in ser.dense_grid(df).orderBy("datum").collect()]
    assert got == [(1, 1.0), (2, 0.0), (3, 2.0)]


def test_time_split_is_exact_partition(spark):
    df = _rand_dense(spark, n_series=2, days=2076)
    sp = features.time_split(df, dense=True)
    c = {(r.series, r.split): r["count"] for r in sp.groupBy("series", "split").count().collect()}
    assert c[("S0", "train")] == 1730 and c[("S0", "test")] == 346
    # window form gives the same rows
    sp2 = features.time_split(df, dense=False)
    assert sp.exceptAll(sp2).count() == 0


def test_time_folds_match_expanding_split(spark):
    df = _rand_dense(spark, n_series=1, days=100)
    f = features.time_folds(df, dense=True)
    t = 100 // 6
    for i in range(5):
        tr, te = features.fold_frames(f, i)
        assert te.count() == t
        assert tr.count() == 100 - (5 - i) * t


def test_features_asof_short_history_uses_mean(spark):
    hist = daily_df(spark, consecutive("A", "2020-01-01", [2.0, 4.0]))
    pts = daily_df(spark, [("A", "2020-01-03", 9.0)])
    r = features.features_asof(hist, pts).first()
    assert r.lag_1 == 4.0 and r.lag_3 == 3.0 and r.rolling_3 == 3.0


def test_features_asof_counts_rows_across_gaps(spark):
    import datetime as dt
    hist = [("A", (dt.date(2024, 1, 1) + dt.timedelta(days=2 * i)).isoformat(), i) for i in range(60)]
    pts = daily_df(spark, [("A", "2024-09-01", 7.0)])
    r = features.features_asof(daily_df(spark, hist), pts).first()
    assert (r.lag_30, r.rolling_30, r.lag_1) == (30.0, 44.5, 59.0)


def test_r2_with_a_large_mean(spark):
    from salescast.operators.metrics import regression_metrics
    rows = [("A", "m", 1e9 + i % 2, 1e9 + 0.5) for i in range(10)]
    df = spark.createDataFrame(rows, "series string, model string, actual double, predicted double")
    assert abs(regression_metrics(df).first().r2) < 1e-6


def test_unpivot_pivot_roundtrip(spark):
    df = _rand_dense(spark, n_series=3, days=20)
    s = ["S0", "S1", "S2"]
    back = ser.unpivot_long(ser.pivot_wide(df, s), s)
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_feature_matrix_drops_warmup(spark):
    df = _rand_dense(spark, n_series=2, days=60)
    fm = features.feature_matrix(ser.dense_grid(df, span="global"), ["S0", "S1"])
    assert fm.count() == 30
    assert len(fm.columns) == 1 + 7 + 2 * 9 + 1
    assert fm.agg(F.min("datum")).first()[0].isoformat() == "2019-12-31"


def test_dense_grid_global_span_fills_both_ends(spark):
    df = daily_df(spark, [("A", "2020-01-03", 1.0), ("A", "2020-01-05", 2.0),
                          ("B", "2020-01-01", 3.0), ("B", "2020-01-02", 4.0)])
    got = sorted((r.series, r.datum.day, r.value) for r in ser.dense_grid(df, span="global").collect())
    assert got == [("A", 1, 0.0), ("A", 2, 0.0), ("A", 3, 1.0), ("A", 4, 0.0), ("A", 5, 2.0),
                   ("B", 1, 3.0), ("B", 2, 4.0), ("B", 3, 0.0), ("B", 4, 0.0), ("B", 5, 0.0)]


def test_unsold_product_is_a_zero_series(spark):
    d = daily_df(spark, consecutive("A", "2024-01-01", [float(i) for i in range(60)]))
    g = ser.dense_grid(d, span="global")
    fm = features.feature_matrix(g, ["A", "B"])
    assert fm.count() == 30
    assert fm.where("B_lag_30 = 0 and B_rolling_3 = 0 and A_lag_1 > 0").count() == 30
    assert features.feature_matrix(g, ["A", "B"], target="A").where("B = 0").count() == 30


def test_asof_in_blocks_of_rows_equals_whole_series(spark):
    import random
    rnd = random.Random(8)
    rows = [("A", i) for i in sorted(rnd.sample(range(3000), 400))] + [("B", i) for i in (1, 2, 2, 9)] + [("C", 5)]
    day = dt.date(2015, 1, 1)
    df = spark.createDataFrame([(s, day + dt.timedelta(days=i), float(rnd.randint(0, 99)), rnd.random() < 0.4) for s, i in rows],
                               "series string, datum date, value double, new boolean")
    h, p = df.where("not new").drop("new"), df.where("new").drop("new")
    want = sorted(map(tuple, features.features_asof(h, p).collect()))
    for block in (30, 64, 1000):
        got = sorted(map(tuple, features.features_asof(h, p, block_rows=block).collect()))
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert g[:3] == w[:3] and all((a is None and b is None) or abs(a - b) < 1e-9 for a, b in zip(g[3:], w[3:]))
    with pytest.raises(ValueError, match="look-back"):
        features.features_asof(h, p, block_rows=10)


def test_row_numbers(spark):
    rows = consecutive("A", "2019-11-01", range(900)) + consecutive("B", "2020-12-30", [3, 2, 1])
    got = features.row_numbers(daily_df(spark, rows), ["datum"]).orderBy("series", "datum").collect()
    assert [r._pos for r in got] == [*range(900), 0, 1, 2]
