"""Linear models from co-moments, against NumPy on the rows themselves."""
import os
import random

import numpy as np
import pytest
from conftest import WIDE_FILE, consecutive, daily_df
from pyspark.sql import functions as F

from salescast.operators import features, forecast, linear, models, registry, series as ser, targets
from salescast.schemas import TOTAL_SERIES

RIDGE = models.ModelSpec("Ridge", "ridge", {"alpha": 1.0})
NET = models.ModelSpec("ElasticNet", "elasticnet", {"alpha": 0.3, "l1_ratio": 0.5})
OLS = models.ModelSpec("One", "ridge", {"alpha": 0.0, "features": ["x1"]})
COLS = ["x1", "x2", "x3"]


def rows(spark, level=0.0, seed=1, n=120):
    rnd = random.Random(seed)
    out = []
    for s in ("A", "B"):
        for i in range(n):
            x1, x2 = rnd.gauss(0, 1), rnd.gauss(3, 2)
            out.append((s, i, level + x1, level + x2, 7.0, level + 2 * x1 - x2 + rnd.gauss(0, 0.5),
                        None if i < 20 else (i - 20) // 20))
    out.append(("A", n, None, 1.0, 7.0, 1.0, 4))  # an incomplete row counts nowhere
    return spark.createDataFrame(out, "series string, i int, x1 double, x2 double, x3 double, value double, test_fold int")


def by_numpy(p, spec):
    x, y = p[COLS].to_numpy(), p["value"].to_numpy()
    mu, sd, n = x.mean(0), x.std(0), len(y)
    z = (x - mu) / np.where(sd > 0, sd, 1.0)
    use = [COLS.index(c) for c in spec.params.get("features", COLS) if sd[COLS.index(c)] > 0]
    z, yc = z[:, use], y - y.mean()
    if spec.kind == "ridge":
        w = np.linalg.lstsq(np.vstack([z, np.sqrt(spec.params["alpha"]) * np.eye(len(use))]),
                            np.r_[yc, np.zeros(len(use))], rcond=None)[0]
    else:  # proximal gradient, unlike the library's coordinate descent
        a, rho, w = spec.params["alpha"], spec.params["l1_ratio"], np.zeros(len(use))
        step = 1 / (np.linalg.eigvalsh(z.T @ z / n).max() + a * (1 - rho))
        for _ in range(20_000):
            g = w - step * (z.T @ (z @ w - yc) / n + a * (1 - rho) * w)
            w = np.sign(g) * np.maximum(np.abs(g) - step * a * rho, 0)
    full = np.zeros(3)
    full[use] = w / sd[use]
    return y.mean() - full @ mu, full


@pytest.mark.parametrize("level", [0.0, 1e9])
def test_every_fold_equals_a_fit_on_its_rows(spark, level):
    df = rows(spark, level).repartition(5)
    specs = [RIDGE, NET, OLS]
    got = {(r.series, r.model, r.fold): r for r in
           linear.fit_series(linear.series_moments(df, COLS), COLS, specs).collect()}
    assert len(got) == 2 * 3 * 6
    p = df.toPandas().dropna(subset=["x1"])
    for (s, m, fold), r in got.items():
        mine = p[(p.series == s) & (p.test_fold.isna() | (p.test_fold < fold))]
        b, w = by_numpy(mine, next(x for x in specs if x.name == m))
        assert r.n_train == len(mine) and np.allclose(r.weights, w, rtol=1e-5, atol=1e-6)
        x = mine[COLS].to_numpy()
        assert np.allclose(r.intercept + x @ np.array(r.weights), b + x @ w, rtol=1e-12 if level else 1e-6, atol=1e-5)


def test_a_level_of_1e9_costs_the_ridge_no_digits(spark):
    low, high = (models.per_series_ridge(rows(spark, x).na.drop(subset=["x1"]), COLS, split_col=None)
                 .orderBy("series").collect() for x in (0.0, 1e9))
    for a, b in zip(low, high):
        assert np.allclose(a.weights, b.weights, rtol=1e-6)


def test_constant_and_missing_series(spark):
    one = spark.createDataFrame([("C", 1.0, 2.0, 5.0, None)] * 4 + [("D", 1.0, 2.0, 5.0, 4)],
                                "series string, x1 double, x2 double, value double, test_fold int")
    got = linear.fit_series(linear.series_moments(one, ["x1", "x2"]), ["x1", "x2"], [RIDGE, NET]).collect()
    assert all(r.weights == [0.0, 0.0] and r.intercept == 5.0 for r in got)
    assert {r.series for r in got if r.fold == linear.HOLDOUT} == {"C"}  # D has only test rows
    none = one.limit(0)
    assert linear.fit_series(linear.series_moments(none, ["x1"]), ["x1"], [RIDGE]).count() == 0


def test_metrics_per_fold_equal_a_loop_over_folds(spark):
    df = rows(spark)
    coefs = linear.fit_series(linear.series_moments(df, COLS), COLS, [RIDGE])
    got = {(r.series, r.fold): r for r in linear.cross_validate(df, coefs, COLS).collect()}
    p = df.toPandas().dropna(subset=["x1"])
    assert len(got) == 10
    for (s, fold), r in got.items():
        mine = p[p.series == s]
        b, w = by_numpy(mine[mine.test_fold.isna() | (mine.test_fold < fold)], RIDGE)
        t = mine[mine.test_fold == fold]
        e = t.value - (b + t[COLS].to_numpy() @ w)
        assert r.n == len(t) and abs(r.mae - e.abs().mean()) < 1e-9 and abs(r.rmse - (e ** 2).mean() ** 0.5) < 1e-9


def panel(spark, n=150, names=("A", "B", "C")):
    rnd = random.Random(3)
    days = [r for s in names for r in consecutive(s, "2021-01-01", [float(rnd.randint(5, 60)) for _ in range(n)])]
    return ser.dense_grid(daily_df(spark, days), span="global")


def test_day_vectors_hold_the_feature_matrix(spark):
    g, names = panel(spark), ["A", "B", "C"]
    v = {r.datum: r for r in linear.day_vectors(g).collect()}
    fm = features.feature_matrix(g, names).collect()
    assert len(v) == len(fm)
    cols = features.feature_columns(names)
    for r in fm:
        z = v[r.datum].z
        assert v[r.datum].names == names and np.allclose(z[:len(cols)], [r[c] for c in cols]) and z[-1] == r[TOTAL_SERIES]


def test_plans_do_not_grow_with_the_series(spark):
    size = [len(linear.day_vectors(panel(spark, 60, [f"s{i}" for i in range(k)]))._jdf.queryExecution().optimizedPlan()
                .toString().splitlines()) for k in (2, 30)]
    assert size[0] == size[1]


def test_targets_equal_a_ridge_on_the_wide_matrix(spark):
    g, names = panel(spark), ["A", "B", "C"]
    v = linear.day_vectors(g)
    got = {r.series: r for r in linear.fit_targets(v, [RIDGE], [linear.HOLDOUT]).collect()}
    met = {r.series: r for r in linear.target_metrics(v, linear.fit_targets(v, [RIDGE])).collect()}
    assert set(got) == set(met) == {*names, TOTAL_SERIES}
    for t in ("B", TOTAL_SERIES):
        cols = features.feature_columns(names, t)
        fm = features.time_split(features.feature_matrix(g, names, t).withColumn("series", F.lit(t)), dense=True).toPandas()
        x, y, train = fm[cols].to_numpy(float), fm[t].to_numpy(), (fm.split == "train").to_numpy()
        mu, sd = x[train].mean(0), x[train].std(0)
        z = (x - mu) / np.where(sd > 0, sd, 1)
        w = np.linalg.solve(z[train].T @ z[train] + np.eye(len(cols)), z[train].T @ (y[train] - y[train].mean()))
        e = (y - y[train].mean() - z @ w)[~train]
        assert met[t].n == len(e) and abs(met[t].mae - np.abs(e).mean()) < 1e-8
        assert abs(met[t].rmse - (e ** 2).mean() ** 0.5) < 1e-8
        mine = [u for i, u in enumerate(got[t].weights) if i < 34 or (t == "B" and names[i - 34] != t)]
        assert np.allclose(mine, np.where(sd > 0, w / np.where(sd > 0, sd, 1), 0), atol=1e-9)


def by_hand(g, coefs, horizon, constant):
    """The two recursions of targets.py, step by step on a pandas frame."""
    import datetime as dt
    wide = g.toPandas().pivot(index="datum", columns="series", values="value").sort_index()
    names, out = list(wide.columns), {}
    full = {n: wide[n].tolist() for n in names}
    lags, rolls = features.LAGS, features.WINDOWS

    def of(x):
        return [x[-k] for k in lags], [sum(x[-k:]) / k for k in rolls]

    past = {n: [of(full[n][:i])[0] + of(full[n][:i + 1])[1] for i in range(30, len(wide))] for n in names}
    for r in coefs:
        t, w, own = r.series, r.weights, dict(full)
        p = len(names)
        for n in names:
            own[n] = full[n][-30:]
        for i in range(horizon):
            day = wide.index[-1] + dt.timedelta(days=i + 1)
            cal = [day.year, day.month, day.weekday(), day.timetuple().tm_yday, day.isocalendar()[1], (day.month + 2) // 3,
                   int(day.weekday() > 4)]
            y = r.intercept + sum(a * b for a, b in zip(w, cal))
            for s, n in enumerate(names):
                a, b = of(own[n])
                if constant and n != t:
                    mean = np.mean(past[n], axis=0)
                    a, b = mean[:5], mean[5:]
                x = own[n][-1] if constant else sum(own[n]) / 30
                y += sum(u * v for u, v in zip(w[7 + s * 5:12 + s * 5], a))
                y += sum(u * v for u, v in zip(w[7 + p * 5 + s * 4:11 + p * 5 + s * 4], b))
                y += w[7 + p * 9 + s] * x if n != t else 0.0
            out[t, i + 1] = max(0.0, y)
            for n in names:
                own[n] = (own[n] + [(max(0.0, y) if constant else y) if n == t else own[n][-1]])[-30:]
    return out


@pytest.mark.parametrize("constant", [True, False])
def test_forecasts_of_all_targets_equal_a_loop(spark, constant):
    g = panel(spark)
    coefs = linear.fit_targets(linear.day_vectors(g), [RIDGE], [linear.HOLDOUT])
    coefs = coefs if constant else coefs.where(F.col("series") != TOTAL_SERIES)
    start = targets.constant_start(g, coefs) if constant else targets.sibling_start(g, coefs, 12)
    got = {(r.series, r.step): r.predicted for r in
           forecast.recursive_forecast(start, targets.fold_model(feed_clamped=constant), 12).collect()}
    want = by_hand(g, coefs.collect(), 12, constant)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


# registry and pooled models

def own_panel(spark):
    from salescast.functions.calendar import calendar_columns
    d = panel(spark, 130)
    f = features.lag_rolling(ser.all_targets(d)).withColumns(calendar_columns("datum"))
    return features.time_folds(f.where(linear.complete(linear.vector(registry.OWN_FEATURES))), dense=True)


def test_pooled_trees_and_scores_by_the_best_model(spark, tmp_path):
    p = own_panel(spark)
    specs = [RIDGE, models.ModelSpec("Forest", "forest", {"numTrees": 5, "maxDepth": 4, "seed": 1}),
             models.ModelSpec("Boost", "gbt", {"maxIter": 2, "maxDepth": 2, "seed": 1})]
    fitted, coefs, metrics = registry.train_all(p, specs)
    assert metrics.count() == 3 * 4 and metrics.where("n <> 16").count() == 0
    root = str(tmp_path / "m")
    registry.save_linear(coefs, metrics, registry.OWN_FEATURES, root)
    registry.save_pipelines(fitted, metrics, root)
    reg = registry.load(spark, root)
    assert reg.count() == 12
    # force one model of each kind to be somebody's best
    force = {"A": "Ridge", "B": "Forest", "C": "Boost"}
    best = reg.where(F.concat("target", "model").isin([a + b for a, b in force.items()]))
    rows = p.where("test_fold = 4")
    got = registry.score(rows, best).collect()
    assert len(got) == rows.count() and {(r.series, r.model_used) for r in got} == {*force.items(), (TOTAL_SERIES, None)}
    assert all(r.predicted == 0.0 for r in got if r.series == TOTAL_SERIES)
    for t, name in (("B", "Forest"), ("C", "Boost")):
        want = {r.datum: round(max(r.prediction, 0), 2) for r in fitted[name].transform(rows.where(F.col("series") == t)).collect()}
        assert all(abs(r.predicted - want[r.datum]) < 0.0051 for r in got if r.series == t)
    again = registry.best(registry.load(spark, root)).collect()
    top = {}
    for r in metrics.collect():
        top[r.series] = max(top.get(r.series, (-9e9, "")), (r.r2, r.model))
    assert {r.target: r.model for r in again} == {t: m for t, (_, m) in top.items()}


def test_recursive_forecast_by_models_of_every_kind(spark, tmp_path):
    import datetime as dt

    from salescast.functions.calendar import calendar_columns
    p = own_panel(spark)
    specs = [RIDGE, models.ModelSpec("Forest", "forest", {"numTrees": 4, "maxDepth": 3, "seed": 1})]
    fitted, coefs, metrics = registry.train_all(p, specs)
    root = str(tmp_path / "m")
    registry.save_linear(coefs, metrics, registry.OWN_FEATURES, root)
    registry.save_pipelines(fitted, metrics, root)
    kinds = {"A": "Ridge", "B": "Forest", TOTAL_SERIES: "Forest"}  # C has no model
    best = registry.load(spark, root).where(F.concat("target", "model").isin([a + b for a, b in kinds.items()]))
    daily = ser.all_targets(panel(spark, 130))
    got = registry.forecast_best(forecast.own_buffers(daily), best, 3).collect()
    assert {(r.series, r.model_used) for r in got} == set(kinds.items()) and len(got) == 9
    ridge = {r.series: r for r in coefs.collect()}
    for s, kind in kinds.items():
        x = [r.value for r in daily.where(F.col("series") == s).orderBy("datum").collect()]
        for step in (1, 2, 3):
            day = dt.date(2021, 1, 1) + dt.timedelta(days=len(x))
            row = spark.createDataFrame([(s, day, *[x[-k] for k in features.LAGS], *[sum(x[-k:]) / k for k in features.WINDOWS])],
                                        ["series", "datum", *features.lag_names(), *features.rolling_names()])
            row = row.withColumns(calendar_columns("datum"))
            if kind == "Ridge":
                y = ridge[s].intercept + sum(w * float(v) for w, v in zip(ridge[s].weights, row.select(*registry.OWN_FEATURES).first()))
            else:
                y = fitted[kind].transform(row).first().prediction
            x.append(max(0.0, y))
            mine = next(r for r in got if (r.series, r.step) == (s, step))
            assert mine.datum == day and abs(mine.predicted - x[-1]) < 1e-6


def test_the_latest_row_of_a_model_counts_and_missing_r2_comes_last(spark, tmp_path):
    root, c = str(tmp_path / "m"), "series string, model string, intercept double, weights array<double>"
    m = "series string, model string, n long, mae double, rmse double, r2 double"
    for b, r2 in ((1.0, 0.9), (2.0, None)):
        registry.save_linear(spark.createDataFrame([("A", "x", b, [0.0]), ("A", "y", b + 10, [0.0])], c),
                             spark.createDataFrame([("A", "x", 5, 1.0, 1.0, r2), ("A", "y", 5, 1.0, 1.0, 0.1)], m), ["lag_1"], root)
    got = registry.best(registry.load(spark, root)).collect()
    assert [(r.target, r.model, r.intercept) for r in got] == [("A", "y", 12.0)]


# the wide history file

def ridge_by_hand(wide, target, names):
    """Holdout MAE, RMSE and R^2 of a ridge on the features of the wide frame, with NumPy alone."""
    cal = np.array([[d.year, d.month, d.weekday(), d.timetuple().tm_yday, d.isocalendar()[1], (d.month + 2) // 3,
                     int(d.weekday() > 4)] for d in wide.index], float)
    cols = [wide[n].shift(k) for n in names for k in features.LAGS] + [wide[n].rolling(k).mean() for n in names for k in features.WINDOWS]
    x = np.column_stack([cal, *cols, *[wide[n] for n in names if n != target and target in names]])
    y = (wide[target] if target in names else wide[names].sum(axis=1)).to_numpy()
    x, y = x[30:], y[30:]
    cut = len(y) - len(y) // 6
    mu, sd = x[:cut].mean(0), x[:cut].std(0)
    z = (x - mu) / np.where(sd > 0, sd, 1)
    w = np.linalg.solve(z[:cut].T @ z[:cut] + np.eye(z.shape[1]), z[:cut].T @ (y[:cut] - y[:cut].mean()))
    e = (y - y[:cut].mean() - z @ w)[cut:]
    return np.abs(e).mean(), (e ** 2).mean() ** 0.5, 1 - (e ** 2).sum() / ((y[cut:] - y[cut:].mean()) ** 2).sum()


def test_every_target_from_a_generated_history_file(spark, tmp_path):
    import pandas as pd

    from salescast import schemas
    from salescast.sources import wide
    names, rng = schemas.WIDE_PRODUCTS, np.random.default_rng(7)
    days = pd.date_range("2016-11-20", periods=260)
    sales = pd.DataFrame(rng.gamma(3, 2, (260, 8)).round(2), index=days.date, columns=names)
    out = sales.reset_index(names="datum")
    out["datum"] = [f"{d.month}/{d.day}/{d.year}" for d in days]
    out["Year"], out["Month"], out["Hour"], out["Weekday Name"] = days.year, days.month, 248, days.day_name()
    path = tmp_path / "daily.csv"
    out.to_csv(path, index=False)
    long = wide.wide_to_long(wide.read_wide_history(spark, str(path)))
    v = linear.day_vectors(ser.dense_grid(long, span="global"))
    got = {r.series: r for r in linear.target_metrics(v, linear.fit_targets(v, [RIDGE], [linear.HOLDOUT])).collect()}
    assert len(got) == 9
    for t, r in got.items():
        assert np.allclose([r.mae, r.rmse, r.r2], ridge_by_hand(sales, t, names), atol=1e-7), t


# published: MAE, RMSE, R^2 of the ridge on the daily history file
GOLDEN = {"Total_Sales": (9.760, 13.537, 0.675), "M01AB": (1.494, 1.887, 0.570), "M01AE": (1.047, 1.336, 0.662),
          "N02BA": (1.146, 1.475, 0.454), "N02BE": (5.786, 7.759, 0.771), "N05B": (2.153, 2.778, 0.581),
          "N05C": (0.595, 0.805, 0.490), "R03": (3.714, 5.198, 0.589), "R06": (1.112, 1.486, 0.683)}


@pytest.mark.skipif(not WIDE_FILE or not os.path.exists(WIDE_FILE), reason="SALESCAST_WIDE_HISTORY not set")
def test_goldens_of_every_target(spark):
    from salescast.sources import wide
    long = wide.wide_to_long(wide.read_wide_history(spark, WIDE_FILE))
    v = linear.day_vectors(ser.dense_grid(long, span="global"))
    specs = [RIDGE, models.ModelSpec("ElasticNet", "elasticnet", {"alpha": 1.0, "l1_ratio": 0.5})]
    got = {(r.series, r.model): r for r in linear.target_metrics(v, linear.fit_targets(v, specs, [linear.HOLDOUT])).collect()}
    for t, want in GOLDEN.items():
        r = got[t, "Ridge"]
        assert np.allclose([r.mae, r.rmse, r.r2], want, atol=1e-3), (t, r)
    r = got["Total_Sales", "ElasticNet"]  # 11.57 / 16.09 / 0.541
    assert np.allclose([r.mae, r.rmse, r.r2], (11.568, 16.094, 0.541), atol=1e-2), r


def test_the_state_of_a_forecast_by_models_keeps_its_partitions(spark, tmp_path):
    p = own_panel(spark)
    forest = models.ModelSpec("Forest", "forest", {"numTrees": 2, "maxDepth": 2, "seed": 1})
    fitted, coefs, metrics = registry.train_all(p, [RIDGE, forest])
    root = str(tmp_path / "m")
    registry.save_linear(coefs, metrics, registry.OWN_FEATURES, root)
    registry.save_pipelines(fitted, metrics, root)
    best = registry.load(spark, root).where(F.concat("target", "model").isin(["ARidge", "BForest"]))
    buffers = forecast.own_buffers(ser.all_targets(panel(spark, 60)))
    for horizon in (1, 4):
        got = registry.forecast_best(buffers, best, horizon)
        assert got.rdd.getNumPartitions() == 1 and got.count() == 2 * horizon
