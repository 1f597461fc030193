import random

import numpy as np
import pytest
from conftest import consecutive, daily_df
from pyspark.sql import functions as F

from salescast.operators import features, metrics, models

# the six kinds with few and shallow trees
SMALL_SPECS = [models.ModelSpec(s.name, s.kind, s.params | {
    "forest": {"numTrees": 20, "maxDepth": 6}, "gbt": {"maxIter": 5, "maxDepth": 3}}.get(s.kind, {}))
    for s in models.DEFAULT_SPECS]


def test_per_series_ridge_matches_numpy(spark):
    rnd = random.Random(1)
    rows = []
    for s in ("A", "B"):
        rows += [(s, i, rnd.random(), rnd.random() * 3, rnd.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "series string, i int, x1 double, x2 double, noise double") \
        .withColumn("value", 2.0 + 3.0 * F.col("x1") - 1.5 * F.col("x2") + F.col("noise"))
    coefs = {r.series: r for r in models.per_series_ridge(df, ["x1", "x2"], "value", 1.0, None).collect()}
    for s in ("A", "B"):
        p = df.where(F.col("series") == s).toPandas()
        X, y = p[["x1", "x2"]].to_numpy(), p["value"].to_numpy()
        mu, sd = X.mean(0), X.std(0)
        Z = (X - mu) / sd
        w = np.linalg.solve(Z.T @ Z + np.eye(2), Z.T @ (y - y.mean()))
        w_raw = w / sd
        b = y.mean() - w_raw @ mu
        assert np.allclose(coefs[s].weights, w_raw, atol=1e-8) and abs(coefs[s].intercept - b) < 1e-8


def test_regression_metrics(spark):
    df = spark.createDataFrame([("A", "m", 1.0, 2.0), ("A", "m", 3.0, 3.0), ("A", "m", 5.0, 4.0)],
                               "series string, model string, actual double, predicted double")
    r = metrics.regression_metrics(df).first()
    assert abs(r.mae - 2 / 3) < 1e-12 and abs(r.rmse - (2 / 3) ** 0.5) < 1e-12
    assert abs(r.r2 - (1 - 2 / 8)) < 1e-12


def test_standardize_uses_train_slice(spark):
    df = daily_df(spark, consecutive("A", "2020-01-01", [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]))
    sp = features.time_split(df, dense=True)
    z = {r.datum.day: r.value_z for r in metrics.standardize(sp, ["value"]).collect()}
    x = np.array([1, 2, 3, 4, 5.0])
    assert abs(z[1] - (1 - x.mean()) / x.std()) < 1e-12


def test_fast_leaderboard_and_registry(spark, tmp_path):
    rnd = random.Random(5)
    rows = consecutive("T", "2020-01-01", [float(50 + rnd.randint(-10, 10)) for _ in range(300)])
    dfl = daily_df(spark, rows).withColumn("series", F.lit("T"))
    f = features.lag_rolling(dfl).withColumns(
        {"dow": F.weekday("datum").cast("double")}).na.drop()
    cols = features.lag_names() + features.rolling_names() + ["dow"]
    fm = features.time_split(f, dense=True).withColumnRenamed("value", "y")
    res = models.train_models(fm, cols, "y", specs=SMALL_SPECS)
    names = {r.model for r in res.metrics.collect()}
    assert names == {s.name for s in SMALL_SPECS}
    reg = models.save_models(spark, res, str(tmp_path / "models"))
    assert reg.where("is_best").count() == 1
    back = models.load_registry(spark, str(tmp_path / "models"))
    assert back.count() == len(SMALL_SPECS)
    pm = models.load_model(back.where("is_best").first().path)
    assert pm.transform(fm.where("split = 'test'")).count() == fm.where("split = 'test'").count()
    imp = models.feature_importance(spark, res.models["RandomForest"], cols, 5)
    assert imp.count() == 5


def test_train_all_targets_parallel(spark):
    rnd = random.Random(9)
    frames = {}
    for t in ("T1", "T2"):
        rows = consecutive("X", "2020-01-01", [float(30 + rnd.randint(-5, 5)) for _ in range(200)])
        f = features.lag_rolling(daily_df(spark, rows)).na.drop()
        f = features.time_split(f, dense=True).withColumnRenamed("value", t)
        frames[t] = (f, features.lag_names() + features.rolling_names())
    lin = [s for s in SMALL_SPECS if s.kind in ("ridge", "elasticnet")]
    res = models.train_all_targets(frames, lin, parallelism=2)
    lb = models.leaderboard(res)
    assert lb.count() == 4 and lb.where("is_best").count() == 2


def test_metrics_match_regression_evaluator(spark):
    from pyspark.ml.evaluation import RegressionEvaluator
    rnd = random.Random(2)
    rows = [("A", "m", float(rnd.randint(0, 50)), float(rnd.randint(0, 50))) for _ in range(300)]
    df = spark.createDataFrame(rows, "series string, model string, actual double, predicted double")
    m = metrics.regression_metrics(df).first()
    for name, v in (("mae", m.mae), ("rmse", m.rmse), ("r2", m.r2)):
        ev = RegressionEvaluator(labelCol="actual", predictionCol="predicted", metricName=name)
        assert abs(ev.evaluate(df) - v) < 1e-9, name


def test_score_recent_with_pipeline_and_recent_predictions(spark, tmp_path):
    import datetime as dt

    from salescast.operators import report, serving, series as ser, trends
    rnd = random.Random(4)
    dfl = daily_df(spark, consecutive("T", "2020-01-01", [float(40 + rnd.randint(-9, 9)) for _ in range(200)]))
    f = features.lag_rolling(dfl).na.drop()
    fm = features.time_split(f, dense=True)
    cols = features.lag_names() + features.rolling_names()
    res = models.train_models(fm, cols, "value", specs=[models.ModelSpec("Ridge", "ridge", {"alpha": 1.0})])
    sc = models.score_recent(res.models["Ridge"], fm, 10)
    assert sc.count() == 10 and sc.where("predicted < 0").count() == 0
    preds = spark.createDataFrame(
        [(dt.datetime(2024, 1, d), dt.date(2024, 1, d), "T", 1.0, "m") for d in (1, 5, 9, 10)],
        "ts timestamp, prediction_date date, target_product string, predicted_value double, model_used string")
    assert [r.ts.day for r in serving.recent_predictions(preds, 7).collect()] == [10, 9, 5]
    rep = report.analysis_report(dfl, trends.trend_seasonality(ser.all_targets(dfl)))
    report.write_report(rep, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 7


def test_a_fit_has_the_partitions_its_rows_need(spark, monkeypatch):
    """Few rows that many shuffle partitions hold are fitted in one task a job; many rows keep several."""
    rnd = random.Random(2)
    rows = spark.createDataFrame([(i, rnd.random(), rnd.random()) for i in range(300)], "i int, x double, y double")
    spread = rows.repartition(40).persist()
    try:
        assert spread.rdd.getNumPartitions() == 40
        assert models.in_partitions(spread, 2).rdd.getNumPartitions() == 1
        assert sorted(models.in_partitions(spread, 2).collect()) == sorted(rows.collect())
        monkeypatch.setattr(models, "TRAINING_VALUES", 100)
        assert models.in_partitions(spread, 2).rdd.getNumPartitions() == 6
        assert models.in_partitions(spread.where("i < 0"), 2).rdd.getNumPartitions() == 1
    finally:
        spread.unpersist()


def test_training_of_spread_rows_runs_few_tasks(spark):
    rnd = random.Random(3)
    rows = daily_df(spark, consecutive("A", "2020-01-01", [rnd.random() for _ in range(120)]))
    fm = features.time_split(rows, dense=True).withColumn("x", F.dayofmonth("datum").cast("double")).repartition(30)
    spark.sparkContext.setJobGroup("few-tasks", "")
    try:
        res = models.train_models(fm, ["x"], "value", SMALL_SPECS[1:2])
        tracker = spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("few-tasks")]
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    stages = [tracker.getStageInfo(s) for j in jobs for s in j.stageIds]
    assert res.best == "GBTDeep" and len(jobs) > 10
    assert sum(s.numTasks >= 30 for s in stages if s) < len(jobs) / 2


def test_model_registry_saves_every_kind_and_reads_all_back(spark, tmp_path, monkeypatch):
    """All six kinds are in the registry, and each saved pipeline is read back and scores the holdout again."""
    from salescast.plans import queries
    rnd = random.Random(6)
    fm = daily_df(spark, consecutive("Total_Sales", "2020-01-01", [float(rnd.randint(0, 50)) for _ in range(150)])) \
        .withColumn("x", F.col("value") % 7).withColumnRenamed("value", "Total_Sales")
    fm = features.time_split(fm, dense=True)
    read, load = [], models.load_model
    monkeypatch.setattr(models, "DEFAULT_SPECS", SMALL_SPECS)
    monkeypatch.setattr(models, "load_model", lambda path: read.append(path) or load(path))
    monkeypatch.setattr(queries, "_total_matrix", lambda spark, sf_dir: (fm, ["A"]))
    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(queries.features, "feature_columns", lambda s: ["x"])
    rows = queries.model_registry(spark, "").collect()
    assert {r.model for r in rows} == {s.name for s in SMALL_SPECS} and sum(r.is_best for r in rows) == 1
    assert len(read) == len(SMALL_SPECS)
    best = min(rows, key=lambda r: (r.rmse, r.model))
    assert best.is_best

    # a pipeline that scores otherwise, or is missing, is an error
    res = models.train_models(fm, ["x"], "Total_Sales", SMALL_SPECS[-2:])
    swapped = dict(zip(res.models, reversed(list(res.models.values()))))
    models.check_loaded(res, fm, res.models)
    for wrong in (swapped, {}):
        with pytest.raises(ValueError, match="read back"):
            models.check_loaded(res, fm, wrong)
