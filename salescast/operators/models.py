"""Model training, comparison, persistence and scoring with MLlib.

* Linear models get a scaler stage (fit on the training slice only); tree
  models use raw features -- one `Pipeline` per model spec.
* All models of a target are scored in one grouped metrics aggregate.
* Ridge / ElasticNet penalties are mapped to MLlib's parametrization so a
  given `alpha` means the same as in the usual least-squares formulation
  (0.5/n * RSS vs RSS, and MLlib's internal label scaling).
* Linear models of many series or targets, all folds in one pass: operators.linear.
"""

from __future__ import annotations

import datetime as _dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescast import schemas
from salescast.operators import linear
from salescast.operators.metrics import regression_metrics

LINEAR = ("ridge", "elasticnet")


@dataclass(frozen=True)
class ModelSpec:
    name: str
    kind: str                      # ridge | elasticnet | forest | gbt
    params: dict = field(default_factory=dict)

    @property
    def scaled(self) -> bool:
        return self.kind in LINEAR


# --- fixed values: the compared model set ---------------------------------------
# Ridge(alpha=1), ElasticNet(alpha=1, l1_ratio=0.5), a 100-tree forest and
# three boosted-tree presets: library-default gradient boosting (100 x depth 3,
# step 0.1), a deep preset (depth 6, step 0.3) and a wide preset (depth 5,
# step 0.1) standing in for the two external boosting libraries.
DEFAULT_SPECS = [
    ModelSpec("RandomForest", "forest", {"numTrees": 100, "maxDepth": 10, "seed": 42}),
    ModelSpec("GBTDeep", "gbt", {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3, "seed": 42}),
    ModelSpec("GBTWide", "gbt", {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "seed": 42}),
    ModelSpec("GradientBoosting", "gbt", {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "seed": 42}),
    ModelSpec("Ridge", "ridge", {"alpha": 1.0}),
    ModelSpec("ElasticNet", "elasticnet", {"alpha": 1.0, "l1_ratio": 0.5}),
]
# -----------------------------------------------------------------------------


def _linear_estimator(spec: ModelSpec, n_train: int, y_std: float, features_col: str, label: str):
    """MLlib LinearRegression equivalent of Ridge / ElasticNet(alpha, rho).

    MLlib minimizes 1/(2n) RSS + lambda * (rho' |w|_1 + (1-rho')/2 |w|^2) and
    scales the L2 term by the label stddev internally.  Matching
    RSS + alpha |w|^2 (ridge) and 1/(2n) RSS + alpha rho |w|_1 +
    alpha (1-rho)/2 |w|^2 (elastic net) on pre-scaled features gives:
      ridge:      lambda = alpha * s / n,                rho' = 0
      elasticnet: lambda = alpha*rho + alpha*(1-rho)*s,  rho' = alpha*rho / lambda
    """
    alpha = float(spec.params.get("alpha", 1.0))
    s = float(y_std) if y_std and y_std > 0 else 1.0
    if spec.kind == "ridge":
        reg, en, solver = alpha * s / max(n_train, 1), 0.0, "normal"
    else:
        rho = float(spec.params.get("l1_ratio", 0.5))
        reg = alpha * rho + alpha * (1.0 - rho) * s
        en, solver = (alpha * rho / reg if reg > 0 else 0.0), "auto"
    return LinearRegression(featuresCol=features_col, labelCol=label, predictionCol="prediction",
                            regParam=reg, elasticNetParam=en, standardization=False,
                            solver=solver, maxIter=500, tol=1e-9)


def build_pipeline(spec: ModelSpec, feature_cols: list[str], label: str,
                   n_train: int = 1, y_std: float = 1.0) -> Pipeline:
    stages = [VectorAssembler(inputCols=feature_cols, outputCol="features_raw", handleInvalid="error")]
    if spec.scaled:
        stages.append(StandardScaler(inputCol="features_raw", outputCol="features",
                                     withMean=True, withStd=True))
        stages.append(_linear_estimator(spec, n_train, y_std, "features", label))
    elif spec.kind == "forest":
        p = {"featureSubsetStrategy": "all", **spec.params}
        stages.append(RandomForestRegressor(featuresCol="features_raw", labelCol=label, **p))
    elif spec.kind == "gbt":
        stages.append(GBTRegressor(featuresCol="features_raw", labelCol=label, **spec.params))
    else:
        raise ValueError(f"unknown model kind {spec.kind!r}")
    return Pipeline(stages=stages)


TRAINING_VALUES = 1 << 20  # of a partition of a training frame


def in_partitions(rows: DataFrame, columns: int) -> DataFrame:
    """Cached ``rows`` of so many ``columns`` in as many partitions as they need, however many shuffles made.

    A tree fit runs a job per level of every tree or group of nodes; each task holds, sends and returns statistics
    of all the nodes at hand.  So time, shuffle and results grow with the partitions, most of which are
    nearly empty where many facts roll up to few days.  Joins only neighbours, so nothing is shuffled again.
    """
    return rows.coalesce(max(1, -(-rows.count() * columns // TRAINING_VALUES)))


def fit_all(estimators: dict[str, Pipeline], train: DataFrame, parallelism: int = 4) -> dict[str, PipelineModel]:
    """Fits every estimator on the same cached rows, a few at once: a fit is many short jobs that wait for each other."""
    # each with local properties of its own
    fits = [inheritable_thread_target(train.sparkSession)(partial(e.fit, train)) for e in estimators.values()]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return dict(zip(estimators, pool.map(lambda fit: fit(), fits), strict=True))


@dataclass
class TrainResult:
    target: str
    models: dict[str, PipelineModel]
    metrics: DataFrame          # (target, model, n, mae, rmse, r2)
    predictions: DataFrame      # (target, model, datum, actual, predicted) on the holdout
    best: str
    feature_cols: list[str]


def train_models(fm: DataFrame, feature_cols: list[str], target: str,
                 specs: list[ModelSpec] | None = None, split_col: str = "split") -> TrainResult:
    """Fit every spec on the training rows, score the holdout, compare.

    `fm` holds the feature columns, the label column `target`, `datum` and a
    train/test `split` column (see features.time_split).  The assembled frame
    is persisted for the iterative fits and released afterwards.
    """
    specs = specs or DEFAULT_SPECS
    data = fm.select("datum", *feature_cols, F.col(target).cast("double").alias(target), split_col)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sized = in_partitions(data, len(feature_cols))
        train = sized.where(F.col(split_col) == "train")
        test = sized.where(F.col(split_col) == "test")
        st = train.agg(F.count(F.lit(1)), F.stddev_samp(target)).first()
        n_train, y_std = int(st[0]), float(st[1] or 0.0)
        models = fit_all({s.name: build_pipeline(s, feature_cols, target, n_train, y_std) for s in specs}, train)
        pred = holdout_predictions(models, test, target)
        rows = regression_metrics(pred, keys=("target", "model")).collect()  # one small row per model
        # from the rows: a later use of the metrics does not score the models again
        met = fm.sparkSession.createDataFrame([[r[f.name] for f in METRICS_SCHEMA] for r in rows], METRICS_SCHEMA)
    finally:
        data.unpersist()
    best = min(rows, key=lambda r: (r["rmse"], r["model"]))["model"]
    return TrainResult(target, models, met, pred, best, feature_cols)


def holdout_predictions(models: dict[str, PipelineModel], test: DataFrame, target: str) -> DataFrame:
    """(target, model, datum, actual, predicted): the holdout by every model."""
    preds = [pm.transform(test).select(
        F.lit(target).alias("target"), F.lit(name).alias("model"), "datum",
        F.col(target).alias("actual"), F.col("prediction").alias("predicted")) for name, pm in models.items()]
    pred = preds[0]
    for p in preds[1:]:
        pred = pred.unionByName(p)
    return pred


def train_all_targets(frames: dict, specs: list[ModelSpec] | None = None,
                      parallelism: int = 4) -> dict[str, TrainResult]:
    """Train and compare models for a few targets at once.

    `frames` maps target -> (feature frame with split, feature columns).  The
    targets are submitted from a small driver thread pool so their
    (distributed) fits overlap on the cluster; for many series use
    `per_series_ridge`, which fits all of them in one job.
    """
    def one(item):
        target, (fm, cols) = item
        return target, train_models(fm, cols, target, specs)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return dict(pool.map(one, frames.items()))


def leaderboard(results: dict[str, TrainResult]) -> DataFrame:
    """All targets' metrics in one frame, with each target's best model."""
    mets = [r.metrics for r in results.values()]
    m = mets[0]
    for x in mets[1:]:
        m = m.unionByName(x)
    best = best_by_target(m)
    return m.join(best, "target").withColumn("is_best", F.col("model") == F.col("best_model")).drop("best_model")


def best_by_target(metrics: DataFrame, rule: str = "rmse") -> DataFrame:
    """Best model per target: min RMSE (or max R^2); ties -> smaller name."""
    if rule == "rmse":
        pick = F.min_by("model", F.struct("rmse", "model"))
    else:
        pick = F.min_by("model", F.struct(-F.col("r2"), F.col("model")))
    return metrics.groupBy("target").agg(pick.alias("best_model"))


def save_models(spark: SparkSession, result: TrainResult, root: str) -> DataFrame:
    """Persist each fitted pipeline under root/<target>/<model> and append one
    registry row per model (metrics included) to root/_registry."""
    rows = []
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    mets = {r["model"]: r for r in result.metrics.collect()}
    for name, pm in result.models.items():
        path = f"{root.rstrip('/')}/{result.target}/{name}"
        pm.write().overwrite().save(path)
        m = mets.get(name)
        rows.append((result.target, name, path, m and m["mae"], m and m["rmse"], m and m["r2"],
                     name == result.best, now))
    reg = spark.createDataFrame(rows, schemas.MODEL_REGISTRY)
    reg.write.mode("append").parquet(f"{root.rstrip('/')}/_registry")
    write_metrics_json(result.metrics, root, result.target)
    return reg


METRICS_SCHEMA = T.StructType([
    T.StructField("target", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("mae", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()), T.StructField("r2", T.DoubleType())])


def write_metrics_json(metrics: DataFrame, root: str, target: str) -> None:
    """Per-target metrics as JSON lines under root/<target>/_metrics."""
    metrics.select(*[f.name for f in METRICS_SCHEMA.fields]).coalesce(1).write.mode("overwrite").json(
        f"{root.rstrip('/')}/{target}/_metrics")


def read_metrics_json(spark: SparkSession, root: str, target: str = "*") -> DataFrame:
    """Read metrics back with an explicit schema (no inference)."""
    return spark.read.schema(METRICS_SCHEMA).json(f"{root.rstrip('/')}/{target}/_metrics")


def load_registry(spark: SparkSession, root: str) -> DataFrame:
    """Latest registry row per (target, model)."""
    r = spark.read.schema(schemas.MODEL_REGISTRY).parquet(f"{root.rstrip('/')}/_registry")
    return r.groupBy("target", "model").agg(F.max_by(F.struct(*r.columns), "saved_at").alias("r")).select("r.*")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_models(registry: DataFrame) -> dict[str, PipelineModel]:
    """The pipelines of one target's registry rows, read back, by name."""
    return {r["model"]: load_model(r["path"]) for r in registry.select("model", "path").orderBy("model").collect()}


def check_loaded(result: TrainResult, fm: DataFrame, loaded: dict[str, PipelineModel], split_col: str = "split") -> None:
    """Raises ValueError unless all of ``result``'s models were read back and score the holdout of ``fm`` as they did."""
    if set(loaded) != set(result.models):
        raise ValueError(f"models of {result.target} that weren't read back: {sorted(set(result.models) - set(loaded))}")
    test = fm.where(F.col(split_col) == "test").select("datum", *result.feature_cols, F.col(result.target).cast("double")
                                                       .alias(result.target)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        again = regression_metrics(holdout_predictions(loaded, in_partitions(test, len(result.feature_cols)), result.target),
                                   keys=("target", "model"))
        both = again.select("model", F.col("rmse").alias("again")).join(result.metrics, "model")
        # sums of an order of their own
        other = [r["model"] for r in both.collect() if abs(r["again"] - r["rmse"]) > 1e-9 * max(1.0, abs(r["rmse"]))]
    finally:
        test.unpersist()
    if other:
        raise ValueError(f"models of {result.target} that score otherwise once read back: {sorted(other)}")


def score_recent(model: PipelineModel, fm: DataFrame, n: int = 30, key: str = "series",
                 clamp: bool = True) -> DataFrame:
    """Score the last n rows per `key` of a feature frame with a fitted
    pipeline (e.g. a target's best model): only the tails are transformed."""
    from salescast.operators.series import tail_n
    t = tail_n(fm.withColumnRenamed(key, "series") if key != "series" else fm, n)
    p = F.col("prediction")
    out = model.transform(t).withColumn("predicted", F.round(F.greatest(F.lit(0.0), p), 2) if clamp else p)
    return out.drop("prediction", "features_raw", "features")


def feature_importance(spark: SparkSession, model: PipelineModel, feature_cols: list[str],
                       top: int = 10) -> DataFrame:
    """Top-k feature importances of a tree pipeline, as a DataFrame."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(feature_cols, [float(x) for x in imp])),
                               "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature")).limit(top)


def linear_coefficients(model: PipelineModel, feature_cols: list[str]) -> tuple[float, list[float]]:
    """Fold scaler + linear model into (intercept, weights) on raw features:
    w_raw = w / std, b_raw = b - sum(w * mean / std)."""
    scaler, lr = model.stages[1], model.stages[2]
    mean = scaler.mean.toArray()
    std = scaler.std.toArray()
    w = lr.coefficients.toArray()
    ws, b = [], float(lr.intercept)
    for i in range(len(feature_cols)):
        s = std[i] if std[i] != 0 else 1.0
        wi = float(w[i] / s) if std[i] != 0 else 0.0
        ws.append(wi)
        b -= wi * mean[i]
    return b, ws


# --- per-series closed-form ridge -------------------------------------------------

def per_series_ridge(df: DataFrame, feature_cols: list[str], label: str = "value",
                     alpha: float = 1.0, split_col: str | None = "split") -> DataFrame:
    """Ridge(alpha) on standardized features, one model per series.

    From centred co-moments (operators.linear): partial per task and mergeable, so a hot series is split across
    tasks and the level of the data does not matter; one small solve per series.  Returns (series, intercept,
    weights array in raw-feature space, n_train).
    """
    tr = df if split_col is None else df.where(F.col(split_col) == "train")
    parts = linear.series_moments(tr.withColumn("test_fold", F.lit(None).cast("int")), feature_cols, label)
    return linear.fit_series(parts, feature_cols, [ModelSpec("Ridge", "ridge", {"alpha": alpha})], [linear.ALL_ROWS]) \
        .select("series", "intercept", "weights", "n_train")


def save_coefficients(coefs: DataFrame, root: str, model: str) -> None:
    """Per-series models as rows under root/_coefficients: (target, model, intercept, weights, n_train, saved_at)."""
    coefs.select(F.col("series").alias("target"), F.lit(model).alias("model"), "intercept", "weights", "n_train",
                 F.current_timestamp().alias("saved_at")) \
        .write.mode("append").parquet(f"{root.rstrip('/')}/_coefficients")


def load_coefficients(spark: SparkSession, root: str) -> DataFrame:
    """Latest row per (target, model)."""
    r = spark.read.schema(COEFFICIENTS).parquet(f"{root.rstrip('/')}/_coefficients")
    return r.groupBy("target", "model").agg(F.max_by(F.struct(*r.columns), "saved_at").alias("r")).select("r.*")


COEFFICIENTS = T.StructType([
    T.StructField("target", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("intercept", T.DoubleType()), T.StructField("weights", T.ArrayType(T.DoubleType())),
    T.StructField("n_train", T.LongType()), T.StructField("saved_at", T.TimestampType())])


def score_linear(df: DataFrame, coefs: DataFrame, feature_cols: list[str],
                 out: str = "predicted") -> DataFrame:
    """intercept + weights . features, JVM-side, coefficients joined per series."""
    j = df.join(coefs.select("series", "intercept", "weights"), "series")
    dot = F.col("intercept")
    for i, c in enumerate(feature_cols):
        dot = dot + F.col("weights")[i] * F.col(c)
    return j.withColumn(out, dot).drop("intercept", "weights")
