"""Fitted models of all targets: one registry table, and scoring of points by each target's best model.

A registry row is a model of one target with its holdout metrics.  A linear model is its row (features, intercept,
weights), so scoring is a join on the target and a dot product.  A tree model is a saved pipeline that serves all
of its targets (``pooled``); scoring runs one transform per distinct pipeline that is somebody's best, over
the rows of those targets only.  Rows are appended; a target's latest row of each model counts.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescast.functions.calendar import CALENDAR_FEATURES, calendar_columns
from salescast.functions.columns import clamp_nonneg, round2
from salescast.operators import features as feat
from salescast.operators import linear
from salescast.operators.forecast import BUFFER_DAYS
from salescast.operators.forecast import _lag as lag_of
from salescast.operators.forecast import _push as push
from salescast.operators.forecast import _tail_mean as tail_mean
from salescast.operators.models import fit_all, in_partitions
from salescast.session import checkpoint_dir, scratch_path

OWN_FEATURES = CALENDAR_FEATURES + feat.lag_names() + feat.rolling_names()

STATE_ROWS = 20_000  # targets of a partition of a forecast's state

MODELS = T.StructType([
    T.StructField("target", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("path", T.StringType()),                       # of a saved pipeline; null: linear
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("intercept", T.DoubleType()), T.StructField("weights", T.ArrayType(T.DoubleType())),
    T.StructField("n", T.LongType()), T.StructField("mae", T.DoubleType()), T.StructField("rmse", T.DoubleType()),
    T.StructField("r2", T.DoubleType()), T.StructField("saved_at", T.TimestampType())])


def _path(root: str) -> str:
    return f"{root.rstrip('/')}/_models"


def save_linear(coefs: DataFrame, metrics: DataFrame, features: list[str], root: str) -> None:
    """Append linear models: (series, model, intercept, weights) with the metrics of the same (series, model)."""
    rows = coefs.join(metrics.select("series", "model", "n", "mae", "rmse", "r2"), ["series", "model"], "left")
    rows.select(F.col("series").alias("target"), "model", F.lit(None).cast("string").alias("path"),
                F.array(*[F.lit(f) for f in features]).alias("features"), "intercept", "weights", "n", "mae", "rmse", "r2",
                F.current_timestamp().alias("saved_at")).write.mode("append").parquet(_path(root))


def save_pipelines(models: dict[str, PipelineModel], metrics: DataFrame, root: str) -> None:
    """Save each pipeline once, and append a row for each target it has metrics for: (series, model, n, mae, rmse, r2)."""
    at = F.lit(None).cast("string")
    for name, model in models.items():
        path = f"{root.rstrip('/')}/pipelines/{name}"
        model.write().overwrite().save(path)
        at = F.when(F.col("model") == name, path).otherwise(at)
    metrics.where(F.col("model").isin(list(models))).select(
        F.col("series").alias("target"), "model", at.alias("path"), F.lit(None).cast("array<string>").alias("features"),
        F.lit(None).cast("double").alias("intercept"), F.lit(None).cast("array<double>").alias("weights"),
        "n", "mae", "rmse", "r2", F.current_timestamp().alias("saved_at")).write.mode("append").parquet(_path(root))


def load(spark: SparkSession, root: str) -> DataFrame:
    """The latest row of each (target, model)."""
    r = spark.read.schema(MODELS).parquet(_path(root))
    return r.groupBy("target", "model").agg(F.max_by(F.struct(*r.columns), "saved_at").alias("r")).select("r.*")


def best(registry: DataFrame) -> DataFrame:
    """Each target's best row: the largest R^2 on the holdout, ties to the smaller name, none only if all lack one."""
    order = F.struct(F.col("r2").isNull(), -F.col("r2"), F.col("model"))
    return registry.groupBy("target").agg(F.min_by(F.struct(*registry.columns), order).alias("r")).select("r.*")


def points(history: DataFrame, facts: DataFrame, lags=feat.LAGS, windows=feat.WINDOWS, missing: float = 0.0) -> DataFrame:
    """``facts`` (series, datum, value) with the calendar and the lags and means of the rows before each of them; a
    point without any row before it has ``missing`` for them."""
    x = feat.features_asof(history, facts, lags, windows)
    return x.fillna(missing, feat.lag_names(lags) + feat.rolling_names(windows)).withColumns(calendar_columns("datum"))


def pipelines(best_rows: DataFrame) -> dict[str, PipelineModel]:
    """The saved pipelines that ``best_rows`` refer to, by path (a few: each serves many targets)."""
    paths = best_rows.where("path is not null").select("path").distinct().collect()
    return {r.path: PipelineModel.load(r.path) for r in sorted(paths)}


def score(rows: DataFrame, best_rows: DataFrame, out: str = "predicted", none: float | None = 0.0,
          loaded: dict[str, PipelineModel] | None = None, cents: bool = True) -> DataFrame:
    """``rows`` (series and feature columns) with ``out``, rounded to ``cents`` and not below 0, and ``model_used``.

    ``best_rows``: at most one registry row per target.  A row without a model gets ``none`` and a null model.
    ``loaded``: the pipelines, if they are at hand.
    """
    return scored(with_models(rows, best_rows), rows.columns, out, none,
                  pipelines(best_rows) if loaded is None else loaded, cents).drop(*MODEL_COLUMNS)


MODEL_COLUMNS = ("path", "features", "intercept", "weights")


def with_models(rows: DataFrame, best_rows: DataFrame) -> DataFrame:
    """``rows`` with ``model_used`` and the other columns of their target's registry row, null if it has none."""
    return rows.join(best_rows.select(F.col("target").alias("series"), F.col("model").alias("model_used"), *MODEL_COLUMNS),
                     "series", "left")


def scored(joined: DataFrame, columns: list[str], out: str, none: float | None, loaded: dict[str, PipelineModel],
           cents: bool = True) -> DataFrame:
    """``columns``, ``out`` and the model columns of ``joined`` (as ``with_models``): see ``score``."""
    named = F.map_from_arrays(F.array(*[F.lit(f) for f in OWN_FEATURES]),
                              F.array(*[F.col(f).cast("double") for f in OWN_FEATURES]))

    def finish(df: DataFrame, p: Column) -> DataFrame:
        p = round2(clamp_nonneg(p)) if cents else clamp_nonneg(p)
        # greatest() skips nulls: a row without a model has no prediction, not 0
        return df.withColumn(out, F.when(F.col("model_used").isNotNull(), p).otherwise(F.lit(none).cast("double"))) \
            .select(*columns, out, "model_used", *MODEL_COLUMNS)

    x = F.transform("features", lambda f: F.element_at(named, f))
    dot = F.aggregate(F.zip_with("weights", x, lambda w, v: w * v), F.col("intercept"), lambda a, v: a + v)
    done = finish(joined.where("path is null"), dot)
    for path, model in loaded.items():
        part = model.transform(joined.where(F.col("path") == path))
        done = done.unionByName(finish(part, F.col("prediction")))
    return done


def forecast_best(buffers: DataFrame, best_rows: DataFrame, horizon: int = 30) -> DataFrame:
    """(series, step, datum, predicted, model_used): every target's recursive forecast by its best model.

    ``buffers``: (series, last, buf) with at least the longest look-back of values.  A loop over steps, not
    targets: a step derives the features of all targets from their buffers, scores them with one transform per
    distinct pipeline and one join for the linear models, and feeds the prediction (not below 0) back.  The
    state is one row per target; it is checkpointed after each step, as a tree model cannot be folded.
    """
    checkpoint_dir(buffers.sparkSession)
    loaded = pipelines(best_rows)
    buf, day = F.col("buf"), F.date_add("last", F.col("step"))
    cols = dict(calendar_columns(day))
    cols |= {f"lag_{k}": lag_of(buf, k) for k in feat.LAGS} | {f"rolling_{k}": tail_mean(buf, k) for k in feat.WINDOWS}
    y, model = F.col("_y"), ["model_used", *MODEL_COLUMNS]
    state = with_models(buffers.select("series", "last", "buf", F.array().cast("array<double>").alias("out"),
                                       F.lit(1).alias("step")), best_rows).checkpoint()
    # a union of the models' rows has the partitions of all of them: every step would have more
    parts = state.count() // STATE_ROWS + 1
    for _ in range(horizon):
        state = scored(state.withColumns(cols), ["series", "last", "buf", "out", "step"], "_y", None, loaded, cents=False) \
            .select("series", "last", push(buf, y, BUFFER_DAYS).alias("buf"), F.concat("out", F.array(y)).alias("out"),
                    (F.col("step") + 1).alias("step"), *model).repartition(parts, "series").checkpoint()
    return state.where("model_used is not null") \
        .select("series", "last", "model_used", F.posexplode("out").alias("at", "predicted")) \
        .select("series", (F.col("at") + 1).alias("step"), F.date_add("last", F.col("at") + 1).alias("datum"), "predicted",
                "model_used")


class BestModelScorer:
    """(history, facts) -> facts with ``predicted``, for a stream: each target by its best registered model.

    The registry is small (a row per target and model) and read anew for every batch, so models that are saved
    while a stream runs are used from the next batch on.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __call__(self, history: DataFrame, facts: DataFrame) -> DataFrame:
        return score(points(history, facts), best(load(self.spark, self.root)))


# --- one pooled model for all targets --------------------------------------------------------

def pooled_pipeline(spec, features: list[str], n_series: int, label: str = "value"):
    """A tree model over the features and the series itself, as a categorical feature."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
    stages = [StringIndexer(inputCol="series", outputCol="series_index", handleInvalid="keep"),
              VectorAssembler(inputCols=["series_index", *features], outputCol="features_raw")]
    common = {"featuresCol": "features_raw", "labelCol": label, "maxBins": max(32, n_series + 2)}
    if spec.kind == "forest":
        stages.append(RandomForestRegressor(**common, **{"featureSubsetStrategy": "all", **spec.params}))
    elif spec.kind == "gbt":
        stages.append(GBTRegressor(**common, **spec.params))
    else:
        raise ValueError(f"not a pooled model: {spec.kind!r}")
    return Pipeline(stages=stages)


def train_all(panel: DataFrame, specs: list, features: list[str] = OWN_FEATURES, label: str = "value"):
    """(pipelines by name, linear coefficients, metrics): every spec for every series of ``panel``.

    ``panel`` has the features, the label and ``test_fold``; models train on what lies before the last fold and are
    measured on it.  A tree spec is one fit over all series; the linear ones are one pass of co-moments with a
    solve per series.  Nothing loops over series.
    """
    from pyspark import StorageLevel

    from salescast.operators.metrics import regression_metrics
    rows = panel.where(linear.complete(linear.vector([*features, label]))).select("series", "datum", label, "test_fold", *features)
    lin, trees = [s for s in specs if s.kind in ("ridge", "elasticnet")], [s for s in specs if s.kind in ("forest", "gbt")]
    cached = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = in_partitions(cached, len(features) + 1)
        train = rows.where(F.col("test_fold").isNull() | (F.col("test_fold") < linear.HOLDOUT))
        test = rows.where(F.col("test_fold") == linear.HOLDOUT)
        n_series = rows.select("series").distinct().count()
        models = fit_all({s.name: pooled_pipeline(s, features, n_series, label) for s in trees}, train)
        out = coefs = None
        if lin:
            coefs = linear.fit_series(linear.series_moments(rows, features, label), features, lin, [linear.HOLDOUT])
            out = linear.cross_validate(rows, coefs, features, label, linear.HOLDOUT).drop("fold")
        for name, model in models.items():
            scored = model.transform(test).select("series", F.lit(name).alias("model"), F.col(label).alias("actual"),
                                                  F.col("prediction").alias("predicted"))
            m = regression_metrics(scored)
            out = m if out is None else out.unionByName(m)
        # tables, so that using them later does not train or score again
        out = _kept(out, "metrics")
        coefs = coefs if coefs is None else _kept(coefs, "coefficients")
    finally:
        cached.unpersist()
    return models, coefs, out


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
