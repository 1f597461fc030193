"""Linear models from mergeable centred co-moments.

Rows carry their features and labels as one array column ``z``, so plans are as wide for ten
thousand series as for ten.  A task turns each Arrow batch into counts, means and centred cross products
per key and block of time; these partials merge without cancellation (pairwise update of
centred sums), whatever the level of the data.  What is shuffled is one small matrix per batch, key and
block, never rows.

Blocks are the test blocks of an expanding time split.  The statistics of the rows that fold i trains on are
the merge of all blocks before i, so one pass over the rows serves the fits of all folds, the holdout fit and
the fit on all rows, of every model and every series.

* ``series_moments`` / ``fit_series``: one model per series, on the series' own features.
* ``day_vectors`` / ``fit_targets``: one vector per day with the features of all series; one matrix then
  holds the normal equations of every target (each series and the total), siblings' values included.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescast.functions.calendar import CALENDAR_FEATURES, calendar_columns
from salescast.operators import features as feat
from salescast.operators.metrics import regression_metrics
from salescast.schemas import TOTAL_SERIES

ALL_ROWS = feat.N_SPLITS          # the "fold" that trains on every row
HOLDOUT = feat.N_SPLITS - 1       # the last fold, which is the holdout of time_split
SWEEPS, SETTLED = 10_000, 1e-13   # of coordinate descent: most sweeps, and the change at which it ends


# --- co-moments ---------------------------------------------------------------------

def vector(cols: Iterable[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def complete(z: str = "z") -> Column:
    """No component is null or NaN."""
    return F.forall(z, lambda x: x.isNotNull() & ~F.isnan(x))


def moments(rows: DataFrame, keys: list[str], block: str = "test_fold") -> DataFrame:
    """Partial (keys, block, n, mean, m2) of the column ``z``: one row per Arrow batch, key and block.

    ``m2`` is the upper triangle of the centred cross products.  A null block is -1: training rows of every
    fold.  Vectors with a missing component are left out.
    """
    x = rows.where(complete()).select(*keys, F.coalesce(F.col(block), F.lit(-1)).cast("int").alias("block"), "z")
    fields = [x.schema[k] for k in keys] + [T.StructField("block", T.IntegerType()), T.StructField("n", T.LongType()),
                                            T.StructField("mean", T.ArrayType(T.DoubleType())),
                                            T.StructField("m2", T.ArrayType(T.DoubleType()))]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            by = batch.select([*keys, "block"]).to_pandas()
            upper = np.triu_indices(z.shape[1])
            first, n, mean, m2 = [], [], [], []
            for at in by.groupby([*keys, "block"], dropna=False).indices.values():
                part = z[at]
                mu = part.mean(0)
                part = part - mu
                first.append(at[0])
                n.append(len(at))
                mean.append(mu)
                m2.append((part.T @ part)[upper])
            keep = batch.select([*keys, "block"]).take(pa.array(first))
            yield pa.RecordBatch.from_arrays(
                [*keep.columns, pa.array(n, pa.int64()), pa.array(mean, pa.list_(pa.float64())),
                 pa.array(m2, pa.list_(pa.float64()))], [*keys, "block", "n", "mean", "m2"])

    return x.mapInArrow(run, T.StructType(fields))


def merge(n, mean, m2):
    """The (n, mean, centred cross products) of all rows together, from those of their parts."""
    n, mean = np.asarray(n, float), np.asarray(mean, float)
    mu = n @ mean / n.sum()
    d = mean - mu
    return n.sum(), mu, np.sum(m2, axis=0) + (d * n[:, None]).T @ d


def fold_moments(pdf: pd.DataFrame, folds=None):
    """(fold, n, mean, m2) of the rows that each fold (of ``folds``, or all and the fit on all rows) trains on: a
    prefix sum of blocks."""
    k = len(pdf["mean"].iloc[0])
    upper = np.triu_indices(k)

    def square(flat):
        out = np.zeros((k, k))
        out[upper] = flat
        return out + np.triu(out, 1).T

    blocks = {b: merge(g["n"].to_numpy(), np.stack(g["mean"].to_list()), [square(x) for x in g["m2"]])
              for b, g in pdf.groupby("block")}
    so_far = None
    for fold in range(-1, ALL_ROWS):
        if so_far is not None and fold >= 0 and (folds is None or fold in folds):
            yield fold, *so_far
        if fold in blocks:
            both = [blocks[fold]] if so_far is None else [so_far, blocks[fold]]
            so_far = merge(*zip(*both))
    if so_far is not None and (folds is None or ALL_ROWS in folds):
        yield ALL_ROWS, *so_far


# --- solvers on co-moments ------------------------------------------------------------

def solve(spec, n: float, mean, m2, x: np.ndarray, y: int) -> tuple[float, np.ndarray]:
    """(intercept, weights of the components ``x``) of the label component ``y``, for raw features.

    The penalty acts on features scaled to unit population variance; constant ones get weight 0.
    ridge: RSS + alpha |w|^2.  elasticnet: RSS / 2n + alpha * (l1_ratio |w|_1 + (1 - l1_ratio) / 2 |w|^2).
    """
    sd = np.sqrt(np.clip(np.diag(m2)[x], 0, None) / n)
    ok = sd > 1e-12 * np.abs(mean[x])
    d = np.where(ok, sd, 1.0)
    at = x[ok]
    g = m2[np.ix_(at, at)] / np.outer(d[ok], d[ok]) / n
    c = m2[at, y] / d[ok] / n
    alpha = float(spec.params.get("alpha", 1.0))
    if spec.kind == "ridge":
        w = np.linalg.solve(g + alpha / n * np.eye(len(at)), c) if alpha > 0 else np.linalg.lstsq(g, c, rcond=1e-12)[0]
    elif spec.kind == "elasticnet":
        rho = float(spec.params.get("l1_ratio", 0.5))
        w = descend(g, c, alpha * rho, alpha * (1 - rho))
    else:
        raise ValueError(f"not a linear model: {spec.kind!r}")
    out = np.zeros(len(x))
    out[ok] = w / d[ok]
    return float(mean[y] - out @ mean[x]), out


def descend(g: np.ndarray, c: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Coordinate descent on 1/2 w'gw - c'w + l1 |w|_1 + l2/2 |w|^2."""
    w, left, top = np.zeros(len(c)), c.copy(), np.abs(c).max(initial=1e-300)
    for _ in range(SWEEPS):
        change = 0.0
        for j in range(len(c)):
            old = w[j]
            r = left[j] + g[j, j] * old
            w[j] = np.sign(r) * max(abs(r) - l1, 0.0) / (g[j, j] + l2)
            if w[j] != old:
                left -= g[:, j] * (w[j] - old)
                change = max(change, abs(w[j] - old))
        if change <= SETTLED * top:
            break
    return w


COEFFICIENTS = T.StructType([
    T.StructField("series", T.StringType()), T.StructField("model", T.StringType()), T.StructField("fold", T.IntegerType()),
    T.StructField("intercept", T.DoubleType()), T.StructField("weights", T.ArrayType(T.DoubleType())),
    T.StructField("label_at", T.IntegerType()), T.StructField("n_train", T.LongType())])


# --- one model per series, on its own features --------------------------------------------

def series_moments(panel: DataFrame, features: list[str], label: str = "value") -> DataFrame:
    """Co-moments per series of a frame with ``test_fold`` (features.time_folds): features first, label last."""
    return moments(panel.withColumn("z", vector([*features, label])), ["series"])


def fit_series(parts: DataFrame, features: list[str], specs: list, folds=None) -> DataFrame:
    """Every spec of every series and fold (or those of ``folds``); a spec's ``features`` parameter limits it to some of the features."""
    places = {s.name: np.array([features.index(f) for f in s.params.get("features", features)]) for s in specs}

    def run(pdf):
        out = []
        for fold, n, mean, m2 in fold_moments(pdf, folds):
            for s in specs:
                x = places[s.name]
                b, w = solve(s, n, mean, m2, x, len(features))
                full = np.zeros(len(features))
                full[x] = w
                out.append((pdf["series"].iloc[0], s.name, fold, b, full, len(features), int(n)))
        return pd.DataFrame(out, columns=COEFFICIENTS.fieldNames())

    return parts.groupBy("series").applyInPandas(run, COEFFICIENTS)


def predict(rows: DataFrame, coefs: DataFrame, on: list[str], z: str = "z") -> DataFrame:
    """``rows`` with ``model`` and ``predicted`` of the coefficients of the same ``on``; z may be longer than weights."""
    c = coefs.select(*on, "model", "intercept", "weights", "label_at")
    dot = F.aggregate(F.zip_with("weights", F.slice(z, 1, F.size("weights")), lambda w, x: w * x), F.col("intercept"),
                      lambda a, x: a + x)
    return rows.join(c, on).withColumn("actual", F.get(z, F.col("label_at"))).withColumn("predicted", dot) \
        .drop("intercept", "weights", "label_at")


def cross_validate(panel: DataFrame, coefs: DataFrame, features: list[str], label: str = "value",
                   fold: int | None = None) -> DataFrame:
    """(series, model, fold, n, mae, rmse, r2): every row scored by the models of the fold that tests it."""
    rows = panel.where("test_fold is not null" if fold is None else F.col("test_fold") == fold) \
        .select("series", F.col("test_fold").alias("fold"), vector([*features, label]).alias("z")).where(complete())
    return regression_metrics(predict(rows, coefs, ["series", "fold"]), keys=("series", "model", "fold"))


def best_models(metrics: DataFrame, key: str = "series") -> DataFrame:
    """(key, model): the largest R^2, ties to the smaller name; a model without an R^2 only if all are."""
    return metrics.groupBy(key).agg(F.min_by("model", F.struct(F.col("r2").isNull(), -F.col("r2"), F.col("model"))).alias("model"))


# --- one vector per day, for models on the features of all series ---------------------------

N_OWN = len(feat.LAGS) + len(feat.WINDOWS)


def day_vectors(dense_global: DataFrame) -> DataFrame:
    """(datum, names, z, test_fold): z holds the calendar, the lags of every series, their rolling means, their
    values and the total; ``names`` the series in that order (by name).

    ``dense_global`` has a row for every series and day.  Warm-up days are left out.  A day's vector is gathered
    from the long frame by an aggregate, so neither plan nor code grow with the number of series.
    """
    f = feat.lag_rolling(dense_global)
    own = F.struct("series", vector(feat.lag_names()).alias("lags"), vector(feat.rolling_names()).alias("rolls"),
                   F.col("value").cast("double").alias("value"))
    days = f.groupBy("datum").agg(F.array_sort(F.collect_list(own)).alias("s")) \
        .withColumn("total", F.aggregate("s.value", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))) \
        .withColumns(calendar_columns("datum"))
    z = F.concat(vector(CALENDAR_FEATURES), F.flatten("s.lags"), F.flatten("s.rolls"), F.col("s.value"), F.array("total"))
    days = days.select("datum", F.col("s.series").alias("names"), z.alias("z")).where(complete())
    return feat.time_folds(days.withColumn("series", F.lit(TOTAL_SERIES)), dense=True).drop("series")


def fit_targets(vectors: DataFrame, specs: list, folds=None) -> DataFrame:
    """Every spec of every target (each series, and the total) and fold, from one matrix.

    Weights follow the layout of the vectors up to the values; a target's own value has weight 0, and the total's
    models use no values.  One solve holds a matrix of (10 series + 8)^2 numbers; for more series than such a
    matrix can hold use ``fit_series``.
    """
    parts = moments(vectors.withColumn("names", F.to_json("names")), ["names"])

    def run(pdf):
        import json
        names = json.loads(pdf["names"].iloc[0])
        p, shared = len(names), len(CALENDAR_FEATURES) + N_OWN * len(names)
        out = []
        for fold, n, mean, m2 in fold_moments(pdf, folds):
            for i, name in enumerate([*names, TOTAL_SERIES]):
                x = np.array([*range(shared), *(shared + j for j in range(p) if j != i and i < p)])
                for s in specs:
                    b, w = solve(s, n, mean, m2, x, shared + i)
                    full = np.zeros(shared + p)
                    full[x] = w
                    out.append((name, s.name, fold, b, full, shared + i, int(n)))
        return pd.DataFrame(out, columns=COEFFICIENTS.fieldNames())

    # a constant key: what meets is one partial matrix per batch of days and block
    return parts.groupBy("names").applyInPandas(run, COEFFICIENTS)


def target_metrics(vectors: DataFrame, coefs: DataFrame, fold: int | None = HOLDOUT) -> DataFrame:
    """(series, model, fold, n, mae, rmse, r2) of every target: a day meets the models of the fold that tests it."""
    rows = vectors.where("test_fold is not null" if fold is None else F.col("test_fold") == fold) \
        .select("datum", "z", F.col("test_fold").alias("fold"))
    by_target = coefs.withColumn("model", F.struct("series", "model"))
    scored = predict(rows, by_target, ["fold"]).select("fold", "actual", "predicted", "model.series", "model.model")
    return regression_metrics(scored, keys=("series", "model", "fold"))


# --- residuals of the optimality conditions -----------------------------------------------

def stationarity(panel: DataFrame, coefs: DataFrame, features: list[str], specs: list, label: str = "value") -> DataFrame:
    """(series, model, feature, weight, gradient): the derivative of the smooth part of the loss of each spec by each
    scaled weight, over the rows the holdout fit trains on, and the weight; from the rows themselves, not from
    co-moments.

    ridge: the gradient is 0.  elasticnet: it is -l1 * sign(weight), or within l1 of 0 where the weight is 0.
    """
    rows = panel.where(F.col("test_fold").isNull() | (F.col("test_fold") < HOLDOUT)) \
        .select("series", vector([*features, label]).alias("z")).where(complete())
    c = coefs.where(F.col("fold") == HOLDOUT)
    sums = predict(rows, c, ["series"]).withColumn("r", F.col("actual") - F.col("predicted")) \
        .select("series", "model", "r", F.posexplode(F.slice("z", 1, len(features))).alias("at", "x")) \
        .groupBy("series", "model", "at").agg(
            F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"),
            F.sum("r").alias("r"), F.sum(F.col("x") * F.col("r")).alias("xr"))
    weight = c.select("series", "model", F.posexplode("weights").alias("at", "w"))
    scaled, pull = F.col("w") * F.col("sd"), F.lit(0.0)
    for s in specs:  # what the squared penalty adds
        alpha = float(s.params.get("alpha", 1.0))
        rate = alpha / F.col("n") if s.kind == "ridge" else F.lit(alpha * (1 - float(s.params.get("l1_ratio", 0.5))))
        pull = F.when(F.col("model") == s.name, scaled * rate).otherwise(pull)
    per_row = (F.col("xr") - F.col("mean") * F.col("r")) / (F.col("sd") * F.col("n"))
    return sums.join(weight, ["series", "model", "at"]).where("sd > 0").select(
        "series", "model", F.element_at(F.array(*[F.lit(f) for f in features]), F.col("at") + 1).alias("feature"),
        scaled.alias("weight"), (pull - per_row).alias("gradient"))
