"""Holdout metrics and train-slice standardization as plain aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(scored: DataFrame, label: str = "actual", pred: str = "predicted",
                       keys=("series", "model")) -> DataFrame:
    """MAE, RMSE, R^2 per key in one aggregate (all models scored in one job).

    R^2 = 1 - SSE / SST with SST = n * population variance, which merges
    centred partial sums: one pass, and no cancellation for labels with a
    large mean.
    """
    e = F.col(label) - F.col(pred)
    g = scored.where(F.col(label).isNotNull() & F.col(pred).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.abs(e)).alias("_sae"),
        F.sum(e * e).alias("_sse"),
        F.var_pop(label).alias("_var"),
    )
    sst = F.col("_var") * F.col("n")
    return g.select(
        *keys, "n",
        (F.col("_sae") / F.col("n")).alias("mae"),
        F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.col("_sse"), sst)).alias("r2"),
    )


def train_stats(df: DataFrame, cols: list[str], split_col: str = "split", keys=("series",),
                ddof: int = 0) -> DataFrame:
    """Mean and stddev of each column over the training rows (population
    stddev by default, as a standard scaler uses)."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), sd(c).alias(f"{c}_std")]
    return df.where(F.col(split_col) == "train").groupBy(*keys).agg(*aggs)


def standardize(df: DataFrame, cols: list[str], split_col: str = "split", keys=("series",),
                ddof: int = 0) -> DataFrame:
    """(x - mean_train) / std_train for every row; statistics come from the
    training slice only, joined back on the series key.  Zero stddev -> 0."""
    keys = list(keys)
    st = train_stats(df, cols, split_col, keys, ddof)
    out = df.join(st, keys)
    for c in cols:
        out = out.withColumn(
            f"{c}_z", F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_std")), F.lit(0.0)))
    return out.drop(*[f"{c}_{s}" for c in cols for s in ("mean", "std")])
