"""Alerts as keyed state: a series' last days live in the state store, so no batch reads the fact store.

Each series keeps the values of its last `days` days.  A new row is judged against the rows of the `days` days
before it and itself, as `operators.anomaly` judges a table.  Alerts do not depend on how the days fall into
micro-batches, nor on restarts, as long as a series' days arrive in order; a late row is judged by what the
state still holds, and later rows that were already judged stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from salescast.functions import columns as col
from salescast.operators.anomaly import BASELINE_DAYS

ALERTS = T.StructType([
    T.StructField("series", T.StringType()), T.StructField("datum", T.DateType()), T.StructField("value", T.DoubleType()),
    T.StructField("n", T.LongType()), T.StructField("baseline_mean", T.DoubleType()),
    T.StructField("baseline_std", T.DoubleType()), T.StructField("alert_type", T.StringType()),
    T.StructField("severity", T.StringType())])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def judge(day: np.ndarray, value: np.ndarray, new: np.ndarray, days: int) -> list[tuple]:
    """(place, n, mean, std, type, severity) of the alerts among the `new` rows; `day` is sorted."""
    out = []
    lo, hi = np.searchsorted(day, day - days), np.searchsorted(day, day, "right")
    for k in np.flatnonzero(new):
        base = value[lo[k]:hi[k]]
        base = base[~np.isnan(base)]
        if len(base) < max(col.ALERT_MIN_ROWS, 2) or np.isnan(value[k]):
            continue
        mean, std = base.mean(), base.std(ddof=1)
        off = abs(value[k] - mean)
        if off > col.ALERT_SIGMA * std:
            out.append((k, len(base), mean, std, "high_sales" if value[k] > mean else "low_sales",
                        "high" if off > col.HIGH_SEVERITY_SIGMA * std else "medium"))
    return out


class LastDays(StatefulProcessor):
    """State: a series' (day, value) rows of the last `days` days."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "day int, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))  # one series' rows of one micro-batch
        held = list(self.rows.get()) if self.rows.exists() else []
        new_day = pd.to_datetime(got["datum"]).to_numpy().astype("datetime64[D]").astype(np.int64)
        day = np.concatenate([np.array([r[0] for r in held], np.int64), new_day])
        value = np.concatenate([np.array([np.nan if r[1] is None else r[1] for r in held], float),
                                got["value"].to_numpy(float)])
        new = np.arange(len(day)) >= len(held)
        order = np.argsort(day, kind="stable")
        day, value, new = day[order], value[order], new[order]
        alerts = judge(day, value, new, self.days)
        keep = day >= day[-1] - self.days
        self.rows.put([(int(d), None if np.isnan(v) else float(v)) for d, v in zip(day[keep], value[keep])])
        if alerts:
            at, n, mean, std, kind, severity = zip(*alerts)
            at = list(at)
            yield pd.DataFrame({"series": key[0], "datum": day[at].astype("datetime64[D]").astype(object), "value": value[at],
                                "n": n, "baseline_mean": mean, "baseline_std": std, "alert_type": kind, "severity": severity})

    def close(self) -> None:
        pass


def alert_stream(facts: DataFrame, days: int = BASELINE_DAYS) -> DataFrame:
    """Streaming facts (series, datum, value) -> their alerts."""
    facts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return facts.select("series", "datum", "value").groupBy("series").transformWithStateInPandas(
        statefulProcessor=LastDays(days), outputStructType=ALERTS, outputMode="Append", timeMode="None")


def write_alerts(alerts: DataFrame, out_dir: str, checkpoint: str):
    """Append alerts to a Parquet folder, each once: the sink's log knows the finished micro-batches."""
    return alerts.writeStream.format("parquet").outputMode("append").option("path", out_dir) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_alerts(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(ALERTS).parquet(out_dir)
