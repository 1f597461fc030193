"""Structured Streaming: payload ingest, per-micro-batch processing, rollups.

Flow per micro-batch (``foreachBatch``):
  validate -> quarantine bad records -> explode to (series, datum, value)
  plus the per-day total -> optional scoring -> write facts -> anomaly check
  of the batch rows against the store (pruned to the months the look-back
  needs) -> write alerts.

Facts carry the number of their micro-batch as a column; a micro-batch that is
replayed after a failure replaces exactly its own rows (store.write_batch), so
retries never duplicate rows.  The stream checkpoint is the recovery boundary;
state lives in the store, not in executor memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescast import schemas
from salescast.operators.anomaly import BASELINE_DAYS, anomaly_alerts
from salescast.schemas import TOTAL_SERIES
from salescast.sources import ingest, store

HISTORY_DAYS = 120  # twice the longest look-back of the features, and more, in days
FACTS = schemas.SALES_STORE


def read_facts(spark: SparkSession, root: str) -> DataFrame:
    return store.read_table(spark, root, "sales_data")


def payload_stream(spark: SparkSession, in_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Unbounded payload source: new text files in `in_dir`, one JSON per line."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(in_dir)


class BatchProcessor:
    """The per-micro-batch chain, usable as ``foreachBatch(processor)``."""

    def __init__(self, root: str, products: DataFrame, product_codes: list[str],
                 scorer: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
                 baseline_days: int = BASELINE_DAYS, source: str = "realtime",
                 predictor: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
                 history_days: int = HISTORY_DAYS):
        """Both callables get (store slice before the batch, batch facts).
        scorer: -> facts with `predicted`, stored with the facts (registry.BestModelScorer).
        predictor: -> rows of (prediction_date, target_product, predicted_value, model_used),
        appended to the predictions table (one row per target and model).
        The slice holds the rows of the `history_days` before the batch's first day: the read
        is pruned to their months, however long the store."""
        self.predictor = predictor
        self.root = root
        self.products = products
        self.codes = product_codes
        self.scorer = scorer
        self.days = baseline_days
        self.source = source
        self.history_days = history_days

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        validated = ingest.parse_payloads(batch).persist()
        facts = None
        try:
            valid, bad = ingest.split_valid(validated)
            if not bad.isEmpty():
                store.write_batch(bad.select("raw", "reason"), self.root, "quarantine", batch_id)
            first = valid.agg(F.min("datum")).first()[0]
            if first is None:
                return
            long = ingest.explode_payloads(valid, self.codes)
            # each payload has its own total, so facts do not depend on how days fall into batches
            facts = long.unionByName(ingest.payload_total(valid, self.codes).select(
                F.lit(TOTAL_SERIES).alias("series"), "datum", F.col("total").alias("value")))
            if self.scorer is not None:
                facts = self.scorer(self._history(spark, first, batch_id), facts)
            if "predicted" not in facts.columns:
                facts = facts.withColumn("predicted", F.lit(None).cast("double"))
            # used by the predictor, the store write and the anomaly keys
            facts = facts.persist()
            if self.predictor is not None:
                self._predict(spark, first, facts, batch_id)
            store.write_batch(facts.drop("model_used"), self.root, "sales_data", batch_id, self.source)
            self._check_anomalies(spark, first, facts.select("series", "datum", "value"), batch_id)
        finally:
            validated.unpersist()
            if facts is not None:
                facts.unpersist()

    def _history(self, spark: SparkSession, first, batch_id: int) -> DataFrame:
        """The store's rows before the batch, of the months that the look-back needs."""
        lo = F.date_sub(F.lit(first), self.history_days)
        own = (F.col("batch") == batch_id) & (F.col("source") == self.source)
        hist = store.read_or_empty(spark, self.root, "sales_data").where(
            (F.col("month") >= F.date_format(lo, "yyyy-MM")) & (F.col("datum") >= lo) & ~F.coalesce(own, F.lit(False)))
        return hist.select("series", "datum", "value")

    def _predict(self, spark: SparkSession, first, facts: DataFrame, batch_id: int) -> None:
        """Score the batch days from the store state before the batch."""
        preds = self.predictor(self._history(spark, first, batch_id), facts.select("series", "datum", "value"))
        store.write_batch(preds, self.root, "predictions", batch_id)

    def _check_anomalies(self, spark: SparkSession, first, keys: DataFrame, batch_id: int) -> None:
        """Alerts for this batch's rows, each against the store's trailing
        window (store already holds the batch: insert before check)."""
        start = F.date_sub(F.lit(first), self.days)
        rows = read_facts(spark, self.root).where(
            (F.col("month") >= F.date_format(start, "yyyy-MM")) & (F.col("datum") >= start))
        alerts = anomaly_alerts(rows.select("series", "datum", "value"), self.days)
        alerts = alerts.join(keys, ["series", "datum", "value"], "left_semi")
        store.write_batch(alerts, self.root, "alerts", batch_id)


def run_ingest(spark: SparkSession, in_dir: str, root: str, checkpoint: str, processor: BatchProcessor,
               max_files_per_trigger: int | None = None, available_now: bool = True,
               processing_time: str = "1 second"):
    """Start the ingest stream.  availableNow drains what is there and stops;
    otherwise it polls every `processing_time` until stopped."""
    w = payload_stream(spark, in_dir, max_files_per_trigger).writeStream.foreachBatch(processor) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def daily_rollup_stream(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Raw events -> daily totals per event type with an event-time window
    and a watermark (late rows within the watermark still count)."""
    # Watermarks need TIMESTAMP; a zone-less column is read in the session zone.
    ev = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return (ev.withWatermark("ts", watermark)
            .groupBy(F.window("ts", "1 day"), F.col("event_type").alias("series"))
            .agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n_events")))


def write_rollup(agg: DataFrame, out_dir: str, checkpoint: str, mode: str = "complete"):
    """Run the rollup to completion; each micro-batch replaces the output
    (complete mode) or adds finalized windows (append mode) as a partition of
    its own, `batch`, which a replayed micro-batch overwrites."""
    def sink(df: DataFrame, batch_id: int) -> None:
        o = df.select("series", F.to_date(F.col("window.start")).alias("datum"), "value", "n_events")
        if mode == "complete":
            o.write.mode("overwrite").parquet(out_dir)
        else:
            (o.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out_dir))

    return (agg.writeStream.outputMode(mode).foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
