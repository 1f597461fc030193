import datetime as dt
import os
import random

from conftest import daily_df
from pyspark.sql import functions as F

from salescast.operators import anomaly, series as ser
from salescast.operators import registry
from salescast.schemas import TOTAL_SERIES
from salescast.sources import ingest, store
from salescast.streaming import alerts as stream_alerts
from salescast.streaming import pipeline as stream


def test_stream_alerts_equal_batch_alerts(spark, tmp_path):
    rnd = random.Random(11)
    rows = []
    for i in range(60):
        day = (dt.date(2024, 1, 1) + dt.timedelta(days=i)).isoformat()
        for p in ("A", "B"):
            v = float(rnd.randint(5, 15)) if i not in (20, 45) else 200.0
            rows.append((p, day, v))
    daily = daily_df(spark, rows)
    pay = ingest.payloads_from_daily(daily).withColumn(
        "wk", F.floor(F.unix_date(F.to_date(F.get_json_object("value", "$.datum"))) / 10))
    inc = tmp_path / "in"
    for i, wk in enumerate(sorted(r[0] for r in pay.select("wk").distinct().collect())):
        pay.where(F.col("wk") == wk).select("value").coalesce(1).write.text(str(inc / f"p{i:03d}"))
    # a bad record in its own file, processed in the same stream
    spark.createDataFrame([("not json",)], "value string").coalesce(1).write.text(str(inc / "p999"))
    prods = spark.createDataFrame([("A",), ("B",)], "code string")
    root = str(tmp_path / "store")
    q = stream.run_ingest(spark, str(inc / "*"), root, str(tmp_path / "ckpt"),
                          stream.BatchProcessor(root, prods, ["A", "B"]), max_files_per_trigger=1)
    q.awaitTermination()
    facts = stream.read_facts(spark, root)
    assert facts.count() == 60 * 3
    assert facts.select("batch").distinct().count() >= 6
    got = store.read_table(spark, root, "alerts").select("series", "datum", "alert_type", "severity")
    exp = anomaly.anomaly_alerts(ser.all_targets(daily)).select("series", "datum", "alert_type", "severity")
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0
    assert exp.count() > 0
    assert store.read_table(spark, root, "quarantine").where("reason = 'malformed_json'").count() == 1


def test_rollup_append_holds_back_open_windows(spark, tmp_path):
    src = tmp_path / "ev"
    ts = [dt.datetime(2024, 1, d, 12) for d in (1, 2, 3, 4)]
    spark.createDataFrame([(t, "x", 1.0) for t in ts], "ts timestamp, event_type string, value double") \
        .coalesce(1).write.parquet(str(src))
    ev = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(src))
    q = stream.write_rollup(stream.daily_rollup_stream(ev), str(tmp_path / "out"), str(tmp_path / "ck"), "append")
    q.awaitTermination()
    # watermark = max(ts) - 1 day: windows ending after it stay open
    days = sorted(r.datum.day for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert days == [1, 2]


def test_polling_stream_start_and_stop(spark, tmp_path):
    inc = tmp_path / "in"
    spark.createDataFrame([('{"datum":"2024-02-01","sales":{"A":3.0}}',)], "value string") \
        .coalesce(1).write.text(str(inc / "p0"))
    prods = spark.createDataFrame([("A",)], "code string")
    root = str(tmp_path / "store")
    q = stream.run_ingest(spark, str(inc / "*"), root, str(tmp_path / "ckpt"),
                          stream.BatchProcessor(root, prods, ["A"]), available_now=False,
                          processing_time="1 second")
    try:
        q.processAllAvailable()
        assert q.isActive
        assert stream.read_facts(spark, root).count() == 2  # A and the total
    finally:
        q.stop()
    assert not q.isActive


def test_rollup_replay_and_table_directory(spark, tmp_path):
    from salescast.plans import queries as Q
    ts = [dt.datetime(2024, 1, d, 12) for d in (1, 2, 3, 4)]
    ev = spark.createDataFrame([(t, "x", 1.0) for t in ts], "ts timestamp, event_type string, value double")
    ev.repartition(3).write.parquet(str(tmp_path / "sf" / "events.parquet"))  # part files
    out = Q.stream_daily_rollup(spark, str(tmp_path / "sf"))
    assert sorted(r.datum.day for r in out.collect()) == [1, 2, 3, 4]
    read = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "sf" / "events.parquet"))
    for ck in ("a", "b"):  # the same micro-batches twice, as after a lost checkpoint
        stream.write_rollup(stream.daily_rollup_stream(read), str(tmp_path / "out"), str(tmp_path / ck),
                            "append").awaitTermination()
    days = sorted(r.datum.day for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert days == [1, 2]


def days_of(spark, tmp_path, n=60, per_file=10):
    rnd = random.Random(12)
    rows = [(p, (dt.date(2024, 1, 1) + dt.timedelta(days=i)).isoformat(), 200.0 if i in (20, 45) else float(rnd.randint(5, 15)))
            for i in range(n) for p in ("A", "B")]
    daily = daily_df(spark, rows)
    pay = ingest.payloads_from_daily(daily).withColumn("day", F.to_date(F.get_json_object("value", "$.datum"))).toPandas()
    inc = tmp_path / "in"
    inc.mkdir()
    pay = pay.sort_values("day")
    for i in range(0, n, per_file):
        f = inc / f"p{i:03d}"
        f.write_text("\n".join(pay.value[i:i + per_file]) + "\n")
        os.utime(f, (1_700_000_000 + i,) * 2)  # the source takes files in order of their times
    return daily, inc


def test_facts_are_scored_by_each_targets_best_model(spark, tmp_path):
    daily, inc = days_of(spark, tmp_path, 40)
    names = registry.OWN_FEATURES
    c, m = "series string, model string, intercept double, weights array<double>", \
        "series string, model string, n long, mae double, rmse double, r2 double"

    def weights(**w):
        return [w.get(x, 0.0) for x in names]

    coefs = [("A", "x", 1.0, weights(lag_1=0.5)), ("A", "y", 0.0, weights(lag_7=1.0)), ("B", "x", 0.0, weights(rolling_7=1.0))]
    root = str(tmp_path / "models")
    registry.save_linear(spark.createDataFrame(coefs, c), spark.createDataFrame(
        [("A", "x", 9, 1.0, 1.0, 0.2), ("A", "y", 9, 1.0, 1.0, 0.1), ("B", "x", 9, 1.0, 1.0, 0.0)], m), names, root)
    prods = spark.createDataFrame([("A",), ("B",)], "code string")
    out = str(tmp_path / "store")
    stream.run_ingest(spark, str(inc), out, str(tmp_path / "ck"), stream.BatchProcessor(
        out, prods, ["A", "B"], scorer=registry.BestModelScorer(spark, root)), max_files_per_trigger=1).awaitTermination()
    got = {(r.series, r.datum): r.predicted for r in stream.read_facts(spark, out).collect()}
    value = {(r.series, r.datum): r.value for r in daily.collect()}
    assert len(got) == 120
    for (s, d), p in got.items():
        before = [value[s, d - dt.timedelta(days=k)] for k in range(1, 8) if (s, d - dt.timedelta(days=k)) in value]
        want = 0.0 if s == TOTAL_SERIES else 1 + 0.5 * before[0] if s == "A" and before else 1.0 if s == "A" else \
            sum(before) / len(before) if before else 0.0
        assert abs(p - want) < 0.0051, (s, d, p, want)


def test_state_alerts_for_any_split_and_after_a_restart(spark, tmp_path):
    daily, inc = days_of(spark, tmp_path)
    exp = anomaly.anomaly_alerts(ser.all_targets(daily)).select("series", "datum", "n", "alert_type", "severity")
    want = sorted(map(tuple, exp.collect()))
    assert want

    def run(name, files, src):
        valid, _ = ingest.split_valid(ingest.parse_payloads(stream.payload_stream(spark, str(src), files)))
        facts = ingest.explode_with_total(valid, ["A", "B"], TOTAL_SERIES)
        stream_alerts.write_alerts(stream_alerts.alert_stream(facts), str(tmp_path / name), str(tmp_path / f"{name}-ck")) \
            .awaitTermination()
        return sorted(map(tuple, stream_alerts.read_alerts(spark, str(tmp_path / name)).select(
            "series", "datum", "n", "alert_type", "severity").collect()))

    assert run("one", None, inc) == want and run("six", 1, inc) == want
    part = tmp_path / "part"
    part.mkdir()
    files = sorted(inc.iterdir())
    for some in (files[:2], files[2:]):  # stopped after two files, started again when the rest has come
        for f in some:
            (part / f.name).write_text(f.read_text())
            os.utime(part / f.name, (f.stat().st_mtime,) * 2)
        got = run("restart", 1, part)
    assert got == want


def test_state_holds_the_last_days_only():
    import numpy as np
    day, value = np.arange(100), np.ones(100)
    value[99] = 50.0
    assert [a[:2] for a in stream_alerts.judge(day, value, day >= 95, 30)] == [(99, 31)]
    assert stream_alerts.judge(day[:4], value[:4], day[:4] >= 0, 30) == []


def test_append_stream_backfill_compact_in_any_order(spark, tmp_path):
    daily, inc = days_of(spark, tmp_path, 40)
    root = str(tmp_path / "store")
    prods = spark.createDataFrame([("A",), ("B",)], "code string")
    old = daily_df(spark, [(s, f"2023-12-{d:02d}", 1.0) for s in ("A", "B") for d in range(1, 32)])
    proc = stream.BatchProcessor(root, prods, ["A", "B"])

    def go():
        stream.run_ingest(spark, str(inc), root, str(tmp_path / "ck"), proc, max_files_per_trigger=1).awaitTermination()

    def state():
        return sorted(((r.series, r.datum, r.value, r.predicted, r.batch) for r in stream.read_facts(spark, root).collect()), key=str)

    more = inc / "p900"
    text = sorted(inc.iterdir())[-1].read_text()
    store.append_facts(old, root, "history")
    go()
    assert len(state()) == 62 + 120
    st = store.read_table(spark, root, "sales_data")
    store.overwrite_months(st.where("month = '2024-01'").withColumn("predicted", F.lit(7.0)), root)
    assert sum(r[3] == 7.0 for r in state()) == 31 * 3 and len(state()) == 182
    more.write_text(text.replace("2024-02-0", "2024-03-0"))
    go()
    before = state()
    assert len(before) > 182
    files = store.read_table(spark, root, "sales_data").select(F.input_file_name()).distinct().count()
    assert store.compact(spark, root, many=1) > 0 and state() == before
    assert store.read_table(spark, root, "sales_data").select(F.input_file_name()).distinct().count() < files
    store.append_facts(old.limit(1), root, "history")
    assert len(state()) == len(before) + 1


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    prods = spark.createDataFrame([("A",)], "code string")
    proc = stream.BatchProcessor(root, prods, ["A"])
    first = spark.createDataFrame([('{"datum":"2024-01-31","sales":{"A":1}}',), ('{"datum":"2024-02-01","sales":{"A":2}}',),
                                   ("bad",)], "value string")
    second = spark.createDataFrame([('{"datum":"2024-02-02","sales":{"A":3}}',)], "value string")
    for batch, k in ((first, 0), (second, 1), (first, 0), (second, 1)):
        proc(batch, k)
    got = sorted((r.series, r.datum.day, r.value, r.batch) for r in stream.read_facts(spark, root).collect())
    assert got == sorted((s, d, float(v), b) for s in ("A", TOTAL_SERIES) for d, v, b in ((31, 1, 0), (1, 2, 0), (2, 3, 1)))
    assert store.read_table(spark, root, "quarantine").count() == 1
    stream.BatchProcessor(root, prods, ["A"], source="other")(first, 0)  # another stream's batch 0 is not a replay
    assert stream.read_facts(spark, root).count() == 10
    proc(spark.createDataFrame([("bad",)], "value string"), 2)  # a batch without a usable record
    assert stream.read_facts(spark, root).count() == 10
