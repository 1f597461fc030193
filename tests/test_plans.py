from conftest import SF001

import __spark_entry__ as E
from salescast.operators import serving
from salescast.plans import explain
from salescast.plans import queries as Q


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_and_registry_consistent(spark):
    df = E.entry(spark)
    assert df.count() > 0
    from salescast.plans.oracle import SQL
    # every oracle written must have its query registered (and vice versa
    # only the documented rows-only keys lack an oracle)
    assert set(SQL) <= set(E.queries())
    rows_only = set(Q.QUERIES) - set(SQL)
    assert rows_only == {"model_leaderboard", "feature_importance", "model_registry", "recursive_forecast_tree",
                         "forecast_best_model"}


def test_recent_filter_pushed_to_scan(spark):
    d = Q._daily(spark, SF001)
    s = spark.read.parquet(f"{SF001}/lineitem.parquet").where("l_shipdate >= timestamp'2000-01-01'")
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in _plan(s.select("l_quantity"))
    plan = _plan(serving.recent_rows(d, 7))
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in plan


def _bad_single_partition(plan: str) -> list[str]:
    """Single-partition exchanges that do not just merge partial aggregates
    (one row per task) -- i.e. ones that would funnel facts into one task."""
    lines = plan.splitlines()
    bad = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1] if i + 1 < len(lines) else ""
            if not (("Aggregate(keys=[]" in child or "Aggregate(key=[]" in child) and "partial_" in child):
                bad.append(line.strip() + " <- " + child.strip())
    return bad


def test_no_single_partition_exchange_in_fact_operators(spark):
    for name in ("trend_seasonality", "lag_features", "anomaly_alerts", "feature_matrix", "time_split",
                 "tail_n", "score_features_asof", "trend_forecast", "daily_sales_dense", "per_series_ridge",
                 "forecast_product", "actual_vs_predicted"):
        df = E.queries()[name](spark, SF001)
        assert _bad_single_partition(_plan(df)) == [], name


def test_recent_rows_prune_store_months(spark, tmp_path):
    import datetime as dt

    from salescast.sources import store as store_io
    rows = [("A", dt.date(2023, m, 1), float(m)) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "series string, datum date, value double")
    root = str(tmp_path / "store")
    store_io.append_facts(df, root)
    st = store_io.read_table(spark, root, "sales_data")
    r = serving.recent_rows(st, days=40, as_of="2023-12-01")
    assert sorted(x.datum.month for x in r.collect()) == [11, 12]
    assert "PartitionFilters: [isnotnull(month" in _plan(r) and "GreaterThanOrEqual(datum" in _plan(r)


def test_final_plan_leaves_out_initial_trees_only():
    class Df:
        text = """AdaptiveSparkPlan isFinalPlan=true
+- == Final Plan ==
   Project
   :  +- Subquery subquery#1
   :     +- AdaptiveSparkPlan
   :        +- == Final Plan ==
   :           FileScan parquet lineitem.parquet
   :        +- == Initial Plan ==
   :           FileScan parquet lineitem.parquet
   +- FileScan parquet part.parquet
+- == Initial Plan ==
   FileScan parquet part.parquet"""
        _jdf = queryExecution = executedPlan = toString = None

    class Text(str):
        def __call__(self):
            return self

        queryExecution = executedPlan = toString = property(lambda self: self)

    Df._jdf = Text(Df.text)
    plan = explain.final_plan(Df)
    assert explain.scans(plan, "lineitem") == 1 and explain.scans(plan, "part") == 1


# fact scans of the final plan; a second one is an as_of date or bounds that are looked up in the facts
SCANS = {"daily_sales_dense": 1, "trend_seasonality": 1, "lag_features": 1, "anomaly_alerts": 1, "time_split": 1,
         "per_series_ridge": 1}


def test_fact_table_scanned_once(spark):
    """Plan branches over the daily roll-up share one scan of the facts
    (reused exchange) instead of re-reading lineitem per branch."""
    got = {}
    for name in SCANS:
        df = E.queries()[name](spark, SF001)
        df.collect()  # final adaptive plan
        got[name] = explain.scans(explain.final_plan(df), "lineitem")
    assert got == SCANS


def test_explicit_as_of_pushes_date_bound_to_fact_scan(spark):
    """With an explicit reference date the recent-window bound passes through
    the roll-up and reaches the parquet scan (row groups are skipped)."""
    from salescast.operators import trends
    df = trends.trend_direction(Q._daily(spark, SF001), as_of="2001-06-30")
    plan = _plan(df)
    scan = [ln for ln in plan.splitlines() if "FileScan" in ln and "lineitem.parquet" in ln]
    assert scan and "GreaterThanOrEqual(l_shipdate,2001-05-01T00:00)" in scan[0]
