"""Every query with an oracle against DuckDB on the smallest tables."""
import math

import duckdb
import pytest
from conftest import SF001

import __spark_entry__ as E

SLOW = {"model_leaderboard", "feature_importance", "model_registry",
        "stream_process", "stream_anomaly", "stream_daily_rollup"}


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        s = v.isoformat()
        return s[:10] if s[10:] in ("", "T00:00:00") else s
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("part", "lineitem", "events", "orders", "documents", "embeddings", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(k for k in E.oracle_sql() if k not in SLOW))
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF001)
    s_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[key])
    d_cols = [x[0] for x in cur.description]
    d_rows = cur.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert _rows(df.columns, s_rows) == _rows(d_cols, d_rows)
