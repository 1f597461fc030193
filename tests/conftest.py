import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from salescast.session import build_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
WIDE_FILE = os.environ.get("SALESCAST_WIDE_HISTORY", "")  # daily history CSV for golden tests


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", "salescast-tests", shuffle_partitions=8)
    yield s


def d(s):
    return dt.date.fromisoformat(s)


def daily_df(spark, rows):
    """rows: (series, 'yyyy-mm-dd', value)."""
    return spark.createDataFrame([(a, d(b), float(c) if c is not None else None) for a, b, c in rows],
                                 "series string, datum date, value double")


def consecutive(series, start, values):
    s = d(start)
    return [(series, (s + dt.timedelta(days=i)).isoformat(), v) for i, v in enumerate(values)]
