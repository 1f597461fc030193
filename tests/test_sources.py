import datetime as dt

from conftest import consecutive, daily_df
from pyspark.sql import functions as F

from salescast import schemas
from salescast.operators import report, series as ser, trends
from salescast.sources import wide


def test_wide_csv_unpadded_dates_and_unpivot(spark, tmp_path):
    header = "datum," + ",".join(schemas.WIDE_PRODUCTS) + ",Year,Month,Hour,Weekday Name"
    lines = [header,
             "1/2/2014,0,3.67,3.4,32.4,7,0,0,2,2014,1,248,Thursday",
             "1/3/2014,8,4,4.4,50.6,16,0,20,4,2014,1,276,Friday"]
    p = tmp_path / "daily.csv"
    p.write_text("\n".join(lines) + "\n")
    w = wide.read_wide_history(spark, str(p))
    assert [r.datum for r in w.orderBy("datum").collect()] == [dt.date(2014, 1, 2), dt.date(2014, 1, 3)]
    long = wide.wide_to_long(w)
    assert long.count() == 16
    tot = {r.datum.day: r.value for r in ser.total_series(long).collect()}
    assert abs(tot[2] - 48.47) < 1e-9 and abs(tot[3] - 107.0) < 1e-9
    back = wide.long_to_wide(long, schemas.WIDE_PRODUCTS)
    assert back.where(F.col("datum") == dt.date(2014, 1, 3)).first()["N02BE"] == 50.6


def test_report_lines(spark):
    df = daily_df(spark, consecutive("A", "2022-01-01", [float(i % 5) for i in range(400)]))
    t = ser.all_targets(df)
    rep = report.analysis_report(df, trends.trend_seasonality(t))
    r = rep.first()
    assert r.n_records == 400 and r.products == "A" and r.trend_direction in ("Increasing", "Decreasing")
    lines = [x.value for x in report.report_lines(rep).collect()]
    assert lines[0] == "Sales analysis report - Total_Sales" and lines[1] == "Records: 400"
