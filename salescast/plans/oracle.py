"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Tables are the driver's pre-registered views.  Shared CTEs mirror the
bindings in ``salescast.sources.tables``; every output column is aliased to
the name the Spark query uses, and non-exact floats are rounded the same way
on both sides.
"""

from __future__ import annotations

DAILY = """daily AS (
  SELECT p_type AS series, CAST(l_shipdate AS DATE) AS datum, SUM(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2)"""

EVENTS_DAILY = """edaily AS (
  SELECT event_type AS series, CAST(ts AS DATE) AS datum, SUM(value) AS value
  FROM events GROUP BY 1, 2)"""

# dense per-series calendar with zero fill
DENSE = DAILY + """,
bounds AS (SELECT series, MIN(datum) AS lo, MAX(datum) AS hi FROM daily GROUP BY 1),
cal AS (SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS datum FROM bounds),
dense AS (
  SELECT c.series, c.datum, COALESCE(d.value, 0.0) AS value
  FROM cal c LEFT JOIN daily d ON c.series = d.series AND c.datum = d.datum)"""

TOTAL = DAILY + """,
total AS (SELECT 'Total_Sales' AS series, datum, SUM(value) AS value FROM daily GROUP BY datum)"""

MONTHLY = """m AS (
  SELECT series, CAST(date_trunc('month', datum) AS DATE) AS month, SUM(value) AS total,
         COUNT(value) AS n_days
  FROM daily GROUP BY 1, 2),
mb AS (SELECT series, MIN(month) AS lo, MAX(month) AS hi FROM m GROUP BY 1),
spine AS (SELECT series, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM mb),
resampled AS (
  SELECT s.series, s.month, COALESCE(m.total, 0.0) AS total,
         CAST(datediff('month', s.lo, s.month) AS INTEGER) AS month_idx,
         COALESCE(m.n_days, 0) AS n_days
  FROM spine s LEFT JOIN m ON s.series = m.series AND s.month = m.month)"""


def _q(**kw: str) -> dict[str, str]:
    return {k: v.strip() for k, v in kw.items()}


SQL: dict[str, str] = {}

SQL.update(_q(
    scan_daily_sales=f"WITH {DAILY} SELECT series, datum, value FROM daily",
    trend_seasonality=f"""
WITH {DAILY}, {MONTHLY},
trend AS (SELECT series, regr_slope(total, month_idx) AS slope, COUNT(*) AS n_months
          FROM resampled GROUP BY 1),
moy AS (SELECT series, CAST(month(month) AS INTEGER) AS mo, SUM(total) / SUM(n_days) AS a
        FROM m GROUP BY 1, 2),
season AS (SELECT series, stddev_samp(a) / avg(a) AS strength,
                  first(mo ORDER BY a DESC, mo ASC) AS peak_month,
                  first(mo ORDER BY a ASC, mo ASC) AS low_month
           FROM moy GROUP BY 1)
SELECT t.series, ROUND(t.slope, 6) AS trend_slope,
       CASE WHEN t.slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend_direction,
       ROUND(s.strength, 6) AS seasonal_strength, s.peak_month, s.low_month, t.n_months
FROM trend t JOIN season s ON t.series = s.series""",
    monthly_resample=f"""
WITH {DAILY}, {MONTHLY}
SELECT series, month, total, month_idx, n_days FROM resampled""",
    seasonal_profile=f"""
WITH {DAILY}
SELECT series, CAST(month(datum) AS INTEGER) AS month, AVG(value) AS avg_value
FROM daily GROUP BY 1, 2""",
    monthly_trends=f"""
WITH {DAILY}
SELECT series, strftime(datum, '%Y-%m') AS month, AVG(value) AS avg_sales, COUNT(*) AS days_count
FROM daily GROUP BY 1, 2""",
    weekly_pattern=f"""
WITH {DAILY}
SELECT series, strftime(datum, '%w') AS day_of_week, AVG(value) AS avg_sales,
       CASE strftime(datum, '%w') WHEN '0' THEN 'Sunday' WHEN '1' THEN 'Monday'
         WHEN '2' THEN 'Tuesday' WHEN '3' THEN 'Wednesday' WHEN '4' THEN 'Thursday'
         WHEN '5' THEN 'Friday' ELSE 'Saturday' END AS day_name
FROM daily GROUP BY 1, 2, 4""",
    peak_low_day=f"""
WITH {DAILY},
wp AS (SELECT series, CAST(strftime(datum, '%w') AS INTEGER) AS dow, AVG(value) AS a
       FROM daily GROUP BY 1, 2),
named AS (SELECT series, dow, a,
       ['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'][dow + 1] AS day_name
       FROM wp)
SELECT series, first(day_name ORDER BY a DESC, dow ASC) AS peak_day,
       first(day_name ORDER BY a ASC, dow ASC) AS low_day
FROM named GROUP BY 1""",
    trend_direction=f"""
WITH {DAILY},
a AS (SELECT MAX(datum) AS as_of FROM daily),
f AS (SELECT d.series, d.value,
             CASE WHEN d.datum >= a.as_of - INTERVAL 30 DAY THEN 'recent' ELSE 'previous' END AS period
      FROM daily d, a WHERE d.datum >= a.as_of - INTERVAL 60 DAY),
g AS (SELECT series, AVG(CASE WHEN period = 'recent' THEN value END) AS recent_avg,
             AVG(CASE WHEN period = 'previous' THEN value END) AS previous_avg
      FROM f GROUP BY 1)
SELECT series, recent_avg, previous_avg,
       CASE WHEN previous_avg = 0 THEN NULL
            ELSE (recent_avg - previous_avg) / previous_avg * 100.0 END AS change_pct,
       CASE WHEN recent_avg IS NULL OR previous_avg IS NULL THEN 'stable'
            WHEN previous_avg = 0 AND recent_avg > 0 THEN 'increasing'
            WHEN previous_avg = 0 AND recent_avg < 0 THEN 'decreasing'
            WHEN (recent_avg - previous_avg) / previous_avg * 100.0 > 5 THEN 'increasing'
            WHEN (recent_avg - previous_avg) / previous_avg * 100.0 < -5 THEN 'decreasing'
            ELSE 'stable' END AS direction
FROM g""",
))


def _lag_cols(lags, fallback=False):
    out = []
    for k in lags:
        e = f"lag(value, {k}) OVER (PARTITION BY series ORDER BY datum)"
        if fallback:
            e = (f"COALESCE({e}, AVG(value) OVER (PARTITION BY series ORDER BY datum "
                 f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
        out.append(f"{e} AS lag_{k}")
    return out


def _roll_cols(windows, include_current=True):
    out = []
    for k in windows:
        if include_current:
            fr = f"OVER (PARTITION BY series ORDER BY datum ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
            out.append(f"CASE WHEN COUNT(value) {fr} = {k} THEN AVG(value) {fr} END AS rolling_{k}")
        else:
            fr = f"OVER (PARTITION BY series ORDER BY datum ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
            out.append(f"AVG(value) {fr} AS rolling_{k}")
    return out


LAGS = [1, 3, 7, 14, 30]
WINDOWS = [3, 7, 14, 30]
# Series domain of the p_type binding; a PIVOT inside a CTE needs its values
# spelled out.
P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_P_IN = ", ".join(f"'{x}'" for x in P_TYPES)

DENSE_GLOBAL = DAILY + """,
gb AS (SELECT MIN(datum) AS lo, MAX(datum) AS hi FROM daily),
ser AS (SELECT DISTINCT series FROM daily),
gcal AS (SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS datum FROM ser, gb),
gdense AS (
  SELECT c.series, c.datum, COALESCE(d.value, 0.0) AS value
  FROM gcal c LEFT JOIN daily d ON c.series = d.series AND c.datum = d.datum)"""

CAL_COLS = """CAST(year(datum) AS INTEGER) AS Year, CAST(month(datum) AS INTEGER) AS Month,
  CAST(isodow(datum) - 1 AS INTEGER) AS DayOfWeek, CAST(dayofyear(datum) AS INTEGER) AS DayOfYear,
  CAST(week(datum) AS INTEGER) AS WeekOfYear, CAST(quarter(datum) AS INTEGER) AS Quarter,
  CAST(CASE WHEN isodow(datum) IN (6, 7) THEN 1 ELSE 0 END AS INTEGER) AS IsWeekend"""

_fm_using = ", ".join([f"first(lag_{k}) AS lag_{k}" for k in LAGS]
                      + [f"first(rolling_{k}) AS rolling_{k}" for k in WINDOWS])

SQL.update(_q(
    daily_sales_dense=f"WITH {DENSE} SELECT series, datum, value FROM dense",
    total_sales=f"WITH {TOTAL} SELECT series, datum, value FROM total",
    all_targets=f"WITH {TOTAL} SELECT series, datum, value FROM daily UNION ALL SELECT series, datum, value FROM total",
    pivot_daily=f"WITH {DAILY} SELECT datum, " + ", ".join(
        f"SUM(CASE WHEN series = '{s}' THEN value END) AS \"{s}\"" for s in P_TYPES) + " FROM daily GROUP BY datum",
    unpivot_roundtrip=f"WITH {DAILY} SELECT series, datum, value FROM daily",
    calendar_features=f"WITH {TOTAL} SELECT datum, {CAL_COLS} FROM total",
    future_dates=f"""
WITH {DAILY}, l AS (SELECT series, MAX(datum) AS last FROM daily GROUP BY 1)
SELECT series, CAST(s AS INTEGER) AS step, CAST(last + s * INTERVAL 1 DAY AS DATE) AS datum
FROM l, generate_series(1, 30) g(s)""",
    tail_n=f"""
WITH {DAILY}
SELECT series, datum, value FROM daily
QUALIFY row_number() OVER (PARTITION BY series ORDER BY datum DESC) <= 30""",
    history_union_new=f"""
WITH {DAILY}, a AS (SELECT MAX(datum) AS as_of FROM daily)
SELECT series, datum, value, NULL::VARCHAR AS source FROM daily, a WHERE datum <= as_of - INTERVAL 30 DAY
UNION ALL
SELECT series, datum, value, 'new' AS source FROM daily, a WHERE datum > as_of - INTERVAL 30 DAY""",
    product_mix=f"""
WITH {TOTAL}, tm AS (SELECT AVG(value) AS m FROM total)
SELECT series, AVG(value) AS mean_value, AVG(value) / (SELECT m FROM tm) AS share
FROM daily GROUP BY series""",
    lag_features=f"WITH {DENSE} SELECT series, datum, value, {', '.join(_lag_cols(LAGS))} FROM dense",
    rolling_features=f"WITH {DENSE} SELECT series, datum, value, {', '.join(_roll_cols(WINDOWS))} FROM dense",
    feature_matrix=f"""
WITH {DENSE_GLOBAL},
f AS (SELECT series, datum, {', '.join(_lag_cols(LAGS) + _roll_cols(WINDOWS))}
      FROM gdense),
p AS (PIVOT f ON series IN ({_P_IN}) USING {_fm_using} GROUP BY datum),
t AS (SELECT datum, SUM(value) AS Total_Sales FROM gdense GROUP BY datum),
j AS (SELECT p.*, {CAL_COLS.replace('datum', 'p.datum')}, t.Total_Sales FROM p JOIN t ON p.datum = t.datum)
SELECT * FROM j WHERE COLUMNS(*) IS NOT NULL""",
    score_features_asof=f"""
WITH {DENSE}, a AS (SELECT MAX(datum) AS as_of FROM dense),
f AS (SELECT series, datum, value, {', '.join(_lag_cols(LAGS, True) + _roll_cols(WINDOWS, False))}
      FROM dense)
SELECT f.* FROM f, a WHERE datum > as_of - INTERVAL 7 DAY""",
    time_split=f"""
WITH {DENSE},
x AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY datum) - 1 AS pos,
             COUNT(*) OVER (PARTITION BY series) AS n FROM dense)
SELECT series, datum, value,
       CASE WHEN pos >= n - n // 6 THEN 'test' ELSE 'train' END AS split FROM x""",
    time_folds=f"""
WITH {DENSE},
x AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY datum) - 1 AS pos,
             COUNT(*) OVER (PARTITION BY series) AS n FROM dense)
SELECT series, datum, value,
       CAST(CASE WHEN n // 6 > 0 AND pos >= n - 5 * (n // 6)
                 THEN (pos - (n - 5 * (n // 6))) // (n // 6) END AS INTEGER) AS test_fold FROM x""",
))


TARGETS = TOTAL + """,
targets AS (SELECT series, datum, value FROM daily UNION ALL SELECT series, datum, value FROM total)"""

STORE = DENSE + """,
store AS (SELECT series, datum, value,
                 lag(value, 7) OVER (PARTITION BY series ORDER BY datum) AS predicted,
                 'history' AS source, CAST(datum AS TIMESTAMP) AS ingest_ts FROM dense)"""

ALERTS = TARGETS + """,
scored AS (
  SELECT series, datum, value,
         COUNT(value) OVER w AS n, AVG(value) OVER w AS baseline_mean, STDDEV_SAMP(value) OVER w AS baseline_std
  FROM targets
  WINDOW w AS (PARTITION BY series ORDER BY datum RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW)),
alerts AS (
  SELECT series, datum, value, n, baseline_mean, baseline_std,
         CASE WHEN value > baseline_mean THEN 'high_sales' ELSE 'low_sales' END AS alert_type,
         CASE WHEN abs(value - baseline_mean) > 3 * baseline_std THEN 'high' ELSE 'medium' END AS severity
  FROM scored WHERE n >= 5 AND abs(value - baseline_mean) > 2 * baseline_std)"""

REGISTRY = TARGETS + """,
registry AS (SELECT series AS target FROM daily GROUP BY series  -- one complete feature row (30 lags) at least
             HAVING datediff('day', MIN(datum), MAX(datum)) + 1 > 30),
dim AS (SELECT DISTINCT p_type AS code FROM part),
dimn AS (SELECT code, concat(upper(code[1]), lower(code[2:]), ' product line (part type ', code, ')') AS name FROM dim),
catalog AS (SELECT d.code, d.name, substr(d.name, 1, 50) AS label, r.target IS NOT NULL AS has_model
            FROM dimn d LEFT JOIN (SELECT DISTINCT target FROM registry) r ON d.code = r.target)"""

TREND_FC = TARGETS + """,
a AS (SELECT MAX(datum) AS as_of FROM targets),
lvl AS (SELECT t.series, AVG(t.value) AS level FROM targets t, a WHERE t.datum >= a.as_of - INTERVAL 30 DAY GROUP BY 1),
ser AS (SELECT DISTINCT series FROM targets),
spine AS (SELECT s.series, CAST(g.step AS INTEGER) AS step, CAST(a.as_of + g.step * INTERVAL 1 DAY AS DATE) AS datum
          FROM ser s, a, generate_series(1, 30) g(step)),
fc AS (SELECT sp.series, sp.datum, sp.step,
              ROUND(GREATEST(0.0, COALESCE(l.level, 50.0)
                    * (1.0 + 0.1 * sin(2 * pi() * dayofyear(sp.datum) / 365))
                    * CASE WHEN isodow(sp.datum) IN (6, 7) THEN 0.8 ELSE 1.0 END), 2) AS predicted_sales,
              'trend_based' AS model_used
       FROM spine sp LEFT JOIN lvl l ON sp.series = l.series)"""

EV_PAY = """ed AS (SELECT event_type AS series, CAST(ts AS DATE) AS datum, ROUND(SUM(value), 2) AS value
       FROM events GROUP BY 1, 2)"""

SQL.update(_q(
    anomaly_baseline=f"""
WITH {TARGETS}, a AS (SELECT MAX(datum) AS as_of FROM targets)
SELECT series, COUNT(value) AS n, AVG(value) AS mean_sales, ROUND(STDDEV_SAMP(value), 6) AS std_sales,
       COUNT(value) >= 5 AS usable
FROM targets, a WHERE datum >= as_of - INTERVAL 30 DAY GROUP BY series""",
    anomaly_alerts=f"""
WITH {ALERTS}
SELECT series, datum, value, n, baseline_mean, ROUND(baseline_std, 6) AS baseline_std, alert_type, severity
FROM alerts""",
    recent_alerts=f"""
WITH {ALERTS}, t AS (SELECT CAST(datum AS TIMESTAMP) AS ts, * FROM alerts)
SELECT ts, series, datum, alert_type, severity FROM t
WHERE ts >= (SELECT MAX(ts) FROM t) - INTERVAL 7 DAY""",
    latest_alerts=f"""
WITH {ALERTS}, t AS (SELECT CAST(datum AS TIMESTAMP) AS ts, * FROM alerts)
SELECT ts, series, datum, alert_type, severity FROM t
ORDER BY ts DESC, series ASC, alert_type ASC LIMIT 20""",
    recent_data=f"""
WITH {STORE}
SELECT series, datum, value, predicted FROM store WHERE datum >= (SELECT MAX(datum) FROM store) - INTERVAL 7 DAY""",
    store_status=f"""
WITH {STORE}
SELECT COUNT(*) AS total_records, MAX(datum) AS last_datum,
       COUNT(*) FILTER (WHERE predicted IS NOT NULL AND predicted > 0) AS rows_with_prediction FROM store""",
    latest_predictions=f"""
WITH {STORE}
SELECT series, datum, value, predicted, ingest_ts FROM store
ORDER BY ingest_ts DESC, datum DESC, series ASC LIMIT 10""",
    actual_vs_predicted=f"""
WITH {STORE}
SELECT d.series, d.datum, d.value AS actual, s.predicted
FROM daily d JOIN store s ON d.series = s.series AND d.datum = s.datum
WHERE s.predicted IS NOT NULL AND s.predicted > 0
QUALIFY row_number() OVER (PARTITION BY d.series ORDER BY d.datum DESC) <= 30""",
    actual_vs_predicted_range=f"""
WITH {STORE}
SELECT d.series, LEAST(MIN(d.value), MIN(s.predicted)) AS range_min,
       GREATEST(MAX(d.value), MAX(s.predicted)) AS range_max, COUNT(*) AS n_pairs
FROM daily d JOIN store s ON d.series = s.series AND d.datum = s.datum
WHERE s.predicted > 0 GROUP BY d.series""",
    backfill_predictions=f"""
WITH {STORE},
means AS (SELECT series, ROUND(AVG(value), 2) AS new_pred FROM store GROUP BY series),
todo AS (SELECT series, datum FROM store WHERE predicted IS NULL OR predicted = 0
         QUALIFY row_number() OVER (PARTITION BY series ORDER BY datum DESC) <= 50),
scores AS (SELECT t.series, t.datum, m.new_pred FROM todo t JOIN means m ON t.series = m.series)
SELECT s.series, s.datum, s.value, COALESCE(sc.new_pred, s.predicted) AS predicted
FROM store s LEFT JOIN scores sc ON s.series = sc.series AND s.datum = sc.datum""",
    product_catalog=f"WITH {REGISTRY} SELECT code, name, label, has_model FROM catalog",
    products_with_models=f"""
WITH {REGISTRY} SELECT code, name FROM dimn WHERE code IN (SELECT target FROM registry)""",
    catalog_summary=f"""
WITH {REGISTRY} SELECT COUNT(*) AS n_products, COUNT(*) FILTER (WHERE has_model) AS n_with_models FROM catalog""",
    trend_forecast=f"WITH {TREND_FC} SELECT series, datum, step, predicted_sales, model_used FROM fc",
    forecast_summary=f"""
WITH {TREND_FC}
SELECT series, ROUND(AVG(predicted_sales), 6) AS mean_forecast,
       CASE WHEN arg_max(predicted_sales, step) > arg_min(predicted_sales, step) THEN 'up' ELSE 'down' END AS direction,
       COUNT(*) AS horizon
FROM fc GROUP BY series""",
    forecast_metrics=f"""
WITH {DENSE},
f AS (SELECT series, datum, value,
             lag(value, 1) OVER (PARTITION BY series ORDER BY datum) AS lag_1,
             lag(value, 7) OVER (PARTITION BY series ORDER BY datum) AS lag_7,
             CASE WHEN COUNT(value) OVER w7 = 7 THEN AVG(value) OVER w7 END AS rolling_7,
             row_number() OVER (PARTITION BY series ORDER BY datum) - 1 AS pos,
             COUNT(*) OVER (PARTITION BY series) AS cnt
      FROM dense WINDOW w7 AS (PARTITION BY series ORDER BY datum ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
t AS (SELECT * FROM f WHERE pos >= cnt - cnt // 6),
l AS (SELECT series, value AS actual, 'naive_lag1' AS model, lag_1 AS predicted FROM t
      UNION ALL SELECT series, value, 'naive_lag7', lag_7 FROM t
      UNION ALL SELECT series, value, 'mean_7', rolling_7 FROM t),
g AS (SELECT series, model, COUNT(*) AS n, SUM(abs(actual - predicted)) AS sae,
             SUM((actual - predicted) * (actual - predicted)) AS sse, SUM(actual) AS sy, SUM(actual * actual) AS syy
      FROM l WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY 1, 2)
SELECT series, model, n, ROUND(sae / n, 6) AS mae, ROUND(sqrt(sse / n), 6) AS rmse,
       ROUND(1.0 - sse / (syy - sy * sy / n), 6) AS r2 FROM g""",
    standardize=f"""
WITH {DENSE},
x AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY datum) - 1 AS pos,
             COUNT(*) OVER (PARTITION BY series) AS n FROM dense),
s AS (SELECT series, datum, value, CASE WHEN pos >= n - n // 6 THEN 'test' ELSE 'train' END AS split FROM x),
st AS (SELECT series, AVG(value) AS m, STDDEV_POP(value) AS sd FROM s WHERE split = 'train' GROUP BY series)
SELECT s.series, s.datum, s.value, s.split,
       ROUND(COALESCE(CASE WHEN st.sd = 0 THEN NULL ELSE (s.value - st.m) / st.sd END, 0.0), 6) AS value_z
FROM s JOIN st ON s.series = st.series""",
    ingest_validate=f"""
WITH {EV_PAY}, g AS (SELECT datum, CAST(COUNT(*) AS INTEGER) AS n FROM ed GROUP BY datum)
SELECT datum, n AS n_products, NULL::VARCHAR AS reason FROM g
UNION ALL SELECT NULL, NULL, 'malformed_json' FROM g
UNION ALL SELECT NULL, n, 'missing_datum' FROM g
UNION ALL SELECT NULL, n, 'bad_datum' FROM g
UNION ALL SELECT datum, NULL, 'missing_sales' FROM g""",
    ingest_unknown_codes=f"""
WITH {EV_PAY} SELECT datum, series AS code, value FROM ed WHERE series = (SELECT MIN(event_type) FROM events)""",
    ingest_explode=f"""
WITH {EV_PAY},
days AS (SELECT DISTINCT datum FROM ed), types AS (SELECT DISTINCT event_type AS series FROM events)
SELECT t.series, d.datum, COALESCE(e.value, 0.0) AS value
FROM days d CROSS JOIN types t LEFT JOIN ed e ON e.datum = d.datum AND e.series = t.series""",
    records_json=f"""
WITH {DAILY}
SELECT to_json({{'series': series, 'datum': datum, 'value': value}}) AS json FROM daily""",
))


SQL.update(_q(
    recursive_forecast=f"""
WITH RECURSIVE {DENSE},
init AS (SELECT series, MAX(datum) AS last,
                list_reverse((list(value ORDER BY datum DESC))[1:30]) AS buf
         FROM dense GROUP BY series),
r(series, last, step, buf, pred) AS (
  SELECT series, last, 0, buf, CAST(NULL AS DOUBLE) FROM init
  UNION ALL
  SELECT series, last, s1, list_append(buf, GREATEST(0.0, p))[2:], p FROM (
    SELECT series, last, buf, step + 1 AS s1,
           2.0::DOUBLE
           + (-3.0)::DOUBLE * CAST(CASE WHEN isodow(CAST(last + (step + 1) * INTERVAL 1 DAY AS DATE)) IN (6, 7)
                                         THEN 1 ELSE 0 END AS DOUBLE)
           + 0.5::DOUBLE * buf[-1]
           + 0.2::DOUBLE * buf[-7]
           + 0.1::DOUBLE * ((((0.0::DOUBLE + buf[-3]) + buf[-2]) + buf[-1]) / 3) AS p
    FROM r WHERE step < 30) x)
SELECT series, CAST(step AS INTEGER) AS step, CAST(last + step * INTERVAL 1 DAY AS DATE) AS datum,
       ROUND(GREATEST(0.0, pred), 6) AS predicted, 'fixed_linear' AS model_used
FROM r WHERE step > 0""",
    score_new_points=f"""
WITH {DENSE}, a AS (SELECT MAX(datum) AS as_of FROM dense),
f AS (SELECT series, datum, value, {', '.join(_lag_cols(LAGS, True) + _roll_cols(WINDOWS, False))}
      FROM dense)
SELECT series, datum, value,
       ROUND(GREATEST(0.0, 1.0::DOUBLE + 0.3::DOUBLE * lag_1 + 0.3::DOUBLE * lag_7
                      + 0.2::DOUBLE * rolling_7 + 0.1::DOUBLE * rolling_30), 2) AS predicted
FROM f, a WHERE datum > as_of - INTERVAL 7 DAY""",
))


STREAM_FACTS = """ed AS (SELECT event_type AS series, CAST(ts AS DATE) AS datum, ROUND(SUM(value), 2) AS value
       FROM events GROUP BY 1, 2),
days AS (SELECT DISTINCT datum FROM ed), types AS (SELECT DISTINCT event_type AS series FROM events),
prod AS (SELECT t.series, d.datum, COALESCE(e.value, 0.0) AS value
         FROM days d CROSS JOIN types t LEFT JOIN ed e ON e.datum = d.datum AND e.series = t.series),
facts AS (SELECT series, datum, value FROM prod
          UNION ALL SELECT 'Total_Sales', datum, SUM(value) FROM prod GROUP BY datum)"""

SQL.update(_q(
    stream_process=f"""
WITH {STREAM_FACTS},
f AS (SELECT series, datum, value, lag(value, 1) OVER w AS lag_1, lag(value, 7) OVER w AS lag_7,
             CASE WHEN COUNT(value) OVER w7 = 7 THEN AVG(value) OVER w7 END AS rolling_7,
             AVG(value) OVER w7 AS mean_7, AVG(value) OVER before AS mean_before
      FROM facts WINDOW w AS (PARTITION BY series ORDER BY datum),
        w7 AS (PARTITION BY series ORDER BY datum ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
        before AS (PARTITION BY series ORDER BY datum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY datum) - 1 AS pos, COUNT(*) OVER (PARTITION BY series) AS n
      FROM f WHERE lag_7 IS NOT NULL AND rolling_7 IS NOT NULL),
l AS (SELECT series, value AS y, pos >= n - n // 6 AS test, 'Lag1' AS model, lag_1 AS x FROM p
      UNION ALL SELECT series, value, pos >= n - n // 6, 'Lag7', lag_7 FROM p
      UNION ALL SELECT series, value, pos >= n - n // 6, 'Mean7', rolling_7 FROM p),
c AS (SELECT series, model, regr_slope(y, x) AS w, regr_intercept(y, x) AS b FROM l WHERE NOT test GROUP BY 1, 2),
m AS (SELECT l.series, l.model, w, b, 1.0 - sum((y - b - w * x) * (y - b - w * x)) / (var_pop(y) * COUNT(*)) AS r2
      FROM l JOIN c ON l.series = c.series AND l.model = c.model WHERE test GROUP BY 1, 2, 3, 4),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY series ORDER BY r2 DESC, model) = 1)
SELECT f.series, datum, ROUND(value, 6) AS value,
       ROUND(GREATEST(0.0, b + w * COALESCE(CASE model WHEN 'Lag1' THEN COALESCE(lag_1, mean_before)
             WHEN 'Lag7' THEN COALESCE(lag_7, mean_before) ELSE mean_7 END, 0.0)), 2) AS predicted
FROM f JOIN best ON f.series = best.series""",
    stream_anomaly=f"""
WITH {STREAM_FACTS},
scored AS (
  SELECT series, datum, value,
         COUNT(value) OVER w AS n, AVG(value) OVER w AS baseline_mean, STDDEV_SAMP(value) OVER w AS baseline_std
  FROM facts
  WINDOW w AS (PARTITION BY series ORDER BY datum RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW))
SELECT series, datum, ROUND(value, 6) AS value, n, ROUND(baseline_mean, 6) AS baseline_mean,
       ROUND(baseline_std, 6) AS baseline_std,
       CASE WHEN value > baseline_mean THEN 'high_sales' ELSE 'low_sales' END AS alert_type,
       CASE WHEN abs(value - baseline_mean) > 3 * baseline_std THEN 'high' ELSE 'medium' END AS severity
FROM scored WHERE n >= 5 AND abs(value - baseline_mean) > 2 * baseline_std""",
    stream_daily_rollup=f"""
SELECT event_type AS series, CAST(ts AS DATE) AS datum, ROUND(SUM(value), 6) AS value, COUNT(*) AS n_events
FROM events GROUP BY 1, 2""",
))


SQL.update(_q(
    analysis_report=f"""
WITH {TARGETS}, {MONTHLY.replace('FROM daily', 'FROM targets')},
trend AS (SELECT series, regr_slope(total, month_idx) AS slope FROM resampled GROUP BY 1),
moy AS (SELECT series, CAST(month(month) AS INTEGER) AS mo, SUM(total) / SUM(n_days) AS a FROM m GROUP BY 1, 2),
season AS (SELECT series, stddev_samp(a) / avg(a) AS strength,
                  first(mo ORDER BY a DESC, mo ASC) AS peak_month, first(mo ORDER BY a ASC, mo ASC) AS low_month
           FROM moy GROUP BY 1),
tt AS (SELECT t.slope, s.strength, s.peak_month, s.low_month FROM trend t JOIN season s USING (series)
       WHERE series = 'Total_Sales'),
a AS (SELECT MAX(datum) AS as_of FROM targets),
lvl AS (SELECT AVG(t.value) AS level FROM targets t, a WHERE t.series = 'Total_Sales' AND t.datum >= a.as_of - INTERVAL 30 DAY),
fc AS (SELECT ROUND(GREATEST(0.0, COALESCE((SELECT level FROM lvl), 50.0)
                * (1.0 + 0.1 * sin(2 * pi() * dayofyear(d) / 365))
                * CASE WHEN isodow(d) IN (6, 7) THEN 0.8 ELSE 1.0 END), 2) AS p
       FROM (SELECT CAST(as_of + g * INTERVAL 1 DAY AS DATE) AS d FROM a, generate_series(1, 30) x(g)))
SELECT (SELECT COUNT(*) FROM daily) AS n_records, (SELECT MIN(datum) FROM daily) AS first_date,
       (SELECT MAX(datum) FROM daily) AS last_date,
       (SELECT string_agg(series, ', ' ORDER BY series) FROM (SELECT DISTINCT series FROM daily)) AS products,
       ROUND(slope, 6) AS trend_slope, CASE WHEN slope > 0 THEN 'Increasing' ELSE 'Decreasing' END AS trend_direction,
       ROUND(strength, 6) AS seasonal_strength, peak_month, low_month,
       (SELECT ROUND(AVG(p), 6) FROM fc) AS forecast_mean, (SELECT COUNT(*) FROM fc) AS forecast_days
FROM tt""",
    store_roundtrip=f"""
WITH {STORE}
SELECT series, datum, value, predicted, source, ingest_ts, strftime(datum, '%Y-%m') AS month FROM store""",
))
SQL["stream_anomaly_state"] = SQL["stream_anomaly"]
SQL["backfill_store"] = SQL["backfill_predictions"]


SQL.update(_q(
    stream_predictions=f"""
WITH {STREAM_FACTS},
f AS (SELECT series, datum, value, {', '.join(_lag_cols(LAGS, True) + _roll_cols(WINDOWS, False))}
      FROM facts)
SELECT datum AS prediction_date, series AS target_product,
       ROUND(GREATEST(0.0, 1.0::DOUBLE + 0.3::DOUBLE * COALESCE(lag_1, 0.0) + 0.3::DOUBLE * COALESCE(lag_7, 0.0)
                      + 0.2::DOUBLE * COALESCE(rolling_7, 0.0) + 0.1::DOUBLE * COALESCE(rolling_30, 0.0)),
             6) AS predicted_value,
       'fixed_linear' AS model_used
FROM f""",
))


SQL["predictions_long"] = f"""
WITH fc_trend AS ({SQL["trend_forecast"]}),
     fc_fold AS ({SQL["recursive_forecast"]})
SELECT datum AS prediction_date, series AS target_product, predicted_sales AS predicted_value, model_used
FROM fc_trend
UNION ALL
SELECT datum, series, predicted, model_used FROM fc_fold"""


SQL["time_split_panel"] = f"""
WITH {DENSE}, b AS (SELECT MIN(datum) AS lo, MAX(datum) AS hi FROM dense)
SELECT series, datum, value,
       CASE WHEN datediff('day', datum, hi) < (datediff('day', lo, hi) + 1) // 6 THEN 'test' ELSE 'train' END AS split
FROM dense, b"""


# --- recursive forecasts over the buffers of all series ---------------------------
_WE = ("CAST(CASE WHEN isodow(CAST(last + (step + 1) * INTERVAL 1 DAY AS DATE)) IN (6, 7) "
       "THEN 1 ELSE 0 END AS DOUBLE)")
_BUFS = ", ".join(f"(SELECT list_reverse((list(value ORDER BY datum DESC))[1:30]) FROM gdense "
                  f"WHERE series = '{s}') AS b{p}" for p, s in enumerate(P_TYPES))
_B = ", ".join(f"b{p}" for p in range(len(P_TYPES)))
_S = ", ".join(f"s{p}" for p in range(len(P_TYPES)))


def _tail_mean(b, w):
    return f"(list_sum({b}[-{w}:]) / {w})"


SQL["recursive_forecast_total"] = f"""
WITH RECURSIVE {DENSE_GLOBAL},
warm AS (SELECT g.series, g.datum, g.value FROM gdense g, gb WHERE g.datum >= gb.lo + INTERVAL 30 DAY),
tot AS (SELECT AVG(v) AS m FROM (SELECT SUM(value) AS v FROM warm GROUP BY datum)),
init AS (SELECT (SELECT MAX(datum) FROM gdense) AS last, {_BUFS}, {", ".join(
    f"(SELECT AVG(value) FROM warm WHERE series = '{s}') / (SELECT m FROM tot) AS s{p}" for p, s in enumerate(P_TYPES))}),
r(step, last, {_B}, {_S}, pred) AS (
  SELECT 0, last, {_B}, {_S}, CAST(NULL AS DOUBLE) FROM init
  UNION ALL
  SELECT step + 1, last, {", ".join(f"list_append(b{p}, s{p} * p)[2:]" for p in range(len(P_TYPES)))}, {_S}, p
  FROM (SELECT *, 5.0::DOUBLE - 2.0::DOUBLE * {_WE} + {" + ".join(
      f"0.3::DOUBLE * b{p}[-1] + 0.2::DOUBLE * b{p}[-7] + 0.1::DOUBLE * {_tail_mean(f'b{p}', 3)}"
      for p in range(len(P_TYPES)))} AS p FROM r WHERE step < 30) x)
SELECT 'Total_Sales' AS series, CAST(step AS INTEGER) AS step, CAST(last + step * INTERVAL 1 DAY AS DATE) AS datum,
       ROUND(GREATEST(0.0, pred), 6) AS predicted, 'fixed_linear' AS model_used
FROM r WHERE step > 0"""

# A target's own buffer takes its predictions; the other buffers repeat their last value.
SQL["recursive_forecast_sibling"] = f"""
WITH RECURSIVE {DENSE_GLOBAL},
buf AS (SELECT series, MAX(datum) AS last, list_reverse((list(value ORDER BY datum DESC))[1:30]) AS b
        FROM gdense GROUP BY series),
sib AS (SELECT t.series, s.series AS other, s.b FROM buf t JOIN buf s ON t.series <> s.series),
steps AS (SELECT CAST(i AS INTEGER) AS i FROM generate_series(0, 29) g(i)),
moved AS (SELECT series, i, b[-1] AS last_value,
                 list_concat(b, list_resize([]::DOUBLE[], i, b[-1]))[-30:] AS b FROM sib, steps),
other AS (SELECT series, i, SUM(0.05::DOUBLE * last_value + 0.02::DOUBLE * list_avg(b)) AS add FROM moved GROUP BY 1, 2),
r(series, step, last, b, pred) AS (
  SELECT series, 0, last, b, CAST(NULL AS DOUBLE) FROM buf
  UNION ALL
  SELECT series, step + 1, last, list_append(b, p)[2:], p
  FROM (SELECT r.series, r.step, r.last, r.b,
               2.0::DOUBLE - 1.0::DOUBLE * {_WE} + 0.4::DOUBLE * b[-1] + 0.2::DOUBLE * b[-7]
               + 0.2::DOUBLE * {_tail_mean('b', 7)} + o.add AS p
        FROM r JOIN other o ON o.series = r.series AND o.i = r.step WHERE step < 30) x)
SELECT series, CAST(step AS INTEGER) AS step, CAST(last + step * INTERVAL 1 DAY AS DATE) AS datum,
       ROUND(GREATEST(0.0, pred), 6) AS predicted, 'fixed_linear' AS model_used
FROM r WHERE step > 0"""


# --- linear models: ridge by Gauss-Jordan elimination on the scaled normal equations ------
_OWN = ["Year", "Month", "DayOfWeek", "DayOfYear", "WeekOfYear", "Quarter", "IsWeekend"] \
    + [f"lag_{k}" for k in LAGS] + [f"rolling_{k}" for k in WINDOWS]
_NONNULL = f"lag_{max(LAGS)} IS NOT NULL AND rolling_{max(WINDOWS)} IS NOT NULL"


def _ridge(k: int) -> str:
    """`weights` (series, w, b), from `tr` (series, datum, x DOUBLE[k], y): ridge(1) on features of unit variance."""
    return f"""
lng AS (SELECT series, datum, unnest(x) AS v, unnest(generate_series(1, {k})) AS j FROM tr),
st AS (SELECT series, j, avg(v) AS mu, CASE WHEN max(v) > min(v) THEN stddev_pop(v) END AS sd FROM lng GROUP BY 1, 2),
sy AS (SELECT series, avg(y) AS ybar FROM tr GROUP BY 1),
z AS (SELECT l.series, l.datum, l.j, COALESCE((l.v - st.mu) / st.sd, 0.0) AS z FROM lng l JOIN st USING (series, j)),
gram AS (SELECT a.series, a.j AS i, b.j AS j, sum(a.z * b.z) + CASE WHEN a.j = b.j THEN 1.0 ELSE 0.0 END AS g
         FROM z a JOIN z b ON a.series = b.series AND a.datum = b.datum GROUP BY 1, 2, 3),
rhs AS (SELECT z.series, z.j AS i, sum(z.z * (tr.y - sy.ybar)) AS c
        FROM z JOIN tr USING (series, datum) JOIN sy USING (series) GROUP BY 1, 2),
{_eliminate(k)}"""


def _eliminate(k: int) -> str:
    return f"""
mrow AS (SELECT g.series, g.i, list_append(list(g.g ORDER BY g.j), any_value(r.c)) AS r
         FROM gram g JOIN rhs r ON g.series = r.series AND g.i = r.i GROUP BY 1, 2),
gj(series, k, m) AS (
  SELECT series, 1, list(r ORDER BY i) FROM mrow GROUP BY 1
  UNION ALL
  SELECT series, k + 1,
         [CASE WHEN i = k THEN [v / m[k][k] FOR v IN m[k]]
               ELSE [m[i][j] - m[i][k] / m[k][k] * m[k][j] FOR j IN generate_series(1, {k + 1})] END
          FOR i IN generate_series(1, {k})]
  FROM gj WHERE k <= {k}),
sol AS (SELECT series, unnest([r[{k + 1}] FOR r IN m]) AS w, unnest(generate_series(1, {k})) AS j FROM gj WHERE k = {k + 1}),
weights AS (SELECT sol.series, list(COALESCE(sol.w / st.sd, 0.0) ORDER BY sol.j) AS w,
                   any_value(sy.ybar) - sum(COALESCE(sol.w / st.sd, 0.0) * st.mu) AS b
            FROM sol JOIN st ON sol.series = st.series AND sol.j = st.j JOIN sy ON sol.series = sy.series GROUP BY 1)"""


SERIES_ROWS = DENSE + f""",
f AS (SELECT series, datum, value, {CAL_COLS}, {', '.join(_lag_cols(LAGS) + _roll_cols(WINDOWS))} FROM dense),
p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY datum) - 1 AS pos, COUNT(*) OVER (PARTITION BY series) AS n
      FROM f WHERE {_NONNULL}),
panel AS (SELECT series, datum, value AS y, [{', '.join(f'CAST({c} AS DOUBLE)' for c in _OWN)}] AS x, lag_1, lag_7, rolling_7,
                 CASE WHEN n // 6 > 0 AND pos >= n - 5 * (n // 6) THEN (pos - (n - 5 * (n // 6))) // (n // 6) END AS test_fold,
                 pos >= n - n // 6 AS test FROM p)"""
SERIES_RIDGE = SERIES_ROWS + f""",
tr AS (SELECT * FROM panel WHERE NOT test),{_ridge(len(_OWN))}"""

_METRICS = """COUNT(*) AS n, ROUND(avg(abs(y - p)), 6) AS mae, ROUND(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
       ROUND(1.0 - sum((y - p) * (y - p)) / (var_pop(y) * COUNT(*)), 6) AS r2"""

SQL.update(_q(
    cross_validation=f"""
WITH {SERIES_ROWS},
l AS (SELECT series, y, test_fold, 'Lag1' AS model, lag_1 AS v FROM panel
      UNION ALL SELECT series, y, test_fold, 'Lag7', lag_7 FROM panel
      UNION ALL SELECT series, y, test_fold, 'Mean7', rolling_7 FROM panel),
c AS (SELECT series, model, fold, regr_slope(y, v) AS w, regr_intercept(y, v) AS b
      FROM l, generate_series(0, 4) g(fold) WHERE test_fold IS NULL OR test_fold < fold GROUP BY 1, 2, 3),
s AS (SELECT l.series, l.model, c.fold, l.y, c.b + c.w * l.v AS p
      FROM l JOIN c ON l.series = c.series AND l.model = c.model AND l.test_fold = c.fold)
SELECT series, model, CAST(fold AS INTEGER) AS fold, {_METRICS} FROM s GROUP BY 1, 2, 3""",
    linear_optimality=f"""
WITH {SERIES_ROWS},
k AS (SELECT series, unnest({_OWN}) AS feature, unnest(x) AS v FROM panel WHERE NOT test)
SELECT series, model, feature, 0.0::DOUBLE AS violation
FROM (SELECT series, feature FROM k GROUP BY 1, 2 HAVING max(v) > min(v)), (VALUES ('Ridge'), ('ElasticNet')) m(model)""",
    per_series_ridge=f"""
WITH RECURSIVE {SERIES_RIDGE},
s AS (SELECT series, y, b + list_dot_product(w, x) AS p FROM panel JOIN weights USING (series) WHERE test)
SELECT series, 'ridge' AS model, {_METRICS} FROM s GROUP BY 1""",
    score_recent=f"""
WITH RECURSIVE {SERIES_RIDGE}
SELECT series, datum, y AS actual, ROUND(GREATEST(0.0, b + list_dot_product(w, x)), 2) AS predicted
FROM panel JOIN weights USING (series)
QUALIFY row_number() OVER (PARTITION BY series ORDER BY datum DESC) <= 30""",
))

# --- models of every target over the features of all series -----------------------------
# Places in a day's vector: 7 of the calendar, lags of each series, rolling means of each, values, the total.
_P = len(P_TYPES)
_LAG0, _ROLL0 = 7, 7 + _P * len(LAGS)
_VAL0 = _ROLL0 + _P * len(WINDOWS)
_K = _VAL0 + _P
_CAL_LIST = "[CAST(v AS DOUBLE) FOR v IN [year(datum), month(datum), isodow(datum) - 1, dayofyear(datum), week(datum), " \
    "quarter(datum), CASE WHEN isodow(datum) IN (6, 7) THEN 1 ELSE 0 END]]"

TARGET_ROWS = DENSE_GLOBAL + f""",
f AS (SELECT series, datum, value, {', '.join(_lag_cols(LAGS) + _roll_cols(WINDOWS))} FROM gdense),
d AS (SELECT datum, list_concat(list_concat({_CAL_LIST},
               flatten(list([{', '.join(f'lag_{k}' for k in LAGS)}] ORDER BY series))),
               list_concat(flatten(list([{', '.join(f'rolling_{k}' for k in WINDOWS)}] ORDER BY series)),
                           list(value ORDER BY series))) AS x, sum(value) AS total
      FROM f WHERE {_NONNULL} GROUP BY datum),
v AS (SELECT *, row_number() OVER (ORDER BY datum) - 1 AS pos, COUNT(*) OVER () AS n FROM d),
names AS (SELECT series, row_number() OVER (ORDER BY series) AS t FROM (SELECT DISTINCT series FROM gdense)
          UNION ALL SELECT 'Total_Sales', {_P + 1}),
days AS (SELECT datum, x, list_append(x[{_VAL0 + 1}:], total) AS ys, pos >= n - n // 6 AS test FROM v),
lng AS (SELECT datum, ys, unnest(x) AS v, unnest(generate_series(1, {_K})) AS j FROM days WHERE NOT test),
st1 AS (SELECT j, avg(v) AS mu, CASE WHEN max(v) > min(v) THEN stddev_pop(v) END AS sd FROM lng GROUP BY 1),
z AS (SELECT datum, j, ys, COALESCE((v - mu) / sd, 0.0) AS z FROM lng JOIN st1 USING (j)),
g1 AS (SELECT a.j AS i, b.j AS j, sum(a.z * b.z) AS g FROM z a JOIN z b ON a.datum = b.datum GROUP BY 1, 2),
use AS (SELECT series, t, j, j <= {_VAL0} OR (t <= {_P} AND j <> {_VAL0} + t) AS u FROM names, generate_series(1, {_K}) x(j)),
st AS (SELECT series, j, mu, CASE WHEN u THEN sd END AS sd FROM use JOIN st1 USING (j)),
sy AS (SELECT series, avg(ys[t]) AS ybar FROM days, names WHERE NOT test GROUP BY 1),
gram AS (SELECT a.series, a.j AS i, b.j AS j, CASE WHEN a.u AND b.u THEN g1.g ELSE 0.0 END
                + CASE WHEN a.j = b.j THEN 1.0 ELSE 0.0 END AS g
         FROM use a JOIN use b ON a.series = b.series JOIN g1 ON g1.i = a.j AND g1.j = b.j),
rhs AS (SELECT u.series, z.j AS i, sum(CASE WHEN u.u THEN z.z * (z.ys[u.t] - sy.ybar) ELSE 0.0 END) AS c
        FROM z JOIN use u USING (j) JOIN sy ON sy.series = u.series GROUP BY 1, 2),
{_eliminate(_K)}"""

# the part of each target's weights that is its siblings'
_SIB = f"""
wl AS (SELECT w.series, n.t, unnest(w.w) AS w, unnest(generate_series(1, {_K})) AS j FROM weights w JOIN names n USING (series)),
ws AS (SELECT series, t, w, j, CASE WHEN j <= {_ROLL0} THEN (j - {_LAG0} - 1) // {len(LAGS)} + 1
               WHEN j <= {_VAL0} THEN (j - {_ROLL0} - 1) // {len(WINDOWS)} + 1 ELSE j - {_VAL0} END AS s
       FROM wl WHERE j > {_LAG0})"""


def _own_step(extra: str) -> str:
    """A step's prediction from the target's own buffer ``b``, its weights ``w`` and ``extra``."""
    day = "CAST(last + (step + 1) * INTERVAL 1 DAY AS DATE)"
    return (f"c + list_dot_product(w[1:7], {_CAL_LIST.replace('datum', day)})"
            + "".join(f" + COALESCE(w[{_LAG0} + (t - 1) * {len(LAGS)} + {j + 1}] * b[-{k}], 0.0)" for j, k in enumerate(LAGS))
            + "".join(f" + COALESCE(w[{_ROLL0} + (t - 1) * {len(WINDOWS)} + {j + 1}] * {_tail_mean('b', k)}, 0.0)"
                      for j, k in enumerate(WINDOWS)) + extra)


_PAST = " UNION ALL ".join(
    [f"SELECT series, {_LAG0} + {j + 1} AS at, {len(LAGS)} AS width, avg(lag_{k}) AS x FROM f WHERE {_NONNULL} GROUP BY 1"
     for j, k in enumerate(LAGS)]
    + [f"SELECT series, {_ROLL0} + {j + 1}, {len(WINDOWS)}, avg(rolling_{k}) FROM f WHERE {_NONNULL} GROUP BY 1"
       for j, k in enumerate(WINDOWS)]
    + [f"SELECT series, {_VAL0} + 1, 1, arg_max(value, datum) FROM gdense GROUP BY 1"])

# The best model is the ridge: on these tables the elastic net (alpha 1) is behind for every target.
SQL["forecast_product"] = f"""
WITH RECURSIVE {TARGET_ROWS},{_SIB},
past AS ({_PAST}),
x AS (SELECT n.t AS s, past.at + (n.t - 1) * past.width AS j, past.x FROM past JOIN names n USING (series)),
sib AS (SELECT ws.series, sum(ws.w * x.x) AS add FROM ws JOIN x ON ws.j = x.j AND ws.s <> ws.t GROUP BY 1),
buf AS (SELECT series, list_reverse((list(value ORDER BY datum DESC))[1:30]) AS b FROM gdense GROUP BY 1),
r(series, t, w, c, last, step, b, pred) AS (
  SELECT w.series, n.t, w.w, w.b + sib.add, (SELECT max(datum) FROM gdense), 0, buf.b, CAST(NULL AS DOUBLE)
  FROM weights w JOIN names n USING (series) JOIN sib USING (series) LEFT JOIN buf USING (series)
  UNION ALL
  SELECT series, t, w, c, last, step + 1, list_append(b, p)[2:], p
  FROM (SELECT *, GREATEST(0.0, {_own_step('')}) AS p FROM r WHERE step < 30) q)
SELECT series, CAST(step AS INTEGER) AS step, CAST(last + step * INTERVAL 1 DAY AS DATE) AS datum,
       ROUND(pred, 2) AS predicted, 'Ridge' AS model_used FROM r WHERE step > 0"""

SQL["forecast_product_summary"] = f"""
WITH fc AS ({SQL["forecast_product"]})
SELECT series, ROUND(AVG(predicted), 6) AS mean_forecast,
       CASE WHEN arg_max(predicted, step) > arg_min(predicted, step) THEN 'up' ELSE 'down' END AS direction,
       COUNT(*) AS horizon FROM fc GROUP BY 1"""

SQL["target_ridge"] = f"""
WITH RECURSIVE {TARGET_ROWS},
s AS (SELECT w.series, days.ys[n.t] AS y, w.b + list_dot_product(w.w, days.x) AS p
      FROM days, weights w JOIN names n ON w.series = n.series WHERE test)
SELECT series, 'Ridge' AS model, {_METRICS} FROM s GROUP BY 1"""

_MOVED = " UNION ALL ".join(
    [f"SELECT t AS s, i, {_LAG0} + (t - 1) * {len(LAGS)} + {j + 1} AS j, b[-{k}] AS x FROM moved" for j, k in enumerate(LAGS)]
    + [f"SELECT t, i, {_ROLL0} + (t - 1) * {len(WINDOWS)} + {j + 1}, {_tail_mean('b', k)} FROM moved"
       for j, k in enumerate(WINDOWS)]
    + [f"SELECT t, i, {_VAL0} + t, list_avg(b) FROM moved"])
SQL["recursive_forecast_product"] = f"""
WITH RECURSIVE {TARGET_ROWS},{_SIB},
buf AS (SELECT series, list_reverse((list(value ORDER BY datum DESC))[1:30]) AS b FROM gdense GROUP BY 1),
moved AS (SELECT t, i, list_concat(b, list_resize([]::DOUBLE[], i, b[-1]))[-30:] AS b
          FROM buf JOIN names USING (series), (SELECT CAST(i AS INTEGER) AS i FROM generate_series(0, 29) g(i))),
x AS ({_MOVED}),
sib AS (SELECT ws.series, x.i, sum(ws.w * x.x) AS add FROM ws JOIN x ON ws.j = x.j AND ws.s <> ws.t GROUP BY 1, 2),
adds AS (SELECT series, list(add ORDER BY i) AS adds FROM sib GROUP BY 1),
r(series, t, w, c, adds, last, step, b, pred) AS (
  SELECT w.series, n.t, w.w, w.b, adds.adds, (SELECT max(datum) FROM gdense), 0, buf.b, CAST(NULL AS DOUBLE)
  FROM weights w JOIN names n USING (series) JOIN adds USING (series) JOIN buf USING (series)
  UNION ALL
  SELECT series, t, w, c, adds, last, step + 1, list_append(b, p)[2:], p
  FROM (SELECT *, {_own_step(' + adds[step + 1]')} AS p FROM r WHERE step < 30) q)
SELECT series, CAST(step AS INTEGER) AS step, CAST(last + step * INTERVAL 1 DAY AS DATE) AS datum,
       ROUND(GREATEST(0.0, pred), 6) AS predicted, 'Ridge' AS model_used FROM r WHERE step > 0"""
