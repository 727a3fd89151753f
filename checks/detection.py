"""Anomalies, holidays, event impact."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyloom import dimensions
from tallyloom.operators import events as e

from . import inputs as i
from .comparison import box_sql
from .registry import query, rnd, with_ctes

# month-day rules in the manner of the published calendar, for the years of the tables
RULES = [
    ("songkran", [(4, 13), (4, 14), (4, 15)], -3, 3, 15),
    ("new_year", [(1, 1)], -1, 1, 10),
    ("labor_day", [(5, 1)], -1, 1, 10),
    ("national_day", [(12, 5)], -1, 1, 10),
    ("constitution_day", [(12, 10)], -1, 1, 10),
    ("king_bday", [(7, 28)], -1, 1, 10),
    ("mother_day", [(8, 12)], -1, 1, 10),
    ("long_weekend", [(4, 17), (7, 29)], -1, 1, 10),
    ("free_transit_week", [(1, d) for d in range(25, 32)], 0, 0, 20),
]
FIRST_YEAR, LAST_YEAR = 1995, 2002
WINDOWS = [("songkran 1999", "1999-04-12", "1999-04-16"),
           ("new year 2000", "1999-12-31", "2000-01-02"),
           ("free week 2000", "2000-01-25", "2000-01-31"),
           ("before the data", "1994-12-30", "1995-01-02"),
           ("partly covered", "2001-07-30", "2001-08-05")]
DAYS = [("1999-01-01", "New Year"), ("1999-04-13", "Songkran"), ("1999-12-05", "National Day"),
        ("2000-01-01", "New Year"), ("2000-12-31", "New Year Eve"), ("1994-01-01", "Too early")]
UNKNOWN = "unknown"


def holidays(spark):
    return dimensions.yearly_holidays(spark, RULES, FIRST_YEAR, LAST_YEAR)


def scored(spark, sf):
    return e.rolling_zscore(i.total(spark, sf))


def classed(spark, sf):
    return e.anomaly_class(scored(spark, sf))


def z_ctes(prefix: str) -> dict[str, str]:
    p = prefix
    return {
        f"{p}windows": f"""
  SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s,
    avg(value) OVER () AS gm, stddev_samp(value) OVER () AS gs FROM {p}total
  WINDOW w AS (ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""",
        f"{p}scored": f"""
  SELECT date, line, value, coalesce(CASE WHEN n >= 15 THEN (value - m) / greatest(s, 0.1 * gs) END,
    (value - gm) / gs) AS z_score FROM {p}windows""",
        f"{p}classed": f"""
  SELECT *, CASE WHEN z_score > 3 THEN 'spike' WHEN z_score < -3 THEN 'drop' ELSE 'normal' END
      AS anomaly_type, dayname(date) AS day_of_week,
    CAST(CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend FROM {p}scored""",
    }


HOLIDAYS = {
    "holidays": "SELECT holiday, make_date(y, m, d) AS ds, lo, hi, prior FROM (VALUES "
    + ", ".join(f"('{n}', {m}, {d}, {lo}, {hi}, {prior}.0)"
                for n, days, lo, hi, prior in RULES for m, d in days)
    + ") AS t(holiday, m, d, lo, hi, prior)"
      f" CROSS JOIN (SELECT unnest(range({FIRST_YEAR}, {LAST_YEAR + 1})) AS y)",
    "holiday_days": """
  SELECT CAST(ds + off AS DATE) AS date, holiday, off AS day_offset, prior AS prior_scale
  FROM (SELECT *, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS off FROM holidays)""",
    "labels": """
  SELECT date, string_agg(DISTINCT holiday, ',' ORDER BY holiday) AS holiday
  FROM holiday_days GROUP BY date""",
}

CTES = {
    **i.DAILY, **z_ctes(""), **HOLIDAYS,
    "anomalies": "SELECT * FROM classed WHERE anomaly_type <> 'normal'",
    "hits": """
  SELECT a.*, coalesce(l.holiday, 'unknown') AS holiday FROM anomalies a
  LEFT JOIN labels l USING (date)""",
    "windows_given": "SELECT event, CAST(s AS DATE) AS s, CAST(t AS DATE) AS t FROM (VALUES "
    + ", ".join(f"('{n}', '{a}', '{b}')" for n, a, b in WINDOWS) + ") AS v(event, s, t)",
}


def event_sql(body: str, needs: str = "windows_given") -> str:
    return with_ctes(CTES, body, needs)


@query("moving_avg_centered", event_sql(f"""
SELECT date, line, value, {rnd('''CASE WHEN count(value) OVER w = 7 THEN avg(value) OVER w END''', 4)}
  AS rolling_mean FROM total
WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""", "total"))
def moving_avg_centered(spark, sf):
    return i.rounded(e.moving_avg_centered(i.total(spark, sf)))


@query("moving_avg_trailing", event_sql(f"""
SELECT date, line, value,
  {rnd('CASE WHEN count(value) OVER a = 7 THEN avg(value) OVER a END', 4)} AS rolling_7,
  {rnd('CASE WHEN count(value) OVER b = 30 THEN avg(value) OVER b END', 4)} AS rolling_30
FROM total WINDOW a AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
  b AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""", "total"))
def moving_avg_trailing(spark, sf):
    return i.rounded(e.moving_avg_trailing(i.total(spark, sf)))


@query("rolling_zscore", event_sql(
    f"SELECT date, line, value, {rnd('z_score', 6)} AS z_score FROM scored", "scored"))
def rolling_zscore(spark, sf):
    return i.rounded(scored(spark, sf), 6)


@query("rolling_zscore_short_series", with_ctes({**i.EVENT, **z_ctes("e_")}, f"""
SELECT date, line, value, {rnd('z_score', 6)} AS z_score FROM e_scored""", "e_scored"))
def rolling_zscore_short_series(spark, sf):
    return i.rounded(e.rolling_zscore(i.event_total(spark, sf)), 6)


@query("rolling_zscore_lines", event_sql(f"""
SELECT date, line, {rnd('''coalesce(CASE WHEN n >= 15 THEN (value - m) / greatest(s, 0.1 * gs) END,
  (value - gm) / gs)''', 6)} AS z_score
FROM (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s,
        avg(value) OVER g AS gm, stddev_samp(value) OVER g AS gs FROM daily
      WINDOW w AS (PARTITION BY line ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
             g AS (PARTITION BY line))""", "daily"))
def rolling_zscore_lines(spark, sf):
    return i.rounded(e.rolling_zscore(i.daily(spark, sf)).drop("value"), 6)


@query("global_zscore", event_sql(f"""
SELECT date, line, value, {rnd('z', 6)} AS z_score, abs(z) > 2 AS is_anomaly FROM (
  SELECT *, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z FROM total)""", "total"))
def global_zscore(spark, sf):
    return i.rounded(e.global_zscore(i.total(spark, sf), 2.0), 6)


@query("anomaly_class", event_sql(f"""
SELECT date, line, value, {rnd('z_score', 6)} AS z_score, anomaly_type, day_of_week, is_weekend
FROM classed""", "classed"))
def anomaly_class(spark, sf):
    return i.rounded(classed(spark, sf), 6)


@query("z_histogram", event_sql(f"""
SELECT b.bin, {rnd('lo + w * b.bin', 6)} AS bin_start, CAST(count(s.z) AS BIGINT) AS n
FROM (SELECT CAST(unnest(range(50)) AS INTEGER) AS bin) b
CROSS JOIN (SELECT min(z) AS lo, (max(z) - min(z)) / 50 AS w FROM (
    SELECT round(z_score, 9) AS z FROM scored)) e
LEFT JOIN (SELECT round(z_score, 9) AS z FROM scored) s
  ON least(CAST(floor((s.z - e.lo) / e.w) AS INTEGER), 49) = b.bin
GROUP BY b.bin, lo, w""", "scored"))
def z_histogram(spark, sf):
    return i.rounded(e.z_histogram(scored(spark, sf)), 6)


@query("holiday_expand", with_ctes(HOLIDAYS, """
SELECT l.date, l.holiday, CAST(count(o.o_orderkey) AS BIGINT) AS orders FROM labels l
JOIN orders o ON CAST(o.o_orderdate AS DATE) = l.date GROUP BY ALL""", "labels"))
def holiday_expand(spark, sf):
    from tallyloom.sources.tables import scan_table
    orders = scan_table(spark, sf, "orders").groupBy(
        F.col("o_orderdate").cast("date").alias("date")).agg(F.count("*").alias("orders"))
    return orders.join(e.holiday_expand(holidays(spark)), "date")


@query("anomaly_holiday_map", event_sql(f"""
SELECT date, line, value, {rnd('z_score', 6)} AS z_score, anomaly_type, day_of_week, is_weekend,
  holiday FROM hits""", "hits"))
def anomaly_holiday_map(spark, sf):
    return i.rounded(e.anomaly_holiday_map(classed(spark, sf), holidays(spark), UNKNOWN), 6)


@query("unknown_anomaly", event_sql(f"""
SELECT date, line, value, {rnd('z_score', 6)} AS z_score, anomaly_type, day_of_week, is_weekend
FROM hits WHERE holiday = 'unknown'""", "hits"))
def unknown_anomaly(spark, sf):
    return i.rounded(e.unknown_anomaly(classed(spark, sf), holidays(spark)), 6)


@query("holiday_hits", event_sql("""
SELECT holiday, CAST(count(*) AS BIGINT) AS days,
  row_number() OVER (ORDER BY count(*) DESC, holiday) = 1 AS is_top FROM hits GROUP BY holiday""",
    "hits"))
def holiday_hits(spark, sf):
    return e.holiday_hits(e.anomaly_holiday_map(classed(spark, sf), holidays(spark), UNKNOWN))


@query("holiday_vs_mean", event_sql(f"""
SELECT t.date, v.event, t.value,
  {rnd('(t.value - a.m) * 100.0 / a.m', 1)} AS vs_mean_pct
FROM total t JOIN (VALUES {', '.join(f"(DATE '{d}', '{n}')" for d, n in DAYS)}) AS v(date, event)
  USING (date) CROSS JOIN (SELECT avg(value) AS m FROM total) a""", "total"))
def holiday_vs_mean(spark, sf):
    return e.holiday_vs_mean(i.total(spark, sf), dimensions.listed_days(spark, DAYS))


IMPACT = f"""
  CAST(round(round(b, 4)) AS BIGINT) AS baseline_avg, CAST(round(round(v, 4)) AS BIGINT) AS event_avg,
  {rnd('(v - b) * 100.0 / b', 1)} AS impact_pct, CASE WHEN v < b THEN 'Drop' ELSE 'Spike' END AS direction
"""


@query("event_impact", event_sql(f"""
SELECT event, first_date, last_date, {IMPACT} FROM (
  SELECT d.*, (SELECT avg(value) FROM total WHERE date BETWEEN first_date - 21 AND first_date - 7) AS b
  FROM (SELECT event, min(date) AS first_date, max(date) AS last_date, avg(value) AS v
        FROM windows_given JOIN total ON date BETWEEN s AND t GROUP BY event) d) WHERE b > 0"""))
def event_impact(spark, sf):
    return e.event_impact(i.total(spark, sf), dimensions.events(spark, WINDOWS))


@query("event_impact_by_line", event_sql(f"""
SELECT event, line, {IMPACT} FROM (
  SELECT event, line, avg(nullif(value, 0)) FILTER (date BETWEEN s AND t) AS v,
    avg(nullif(value, 0)) FILTER (date BETWEEN s - 21 AND s - 7) AS b
  FROM windows_given CROSS JOIN daily GROUP BY ALL) WHERE b > 0 AND v IS NOT NULL"""))
def event_impact_by_line(spark, sf):
    return e.event_impact_by_line(i.daily(spark, sf), dimensions.events(spark, WINDOWS))


@query("peak_in_window", event_sql("""
SELECT date, value FROM total WHERE date BETWEEN DATE '2000-01-25' AND DATE '2000-01-31'
ORDER BY value DESC, date LIMIT 1""", "total"))
def peak_in_window(spark, sf):
    return e.peak_in_window(i.total(spark, sf), dt.date(2000, 1, 25), dt.date(2000, 1, 31))


@query("anomaly_line_ratio", event_sql(f"""
SELECT d.date, d.line, {rnd('d.value', 5)} AS value, {rnd('d.value / d.m', 4)} AS ratio, a.anomaly_type,
  {rnd('a.z_score', 4)} AS z_score
FROM (SELECT *, avg(value) OVER (PARTITION BY line) AS m FROM daily) d
JOIN (SELECT date, anomaly_type, z_score FROM anomalies) a USING (date)""", "anomalies"))
def anomaly_line_ratio(spark, sf):
    return i.rounded(e.anomaly_line_ratio(i.daily(spark, sf), classed(spark, sf)), 4, value=5)


@query("soft_anomaly", event_sql(f"""
SELECT date, line, value, {rnd('z_score', 6)} AS z_score,
  CASE WHEN z_score > 2 AND z_score <= 3 THEN 'soft_spike'
       WHEN z_score < -2 AND z_score >= -3 THEN 'soft_drop' ELSE 'normal' END AS soft_type
FROM scored""", "scored"))
def soft_anomaly(spark, sf):
    return i.rounded(e.soft_anomaly(scored(spark, sf)), 6)


@query("weekday_box", event_sql(f"""
SELECT b.*, p.day_of_week, p.anomaly_days FROM (
  {box_sql('dow', "SELECT CAST(isodow(date) - 1 AS INTEGER) AS dow, value AS v FROM classed")}) b
JOIN (SELECT CAST(isodow(date) - 1 AS INTEGER) AS dow, any_value(day_of_week) AS day_of_week,
        CAST(count(*) FILTER (anomaly_type <> 'normal') AS BIGINT) AS anomaly_days
      FROM classed GROUP BY 1) p USING (dow)""", "classed"))
def weekday_box(spark, sf):
    return i.rounded(e.weekday_box(classed(spark, sf)))


@query("weekday_points", event_sql(
    "SELECT day_of_week, date, value, anomaly_type FROM anomalies", "anomalies"))
def weekday_points(spark, sf):
    return e.weekday_points(classed(spark, sf))


@query("anomaly_summary", event_sql(f"""
SELECT *, {rnd('100.0 * anomalies / days', 4)} AS rate_pct,
  CASE WHEN 100.0 * anomalies / days < 0.5 THEN 'threshold may be too strict'
       WHEN 100.0 * anomalies / days > 5 THEN 'threshold may be too loose' ELSE 'ok' END AS advice
FROM (SELECT CAST(count(*) AS BIGINT) AS days,
  CAST(count(*) FILTER (abs(z_score) > 3) AS BIGINT) AS anomalies,
  CAST(count(*) FILTER (z_score > 3) AS BIGINT) AS spikes,
  CAST(count(*) FILTER (z_score < -3) AS BIGINT) AS drops,
  CAST(count(*) FILTER (abs(z_score) > 2 AND abs(z_score) <= 3) AS BIGINT) AS soft,
  CAST(count(*) FILTER (abs(z_score) > 3 AND is_weekend = 0) AS BIGINT) AS weekday_anomalies,
  CAST(count(*) FILTER (abs(z_score) > 3 AND is_weekend = 1) AS BIGINT) AS weekend_anomalies
  FROM classed)""", "classed"))
def anomaly_summary(spark, sf):
    return e.anomaly_summary(scored(spark, sf))


@query("anomaly_crosstab", event_sql("""
SELECT is_weekend, CAST(count(*) FILTER (anomaly_type = 'drop') AS BIGINT) AS drop,
  CAST(count(*) FILTER (anomaly_type = 'spike') AS BIGINT) AS spike
FROM anomalies GROUP BY is_weekend""", "anomalies"))
def anomaly_crosstab(spark, sf):
    return e.anomaly_crosstab(classed(spark, sf))
