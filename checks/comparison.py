"""Comparing series: levels, volatility, profiles, correlation."""

from __future__ import annotations

from tallyloom import dimensions
from tallyloom.operators import compare as c
from tallyloom.operators import correlate as k

from . import inputs as i
from .registry import query, rnd
from .shaping import day_sql, ship_sql

SHIP_PAIRS = [("A-F", "N-O"), ("A-O", "R-F"), ("N-F", "R-O"), ("R-F", "A-F")]


@query("daily_series", day_sql(
    f"SELECT date, line, {rnd('value', 5)} AS value FROM daily", "daily"))
def daily_series(spark, sf):
    return i.rounded(c.daily_series(i.daily(spark, sf)), 5)


@query("base_index", day_sql(f"""
SELECT d.date, d.line, {rnd('d.value / coalesce(b.base, 1.0) * 100', 4)} AS index_value
FROM daily d LEFT JOIN (
  SELECT line, avg(value) AS base FROM (
    SELECT line, value, row_number() OVER (PARTITION BY line ORDER BY date) AS k
    FROM daily WHERE value > 0) WHERE k <= 7 GROUP BY line) b USING (line)""", "daily"))
def base_index(spark, sf):
    return i.rounded(c.base_index(i.daily(spark, sf)))


RANKING = f"""SELECT line, avg_daily, std_daily,
  CASE WHEN avg_daily > 0 THEN {rnd('100.0 * std_daily / avg_daily', 1)} ELSE 0.0 END AS cv_pct
FROM (SELECT line, CAST(coalesce(round(avg(nullif(value, 0))), 0) AS BIGINT) AS avg_daily,
        CAST(coalesce(round(stddev_samp(nullif(value, 0))), 0) AS BIGINT) AS std_daily
      FROM daily GROUP BY line)"""


@query("line_ranking", day_sql(RANKING, "daily"))
def line_ranking(spark, sf):
    return c.line_ranking(i.daily(spark, sf))


@query("line_volatility", day_sql(f"""
SELECT line, {rnd('avg(value)', 4)} AS mean, {rnd('stddev_samp(value)', 4)} AS std,
  {rnd('stddev_samp(value) * 100.0 / avg(value)', 4)} AS cv_pct FROM daily GROUP BY line""", "daily"))
def line_volatility(spark, sf):
    return i.rounded(c.line_volatility(i.daily(spark, sf)))


@query("volatility_ranking", day_sql(f"""
SELECT line, cv_pct, CASE WHEN row_number() OVER (ORDER BY cv_pct DESC, line DESC) = 1
    THEN 'most_volatile' WHEN row_number() OVER (ORDER BY cv_pct, line) = 1
    THEN 'least_volatile' ELSE 'middle' END AS role FROM ({RANKING})""", "daily"))
def volatility_ranking(spark, sf):
    return c.volatility_ranking(i.daily(spark, sf))


@query("rolling_std30", ship_sql(f"""
SELECT date, line, {rnd('sd', 4)} AS rolling_std FROM (
  SELECT *, count(sd) OVER (PARTITION BY date) AS ok FROM (
    SELECT date, line, CASE WHEN count(nullif(value, 0)) OVER w = 30
        THEN stddev_samp(nullif(value, 0)) OVER w END AS sd FROM s_daily
    WINDOW w AS (PARTITION BY line ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)))
WHERE ok = (SELECT count(DISTINCT line) FROM s_daily)""", "s_daily"))
def rolling_std30(spark, sf):
    return i.rounded(c.rolling_std30(i.ship_daily(spark, sf)))


PROFILE = f"""SELECT line, CAST(isodow(date) - 1 AS INTEGER) AS dow, dayname(date) AS day_of_week,
  {rnd('round(avg(value), 4)', 0)} AS avg_value FROM daily GROUP BY ALL"""


@query("weekday_profile", day_sql(PROFILE, "daily"))
def weekday_profile(spark, sf):
    return c.weekday_profile(i.daily(spark, sf))


@query("weekday_profile_norm", day_sql(f"""
SELECT *, {rnd('avg_value / avg(avg_value) OVER (PARTITION BY line)', 6)} AS relative
FROM ({PROFILE})""", "daily"))
def weekday_profile_norm(spark, sf):
    return i.rounded(c.weekday_profile_norm(i.daily(spark, sf)), 6)


@query("rolling_yoy", ship_sql(f"""
SELECT date, line, {rnd('m', 4)} AS rolling_mean, {rnd('(m - o) * 100.0 / o', 4)} AS yoy_pct
FROM (SELECT *, lag(m, 365) OVER (PARTITION BY line ORDER BY date) AS o FROM (
  SELECT date, line, CASE WHEN count(value) OVER w = 30 THEN avg(value) OVER w END AS m FROM s_total
  WINDOW w AS (PARTITION BY line ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)))
WHERE m IS NOT NULL AND o IS NOT NULL""", "s_total"))
def rolling_yoy(spark, sf):
    return i.rounded(c.rolling_yoy(i.ship_total(spark, sf)))


def corr_cte(value: str) -> str:
    return f"""SELECT x.line AS a, y.line AS b, count(*) AS n, corr(x.v, y.v) AS r
FROM (SELECT date, line, {value} AS v FROM s_daily) x
JOIN (SELECT date, line, {value} AS v FROM s_daily) y
  ON x.date = y.date AND x.line < y.line AND x.v IS NOT NULL AND y.v IS NOT NULL
GROUP BY ALL"""


LOG = corr_cte("ln(1 + nullif(value, 0))")
PLAIN = corr_cte("value")


@query("corr_matrix_log", ship_sql(f"""
SELECT a, b, CAST(n AS BIGINT) AS n, {rnd('r', 6)} AS r FROM ({LOG})""", "s_daily"))
def corr_matrix_log(spark, sf):
    return i.rounded(k.corr_matrix(i.ship_daily(spark, sf), log=True), 6)


@query("corr_matrix_raw", ship_sql(f"""
SELECT a, b, CAST(n AS BIGINT) AS n, {rnd('r', 6)} AS r FROM ({PLAIN})""", "s_daily"))
def corr_matrix_raw(spark, sf):
    return i.rounded(k.corr_matrix(i.ship_daily(spark, sf)), 6)


@query("corr_matrix_log_parts", ship_sql(f"""
SELECT a, b, CAST(n AS BIGINT) AS n, {rnd('r', 6)} AS r FROM ({LOG})""", "s_daily"))
def corr_matrix_log_parts(spark, sf):
    return i.rounded(k.corr_matrix(i.ship_daily(spark, sf), log=True, part_days=64), 6)


@query("corr_matrix_raw_parts", ship_sql(f"""
SELECT a, b, CAST(n AS BIGINT) AS n, {rnd('r', 6)} AS r FROM ({PLAIN})""", "s_daily"))
def corr_matrix_raw_parts(spark, sf):
    return i.rounded(k.corr_matrix(i.ship_daily(spark, sf), part_days=64), 6)


@query("corr_pairs", ship_sql(f"SELECT a, b, {rnd('r', 3)} AS r FROM ({LOG})", "s_daily"))
def corr_pairs(spark, sf):
    return k.corr_pairs(k.corr_matrix(i.ship_daily(spark, sf), log=True))


@query("corr_pairs_ends", ship_sql(f"""
SELECT 'top' AS part, * FROM (SELECT a, b, {rnd('m.r', 3)} AS r FROM ({LOG}) m
  ORDER BY m.r DESC, a, b LIMIT 5)
UNION ALL SELECT 'bottom' AS part, * FROM (SELECT a, b, {rnd('m.r', 3)} AS r FROM ({LOG}) m
  ORDER BY m.r, a, b LIMIT 5)""", "s_daily"))
def corr_pairs_ends(spark, sf):
    return k.corr_ends(k.corr_matrix(i.ship_daily(spark, sf), log=True))


DISTANCE = f"""SELECT x.a, y.a AS b, count(*) AS n, sqrt(sum(pow(x.r - y.r, 2))) AS distance
FROM square x JOIN square y ON x.b = y.b AND x.a < y.a GROUP BY ALL"""
SQUARE = f""", pairs AS ({LOG}), square AS (
  SELECT a, b, r FROM pairs UNION ALL SELECT b, a, r FROM pairs
  UNION ALL SELECT DISTINCT line, line, 1.0 FROM s_daily)
"""


@query("corr_profile_distance", ship_sql("", "s_daily").rstrip() + SQUARE + f"""
SELECT a, b, CAST(n AS BIGINT) AS n, {rnd('distance', 6)} AS distance FROM ({DISTANCE})""")
def corr_profile_distance(spark, sf):
    return i.rounded(k.corr_profile_distance(i.ship_daily(spark, sf)), 6)


@query("corr_profile_nearest", ship_sql("", "s_daily").rstrip() + SQUARE + f"""
SELECT a AS line, b AS nearest, {rnd('distance', 6)} AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS k FROM (
    SELECT a, b, distance FROM ({DISTANCE}) UNION ALL SELECT b, a, distance FROM ({DISTANCE})))
WHERE k = 1""")
def corr_profile_nearest(spark, sf):
    return i.rounded(k.nearest_line(k.corr_profile_distance(i.ship_daily(spark, sf))), 6)


@query("lag_corr", ship_sql(f"""
SELECT line_a, line_b, {rnd('r0', 3)} AS lag0, {rnd('r1', 3)} AS a_leads, {rnd('r2', 3)} AS b_leads,
  CASE WHEN r1 > r0 + 0.05 THEN line_a || ' leads ' || line_b
       WHEN r2 > r0 + 0.05 THEN line_b || ' leads ' || line_a ELSE 'Simultaneous demand' END AS verdict
FROM (SELECT p.line_a, p.line_b, corr(a.value, b.value) AS r0, corr(a.value, b.nx) AS r1,
        corr(a.value, b.pv) AS r2
      FROM (VALUES ('A-F', 'N-O'), ('A-O', 'R-F'), ('N-F', 'R-O'), ('R-F', 'A-F')) AS p(line_a, line_b)
      JOIN s_daily a ON a.line = p.line_a
      JOIN (SELECT date, line, value, lead(value) OVER w AS nx, lag(value) OVER w AS pv FROM s_daily
            WINDOW w AS (PARTITION BY line ORDER BY date)) b
        ON b.line = p.line_b AND b.date = a.date
      GROUP BY ALL)""", "s_daily"))
def lag_corr(spark, sf):
    return k.lag_corr(i.ship_daily(spark, sf), dimensions.lag_pairs(spark, SHIP_PAIRS))


@query("share_smoothed14", day_sql(f"""
SELECT date, line, {rnd('m', 6)} AS share_pct FROM (
  SELECT *, count(m) OVER (PARTITION BY date) AS ok FROM (
    SELECT date, line, CASE WHEN count(p) OVER w = 14 THEN avg(p) OVER w END AS m FROM (
      SELECT date, line, value * 100.0 / nullif(sum(value) OVER (PARTITION BY date), 0) AS p FROM daily)
    WINDOW w AS (PARTITION BY line ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)))
WHERE ok = (SELECT count(DISTINCT line) FROM daily)""", "daily"))
def share_smoothed14(spark, sf):
    return i.rounded(c.share_smoothed14(i.daily(spark, sf)), 6)


@query("line_share", day_sql(f"""
SELECT date, line, {rnd('value * 100.0 / nullif(sum(value) OVER (PARTITION BY date), 0)', 6)} AS share_pct
FROM daily""", "daily"))
def line_share(spark, sf):
    return i.rounded(c.line_share(i.daily(spark, sf)), 6)


def box_sql(key: str, source: str) -> str:
    return f"""SELECT {key}, CAST(count(*) AS BIGINT) AS n, {rnd('any_value(q1)', 4)} AS q1,
  {rnd('any_value(q2)', 4)} AS median, {rnd('any_value(q3)', 4)} AS q3,
  {rnd('any_value(q3 - q1)', 4)} AS iqr,
  {rnd('min(v) FILTER (v BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5)', 4)} AS whisker_low,
  {rnd('max(v) FILTER (v BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5)', 4)} AS whisker_high,
  CAST(count(*) FILTER (NOT v BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS BIGINT) AS outliers
FROM (SELECT *, quantile_cont(v, 0.25) OVER (PARTITION BY {key}) AS q1,
        quantile_cont(v, 0.5) OVER (PARTITION BY {key}) AS q2,
        quantile_cont(v, 0.75) OVER (PARTITION BY {key}) AS q3 FROM ({source}) WHERE v IS NOT NULL)
GROUP BY {key}"""


@query("box_stats", day_sql(
    box_sql("line", "SELECT line, nullif(value, 0) AS v FROM daily"), "daily"))
def box_stats(spark, sf):
    return i.rounded(c.line_box_stats(i.daily(spark, sf)))


def _grid(agg: str, year: str) -> str:
    return f"""SELECT CAST(isodow(date) - 1 AS INTEGER) AS dow,
  {year} || '-W' || lpad(CAST(week(date) AS VARCHAR), 2, '0') AS year_week, {rnd(f'{agg}(value)', 4)} AS value
FROM total GROUP BY ALL"""


@query("calendar_grid", day_sql(_grid("median", "CAST(year(date) AS VARCHAR)"), "total"))
def calendar_grid(spark, sf):
    return i.rounded(c.calendar_grid(i.total(spark, sf)))


@query("calendar_grid_mean", day_sql(_grid("avg", "CAST(year(date) AS VARCHAR)"), "total"))
def calendar_grid_mean(spark, sf):
    return i.rounded(c.calendar_grid(i.total(spark, sf), method="mean"))


@query("calendar_grid_iso_year", day_sql(_grid("median", "CAST(isoyear(date) AS VARCHAR)"), "total"))
def calendar_grid_iso_year(spark, sf):
    return i.rounded(c.calendar_grid(i.total(spark, sf), iso_year=True))


@query("top_days", day_sql("""
SELECT date, value, dayname(date) AS day_of_week FROM total ORDER BY value DESC, date LIMIT 10""",
    "total"))
def top_days(spark, sf):
    return c.top_days(i.total(spark, sf))


@query("weekday_weekend_ratio", day_sql(f"""
SELECT method, {rnd('wd', 4)} AS weekday_mean, {rnd('we', 4)} AS weekend_mean, {rnd('wd / we', 4)} AS ratio
FROM (SELECT 'mean_of_means' AS method, avg(avg_value) FILTER (dow < 5) AS wd,
        avg(avg_value) FILTER (dow >= 5) AS we FROM ({PROFILE})
      UNION ALL SELECT 'mean_of_days', avg(value) FILTER (isodow(date) < 6),
        avg(value) FILTER (isodow(date) >= 6) FROM total)""", "total"))
def weekday_weekend_ratio(spark, sf):
    return i.rounded(c.weekday_weekend_ratio(i.daily(spark, sf), i.total(spark, sf)))
