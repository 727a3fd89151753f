"""Mapping, pivoting, gap filling, calendar features; shares and growth."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import reshape as r
from tallyloom.operators import share as s

from . import inputs as i
from .ingest import raw_sql
from .registry import query, rnd, with_ctes


def day_sql(body: str, needs: str) -> str:
    return with_ctes(i.DAILY, body, needs)


def ship_sql(body: str, needs: str) -> str:
    return with_ctes(i.SHIP, body, needs)


# ------------------------------------------------------------------ 2.3 transformation


@query("map_dimension", raw_sql(f"""
SELECT d.vehicle, d.date, d.ingest_seq, {rnd('qty', 4)} AS qty, m.line
FROM domain d LEFT JOIN line_map m USING (vehicle)""", "line_map"))
def map_dimension(spark, sf):
    return i.rounded(r.map_dimension(i.domain(spark, sf), i.line_dim(spark)).select(
        "vehicle", "date", "ingest_seq", "qty", "line"))


@query("unmapped_keys", raw_sql("""
SELECT vehicle, CAST(count(*) AS BIGINT) AS rows FROM domain
WHERE vehicle NOT IN (SELECT vehicle FROM line_map) GROUP BY ALL""", "line_map"))
def unmapped_keys(spark, sf):
    return r.unmapped_keys(i.domain(spark, sf), i.line_dim(spark))


@query("mapped_only", raw_sql(f"""
SELECT vehicle, date, ingest_seq, {rnd('qty', 4)} AS qty, line FROM mapped""", "mapped"))
def mapped_only(spark, sf):
    return i.rounded(r.mapped_only(i.domain(spark, sf), i.line_dim(spark)).select(
        "vehicle", "date", "ingest_seq", "qty", "line"))


@query("duplicate_cells", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, shipped
FROM (SELECT *, CAST(l_shipdate AS DATE) AS shipped,
        count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1""")
def duplicate_cells(spark, sf):
    from tallyloom.operators import quality as q
    from tallyloom.sources.tables import scan_table

    items = scan_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
        F.col("l_shipdate").cast("date").alias("shipped"))
    order = F.struct("shipped", "l_partkey", "l_quantity", "l_extendedprice")
    return q.duplicate_cells(items.withColumn("seq", order), ("l_orderkey", "l_linenumber"),
                             "seq").drop("seq")


def _pivot(value="value"):
    return ", ".join(f"max(CASE WHEN line = '{p}' THEN {value} END) AS \"{p}\""
                     for p in i.PRIORITIES)


@query("pivot_daily", day_sql(f"SELECT date, {_pivot()} FROM cells GROUP BY date", "cells"))
def pivot_daily(spark, sf):
    return i.rounded(r.pivot_daily(i.order_cells(spark, sf), i.PRIORITIES), 2)


@query("unpivot_daily", day_sql("""
SELECT d.date, l.line, c.value
FROM (SELECT DISTINCT date FROM cells) d CROSS JOIN (SELECT DISTINCT line FROM cells) l
LEFT JOIN cells c ON c.date = d.date AND c.line = l.line""", "cells"))
def unpivot_daily(spark, sf):
    return r.unpivot_daily(r.pivot_daily(i.order_cells(spark, sf), i.PRIORITIES), i.PRIORITIES)


@query("series_missing", day_sql(f"""
SELECT line, CAST((SELECT count(DISTINCT date) FROM cells) - count(value) AS BIGINT) AS missing_days,
  {rnd('100.0 * ((SELECT count(DISTINCT date) FROM cells) - count(value)) / (SELECT count(DISTINCT date) FROM cells)', 1)}
    AS missing_pct
FROM cells GROUP BY line""", "cells"))
def series_missing(spark, sf):
    return r.series_missing(i.order_cells(spark, sf))


@query("densify_daily", day_sql("SELECT date, line, value FROM dense", "dense"))
def densify_daily(spark, sf):
    return r.densify_daily(i.order_cells(spark, sf))


@query("interpolate_time", day_sql(
    f"SELECT date, line, {rnd('value', 5)} AS value FROM timed", "timed"))
def interpolate_time(spark, sf):
    return i.rounded(r.interpolate_time(r.densify_daily(i.order_cells(spark, sf))), 5)


@query("interpolate_time_with_tail", day_sql(f"""
SELECT date, line, {rnd('''CASE WHEN value IS NOT NULL THEN value
  WHEN date - d0 <= 3 THEN coalesce(v0 + (v1 - v0) * (date - d0) / (d1 - d0), v0) END''', 5)} AS value
FROM known""", "known"))
def interpolate_time_with_tail(spark, sf):
    return i.rounded(r.interpolate_time(r.densify_daily(i.order_cells(spark, sf)), inside=False), 5)


@query("zero_fill", day_sql(
    f"SELECT date, line, {rnd('value', 5)} AS value FROM daily", "daily"))
def zero_fill(spark, sf):
    return i.rounded(i.daily(spark, sf), 5)


@query("integrity_check", day_sql("""
SELECT unnest(['one_row_per_day', 'no_missing_day', 'no_null', 'enough_lines']) AS check_name,
  unnest([n, d, z, k]) AS found, unnest([d, k * s, 0, 5]) AS expected,
  unnest([n = d, d = k * s, z = 0, k >= 5]) AS passed
FROM (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS d, CAST(sum(z) AS BIGINT) AS z,
        CAST(count(*) AS BIGINT) AS k, CAST(max(s) AS BIGINT) AS s
      FROM (SELECT line, count(*) AS n, count(DISTINCT date) AS d,
              count(*) FILTER (value IS NULL) AS z, max(date) - min(date) + 1 AS s
            FROM daily GROUP BY line))""", "daily"))
def integrity_check(spark, sf):
    return r.integrity_check(i.daily(spark, sf))


@query("calendar_features", day_sql(f"""
SELECT date, line, {rnd('value', 5)} AS value, CAST(year(date) AS INTEGER) AS year,
  CAST(month(date) AS INTEGER) AS month, dayname(date) AS day_of_week,
  CAST(isodow(date) - 1 AS INTEGER) AS dow,
  CAST(CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend FROM daily""", "daily"))
def calendar_features(spark, sf):
    return i.rounded(r.calendar_features(i.daily(spark, sf)), 5)


@query("network_total", day_sql("SELECT date, line, value FROM total", "total"))
def network_total(spark, sf):
    return i.total(spark, sf)


# ------------------------------------------------------------------ 2.4 shares


@query("mode_share", day_sql(f"""
SELECT mode, CAST(trunc(round(t, 4)) AS BIGINT) AS total, {rnd('100.0 * t / sum(t) OVER ()', 1)} AS share_pct
FROM (SELECT mode, sum(value) AS t FROM modal GROUP BY mode)""", "modal"))
def mode_share(spark, sf):
    return s.mode_share(i.daily(spark, sf), i.mode_dim(spark))


@query("mode_share_daily", day_sql(f"""
SELECT date, mode, {rnd('100.0 * v / nullif(sum(v) OVER (PARTITION BY date), 0)', 2)} AS share_pct
FROM (SELECT date, mode, sum(value) AS v FROM modal GROUP BY ALL)""", "modal"))
def mode_share_daily(spark, sf):
    return s.mode_share_daily(i.daily(spark, sf), i.mode_dim(spark))


def _yoy(per_day: bool) -> str:
    v = "sum(value) / count(DISTINCT date)" if per_day else "sum(value)"
    return f"""
SELECT mode, {rnd('old', 4)} AS old_value, {rnd('new', 4)} AS new_value,
  {rnd('(new - old) * 100.0 / old', 2)} AS growth_pct
FROM (SELECT mode, max(CASE WHEN y = 2000 THEN v END) AS old, max(CASE WHEN y = 2001 THEN v END) AS new
      FROM (SELECT mode, year(date) AS y, {v} AS v FROM modal GROUP BY ALL) GROUP BY mode)"""


@query("yoy_mode", day_sql(_yoy(True), "modal"))
def yoy_mode(spark, sf):
    return i.rounded(s.yoy_mode(i.daily(spark, sf), i.mode_dim(spark), 2000, 2001))


@query("yoy_mode_totals", day_sql(_yoy(False), "modal"))
def yoy_mode_totals(spark, sf):
    return i.rounded(s.yoy_mode(i.daily(spark, sf), i.mode_dim(spark), 2000, 2001,
                                per_day=False))


@query("share_headline", day_sql(f"""
SELECT (SELECT mode FROM shares ORDER BY t DESC, mode LIMIT 1) AS top_mode,
  (SELECT {rnd('100.0 * max(t) / sum(t)', 1)} FROM shares) AS top_share_pct,
  (SELECT CAST(trunc(round(sum(t), 4)) AS BIGINT) FROM shares) AS total,
  (SELECT {rnd('sum(value) / count(DISTINCT date)', 4)} FROM modal) AS mean_per_day,
  (SELECT mode FROM growth ORDER BY growth_pct DESC, mode LIMIT 1) AS fastest_mode,
  (SELECT max(growth_pct) FROM growth) AS fastest_pct,
  (SELECT mode FROM growth ORDER BY growth_pct, mode LIMIT 1) AS weakest_mode,
  (SELECT min(growth_pct) FROM growth) AS weakest_pct""", "modal").replace(
    "\nSELECT (SELECT mode FROM shares", f""",
shares AS (SELECT mode, sum(value) AS t FROM modal GROUP BY mode),
growth AS ({_yoy(True)})
SELECT (SELECT mode FROM shares""", 1))
def share_headline(spark, sf):
    return i.rounded(s.share_headline(i.daily(spark, sf), i.mode_dim(spark), 2000, 2001))
