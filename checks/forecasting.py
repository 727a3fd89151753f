"""Forecast frame, regressors, decomposition forecasts and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import forecast as f
from tallyloom.operators.ridge import forecast_lines_ridge as ridge
from tallyloom.session import staged

from . import inputs as i
from .detection import HOLIDAYS, holidays
from .registry import query, rnd, with_ctes


def split_ctes(p: str, source: str) -> dict[str, str]:
    return {
        f"{p}split": f"""
  SELECT line, date AS ds, greatest(value, 0.0) AS y,
    row_number() OVER (PARTITION BY line ORDER BY date DESC) <= 30 AS is_test FROM {source}""",
        f"{p}train": f"SELECT line, ds, y FROM {p}split WHERE NOT is_test",
        f"{p}test": f"SELECT line, ds, y FROM {p}split WHERE is_test",
        f"{p}future": f"""
  SELECT line, ds, y, false AS is_future FROM {p}train
  UNION ALL SELECT line, CAST(hi + k AS DATE), NULL, true
  FROM (SELECT line, max(ds) AS hi FROM {p}train GROUP BY line),
       (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS k)""",
    }


HOLIDAY_KEYS = {
    **HOLIDAYS,
    "regressors": """
  SELECT date, holiday || '_' || format('{:+d}', day_offset) AS regressor,
    max(prior_scale) AS prior_scale FROM holiday_days GROUP BY ALL""",
    "hkeys": """
  SELECT date AS ds, string_agg(regressor, ',' ORDER BY regressor) AS hk
  FROM regressors GROUP BY date""",
}


def fit_ctes(p: str, source: str, keys: str) -> dict[str, str]:
    """The decomposition as grouped aggregates over ``source(keys, ds, y, hk)``."""
    def factor(name, frame, group, level):
        return {name: f"SELECT {keys}, {group} AS g, avg(y / {level}) AS f FROM {frame} "
                      f"GROUP BY {keys}, {group}"}

    level0 = "CASE WHEN trend > 0 THEN trend END"
    level1 = f"nullif({level0} * weekly, 0)"
    level2 = f"nullif({level0} * weekly * yearly, 0)"
    return {
        f"{p}b": f"""
  SELECT {keys}, min(ds) AS lo, max(ds) AS hi FROM {source} WHERE y IS NOT NULL GROUP BY {keys}""",
        f"{p}t": f"""
  SELECT {keys}, regr_slope(y, ds - lo) AS sl, regr_intercept(y, ds - lo) AS ic, avg(y) AS av
  FROM {source} JOIN {p}b USING ({keys}) WHERE y IS NOT NULL GROUP BY {keys}""",
        f"{p}f0": f"""
  SELECT s.*, coalesce(ic + sl * (ds - lo), av) AS trend, hi - lo + 1 AS span
  FROM {source} s JOIN {p}b USING ({keys}) JOIN {p}t USING ({keys})""",
        **factor(f"{p}w", f"{p}f0", "isodow(ds)", level0),
        f"{p}f1": f"""
  SELECT a.*, coalesce(b.f, 1.0) AS weekly FROM {p}f0 a LEFT JOIN (SELECT {keys}, g, f FROM {p}w) b
  ON {' AND '.join(f'a.{k} = b.{k}' for k in keys.split(', '))} AND isodow(a.ds) = b.g""",
        **factor(f"{p}m", f"{p}f1", "month(ds)", level1),
        f"{p}f2": f"""
  SELECT a.*, CASE WHEN span >= 365 THEN coalesce(b.f, 1.0) ELSE 1.0 END AS yearly
  FROM {p}f1 a LEFT JOIN {p}m b
  ON {' AND '.join(f'a.{k} = b.{k}' for k in keys.split(', '))} AND month(a.ds) = b.g""",
        **factor(f"{p}h", f"{p}f2", "hk", level2),
        f"{p}f3": f"""
  SELECT a.*, CASE WHEN hk IS NOT NULL THEN coalesce(b.f, 1.0) ELSE 1.0 END AS holiday_effect
  FROM {p}f2 a LEFT JOIN {p}h b
  ON {' AND '.join(f'a.{k} = b.{k}' for k in keys.split(', '))} AND a.hk = b.g""",
        f"{p}f4": f"""
  SELECT *, greatest(trend * weekly * yearly * holiday_effect, 0.0) AS yhat FROM {p}f3""",
        f"{p}s": f"""
  SELECT {keys}, 1.2816 * coalesce(stddev_samp((y - yhat) / nullif(yhat, 0)), 0) AS margin
  FROM {p}f4 GROUP BY {keys}""",
        f"{p}fc": f"""
  SELECT a.*, greatest(yhat * (1 - margin), 0.0) AS yhat_lower, yhat * (1 + margin) AS yhat_upper
  FROM {p}f4 a JOIN {p}s USING ({keys})""",
    }


def model_ctes(p: str, source: str) -> dict[str, str]:
    return {
        **i.SHIP, **HOLIDAY_KEYS, **split_ctes(p, source),
        f"{p}frame": f"SELECT u.*, k.hk FROM {p}future u LEFT JOIN hkeys k USING (ds)",
        **fit_ctes(p, f"{p}frame", "line"),
    }


LINES = model_ctes("l_", "s_daily")
TOTAL = model_ctes("t_", "s_total")


def lines_sql(body: str, needs: str = "l_fc") -> str:
    return with_ctes(LINES, body, needs)


def split(spark, sf):
    return f.train_test_split(f.forecast_frame(i.ship_daily(spark, sf)))


def train(spark, sf):
    return f.train_part(split(spark, sf))


def total_train(spark, sf):
    return f.train_part(f.train_test_split(f.forecast_frame(i.ship_total(spark, sf))))


def forecast(spark, sf):
    return f.forecast_lines(train(spark, sf), holidays(spark))


WAVES = f"""CAST(CASE WHEN isodow(ds) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
  {rnd('sin(2 * pi() * month(ds) / 12)', 6)} AS month_sin,
  {rnd('cos(2 * pi() * month(ds) / 12)', 6)} AS month_cos"""


@query("forecast_frame", lines_sql(f"SELECT line, ds, {rnd('y', 6)} AS y, {WAVES} FROM l_split", "l_split"))
def forecast_frame(spark, sf):
    return i.rounded(f.forecast_frame(i.ship_daily(spark, sf)), 6)


@query("train_test_split", lines_sql("SELECT line, ds, y, is_test FROM l_split", "l_split"))
def train_test_split(spark, sf):
    return split(spark, sf).select("line", "ds", "y", "is_test")


@query("holiday_regressors", lines_sql(f"""
SELECT r.date, r.regressor, CAST(r.prior_scale AS DOUBLE) AS prior_scale, d.line, {rnd('d.value', 4)} AS value
FROM regressors r JOIN s_daily d USING (date)""", "regressors"))
def holiday_regressors(spark, sf):
    # joined to the series, as a model reads them
    return i.rounded(f.holiday_regressors(holidays(spark)).join(i.ship_daily(spark, sf), "date"))


@query("future_frame", lines_sql(f"SELECT line, ds, {rnd('y', 6)} AS y, is_future, {WAVES} FROM l_future", "l_future"))
def future_frame(spark, sf):
    return i.rounded(f.future_frame(train(spark, sf)), 6)


FC = ", ".join(f"{rnd(c, 4)} AS {c}" for c in f.FORECAST)


@query("forecast_total", with_ctes(TOTAL, f"SELECT line, ds, is_future, {FC} FROM t_fc", "t_fc"))
def forecast_total(spark, sf):
    return i.rounded(f.forecast_lines(total_train(spark, sf), holidays(spark)))


@query("forecast_lines", lines_sql(f"SELECT line, ds, is_future, {FC} FROM l_fc"))
def forecast_lines(spark, sf):
    return i.rounded(forecast(spark, sf))


RIDGE_ERROR = 1.25         # bound on the days held out, in errors of the training mean


@query("forecast_lines_ridge", lines_sql("""
SELECT f.line, CAST(count(*) AS BIGINT) AS rows, min(f.ds) AS first_date, max(f.ds) AS last_date,
  CAST(count(*) FILTER (f.is_future) AS BIGINT) AS future_rows,
  true AS non_negative, true AS ordered, true AS error_bounded
FROM l_future f GROUP BY f.line""", "l_future"))
def forecast_lines_ridge(spark, sf):
    """The fit itself has no SQL; its shape, its signs and its error on the last days do."""
    days = staged(split(spark, sf))
    known = f.train_part(days)
    out = staged(ridge(known, holidays(spark)))
    test = f.test_part(days).select("line", "ds", F.col("y").alias("actual"))
    level = known.groupBy("line").agg(F.avg("y").alias("level"))
    miss = F.abs(F.col("actual") - F.col("yhat"))
    return (out.join(test, ["line", "ds"], "left").join(level, "line").groupBy("line").agg(
        F.count("*").alias("rows"), F.min("ds").alias("first_date"),
        F.max("ds").alias("last_date"), F.count_if("is_future").alias("future_rows"),
        F.bool_and(F.col("yhat") >= 0).alias("non_negative"),
        F.bool_and((F.col("yhat_lower") <= F.col("yhat"))
                   & (F.col("yhat") <= F.col("yhat_upper"))).alias("ordered"),
        (F.avg(miss) <= RIDGE_ERROR * F.avg(F.abs(F.col("actual") - F.col("level")))
         ).alias("error_bounded")))


@query("forecast_components", lines_sql(f"""
SELECT line, ds, is_future, {', '.join(f"{rnd(c, 6)} AS {c}" for c in f.COMPONENTS)} FROM l_fc"""))
def forecast_components(spark, sf):
    return i.rounded(f.forecast_components(train(spark, sf), holidays(spark)).select(
        "line", "ds", "is_future", *f.COMPONENTS), 6)


@query("forecast_summary", lines_sql(f"""
SELECT line, {rnd('avg(yhat)', 4)} AS mean_yhat, {rnd('min(yhat)', 4)} AS min_yhat,
  {rnd('max(yhat)', 4)} AS max_yhat, {rnd('min_by(yhat, ds)', 4)} AS first_yhat,
  {rnd('max_by(yhat, ds)', 4)} AS last_yhat,
  {rnd('(max_by(yhat, ds) - min_by(yhat, ds)) * 100.0 / min_by(yhat, ds)', 4)} AS change_pct
FROM l_fc WHERE is_future GROUP BY line"""))
def forecast_summary(spark, sf):
    return i.rounded(f.forecast_summary(forecast(spark, sf)))


@query("forecast_vs_recent", lines_sql(f"""
SELECT line, CAST(round(round(a, 4)) AS BIGINT) AS forecast_avg,
  CAST(round(round(r, 4)) AS BIGINT) AS recent_avg, {rnd('(a - r) * 100.0 / r', 1)} AS change_pct
FROM (SELECT line, avg(yhat) AS a FROM l_fc WHERE is_future GROUP BY line)
JOIN (SELECT line, avg(y) AS r FROM (SELECT *, row_number() OVER (
        PARTITION BY line ORDER BY ds DESC) AS k FROM l_train) WHERE k <= 90 GROUP BY line)
USING (line)"""))
def forecast_vs_recent(spark, sf):
    rows = staged(train(spark, sf))
    return f.forecast_vs_recent(f.forecast_lines(rows, holidays(spark)), rows)


@query("forecast_outlook_weekly", lines_sql("""
SELECT line, CAST(isoyear(ds) AS INTEGER) AS year, CAST(week(ds) AS INTEGER) AS week, min(ds) AS first_date,
  CAST(round(round(sum(yhat), 4)) AS BIGINT) AS total,
  CAST(round(round(avg(yhat), 4)) AS BIGINT) AS mean_per_day,
  CAST(count(*) FILTER (isodow(ds) >= 6) AS BIGINT) AS weekend_days
FROM l_fc WHERE is_future GROUP BY ALL"""))
def forecast_outlook_weekly(spark, sf):
    return f.forecast_outlook_weekly(forecast(spark, sf))
