"""Forecast evaluation."""

from __future__ import annotations

from tallyloom.operators import evaluate as v
from tallyloom.operators import forecast as f
from tallyloom.session import staged

from . import inputs as i
from .detection import holidays
from .forecasting import FC, LINES, fit_ctes, split, train
from .registry import query, rnd, with_ctes

EVAL = {
    **LINES,
    "joined": """
  SELECT t.line, t.ds, t.y, c.yhat, c.yhat_lower, c.yhat_upper
  FROM l_test t JOIN l_fc c ON t.line = c.line AND t.ds = c.ds""",
    "clean": "SELECT * FROM joined WHERE y > 0",
    "shifted": """
  SELECT *, y - yhat AS residual, lag(y, 1) OVER w AS naive, lag(y, 7) OVER w AS week
  FROM clean WINDOW w AS (PARTITION BY line ORDER BY ds)""",
    "cutoffs": """
  SELECT line, CAST(hi - 30 - 30 * k AS DATE) AS cutoff FROM (
    SELECT *, CAST(unnest(range(0, (hi - 30 - lo - initial) // 30 + 1)) AS INTEGER) AS k FROM (
      SELECT line, min(ds) AS lo, max(ds) AS hi,
        CAST(least(greatest(floor(count(*) * CAST(0.6 AS DOUBLE)), 180), count(*) - 60) AS BIGINT) AS initial
      FROM l_train GROUP BY line))""",
    "cv_frame": """
  SELECT t.line, c.cutoff, t.ds, k.hk, CASE WHEN t.ds <= c.cutoff THEN t.y END AS y,
    CASE WHEN t.ds > c.cutoff THEN t.y END AS actual
  FROM l_train t JOIN cutoffs c ON t.line = c.line AND t.ds <= c.cutoff + 30
  LEFT JOIN hkeys k ON k.ds = t.ds""",
    **fit_ctes("c_", "cv_frame", "line, cutoff"),
    "cv": """
  SELECT line, cutoff, ds, CAST(ds - cutoff AS INTEGER) AS horizon_day, actual AS y, yhat,
    yhat_lower, yhat_upper FROM c_fc WHERE ds > cutoff""",
    "scores": """
  SELECT line, day AS horizon_day, abs(y - yhat) / yhat AS score FROM cv
  JOIN (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS day) ON abs(horizon_day - day) <= 3
  WHERE yhat > 0 AND y IS NOT NULL""",
    "calibration": """
  SELECT line, horizon_day, n, max(score) FILTER (
      k = least(CAST(ceil((n + 1) * CAST(0.8 AS DOUBLE)) AS BIGINT), n)) AS margin
  FROM (SELECT *, row_number() OVER (PARTITION BY line, horizon_day ORDER BY score) AS k,
          CAST(count(*) OVER (PARTITION BY line, horizon_day) AS BIGINT) AS n FROM scores)
  GROUP BY line, horizon_day, n""",
    "recalibrated": """
  SELECT f.line, f.ds, f.yhat, f.is_future,
    coalesce(CASE WHEN f.is_future THEN greatest(f.yhat * (1 - c.margin), 0.0) END,
             f.yhat_lower) AS yhat_lower,
    coalesce(CASE WHEN f.is_future THEN f.yhat * (1 + c.margin) END, f.yhat_upper) AS yhat_upper
  FROM l_fc f JOIN (SELECT line, max(ds) AS seen FROM l_fc WHERE NOT is_future GROUP BY line)
    USING (line)
  LEFT JOIN calibration c ON c.line = f.line AND c.horizon_day = f.ds - seen""",
}


def ev(body: str, needs: str = "shifted") -> str:
    return with_ctes(EVAL, body, needs)


def joined(spark, sf):
    # written once: training and test rows are two passes over the split
    parts = staged(split(spark, sf))
    predicted = f.forecast_lines(f.train_part(parts), holidays(spark))
    return v.eval_join(f.test_part(parts), predicted)


def errors_by_cutoff(spark, sf):
    return v.cv_errors(staged(train(spark, sf)), holidays(spark))


def clean(spark, sf):
    return v.positive_only(joined(spark, sf))


def errors(guess: str) -> dict[str, str]:
    return {"mae": f"avg(abs(y - {guess}))", "rmse": f"sqrt(avg(pow(y - {guess}, 2)))",
            "mape": f"avg(abs(y - {guess}) / abs(y)) * 100",
            "smape": f"avg(2 * abs(y - {guess}) / nullif(abs(y) + abs({guess}), 0)) * 100"}


@query("eval_join", ev(
    f"SELECT line, ds, {rnd('y', 4)} AS y, {FC} FROM joined", "joined"))
def eval_join(spark, sf):
    return i.rounded(joined(spark, sf))


@query("error_metrics", ev(f"""
SELECT line, CAST(count(*) AS BIGINT) AS n,
  {', '.join(f"{rnd(e, 4)} AS {k}" for k, e in errors('yhat').items())} FROM clean GROUP BY line""",
    "clean"))
def error_metrics(spark, sf):
    return i.rounded(v.error_metrics(clean(spark, sf)))


def _baseline(name, guess, usable="true", smape=False):
    e = errors(guess)

    def get(k, d):
        return f"CASE WHEN {usable} THEN {rnd(f'round({e[k]}, {d + 4})', d)} END AS {k}"
    last = get("smape", 2) if smape else "CAST(NULL AS DOUBLE) AS smape"
    naive, model = errors("naive")["mae"], errors("yhat")["mae"]
    return f"""SELECT line, {model} < {naive} AS model_wins,
  {rnd(f'({naive} - {model}) * 100.0 / {naive}', 1)} AS gain_pct, '{name}' AS model,
  CAST(count({guess}) AS BIGINT) AS n, {get('mae', 0)}, {get('rmse', 0)}, {get('mape', 2)}, {last}
FROM shifted GROUP BY line"""


@query("baseline_compare", ev(" UNION ALL ".join([
    _baseline("Naive (t-1)", "naive"),
    _baseline("Seasonal Naive (t-7)", "week", "count(week) >= 3"),
    _baseline("Model", "yhat", smape=True)])))
def baseline_compare(spark, sf):
    return v.baseline_compare(clean(spark, sf))


@query("residuals", ev(f"""
SELECT line, ds, {rnd('y', 4)} AS y, {FC}, {rnd('residual', 4)} AS residual,
  {rnd('residual * 100.0 / y', 4)} AS pct_error FROM shifted"""))
def residuals(spark, sf):
    return i.rounded(v.residuals(clean(spark, sf)))


@query("residual_trend", ev(f"""
SELECT line, CASE WHEN count(*) > 3 THEN {rnd('regr_slope(residual, y)', 6)} END AS slope,
  CASE WHEN count(*) > 3 THEN {rnd('regr_intercept(residual, y)', 4)} END AS intercept
FROM shifted GROUP BY line"""))
def residual_trend(spark, sf):
    return i.rounded(v.residual_trend(v.residuals(clean(spark, sf))), 4, slope=6)


@query("residual_histogram", ev(f"""
SELECT e.line, b.bin, {rnd('lo + w * b.bin', 4)} AS bin_start, CAST(count(s.z) AS BIGINT) AS n,
  {rnd('any_value(mean)', 4)} AS mean, {rnd('any_value(std)', 4)} AS std
FROM (SELECT CAST(unnest(range(20)) AS INTEGER) AS bin) b
CROSS JOIN (SELECT line, min(round(residual, 9)) AS lo,
  (max(round(residual, 9)) - min(round(residual, 9))) / 20 AS w,
  avg(residual) AS mean, stddev_samp(residual) AS std FROM shifted GROUP BY line) e
LEFT JOIN (SELECT line, round(residual, 9) AS z FROM shifted) s
  ON s.line = e.line AND least(CAST(floor((s.z - e.lo) / e.w) AS INTEGER), 19) = b.bin
GROUP BY e.line, b.bin, lo, w"""))
def residual_histogram(spark, sf):
    return i.rounded(v.residual_histogram(v.residuals(clean(spark, sf))))


@query("interval_coverage", ev(f"""
SELECT line, {rnd('p', 4)} AS coverage_pct, CASE WHEN p > 90 THEN 'too wide'
  WHEN p < 70 THEN 'too narrow' ELSE 'calibrated' END AS verdict
FROM (SELECT line, 100.0 * count(*) FILTER (y BETWEEN yhat_lower AND yhat_upper) / count(*) AS p
      FROM joined GROUP BY line)""", "joined"))
def interval_coverage(spark, sf):
    return i.rounded(v.interval_coverage(joined(spark, sf)))


@query("direction_accuracy", ev(f"""
SELECT line, {rnd('p', 4)} AS direction_pct,
  CASE WHEN p >= 60 THEN 'better than random' ELSE 'no better than random' END AS verdict
FROM (SELECT line, 100.0 * count(*) FILTER (a = b) / count(a) AS p FROM (
        SELECT line, sign(y - lag(y) OVER w) AS a, sign(yhat - lag(yhat) OVER w) AS b FROM joined
        WINDOW w AS (PARTITION BY line ORDER BY ds)) GROUP BY line)""", "joined"))
def direction_accuracy(spark, sf):
    return i.rounded(v.direction_accuracy(joined(spark, sf)))


@query("cv_cutoffs", ev("SELECT line, cutoff FROM cutoffs", "cutoffs"))
def cv_cutoffs(spark, sf):
    return v.cv_cutoffs(train(spark, sf))


@query("cv_errors", ev(
    f"SELECT line, cutoff, ds, horizon_day, {rnd('y', 4)} AS y, {FC} FROM cv", "cv"))
def cv_errors(spark, sf):
    return i.rounded(errors_by_cutoff(spark, sf))


@query("cv_by_horizon", ev(f"""
SELECT line, horizon_day, CAST(count(*) AS BIGINT) AS n, {rnd('avg(abs(y - yhat))', 4)} AS mae,
  {rnd('sqrt(avg(pow(y - yhat, 2)))', 4)} AS rmse,
  {rnd('avg(abs(y - yhat) / y) FILTER (y > 0) * 100', 4)} AS mape
FROM cv GROUP BY ALL""", "cv"))
def cv_by_horizon(spark, sf):
    return i.rounded(v.cv_by_horizon(errors_by_cutoff(spark, sf)))


def recalibrated(spark, sf):
    known = staged(train(spark, sf))
    table = v.interval_calibration(v.cv_errors(known, holidays(spark)))
    return v.calibrated(f.forecast_lines(known, holidays(spark)), table)


@query("interval_calibration", ev(
    f"SELECT line, horizon_day, n, {rnd('margin', 6)} AS margin FROM calibration", "calibration"))
def interval_calibration(spark, sf):
    return i.rounded(v.interval_calibration(errors_by_cutoff(spark, sf)), 6)


@query("forecast_lines_calibrated", ev(
    f"SELECT line, ds, is_future, {FC} FROM recalibrated", "recalibrated"))
def forecast_lines_calibrated(spark, sf):
    return i.rounded(recalibrated(spark, sf))


@query("interval_coverage_calibrated", ev(f"""
SELECT line, {rnd('p', 4)} AS coverage_pct, CASE WHEN p > 90 THEN 'too wide'
  WHEN p < 70 THEN 'too narrow' ELSE 'calibrated' END AS verdict
FROM (SELECT line, 100.0 * count(*) FILTER (y BETWEEN yhat_lower AND yhat_upper) / count(*) AS p
      FROM l_test JOIN recalibrated USING (line, ds) GROUP BY line)""", "recalibrated"))
def interval_coverage_calibrated(spark, sf):
    test = f.test_part(split(spark, sf))
    return i.rounded(v.interval_coverage(v.eval_join(test, recalibrated(spark, sf))))


@query("residual_acf", ev(f"""
SELECT line, lag, {rnd('acf', 6)} AS acf,
  row_number() OVER (PARTITION BY line ORDER BY abs(acf) DESC, lag) = 1 AND acf IS NOT NULL AS is_strongest,
  abs(acf) > 0.4 AS significant
FROM (SELECT a.line, k.lag, corr(a.residual, b.residual) AS acf
      FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY ds) AS r FROM shifted) a
      CROSS JOIN (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS lag) k
      JOIN (SELECT *, row_number() OVER (PARTITION BY line ORDER BY ds) AS r FROM shifted) b
        ON a.line = b.line AND b.r = a.r - k.lag
      GROUP BY ALL)"""))
def residual_acf(spark, sf):
    return i.rounded(v.residual_acf(v.residuals(clean(spark, sf))), 6)


COVERED = "100.0 * count(*) FILTER (y BETWEEN yhat_lower AND yhat_upper) / count(*)"
SCORE = f"""SELECT line, CAST(count(*) AS BIGINT) AS n,
  CAST(round(round({errors('yhat')['mae']}, 4)) AS BIGINT) AS mae,
  CAST(round(round({errors('yhat')['rmse']}, 4)) AS BIGINT) AS rmse,
  {rnd(errors('yhat')['mape'], 2)} AS mape, {rnd(COVERED, 1)} AS coverage_pct,
  coalesce({errors('yhat')['mae']} < {errors('naive')['mae']}, false) AS beats_naive,
  CASE WHEN {errors('yhat')['mape']} < 5 THEN 'very good' WHEN {errors('yhat')['mape']} < 10 THEN 'good'
       WHEN {errors('yhat')['mape']} < 20 THEN 'fair' ELSE 'poor' END AS grade
FROM shifted GROUP BY line HAVING count(*) >= 5"""


@query("line_scorecard", ev(SCORE))
def line_scorecard(spark, sf):
    return v.line_scorecard(clean(spark, sf))


@query("bias_grade", ev(f"""
SELECT line, {rnd('r', 4)} AS mean_residual, {rnd('abs(r) * 100.0 / l', 4)} AS bias_pct,
  CASE WHEN abs(r) * 100.0 / l < 1 THEN 'Excellent' WHEN abs(r) * 100.0 / l < 3 THEN 'Acceptable'
       ELSE 'Biased' END AS grade
FROM (SELECT line, avg(y - yhat) AS r, avg(y) AS l FROM clean GROUP BY line)""", "clean"))
def bias_grade(spark, sf):
    return i.rounded(v.bias_grade(clean(spark, sf)))


@query("acceptance", ev(f"""
SELECT line, low_error, beats_weekly, covered, low_error AND beats_weekly AND covered AS usable
FROM (SELECT line, {errors('yhat')['mape']} < 15 AS low_error,
        {errors('yhat')['mae']} < {errors('week')['mae']} AS beats_weekly FROM shifted GROUP BY line)
JOIN (SELECT line, {COVERED} >= 70 AS covered FROM joined GROUP BY line) USING (line)"""))
def acceptance(spark, sf):
    j = joined(spark, sf)
    return v.acceptance(v.positive_only(j), j)
