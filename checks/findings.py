"""Key figures, dashboard and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom import dimensions
from tallyloom.operators import correlate, evaluate, events, insight
from tallyloom.operators import forecast as f
from tallyloom.operators import reshape
from tallyloom.session import staged

from . import inputs as i
from .comparison import PLAIN
from .detection import WINDOWS, holidays
from .evaluation import EVAL, SCORE
from .forecasting import TOTAL
from .registry import query, rnd, with_ctes

FOCUS, PAIR, GROUP, WORD = "R-F", ("A-F", "N-O"), ["N-F", "N-O"], "songkran"
POLICY = "free week 2000"

LEVELS = """
  SELECT line, avg(value) AS mean_all, sum(value) AS volume, avg(nullif(value, 0)) AS mean,
    stddev_samp(nullif(value, 0)) / avg(nullif(value, 0)) * 100 AS cv_pct,
    avg(nullif(value, 0)) FILTER (isodow(date) < 6) AS weekday,
    avg(nullif(value, 0)) FILTER (isodow(date) >= 6) AS weekend FROM s_daily GROUP BY line"""
GROWTH = f"""
  SELECT avg(v) FILTER (f <= 30) AS first_mean, avg(v) FILTER (l <= 30) AS last_mean FROM (
    SELECT v, row_number() OVER (ORDER BY date) AS f, row_number() OVER (ORDER BY date DESC) AS l
    FROM (SELECT date, sum(value) AS v FROM s_daily
          WHERE line IN ({', '.join(f"'{g}'" for g in GROUP)}) GROUP BY date))"""
IMPACT = """
  SELECT event, round((v - b) * 100.0 / b, 1) AS impact_pct FROM (
    SELECT event, v, (SELECT avg(value) FROM s_total WHERE date BETWEEN d0 - 21 AND d0 - 7) AS b
    FROM (SELECT event, min(date) AS d0, avg(value) AS v FROM windows_given
          JOIN s_total ON date BETWEEN s AND t GROUP BY event)) WHERE b > 0"""
WINDOWS_SQL = "SELECT event, CAST(s AS DATE) AS s, CAST(t AS DATE) AS t FROM (VALUES " + ", ".join(
    f"('{n}', '{a}', '{b}')" for n, a, b in WINDOWS) + ") AS v(event, s, t)"

FIGURES = {
    **TOTAL,
    "windows_given": WINDOWS_SQL,
    "levels": LEVELS,
    "growth": GROWTH,
    "impact": IMPACT,
    "pairs": PLAIN,
    "yearly": """
  SELECT year(date) AS y, avg(value) AS v FROM s_total GROUP BY 1""",
    "metrics": f"""
  SELECT 'line_mean' AS metric, line AS label, mean_all AS value FROM levels
  UNION ALL SELECT 'total_volume', NULL, sum(volume) FROM levels
  UNION ALL SELECT 'top_line_mean', max_by(line, (mean_all, line)), max(mean_all) FROM levels
  UNION ALL SELECT 'top_line_share_pct', max_by(line, (mean_all, line)),
    max(mean_all) * 100.0 / sum(mean_all) FROM levels
  UNION ALL SELECT 'focus_weekday_weekend_ratio', '{FOCUS}', weekday / weekend FROM levels
    WHERE line = '{FOCUS}'
  UNION ALL SELECT 'highest_cv_pct', max_by(line, cv_pct), max(cv_pct) FROM levels
  UNION ALL SELECT 'lowest_cv_pct', min_by(line, cv_pct), min(cv_pct) FROM levels
  UNION ALL SELECT 'weekday_mean', NULL, avg(value) FROM s_total WHERE isodow(date) < 6
  UNION ALL SELECT 'weekend_mean', NULL, avg(value) FROM s_total WHERE isodow(date) >= 6
  UNION ALL SELECT 'weekday_weekend_ratio', NULL, avg(value) FILTER (isodow(date) < 6)
    / avg(value) FILTER (isodow(date) >= 6) FROM s_total
  UNION ALL SELECT 'first_year_mean', CAST(min(y) AS VARCHAR), min_by(v, y) FROM yearly
  UNION ALL SELECT 'last_year_mean', CAST(max(y) AS VARCHAR), max_by(v, y) FROM yearly
  UNION ALL SELECT 'yoy_pct', min(y) || '-' || max(y),
    (max_by(v, y) - min_by(v, y)) * 100.0 / min_by(v, y) FROM yearly
  UNION ALL SELECT 'top_pair_r', max_by(a || ' / ' || b, r), max(r) FROM pairs
  UNION ALL SELECT 'focus_pair_r', '{PAIR[0]} / {PAIR[1]}', r FROM pairs
    WHERE a = '{PAIR[0]}' AND b = '{PAIR[1]}'
  UNION ALL SELECT 'event_impact_pct', '{WORD}', avg(impact_pct) FROM impact
    WHERE contains(event, '{WORD}')
  UNION ALL SELECT 'group_growth_pct', '{', '.join(GROUP)}',
    (last_mean - first_mean) * 100.0 / first_mean FROM growth""",
    "judged": """
  SELECT t.ds, t.y, c.yhat, c.yhat_lower, c.yhat_upper FROM t_test t JOIN t_fc c USING (line, ds)""",
    "model": f"""
  SELECT 'model_mape' AS metric, 'TOTAL' AS label,
    round(avg(abs(y - yhat) / y) FILTER (y > 0) * 100, 2) AS value FROM judged
  UNION ALL SELECT 'model_coverage_pct', 'TOTAL', round(100.0 * count(*) FILTER (
    y BETWEEN yhat_lower AND yhat_upper) / count(*), 1) FROM judged
  UNION ALL SELECT 'model_direction_pct', 'TOTAL', 100.0 * count(*) FILTER (a = b) / count(a) FROM (
    SELECT sign(y - lag(y) OVER (ORDER BY ds)) AS a, sign(yhat - lag(yhat) OVER (ORDER BY ds)) AS b
    FROM judged)""",
    "named": "SELECT metric, label, value FROM metrics UNION ALL SELECT metric, label, value FROM model",
}


def figures_sql(body: str, needs: str) -> str:
    return with_ctes(FIGURES, body, needs)


def series(spark, sf):
    """The dense series as a written table: the figures read it several times."""
    daily = staged(i.ship_daily(spark, sf))
    return daily, reshape.network_total(daily)


def metrics(spark, daily, total):
    impact = events.event_impact(total, dimensions.events(spark, WINDOWS))
    return insight.key_metrics(daily, total, correlate.corr_matrix(daily), impact, FOCUS, PAIR,
                               GROUP, WORD)


@query("key_metrics", figures_sql(
    f"SELECT metric, label, {rnd('value', 4)} AS value FROM metrics", "metrics"))
def key_metrics(spark, sf):
    return i.rounded(metrics(spark, *series(spark, sf)))


@query("edge_growth", figures_sql(f"""
SELECT {rnd('first_mean', 4)} AS first_mean, {rnd('last_mean', 4)} AS last_mean,
  {rnd('(last_mean - first_mean) * 100.0 / first_mean', 4)} AS growth_pct FROM growth""", "growth"))
def edge_growth(spark, sf):
    return i.rounded(insight.edge_growth(i.ship_daily(spark, sf), GROUP))


@query("line_dashboard", with_ctes({**EVAL, "levels": LEVELS}, f"""
SELECT l.line, CAST(round(round(mean, 4)) AS BIGINT) AS mean_per_day, {rnd('cv_pct', 1)} AS cv_pct,
  CAST(round(round(weekday, 4)) AS BIGINT) AS weekday_mean,
  CAST(round(round(weekend, 4)) AS BIGINT) AS weekend_mean, {rnd('weekday / weekend', 2)} AS ratio,
  {rnd('s.mape', 1)} AS model_mape
FROM levels l LEFT JOIN ({SCORE}) s USING (line)""", "levels"))
def line_dashboard(spark, sf):
    daily = staged(i.ship_daily(spark, sf))
    split = staged(f.train_test_split(f.forecast_frame(daily)))
    forecast = f.forecast_lines(f.train_part(split), holidays(spark))
    clean = evaluate.positive_only(evaluate.eval_join(f.test_part(split), forecast))
    return insight.line_dashboard(daily, evaluate.line_scorecard(clean))


def _v(n):
    return f"(SELECT value FROM named WHERE metric = '{n}')"


def _l(n):
    return f"(SELECT label FROM named WHERE metric = '{n}')"


def _num(n, d=0):
    return f"format('{{:,.{d}f}}', round(round({_v(n)}, {d + 4}), {d}) + 0.0)"


def _signed(expr):
    return f"format('{{:+.1f}}%', round(round({expr}, 5), 1) + 0.0)"


FINDINGS = [
    (f"{_l('top_line_mean')} || ' carries the largest share'",
     f"{_num('top_line_mean')} || ' per day, ' || {_num('top_line_share_pct', 1)} || '% of all lines'",
     "High", "High"),
    (f"'Line group change ' || {_signed(_v('group_growth_pct'))}",
     f"'last 30 against first 30 days of ' || {_l('group_growth_pct')} || ': ' || "
     f"{_signed(_v('group_growth_pct'))}", "High", "High"),
    (f"'Yearly change ' || {_l('yoy_pct')} || ': ' || {_signed(_v('yoy_pct'))}",
     f"'mean per day ' || {_num('first_year_mean')} || ' to ' || {_num('last_year_mean')} || ' (' || "
     f"{_signed(_v('yoy_pct'))} || ')'", "Medium", "High"),
    (f"{_l('focus_weekday_weekend_ratio')} || ' has its own weekend pattern'",
     f"'weekday to weekend ' || {_num('focus_weekday_weekend_ratio', 2)} || ', all lines ' || "
     f"{_num('weekday_weekend_ratio', 2)}", "High", "Medium"),
    (f"'Effect of ' || {_l('event_impact_pct')}",
     f"'mean impact ' || {_signed(_v('event_impact_pct'))} || ' against the weeks before'",
     "High", "High"),
    (f"'Policy event: {POLICY}'",
     "'impact ' || " + _signed(f"(SELECT impact_pct FROM impact WHERE event = '{POLICY}')")
     + " || ' against the weeks before'", "High", "High"),
    (f"{_l('top_pair_r')} || ' move together'", f"'r = ' || {_num('top_pair_r', 3)}", "High", "High"),
    (f"{_l('highest_cv_pct')} || ' fluctuates most'",
     f"'deviation ' || {_num('highest_cv_pct', 1)} || '% of the mean; steadiest ' || "
     f"{_l('lowest_cv_pct')} || ' ' || {_num('lowest_cv_pct', 1)} || '%'", "High", "Medium"),
    ("'Weekday pattern'",
     f"'weekday ' || {_num('weekday_mean')} || ', weekend ' || {_num('weekend_mean')} || ', ratio ' || "
     f"{_num('weekday_weekend_ratio', 2)}", "High", "High"),
    ("'Forecast quality'",
     f"'MAPE ' || {_num('model_mape', 2)} || '%, coverage ' || {_num('model_coverage_pct', 1)} || "
     f"'%, direction ' || {_num('model_direction_pct', 1)} || '%'", "High", "High"),
]


@query("insight_rows", figures_sql(" UNION ALL ".join(
    f"SELECT CAST({k} AS INTEGER) AS position, {t} AS title, {e} AS evidence, '{c}' AS confidence, "
    f"'{w}' AS impact" for k, (t, e, c, w) in enumerate(FINDINGS, 1)), "named"))
def insight_rows(spark, sf):
    daily, total = series(spark, sf)
    split = staged(f.train_test_split(f.forecast_frame(total)))
    forecast = f.forecast_lines(f.train_part(split), holidays(spark))
    joined = evaluate.eval_join(f.test_part(split), forecast)
    score = evaluate.line_scorecard(evaluate.positive_only(joined))
    model = insight.model_metrics(score, evaluate.direction_accuracy(joined),
                                  evaluate.interval_coverage(joined), reshape.TOTAL)
    policy = events.event_impact(total, dimensions.events(
        spark, [w for w in WINDOWS if w[0] == POLICY]))
    return insight.insight_rows(metrics(spark, daily, total).unionByName(model), policy)


@query("forecast_headline", figures_sql(f"""
SELECT line, {rnd('avg(yhat)', 4)} AS mean_yhat FROM t_fc WHERE is_future GROUP BY line""", "t_fc"))
def forecast_headline(spark, sf):
    _, total = series(spark, sf)
    train = f.train_part(f.train_test_split(f.forecast_frame(total)))
    out = f.forecast_summary(f.forecast_lines(train, holidays(spark)))
    return i.rounded(out.select("line", F.col("mean_yhat")))
