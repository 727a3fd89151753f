"""Shares, forecasts, evaluation, findings and the network."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from frames import START, by_key, day, series
from pyspark.sql import functions as F

from tallyloom import dimensions as dim
from tallyloom.operators import compare as c
from tallyloom.operators import correlate as k
from tallyloom.operators import evaluate as v
from tallyloom.operators import forecast as f
from tallyloom.operators import graph as g
from tallyloom.operators import insight
from tallyloom.operators import share as s
from tallyloom.operators.ridge import forecast_lines_ridge
from tallyloom.sources import tables

N = None


def planted(days=800, noise=0.0, seed=0):
    """Trend, weekend dip and a yearly festival at a third of the level."""
    rng = np.random.default_rng(seed)
    out = []
    for n in range(days):
        d = START + dt.timedelta(days=n)
        value = (1000 + 0.5 * n) * (0.7 if d.weekday() >= 5 else 1.0)
        if (d.month, d.day) in ((6, 10), (6, 11)):
            value *= 0.33
        out.append(value * (1 + noise * rng.normal()))
    return out


def festival(spark):
    return dim.yearly_holidays(spark, [("fest", [(6, 10)], 0, 1, 10)], 2024, 2028)


def test_split_and_future(spark):
    frame = f.forecast_frame(series(spark, {"a": range(100), "b": range(40)}))
    split = f.train_test_split(frame)
    assert by_key(f.test_part(split).groupBy("line").count(), "line", "count") == {"a": 30, "b": 30}
    train = f.train_part(split)
    assert by_key(train.groupBy("line").agg(F.max("ds")), "line", "max(ds)") == {
        "a": day(69), "b": day(9)}
    future = f.future_frame(train).where("is_future")
    assert future.count() == 60 and future.where("y is not null").count() == 0
    assert future.agg(F.max("ds")).first()[0] == day(99)


def test_decomposition_finds_the_planted_parts(spark):
    values = planted()
    train = f.train_part(f.train_test_split(f.forecast_frame(series(spark, {"x": values}))))
    parts = f.forecast_components(train, festival(spark)).withColumn("dow", F.weekday("ds"))
    weekly = by_key(parts.groupBy("dow").agg(F.avg("weekly").alias("w")), "dow", "w")
    assert weekly[6] / weekly[2] == pytest.approx(0.7, rel=0.03)
    effect = {r["ds"]: r["holiday_effect"] for r in parts.collect()}
    assert effect[dt.date(2026, 6, 10)] == pytest.approx(0.33, rel=0.1)
    assert effect[dt.date(2026, 6, 9)] == 1.0
    future = f.future_only(f.forecast_lines(train, festival(spark)))
    got = by_key(future, "ds", "yhat")
    for n in range(770, 800):
        assert got[day(n)] == pytest.approx(values[n], rel=0.06)


def test_no_value_after_the_cutoff_leaks(spark):
    values = planted(400)
    changed = values[:370] + [9e9] * 30
    one, two = (f.forecast_lines(f.train_part(f.train_test_split(f.forecast_frame(
        series(spark, {"x": vs})))), festival(spark)).where("is_future").agg(
        F.sum("yhat")).first()[0] for vs in (values, changed))
    assert one == two


def test_short_and_empty_histories(spark):
    frame = f.forecast_frame(series(spark, {"zero": [0] * 40, "short": [5, 6, 7]}))
    out = f.forecast_lines(frame, festival(spark)).where("is_future")
    got = by_key(out.groupBy("line").agg(F.min("yhat").alias("m")), "line", "m")
    assert got["zero"] == 0 and got["short"] > 0


def test_ridge(spark):
    values = planted(noise=0.02)
    train = f.train_part(f.train_test_split(f.forecast_frame(
        series(spark, {"x": values, "y": [2 * u for u in values]}))))
    out = forecast_lines_ridge(train, festival(spark)).collect()
    assert len(out) == 2 * 800
    for r in out:
        assert 0 <= r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"]
    miss = [abs(r["yhat"] / values[(r["ds"] - START).days] - 1) for r in out
            if r["line"] == "x" and r["is_future"]]
    assert np.mean(miss) < 0.06
    fest = [r["yhat"] / values[(r["ds"] - START).days] for r in out
            if r["line"] == "x" and r["ds"] == dt.date(2026, 6, 10)]
    assert fest[0] == pytest.approx(1, abs=0.15)


def evaluation(spark, y, yhat, width=10.0):
    rows = [("x", day(n), float(a), float(b), float(b) - width, float(b) + width)
            for n, (a, b) in enumerate(zip(y, yhat))]
    return spark.createDataFrame(
        rows, "line string, ds date, y double, yhat double, yhat_lower double, yhat_upper double")


def test_errors_and_baselines(spark):
    rng = np.random.default_rng(1)
    y = rng.uniform(50, 150, 30)
    y[3], yhat = 0, rng.uniform(50, 150, 30)
    joined = evaluation(spark, y, yhat)
    clean = v.positive_only(joined)
    keep = y > 0
    a, b = y[keep], yhat[keep]
    got = v.error_metrics(clean).first()
    assert got["n"] == 29 and got["mae"] == pytest.approx(np.abs(a - b).mean())
    assert got["rmse"] == pytest.approx(np.sqrt(((a - b) ** 2).mean()))
    assert got["mape"] == pytest.approx((np.abs(a - b) / a).mean() * 100)
    table = {r["model"]: r for r in v.baseline_compare(clean).collect()}
    assert [table[m]["n"] for m in ("Naive (t-1)", "Seasonal Naive (t-7)", "Model")] == [28, 22, 29]
    naive = np.abs(np.diff(a)).mean()
    assert table["Model"]["model_wins"] == (np.abs(a - b).mean() < naive)
    assert table["Naive (t-1)"]["smape"] is None
    inside = ((y >= yhat - 10) & (y <= yhat + 10)).mean() * 100
    assert v.interval_coverage(joined).first()["coverage_pct"] == pytest.approx(inside)
    right = (np.sign(np.diff(y)) == np.sign(np.diff(yhat))).mean() * 100
    assert v.direction_accuracy(joined).first()["direction_pct"] == pytest.approx(right)
    residual = pd.Series(a - b)
    acf = by_key(v.residual_acf(v.residuals(clean)), "lag", "acf")
    for lag in range(1, 8):
        assert acf[lag] == pytest.approx(residual.autocorr(lag))
    slope, intercept = np.polyfit(a, a - b, 1)
    line = v.residual_trend(v.residuals(clean)).first()
    assert (line["slope"], line["intercept"]) == (pytest.approx(slope), pytest.approx(intercept))


def test_too_few_rows(spark):
    clean = evaluation(spark, [5, 6, 7], [5, 5, 5])
    assert v.line_scorecard(clean).count() == 0
    assert v.residual_trend(v.residuals(clean)).first()["slope"] is None
    seasonal = v.baseline_compare(clean).where("model like 'Seasonal%'").first()
    assert seasonal["mae"] is None


def test_cutoffs(spark):
    train = f.forecast_frame(series(spark, {"x": range(400), "short": range(70)}))
    got = sorted(r["cutoff"] for r in v.cv_cutoffs(train).where("line = 'x'").collect())
    # first span 240 days; cut-offs back from day 369 in steps of thirty
    assert got == [day(n) for n in (249, 279, 309, 339, 369)]
    # seventy rows: the first span shrinks to ten days
    short = [r["cutoff"] for r in v.cv_cutoffs(train).where("line = 'short'").collect()]
    assert short == [day(39)]


def test_rolling_evaluation_equals_single_fits(spark):
    values = planted(330, noise=0.05)
    train = f.forecast_frame(series(spark, {"x": values}))
    errors = v.cv_errors(train, festival(spark))
    cutoff = errors.agg(F.min("cutoff")).first()[0]
    one = f.future_only(f.forecast_lines(train.where(F.col("ds") <= F.lit(cutoff)),
                                         festival(spark)))
    single = by_key(one, "ds", "yhat")
    rolled = by_key(errors.where(F.col("cutoff") == F.lit(cutoff)), "ds", "yhat")
    assert rolled.keys() == single.keys() and len(rolled) == 30
    for d in rolled:
        assert rolled[d] == pytest.approx(single[d])
    assert v.cv_by_horizon(errors).count() == 30


def test_calibration_takes_order_statistics_of_unseen_errors(spark):
    rng = np.random.default_rng(5)
    rows = [("a", h, 100.0 * (1 + float(rng.normal(0, 0.2))), 100.0)
            for h in range(1, 11) for _ in range(7)]
    odd = [("a", 2, None, 100.0), ("a", 2, 9.0, 0.0), ("b", 4, 110.0, 100.0)]
    errors = spark.createDataFrame(rows + odd,
                                   "line string, horizon_day int, y double, yhat double")
    table = v.interval_calibration(errors, 0.8, spread=2, horizon=10)
    got = {(r["line"], r["horizon_day"]): r for r in table.collect()}
    for h in range(1, 11):
        scores = sorted(abs(y - 100) / 100 for _, k, y, _ in rows if abs(k - h) <= 2)
        rank = min(math.ceil((len(scores) + 1) * 0.8), len(scores))
        assert got["a", h]["n"] == len(scores)
        assert got["a", h]["margin"] == pytest.approx(scores[rank - 1])
    # one score is its own largest; days further away have none
    assert {k for k in got if k[0] == "b"} == {("b", h) for h in range(2, 7)}
    assert got["b", 4]["margin"] == pytest.approx(0.1)
    assert v.interval_calibration(errors.where("false")).count() == 0


def test_calibrated_forecast_keeps_what_has_no_calibration(spark):
    known = [("a", day(0), False, 50.0, 40.0, 60.0), ("b", day(0), False, 50.0, 40.0, 60.0)]
    ahead = [(n, day(k), True, 50.0, 45.0, 55.0) for n in "ab" for k in (1, 2, 3)]
    forecast = spark.createDataFrame(
        known + ahead, "line string, ds date, is_future boolean, yhat double, "
                       "yhat_lower double, yhat_upper double")
    table = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 3.0)],
                                  "line string, horizon_day int, margin double")
    got = {(r["line"], r["ds"]): (r["yhat_lower"], r["yhat_upper"])
           for r in v.calibrated(forecast, table).collect()}
    assert len(got) == 8
    assert got["a", day(1)] == (25.0, 75.0)
    assert got["a", day(2)] == (0.0, 200.0)
    assert got["a", day(3)] == got["b", day(1)] == (45.0, 55.0)
    assert got["a", day(0)] == got["b", day(0)] == (40.0, 60.0)


def test_calibrated_intervals_cover_days_held_out(spark):
    rng = np.random.default_rng(11)
    lines = {n: (400 * rng.lognormal(0, 0.3, 900)).tolist() for n in "ab"}
    frame = f.forecast_frame(series(spark, lines))
    errors = v.cv_errors(frame, festival(spark), initial=300)
    split = F.lit(day(600))
    table = v.interval_calibration(errors.where(F.col("cutoff") < split))
    held = errors.where(F.col("cutoff") >= split).join(table, ["line", "horizon_day"])
    inside = F.abs(F.col("y") - F.col("yhat")) <= F.col("margin") * F.col("yhat")
    for r in held.groupBy("line").agg(F.avg(inside.cast("int")).alias("share")).collect():
        assert 0.7 <= r["share"] <= 0.9


# ---------------------------------------------------------------- network


def net(spark, names, links):
    nodes = spark.createDataFrame([(n,) for n in names], "line string")
    edges = spark.createDataFrame([(*sorted(x), 0.9) for x in links],
                                  "a string, b string, r double")
    return nodes, edges


def test_chain(spark):
    names = "abcdefghij"
    nodes, edges = net(spark, names, list(zip(names, names[1:])))
    assert {r["component"] for r in g.graph_components(nodes, edges).collect()} == {"a"}
    hops = by_key(g.graph_paths(nodes, edges), "a", "b", "hops")
    assert len(hops) == 45 and hops["a", "j"] == 9
    between = by_key(g.graph_betweenness(nodes, edges), "line", "betweenness")
    for n, name in enumerate(names):
        assert between[name] == pytest.approx(n * (9 - n) / 36)
    summary = g.graph_summary(nodes, edges).first()
    assert (summary["nodes"], summary["edges"], summary["avg_clustering"]) == (10, 9, 0)
    assert summary["density"] == pytest.approx(0.2)


def test_star_with_a_triangle_and_islands(spark):
    nodes, edges = net(spark, "habcdxyz", [("h", n) for n in "abcd"] + [("a", "b"), ("x", "y")])
    sizes = by_key(g.component_sizes(g.graph_components(nodes, edges)), "component", "lines")
    assert sizes == {"a": 5, "x": 2, "z": 1}
    cluster = by_key(g.clustering(nodes, edges), "line", "clustering")
    assert cluster["h"] == pytest.approx(1 / 6) and cluster["a"] == 1 and cluster["z"] == 0
    scores = g.graph_betweenness(nodes, edges)
    assert scores.where("is_hub").first()["line"] == "h"
    assert by_key(scores, "line", "betweenness")["h"] == pytest.approx(5 / 21)
    paths = g.graph_paths(nodes, edges)
    assert g.mean_path_length(nodes, paths).first()[0] is None


def test_square_splits_paths(spark):
    nodes, edges = net(spark, "abcd", ["ab", "bc", "cd", "da"])
    scores = by_key(g.graph_betweenness(nodes, edges), "line", "betweenness")
    assert all(x == pytest.approx(1 / 6) for x in scores.values())
    paths = g.graph_paths(nodes, edges)
    assert g.mean_path_length(nodes, paths).first()[0] == pytest.approx(8 / 6)


def test_no_edges(spark):
    nodes, edges = net(spark, "abc", [])
    assert g.graph_components(nodes, edges).where("line <> component").count() == 0
    assert by_key(g.graph_betweenness(nodes, edges), "line", "betweenness") == dict.fromkeys("abc", 0)
    assert g.graph_paths(nodes, edges).count() == 0


# ---------------------------------------------------------------- shares and findings


def test_growth_compares_days_not_totals(spark):
    first = series(spark, {"BTS": [10] * 365, "SRT Red": [4] * 365})
    later = series(spark, {"BTS": [11] * 30, "SRT Red": [2] * 30}, dt.date(2026, 1, 1))
    daily = first.unionByName(later)
    growth = by_key(s.yoy_mode(daily, dim.mode_map(spark), 2025, 2026), "mode", "growth_pct")
    assert growth == {"BTS": 10.0, "SRT": -50.0}
    totals = by_key(s.yoy_mode(daily, dim.mode_map(spark), 2025, 2026, per_day=False),
                    "mode", "growth_pct")
    assert totals["BTS"] < 0
    row = s.share_headline(daily, dim.mode_map(spark), 2025, 2026).first()
    assert (row["top_mode"], row["fastest_mode"], row["weakest_mode"]) == ("BTS", "BTS", "SRT")


def test_findings(spark):
    rng = np.random.default_rng(3)
    base = np.array(planted(400, noise=0.05))
    daily = series(spark, {"A": base, "B": base * 0.5 + rng.random(400), "C": rng.random(400)})
    total = daily.groupBy("date").agg(F.sum("value").alias("value")).withColumn(
        "line", F.lit("TOTAL"))
    events = dim.events(spark, [("fest", "2025-06-10", "2025-06-11")])
    from tallyloom.operators.events import event_impact
    impact = event_impact(total, events)
    metrics = insight.key_metrics(daily, total, k.corr_matrix(daily), impact, "B", ("B", "A"),
                                  ["A", "B"], "fest")
    got = by_key(metrics, "metric", "label", "value")
    assert got["top_pair_r", "A / B"] == got["focus_pair_r", "A / B"] > 0.99
    assert got["event_impact_pct", "fest"] < -50
    assert got["top_line_mean", "A"] == pytest.approx(base.mean())
    rows = insight.insight_rows(metrics, impact).collect()
    assert [r["position"] for r in rows] == list(range(1, 11))
    assert all(r["title"] and r["evidence"] for r in rows)
    assert "N/A" in rows[9]["evidence"]                    # no model figures given
    board = insight.line_dashboard(daily, spark.createDataFrame(
        [("A", 3.21)], "line string, mape double")).collect()
    assert [r["model_mape"] for r in board] == [3.2, N, N]


def test_profile_distance(spark):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame(rng.random((60, 4)) + 1, columns=list("abcd"))
    daily = series(spark, {n: frame[n] for n in frame})
    got = by_key(k.corr_profile_distance(daily), "a", "b", "distance")
    m = (1 - np.log1p(frame).corr()).to_numpy()
    for (a, b), value in got.items():
        want = np.linalg.norm(m["abcd".index(a)] - m["abcd".index(b)])
        assert value == pytest.approx(want, abs=1e-6)
    assert k.nearest_line(k.corr_profile_distance(daily)).count() == 4


def test_weekday_ratio_variants(spark):
    daily = series(spark, {"a": [n % 7 for n in range(70)]})
    methods = {r["method"] for r in c.weekday_weekend_ratio(daily, daily).collect()}
    assert methods == {"mean_of_means", "mean_of_days"}


def test_schema_of_sources():
    assert tables.RAW_SCHEMA.names == list(tables.RAW_COLUMNS)


def test_correlation_of_chosen_pairs(spark):
    daily = series(spark, {"a": [1, 2, 4, 3], "b": [2, 3, 5, 4], "c": [4, 1, 2, 9]})
    every = {(r["a"], r["b"]): r["r"] for r in k.corr_matrix(daily).collect()}
    pairs = spark.createDataFrame([("c", "a")], "a string, b string")
    some = {(r["a"], r["b"]): r["r"] for r in k.corr_matrix(daily, pairs=pairs).collect()}
    assert some == {("a", "c"): pytest.approx(every["a", "c"])}
    strong = k.corr_matrix(daily, least=0.9).collect()
    assert [(r["a"], r["b"]) for r in strong] == [("a", "b")]


def test_profile_distance_in_parts(spark):
    rng = np.random.default_rng(5)
    daily = series(spark, {x: list(rng.random(40) + 1) for x in "abcde"})
    whole = by_key(k.corr_profile_distance(daily), "a", "b", "distance")
    parts = by_key(k.corr_profile_distance(daily, axis_lines=2), "a", "b", "distance")
    assert len(whole) == 10 and parts == {p: pytest.approx(d) for p, d in whole.items()}
