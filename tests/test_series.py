"""Dense series, comparison, correlation and events against hand values and pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from frames import START, by_key, day, series
from pyspark.sql import functions as F

from tallyloom import dimensions as dim
from tallyloom.operators import compare as c
from tallyloom.operators import correlate as k
from tallyloom.operators import events as e
from tallyloom.operators import reshape as r

N = None


def test_time_interpolation(spark):
    df = series(spark, {"a": [N, 1, N, N, N, N, N, 7, N, N, N, N]})
    inside = by_key(r.interpolate_time(df), "date", "value")
    assert [inside[day(x)] for x in range(12)] == [N, 1, 2, 3, 4, N, N, 7, N, N, N, N]
    tail = by_key(r.interpolate_time(df, inside=False), "date", "value")
    assert [tail[day(x)] for x in range(12)] == [N, 1, 2, 3, 4, N, N, 7, 7, 7, 7, N]


def test_densify_spans_the_whole_table(spark):
    cells = spark.createDataFrame(
        [(day(2), "a", 1.0), (day(4), "a", 2.0), (day(0), "b", 3.0), (day(6), "b", 4.0)],
        "date date, line string, value double")
    dense = r.densify_daily(cells)
    assert dense.count() == 14
    assert dense.where("value is not null").count() == 4
    got = by_key(r.fill_daily(cells), "line", "date", "value")
    assert [got["a", day(x)] for x in range(7)] == [0, 0, 1, 1.5, 2, 0, 0]
    assert [got["b", day(x)] for x in range(7)] == pytest.approx(
        [3, 3 + 1 / 6, 3 + 2 / 6, 3.5, 0, 0, 4])
    checks = {row["check_name"]: row["passed"] for row in
              r.integrity_check(r.fill_daily(cells)).collect()}
    assert checks == {"one_row_per_day": True, "no_missing_day": True, "no_null": True,
                      "enough_lines": False}


def test_densify_keeps_the_partitioning(spark):
    plan = r.interpolate_time(r.densify_daily(series(spark, {"a": [1, 2], "b": [3, 4]})))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(line") == 1


def test_week_label(spark):
    df = spark.createDataFrame([(dt.date(2025, 12, 29), "TOTAL", 10.0),
                                (dt.date(2024, 12, 30), "TOTAL", 4.0)],
                               "date date, line string, value double")
    assert {row["year_week"] for row in c.calendar_grid(df).collect()} == {"2025-W01", "2024-W01"}
    assert {row["year_week"] for row in c.calendar_grid(df, iso_year=True).collect()} == {
        "2026-W01", "2025-W01"}


def test_base_index(spark):
    df = series(spark, {"a": [0, 2, 4, 0, 6, 8, 10, 12, 14, 100], "none": [0] * 10})
    got = by_key(c.base_index(df), "line", "date", "index_value")
    assert got["a", day(1)] == pytest.approx(100 * 2 / 8)
    assert got["none", day(1)] == 0


def test_rolling_std_needs_all_lines(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random(40) + 1, rng.random(40) + 1
    b[35] = 0
    got = by_key(c.rolling_std30(series(spark, {"a": a, "b": b})), "line", "date", "rolling_std")
    frame = pd.DataFrame({"a": a, "b": b}).replace(0, np.nan).rolling(30).std().dropna()
    assert len(got) == 2 * len(frame)
    for row in frame.index:
        assert got["a", day(row)] == pytest.approx(frame.loc[row, "a"])


def test_ranking_uses_rounded_values(spark):
    got = c.line_ranking(series(spark, {"a": [0, 1, 2, 4]})).first()
    assert (got["avg_daily"], got["std_daily"], got["cv_pct"]) == (2, 2, 100.0)


@pytest.mark.parametrize("block", [2, 128])
def test_correlation_matrix(spark, block):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({f"s{i}": rng.random(50) * 10 for i in range(7)})
    frame["s1"] = frame["s0"] * 2 + 1
    frame["flat"] = 3.3
    frame.iloc[5:15, 2] = np.nan
    df = series(spark, {n: [N if np.isnan(v) else v for v in frame[n]] for n in frame})
    pairs = k.all_pairs(df, "line", F.unix_date("date"), F.col("value"), k._pearson, "r", block)
    got = by_key(pairs, "a", "b", "r")
    want = frame.corr()
    assert len(got) == 8 * 7 // 2
    for (a, b), value in got.items():
        assert a < b
        if np.isnan(want.loc[a, b]):
            assert value is None
        else:
            assert value == pytest.approx(want.loc[a, b]) and -1 <= value <= 1


def test_lag_correlation_finds_a_leader(spark):
    rng = np.random.default_rng(2)
    lead = rng.random(200)
    follow = np.r_[0.5, lead[:-1]] + rng.random(200) * 0.01
    df = series(spark, {"x": lead, "y": follow, "flat": [1] * 200})
    pairs = dim.lag_pairs(spark, [("x", "y"), ("y", "x"), ("x", "flat"), ("x", "absent")])
    got = by_key(k.lag_corr(df, pairs), "line_a", "line_b", "verdict")
    assert got == {("x", "y"): "x leads y", ("y", "x"): "x leads y",
                   ("x", "flat"): "Simultaneous demand"}


def zscore(values):
    s = pd.Series(values, dtype=float)
    mean = s.rolling(30, min_periods=15).mean().shift(1)
    std = s.rolling(30, min_periods=15).std().shift(1).clip(lower=0.1 * s.std())
    return ((s - mean) / std).fillna((s - s.mean()) / s.std())


def test_rolling_zscore(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(100, 5, 120)
    values[40:75] = 100          # a quiet stretch needs the floor
    values[90], values[100] = 160, 20
    scored = e.rolling_zscore(series(spark, {"TOTAL": values}))
    got = by_key(scored, "date", "z_score")
    for row, want in enumerate(zscore(values)):
        assert got[day(row)] == pytest.approx(want)
    kinds = by_key(e.anomaly_class(scored), "date", "anomaly_type")
    assert kinds[day(90)] == "spike" and kinds[day(100)] == "drop"
    summary = e.anomaly_summary(scored).first()
    assert summary["weekday_anomalies"] + summary["weekend_anomalies"] == summary["anomalies"] > 0


def test_constant_series_has_no_score(spark):
    got = e.anomaly_class(e.rolling_zscore(series(spark, {"TOTAL": [5] * 40})))
    assert got.where("z_score is not null").count() == 0
    assert got.where("anomaly_type <> 'normal'").count() == 0


def test_holiday_windows(spark):
    days = by_key(e.holiday_expand(dim.holidays(spark)), "date", "holiday")
    assert days[dt.date(2025, 4, 10)] == "songkran" and dt.date(2025, 4, 9) not in days
    assert days[dt.date(2025, 5, 5)] == "coronation_day,long_weekend"
    assert sum(1 for h in days.values() if h == "free_transit_week") == 7
    assert dim.holidays(spark).count() == 33


def test_event_impact(spark):
    values = np.full(60, 100.0)
    values[25 - 21:25 - 7 + 1] = 50            # fifteen days of baseline, both ends in
    values[25:28] = 60
    total = series(spark, {"TOTAL": values})
    event = dim.events(spark, [("x", str(day(25)), str(day(27))),
                               ("outside", "2020-01-01", "2020-01-03")])
    row = e.event_impact(total, event).collect()
    assert len(row) == 1 and row[0]["baseline_avg"] == 50 and row[0]["impact_pct"] == 20.0
    lines = e.event_impact_by_line(series(spark, {"a": values, "zero": [0] * 60}), event).collect()
    assert [(x["line"], x["impact_pct"], x["direction"]) for x in lines] == [("a", 20.0, "Spike")]


def test_early_event_only_with_early_data(spark):
    assert dim.events_for(spark, series(spark, {"TOTAL": [1, 2]})).count() == 3
    early = series(spark, {"TOTAL": [1, 2]}, START - dt.timedelta(days=5))
    assert dim.events_for(spark, early).count() == 4


def test_shares_sum_to_hundred(spark):
    rng = np.random.default_rng(5)
    df = series(spark, {"a": rng.random(30), "b": rng.random(30), "c": [0] * 30})
    sums = c.line_share(df).groupBy("date").agg(F.sum("share_pct").alias("s")).collect()
    assert all(x["s"] == pytest.approx(100) for x in sums)
    empty = c.line_share(series(spark, {"a": [0, 1], "b": [0, 1]})).where("share_pct is null")
    assert empty.count() == 2


def test_histogram_counts_every_row(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 2, 3, 10]], "v double")
    bins = [x["n"] for x in e.histogram(df, "v", 3).collect()]
    assert bins == [4, 0, 1]
    flat = spark.createDataFrame([(2.0,)] * 4, "v double")
    assert [x["n"] for x in e.histogram(flat, "v", 2).collect()] == [4, 0]
