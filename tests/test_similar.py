"""Correlated lines by sketches, and correlation by parts of the day axis."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import correlate, graph, similar

from frames import START, series


def table(spark, values):
    """The daily table of an array with one row per line; NaN is a missing day."""
    rows = [(START + dt.timedelta(days=int(d)), f"l{k:05d}", float(v))
            for k, row in enumerate(values) for d, v in enumerate(row) if v == v]
    return spark.createDataFrame(rows, "date date, line string, value double")


def related(draw, lines, days, r):
    """Line 2k + 1 has the exact correlation ``r`` with line 2k, or ``-r`` for odd k."""
    out = np.zeros((lines, days))
    for k in range(0, lines, 2):
        x, y = draw.randn(2, days)
        x = (x - x.mean()) / x.std()
        y = y - y.mean()
        y -= x * (x @ y) / days
        y /= y.std()
        out[k], out[k + 1] = x, (r * x + (1 - r * r) ** 0.5 * y) * (1 if k % 4 else -1)
    return out * 50 + 1000


def test_parts_add_up_to_the_whole(spark):
    draw = np.random.RandomState(1)
    values = np.abs(draw.randn(7, 90)) * 1e6 + 1e9
    values[1] = 3.0                            # constant: no correlation
    values[2, :40] = np.nan
    values[3, 40:] = np.nan                    # no day in common with line 2
    daily = table(spark, values)
    for log in (False, True):
        whole = {(r["a"], r["b"]): (r["n"], r["r"]) for r in
                 correlate.corr_matrix(daily, log).collect() if r["n"]}
        for days in (1, 7, 64):
            parts = {(r["a"], r["b"]): (r["n"], r["r"]) for r in
                     correlate.corr_matrix(daily, log, part_days=days).collect()}
            assert parts.keys() == whole.keys()
            for pair, (n, r) in parts.items():
                assert n == whole[pair][0] and r == pytest.approx(whole[pair][1], abs=1e-9)


def test_given_pairs_are_exact(spark):
    daily = table(spark, related(np.random.RandomState(2), 8, 60, 0.7))
    whole = {(r["a"], r["b"]): r["r"] for r in correlate.corr_matrix(daily).collect()}
    pairs = spark.createDataFrame([("l00000", "l00001"), ("l00002", "l00007")],
                                  "a string, b string")
    got = {(r["a"], r["b"]): r["r"] for r in
           similar.corr_of_pairs(daily, pairs, part_days=16).collect()}
    assert got == {p: pytest.approx(whole[p], abs=1e-9) for p in got} and len(got) == 2


@pytest.mark.parametrize("least", [0.6, 0.8])
def test_recall_at_the_threshold(spark, least):
    """400 pairs just above the threshold; the bound on misses leaves 4 of them."""
    daily = table(spark, related(np.random.RandomState(3), 800, 120, least + 1e-6))
    want = {(f"l{k:05d}", f"l{k + 1:05d}") for k in range(0, 800, 2)}
    got = {(r["a"], r["b"]) for r in similar.corr_search(daily, least, part_days=50).collect()}
    assert len(want - got) <= 20
    exact = {(r["a"], r["b"]) for r in correlate.corr_matrix(daily, least=least).collect()}
    assert got <= exact


def test_search_on_many_lines_is_not_quadratic(spark):
    """20,000 lines: candidates are a small share of the 200 million pairs, and hold the
    10,000 related ones."""
    ids = spark.range(20000 * 40, numPartitions=8)
    line, day = F.col("id") % 20000, F.floor(F.col("id") / 20000).cast("int")

    def noise(key):
        unit = F.pmod(F.xxhash64(key, day), F.lit(1 << 20)) / F.lit(float(1 << 20))
        return unit - 0.5

    daily = ids.select(
        F.date_add(F.lit(START), day).alias("date"), F.format_string("l%05d", line).alias("line"),
        (noise(F.floor(line / 2)) + 0.2 * noise(-1 - line)).alias("value"))
    found = similar.candidate_pairs(daily, 0.9).withColumn(
        "related", F.substring("a", 2, 5).cast("int") + 1 == F.substring("b", 2, 5).cast("int"))
    n, related_ = found.agg(F.count("*"), F.sum(F.col("related").cast("int"))).first()
    assert related_ >= 9900 and n < 0.005 * 20000 * 19999 / 2


def test_search_edges(spark):
    flat = {"a": [1, 2, 3, 4], "b": [2, 4, 6, 8], "c": [4, 3, 2, 1], "d": [5, 5, 5, 5]}
    daily = series(spark, flat)
    got = {(r["a"], r["b"], round(r["r"], 6)) for r in
           graph.corr_edges(daily, 0.9, search=True).collect()}
    assert got == {("a", "b", 1.0), ("a", "c", -1.0), ("b", "c", -1.0)}
    assert graph.corr_edges(daily.where("line = 'x'"), 0.9, search=True).count() == 0
