"""Cleaning and quality operators against hand values and pandas."""

import numpy as np
import pandas as pd
import pytest
from frames import by_key, day
from pyspark.sql import functions as F

from tallyloom.functions.columns import parse_day, parse_number
from tallyloom.operators import quality as q
from tallyloom.operators.quantiles import exact_quantiles
from tallyloom.sources import tables

N = None
GAPS = [N, 1, N, N, N, N, N, 7, N, N, N, N]
FILLED = [N, 1, 2, 3, 4, N, N, 7, 7, 7, 7, N]


def rows(spark, vehicles):
    data, seq = [], 0
    for name, values in vehicles.items():
        for k, v in enumerate(values):
            data.append((name, day(k), None if v is None else float(v), seq))
            seq += 1
    return spark.createDataFrame(data, "vehicle string, date date, qty double, ingest_seq long")


@pytest.mark.parametrize("block", [1, 2, 5, 1 << 20])
def test_interpolation_by_row(spark, block):
    df = rows(spark, {"a": GAPS, "b": [5, N, 8], "c": [N, N]})
    out = q.interpolate_rows(df, block_rows=block)
    got = by_key(out, "vehicle", "date", "qty")
    assert [got["a", day(k)] for k in range(12)] == FILLED
    assert [got["b", day(k)] for k in range(3)] == [5, 6.5, 8]
    assert [got["c", day(k)] for k in range(2)] == [N, N]


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_interpolation_of_a_hot_series_with_many_rows_per_day(spark, block):
    rng = np.random.default_rng(7)
    n = 600
    frame = pd.DataFrame({
        "vehicle": np.where(np.arange(n) % 10 < 9, "hot", "cold"),
        "date": [day(int(d)) for d in rng.integers(0, 12, n)],
        "qty": np.where(rng.random(n) < 0.6, np.nan, rng.integers(1, 100, n).astype(float)),
        "ingest_seq": np.arange(n)})
    ordered = frame.sort_values(["vehicle", "date", "ingest_seq"])
    expected = ordered.groupby("vehicle")["qty"].transform(
        lambda x: x.interpolate(method="linear", limit=3))
    df = spark.createDataFrame(
        [(r.vehicle, r.date, None if np.isnan(r.qty) else float(r.qty), int(r.ingest_seq))
         for r in frame.itertuples()], "vehicle string, date date, qty double, ingest_seq long")
    got = by_key(q.interpolate_rows(df, block_rows=block), "ingest_seq", "qty")
    for seq, want in zip(ordered["ingest_seq"], expected):
        have = got[int(seq)]
        assert (have is None) if np.isnan(want) else have == pytest.approx(want)


def test_interpolation_of_ties_unknown_keys_and_other_columns(spark):
    kind = "vehicle string, date date, qty double, ingest_seq long, series string, value int"
    df = spark.createDataFrame(
        [("a", day(0), 1.0, 1, "x", 7), ("a", day(1), None, 2, "y", 8),
         ("a", day(1), None, 2, "z", 9), ("a", day(2), 4.0, 3, "w", None),
         ("a", None, 2.0, 9, "u", 1), ("b", None, 3.0, None, "t", 2),
         ("b", day(0), None, None, "s", 3)], kind)
    out = q.interpolate_rows(df)
    assert out.columns == df.columns
    got = by_key(out, "series", "qty")
    # rows that agree in series, day and number share one value
    assert got["y"] == got["z"] and 1 < got["y"] < 4
    assert (got["x"], got["w"], got["u"], got["t"], got["s"]) == (1, 4, 2, 3, 3)
    assert q.interpolate_rows(df.where("false")).count() == 0
    unknown = df.withColumn("qty", F.lit(None).cast("double"))
    assert q.interpolate_rows(unknown).where("qty IS NOT NULL").count() == 0


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_interpolation_over_many_ranges_and_segments(spark, block):
    rng = np.random.default_rng(block)
    values = np.where(rng.random(5000) < 0.7, np.nan, rng.integers(1, 99, 5000).astype(float))
    rows_ = [("one", day(k // 50), None if np.isnan(x) else float(x), k)
             for k, x in enumerate(values)]
    df = spark.createDataFrame(rows_, "vehicle string, date date, qty double, ingest_seq long")
    got = by_key(q.interpolate_rows(df, block_rows=block), "ingest_seq", "qty")
    want = pd.Series(values).interpolate(method="linear", limit=3)
    for k, x in enumerate(want):
        assert (got[k] is None) if np.isnan(x) else got[k] == pytest.approx(x)


def test_rows_without_a_series_lose_their_value(spark):
    df = spark.createDataFrame([(None, day(0), 5.0, 1), ("a", day(0), 6.0, 2)],
                               "vehicle string, date date, qty double, ingest_seq long")
    assert by_key(q.interpolate_rows(df), "ingest_seq", "qty") == {1: None, 2: 6.0}


def test_parse_number(spark):
    texts = [" 1,234 ", "n/a", "", "nan", "-5", "1e3", "12d", "0x1F", ".5", "inf", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = by_key(df.select("k", parse_number(F.col("t")).alias("v")), "k", "v")
    assert [got[k] for k in range(len(texts))] == [
        1234, N, N, N, -5, 1000, N, N, 0.5, float("inf"), N]


def test_parse_day(spark):
    texts = ["13/01/2026", "2026-02-01", "01/02/2026", "31/02/2026", "1/2/2026", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = by_key(df.select("k", parse_day(F.col("t")).cast("string").alias("v")), "k", "v")
    assert [got[k] for k in range(6)] == ["2026-01-13", N, "2026-02-01", N, "2026-02-01", N]


def test_text_is_parsed_once(spark):
    df = spark.createDataFrame([("01/02/2026", "1")], "date_raw string, qty_raw string")
    out = q.clean_numeric(q.year_range_filter(q.parse_dates(df), 2025, 2026))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("gettimestamp") + plan.count("GetTimestamp") <= 1


def copies(spark, n=200):
    """One key holds most rows, each with its own value."""
    data = [(day(0), "hot", float(k), k) for k in range(n)]
    data += [(day(1), f"v{k}", float(k), n + k) for k in range(20)]
    data += [(day(1), "v3", -1.0, n + 50)]
    return spark.createDataFrame(data, "date date, vehicle string, qty double, ingest_seq long")


def test_duplicates(spark):
    df = copies(spark)
    assert by_key(q.dedup_first(df), "vehicle", "qty") == {
        "hot": 0.0, **{f"v{k}": float(k) for k in range(20)}}
    assert q.duplicate_keys(df).count() == 200
    cells = q.duplicate_cells(df, ("date", "vehicle"))
    assert cells.count() == 202 and cells.select("ingest_seq").distinct().count() == 202
    assert q.duplicate_summary(df).first().asDict() == {
        "rows": 221, "repeats": 200, "distinct_keys": 21}
    assert sorted(q.dedup_first(df).columns) == sorted(df.columns)


def distributions():
    rng = np.random.default_rng(3)
    return {
        "normal": rng.normal(0, 50, 3000), "heavy": np.exp(rng.normal(0, 8, 3000)),
        "one value": np.full(500, 4.25), "hot value": np.r_[np.full(2000, 7.0), rng.random(9)],
        "integers": rng.integers(-20, 20, 1000).astype(float), "single": np.array([3.5]),
        "tiny": rng.random(1500) * 1e-9}


PROBS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("name", list(distributions()))
def test_exact_quantiles_by_counting(spark, name):
    values = distributions()[name]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)],
                               "qty double")
    got = exact_quantiles(df, "qty", PROBS).first().asDict()
    for column, p in PROBS.items():
        assert got[column] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-15)


def test_exact_quantiles_per_key(spark):
    groups = distributions()
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs],
                               "key string, qty double")
    got = {r["key"]: r for r in
           exact_quantiles(df, "qty", PROBS, ["key"]).collect()}
    assert set(got) == set(groups)
    for name, values in groups.items():
        for column, p in PROBS.items():
            assert got[name][column] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-15)


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([], "qty double"), "qty", PROBS).count() == 0


def test_gaps(spark):
    df = spark.createDataFrame([(day(k), v) for k, v in
                                [(0, "a"), (1, "b"), (4, "a"), (5, "a"), (9, "b")]],
                               "date date, vehicle string")
    islands = [(r["gap_start"], r["gap_days"], r["short_gap"]) for r in q.gap_islands(df).collect()]
    assert islands == [(day(2), 2, True), (day(6), 3, True)]
    assert by_key(q.series_gaps(df), "vehicle", "missing_days") == {"a": 3, "b": 7}
    assert q.calendar_missing(df).first()["missing_days"] == 5


def test_profiles_and_counts(spark):
    df = spark.createDataFrame([("x", 1), (None, 2), (None, None)], "a string, b int")
    profile = {r["column_name"]: (r["non_null"], r["nulls"], r["null_pct"])
               for r in q.column_profile(df).collect()}
    assert profile == {"a": (1, 2, 66.67), "b": (2, 1, 33.33)}
    assert q.drop_empty_rows(df, ["a", "b"]).count() == 2
    counts = q.step_counts(df, q.has_any_value(["a", "b"])).first()
    assert (counts["rows_before"], counts["rows_after"], counts["rows_removed"]) == (3, 2, 1)


def test_sample_is_repeatable(spark):
    df = spark.range(1000).repartition(7)
    one = [r["id"] for r in q.sample_rows(df, ["id"]).collect()]
    two = [r["id"] for r in q.sample_rows(spark.range(1000), ["id"]).collect()]
    other = [r["id"] for r in q.sample_rows(df, ["id"], seed=1).collect()]
    assert one == two and len(one) == 5 and one != other


def test_csv_source(spark, tmp_path):
    text = ("รูปแบบการเดินทาง,วัตถุประสงค์,สาธารณะ/ส่วนบุคคล,หน่วยงาน,ยานพาหนะ/ท่า,วันที่,หน่วย,ปริมาณ\n"
            'ทางราง,x,สาธารณะ,รฟม.,รถไฟฟ้า BTS,01/01/2026,คน,"286,004"\n'
            ",,,,,,,\n"
            "ทางราง,x,สาธารณะ,n/a,รถไฟฟ้า ARL,02/01/2026,คน,nan\n")
    path = tmp_path / "passengers.csv"
    path.write_text(text, encoding="utf-8")
    df = tables.scan_csv(spark, str(path), by_position=True)
    got = df.select("vehicle", "agency", "qty_raw").collect()
    assert [tuple(r) for r in got] == [("รถไฟฟ้า BTS", "รฟม.", "286,004"), (N, N, N),
                                       ("รถไฟฟ้า ARL", N, N)]
    assert q.drop_empty_rows(df).count() == 2
    assert df.first()["source_file"] == "passengers.csv"


def test_input_checks(spark):
    one, two = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame(
        [(1, 2)], "a int, c int")
    check = {r["column_name"]: r["matches"] for r in tables.schema_check(one, two).collect()}
    assert check == {"a": True, "b": False, "c": False}
    with pytest.raises(ValueError):
        tables.union_sources(one, two)
    with pytest.raises(ValueError):
        tables.require_rows(one.where("a = 0"))
    assert tables.union_sources(one, one.select("b", "a")).count() == 2


def test_columns_bind_by_name(spark, tmp_path):
    one, two = tmp_path / "one.csv", tmp_path / "two.csv"
    names = list(tables.RAW_COLUMNS)
    one.write_text(",".join(names) + "\nm,p,o,a,v,1/1/2025,persons,20\n", "utf-8")
    swapped = names[:-2] + ["qty_raw", "unit"]
    two.write_text(",".join(swapped) + "\nm,p,o,a,v,1/1/2026,30,persons\n", "utf-8")
    got = tables.scan_csv(spark, [str(one), str(two)]).select("unit", "qty_raw").collect()
    assert sorted(tuple(r) for r in got) == [("persons", "20"), ("persons", "30")]
    renamed = tmp_path / "renamed.csv"
    renamed.write_text(",".join(["x", *names[1:]]) + "\nm,p,o,a,v,1/1/2025,persons,20\n", "utf-8")
    with pytest.raises(ValueError):
        tables.scan_csv(spark, str(renamed))
    assert tables.scan_csv(spark, str(renamed), headers={"x": "mode"}).first()["mode"] == "m"


def structs(spark, rows):
    """Rows numbered as two sources with split ids far beyond what a packed number holds."""
    df = spark.createDataFrame(rows, "vehicle string, date date, qty double, source long, "
                                     "split long, line long")
    row = F.shiftleft(F.col("split"), 33) + F.col("line")
    return df.select("vehicle", "date", "qty", F.struct(
        "source", F.lit("f").alias("file"), F.lit(0).cast("bigint").alias("block"),
        row.alias("row")).alias("ingest_seq"))


def test_row_numbers_without_a_cap(spark):
    d = day(0)
    df = structs(spark, [("a", d, 1.0, 0, 131_072, 0), ("a", d, 2.0, 0, 200_000, 5),
                         ("a", d, 3.0, 1, 0, 0), ("a", d, 4.0, 1, 300_000, 1),
                         (None, d, 5.0, 9_000, 1, 1), (None, d, 6.0, 9_000, 400_000, 2)])
    assert sorted(r["qty"] for r in q.dedup_first(df).collect()) == [1.0, 5.0]
    assert sorted(r["qty"] for r in q.duplicate_keys(df).collect()) == [2.0, 3.0, 4.0, 6.0]
    assert q.duplicate_cells(df, ("date", "vehicle")).count() == 6
    assert q.duplicate_summary(df).first().asDict() == {
        "rows": 6, "repeats": 4, "distinct_keys": 2}
    gap = structs(spark, [("a", d, 1.0, 0, 131_072, 0), ("a", d, None, 0, 200_000, 5),
                          ("a", d, 3.0, 1, 0, 0)])
    filled = q.interpolate_rows(gap).orderBy("ingest_seq").collect()
    assert [r["qty"] for r in filled] == [1.0, 2.0, 3.0]


def test_value_counts_leave_nulls_out(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "v string")
    assert [tuple(r) for r in q.value_counts(df, "v").collect()] == [("a", 2)]
    assert q.value_counts(df, "v", keep_nulls=True).count() == 2
