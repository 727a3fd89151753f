"""The flows with the published dimensions on a small raw table."""

import datetime as dt

import pytest
from frames import by_key
from pyspark.sql import functions as F

from tallyloom import dimensions as dim
from tallyloom.plans import flows


@pytest.fixture(scope="module")
def raw(spark):
    rows, seq = [], 0
    for vehicle, base in (("รถไฟฟ้า BTS", 700_000), ("รถไฟฟ้าสายสีน้ำเงิน", 400_000),
                          ("รถไฟฟ้าสายสีม่วง", 60_000), ("รถไฟฟ้า ARL", 70_000),
                          ("รถไฟฟ้าสายสีแดง", 30_000), ("รถไฟทางไกล", 9_000)):
        for n in range(420):
            d = dt.date(2025, 1, 1) + dt.timedelta(days=n)
            value = base * (0.7 if d.weekday() >= 5 else 1.0) + n * 10
            if dt.date(2025, 1, 25) <= d <= dt.date(2025, 1, 31):
                value *= 1.6
            text = f"{value:,.0f}"
            if vehicle == "รถไฟฟ้า ARL" and n in (50, 51):
                text = "n/a"
            rows.append(("ทางราง", "p", "สาธารณะ", "รฟม.", vehicle, d.strftime("%d/%m/%Y"),
                         "คน", text, seq))
            seq += 1
            if n == 9:
                rows.append((*rows[-1][:7], "1", seq))          # a later copy of the key
                seq += 1
    rows += [(None,) * 8 + (seq,),
             ("ทางถนน", "p", "สาธารณะ", "x", "รถเมล์", "01/01/2025", "คน", "5", seq + 1),
             ("ทางราง", "p", "สาธารณะ", "x", "รถไฟฟ้า BTS", "01/01/2025", "คัน", "5", seq + 2),
             ("ทางราง", "p", "สาธารณะ", "x", "รถไฟฟ้า BTS", "31/02/2025", "คน", "5", seq + 3),
             ("ทางราง", "p", "สาธารณะ", "x", "รถไฟฟ้า BTS", "01/01/2024", "คน", "5", seq + 4)]
    return spark.createDataFrame(
        rows, "mode string, purpose string, ownership string, agency string, vehicle string, "
              "date_raw string, unit string, qty_raw string, ingest_seq long")


def test_flows(spark, raw):
    series = flows.to_daily(raw, dim.line_map(spark))
    assert series.clean.count() == 6 * 420 + 1
    assert series.daily.count() == 5 * 420
    arl = by_key(series.daily.where("line = 'Airport Rail Link'"), "date", "value")
    before, after = arl[dt.date(2025, 2, 19)], arl[dt.date(2025, 2, 22)]
    assert arl[dt.date(2025, 2, 20)] == pytest.approx(before + (after - before) / 3)
    assert series.total.count() == 420

    found = flows.detect(series, dim.holidays(spark), dim.events_for(spark, series.total))
    impact = by_key(found.impact, "event", "impact_pct")
    assert impact["รถไฟฟ้าฟรี ม.ค. 2025"] > 40
    assert found.summary.first()["days"] == 420
    labels = {r["holiday"] for r in found.mapped.collect()}
    assert "free_transit_week" in labels

    result = flows.predict(series, dim.holidays(spark, dim.FORECAST_HOLIDAYS))
    errors = by_key(result.errors, "line", "mape")
    assert len(errors) == 6 and all(x < 15 for x in errors.values())
    assert result.by_horizon.where(F.col("line") == "TOTAL").count() == 30


def test_empty_input_is_an_error(spark, raw):
    with pytest.raises(ValueError):
        flows.to_daily(raw.where("false"), dim.line_map(spark))


HEADER = "รูปแบบการเดินทาง,วัตถุประสงค์,สาธารณะ/ส่วนบุคคล,หน่วยงาน,ยานพาหนะ/ท่า,วันที่,หน่วย,ปริมาณ\n"


def test_yearly_files(spark, tmp_path):
    line = "ทางราง,p,สาธารณะ,รฟม.,รถไฟฟ้า BTS,01/01/2026,คน,{}\n"
    for name, values in (("b.csv", ("1", "2")), ("a.csv", ("3",))):
        (tmp_path / name).write_text(HEADER + "".join(line.format(x) for x in values), "utf-8")
    table = flows.read_years(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")])
    assert [r["qty_raw"] for r in table.orderBy("ingest_seq").collect()] == ["1", "2", "3"]
    kept = flows.clean_rows(table).collect()
    assert [r["qty"] for r in kept] == [1.0]
    (tmp_path / "c.csv").write_text("x,y\n1,2\n", "utf-8")
    with pytest.raises(ValueError):
        flows.read_years(spark, [str(tmp_path / "a.csv"), str(tmp_path / "c.csv")])
