"""Delimited records over line ends and splits, and damaged ones."""

import csv
import io

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from tallyloom.sources import records, tables

THREE = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b", "c")])
HEAD = "a,b,c\n"


def read(spark, path, **given):
    good, rejects = tables.scan_csv_rejects(spark, str(path), THREE, **given)
    return (sorted(tuple(r) for r in good.select("a", "b", "c").collect()),
            sorted((r["reason"], r["record"]) for r in rejects.collect()))


def test_short_long_and_open_records(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text(HEAD + '1,x,"1,234"\n2,x,1,234\n3,x\n\n4,"two\nlines, ""q""\n",9\n'
                    '5,"open,7\n6,x,8\n7,5" pipe,8\n   \n8,"é","a"\n')
    good, bad = read(spark, path)
    assert good == [("1", "x", "1,234"), ("4", 'two\nlines, "q"\n', "9"), ("6", "x", "8"),
                    ("7", '5" pipe', "8"), ("8", "é", "a")]
    assert bad == [("open quote", '5,"open,7'), ("too few fields", "3,x"),
                   ("too many fields", "2,x,1,234")]
    with pytest.raises(Exception, match="damaged record"):
        tables.scan_csv(spark, str(path), THREE).count()


def test_places_and_numbers(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("\ufeff" + HEAD + "1,x,2\n3\n4,x,5\n", encoding="utf-8")
    _, rejects = tables.scan_csv_rejects(spark, str(path), THREE, by_position=True)
    assert [tuple(r) for r in rejects.collect()] == [("x.csv", 0, 2, "too few fields", "3")]
    path.write_text(HEAD + "1,x,2\n4,x,5\n")
    rows = tables.scan_csv(spark, str(path), THREE, source=3).orderBy("ingest_seq").collect()
    assert [(r["a"], r["ingest_seq"]["source"], r["ingest_seq"]["row"]) for r in rows] == [
        ("1", 3, 1), ("4", 3, 2)]


def test_header_of_every_file(spark, tmp_path):
    (tmp_path / "1.csv").write_text(HEAD + "1,x,2\n")
    (tmp_path / "2.csv").write_text("a,c,b\n1,x,2\n")
    with pytest.raises(Exception, match="wanted"):
        tables.scan_csv(spark, str(tmp_path), THREE).count()
    assert tables.scan_csv(spark, str(tmp_path), THREE, by_position=True).count() == 2
    (tmp_path / "2.csv").write_text(HEAD)
    assert tables.scan_csv(spark, str(tmp_path), THREE).count() == 1


@pytest.fixture
def narrow_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "97")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_records_across_splits(spark, tmp_path, narrow_splits):
    rows = [[str(k), ("line of text, " + "\n" * (k % 4) + '"q" ') * (1 + k % 2), "z" * (k % 7)]
            for k in range(200)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    path = tmp_path / "x.csv"
    path.write_text(HEAD + out.getvalue())
    good, bad = read(spark, path)
    assert bad == []
    assert good == sorted(tuple(None if v in tables.MISSING_TEXTS else v for v in r)
                          for r in rows)
    # a stray quote costs its own record, wherever it falls
    text = out.getvalue().replace('z"', "z")
    lines = ["1,x,2"] * 150
    for k in range(0, 150, 13):
        lines[k] = '1,"x,2'
    path.write_text(HEAD + "\n".join(lines) + "\n")
    good, bad = read(spark, path)
    assert len(good) == 150 - 12 and bad == [("open quote", '1,"x,2')] * 12
    assert text


def test_a_record_has_a_bound(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text(HEAD + '1,"' + "x\n" * 9 + '",2\n')
    assert read(spark, path)[0] == [("1", "x\n" * 9, "2")]
    good, bad = read(spark, path, most_lines=5)
    assert good == [] and len(bad) == 10


def test_fields():
    assert records.fields_of('a,"b,c",d') == 3 and records.fields_of('a,"b') == -1
    assert records.fields_of('a,"b"x,c') == 3 and records.fields_of("") == 0


class Batches:
    """Stands for a frame of lines: runs a function over their batches."""

    def __init__(self, batches):
        self.batches = batches

    def mapInArrow(self, run, schema):
        return list(run(iter(self.batches)))


def test_stray_quotes_do_not_cut_batches():
    lines = ['1,"x,2' if k % 10 == 3 else '1,"x' if k % 10 == 6 else 'y",2' if k % 10 == 7
             else "1,x,2" for k in range(5000)]
    given = [pa.RecordBatch.from_arrays(
        [pa.array(lines[a:a + 1000]), pa.array(["f"] * 1000), pa.array(["f"] * 1000),
         pa.array([97] * 1000, pa.int64())], ["value", "file", "source_file", "block"])
        for a in range(0, 5000, 1000)]
    out = records.in_splits(Batches(given), 3, None, 64)
    assert len(out) <= len(given)
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["line"] for r in rows] == [k for k in range(5000) if k % 10 != 7]
    assert all(r["record"] == ('1,"x\ny",2' if r["line"] % 10 == 6 else lines[r["line"]])
               for r in rows)
    assert [r["line"] for r in rows if r["seam"]] == [0, 1, 2, 3]


def test_lines_are_read_once(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text(HEAD + '1,x,2\n3\n4,"x,5\n')
    good, bad = tables.scan_csv_rejects(spark, str(path), THREE)
    for frame in (good, bad):
        assert frame.inputFiles() and all(f.endswith(".parquet") for f in frame.inputFiles())
