"""Run registered queries in Spark and DuckDB and compare every cell.

    python -m checks.compare /root/testdata/sf0.01 [section or query name ...]
"""

from __future__ import annotations

import datetime as dt
import glob
import importlib
import os
import sys
import time

import duckdb

from . import registry

SECTIONS = ("ingest", "shaping", "comparison", "detection", "forecasting", "evaluation",
            "findings", "network")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float) and v != v:
        return "NaN"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return repr(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_cell(v) for v in row) for row in df.select(*names).collect())


def duck_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    rows = sorted(tuple(_cell(row[k]) for k in order) for row in result.fetchall())
    return [names[k] for k in order], rows


def difference(spark, con, folder, name) -> str | None:
    """None when equal, else a short description."""
    names, ours = spark_rows(registry.QUERIES[name](spark, folder))
    if name not in registry.ORACLES:
        return None
    expected_names, expected = duck_rows(con, registry.ORACLES[name])
    if names != expected_names:
        return f"columns {names} / {expected_names}"
    if len(ours) != len(expected):
        return f"rows {len(ours)} / {len(expected)}; {set(ours) ^ set(expected)!s:.300}"
    wrong = [(a, b) for a, b in zip(ours, expected) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows differ: {names} {wrong[0][0]} / {wrong[0][1]}"
    return None


def main(folder: str, wanted: list[str]) -> int:
    from tallyloom.session import local_session

    sections = [w for w in wanted if w in SECTIONS]
    named = [w for w in wanted if w not in SECTIONS]
    for s in SECTIONS if named or not sections else sections:
        importlib.import_module(f"checks.{s}")
    names = named or [n for n, f in registry.QUERIES.items()
                      if not sections or f.__module__.rpartition(".")[2] in sections]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in names:
        t = time.time()
        try:
            problem = difference(spark, con, folder, name)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {time.time() - t:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} equal")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
