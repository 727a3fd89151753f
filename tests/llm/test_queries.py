"""The registered queries of the subpackage on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks import compare
from tallyloom.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    ours = compare.spark_rows(queries.QUERIES[name](spark, FOLDER))
    assert ours == compare.duck_rows(compare.connect(FOLDER), queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(
    set(queries.QUERIES) - set(queries.ORACLES) - {"op11_spelling"}))
def test_one_row_per_input_row(spark, name):
    table, key = ("pages", "page_id") if name.startswith("op8") else ("documents", "doc_id")
    given = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    got = queries.QUERIES[name](spark, FOLDER).select(key)
    assert got.exceptAll(given.select(key)).isEmpty() and got.count() == given.count()
