"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_by_value, staged

ship_by_value(__name__)

# The six white-space characters that separate words.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def worker_cache(key: str, build: Callable[[], object]) -> object:
    """One object per Python worker and key, kept from task to task.

    Functions reach the workers by value, so their module's globals are new in each job;
    the cache hangs on a module of its own instead.
    """
    home = sys.modules.setdefault("_tallyloom_worker", types.ModuleType("_tallyloom_worker"))
    if not hasattr(home, "kept"):
        home.kept = {}
    if key not in home.kept:
        home.kept[key] = build()
    return home.kept[key]


def unused(columns: Sequence[str], name: str) -> str:
    """``name``, lengthened until no column is called so (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; the built-in lower-casing serves where a text is all ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (F.when(F.length(text) == F.octet_length(text), F.lower(text))
            .otherwise(F.translate(text, upper, upper.lower())))


def small(df: DataFrame) -> DataFrame:
    """Write a small table and read it back: the planner then knows its size, and
    broadcasts it or not by ``spark.sql.autoBroadcastJoinThreshold``.  Only its few rows go
    to one task; what makes them stays spread out."""
    return staged(df.repartition(1))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
