"""Dimension tables: small, given as rows, so their size is known before planning.

They become local relations; the planner broadcasts them because it knows how small they
are, and takes a shuffle join by itself should a caller pass a large one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# --- fixed values: these must equal the published analysis ---------------------------

RAIL_MODE = "ทางราง"
PUBLIC = "สาธารณะ"
PERSONS = "คน"
UNKNOWN_EVENT = "ไม่ทราบเหตุการณ์"

RAW_HEADERS = {
    "รูปแบบการเดินทาง": "mode",
    "วัตถุประสงค์": "purpose",
    "สาธารณะ/ส่วนบุคคล": "ownership",
    "หน่วยงาน": "agency",
    "ยานพาหนะ/ท่า": "vehicle",
    "วันที่": "date_raw",
    "หน่วย": "unit",
    "ปริมาณ": "qty_raw",
}

LEADS, TOGETHER = " leads ", "Simultaneous demand"          # verdicts on a pair of lines
NAIVE, WEEKLY, MODEL = "Naive (t-1)", "Seasonal Naive (t-7)", "Model"
BIAS_GRADES = ("Excellent", "Acceptable", "Biased")

LINE_OF_VEHICLE = {
    "รถไฟฟ้า BTS": "BTS",
    "รถไฟฟ้าสายสีน้ำเงิน": "MRT Blue",
    "รถไฟฟ้าสายสีม่วง": "MRT Purple",
    "รถไฟฟ้าสายสีเหลือง": "MRT Yellow",
    "รถไฟฟ้าสายสีชมพู": "MRT Pink",
    "รถไฟฟ้า ARL": "Airport Rail Link",
    "รถไฟฟ้าสายสีแดง": "SRT Red",
}

LINES_OF_MODE = {
    "BTS": ["BTS"],
    "MRT": ["MRT Blue", "MRT Purple", "MRT Yellow", "MRT Pink"],
    "ARL": ["Airport Rail Link"],
    "SRT": ["SRT Red"],
}

LAG_PAIRS = [
    ("BTS", "MRT Blue"),
    ("BTS", "MRT Purple"),
    ("Airport Rail Link", "BTS"),
    ("MRT Blue", "Airport Rail Link"),
]

# holiday, dates, days before, days after
HOLIDAYS = [
    ("songkran", ["2025-04-13", "2025-04-14", "2025-04-15",
                  "2026-04-13", "2026-04-14", "2026-04-15"], -3, 3),
    ("new_year", ["2025-01-01", "2026-01-01", "2027-01-01"], -1, 1),
    ("labor_day", ["2025-05-01", "2026-05-01"], -1, 1),
    ("national_day", ["2025-12-05", "2026-12-05"], -1, 1),
    ("constitution_day", ["2025-12-10", "2026-12-10"], -1, 1),
    ("royal_ploughing", ["2025-05-09"], -1, 1),
    ("coronation_day", ["2025-05-05"], -1, 1),
    ("visakha_bucha", ["2025-05-12"], -1, 1),
    ("asanha_bucha", ["2025-07-10"], -1, 1),
    ("king_bday", ["2025-07-28"], -1, 1),
    ("mother_day", ["2025-08-12"], -1, 1),
    ("long_weekend", ["2025-02-12", "2025-02-14", "2025-05-02", "2025-05-06",
                      "2025-07-29"], -1, 1),
    ("free_transit_week", ["2025-01-25", "2025-01-26", "2025-01-27", "2025-01-28",
                           "2025-01-29", "2025-01-30", "2025-01-31"], 0, 0),
]

# holiday, dates, days before, days after, prior scale
FORECAST_HOLIDAYS = [
    ("songkran", ["2025-04-13", "2025-04-14", "2025-04-15",
                  "2026-04-13", "2026-04-14", "2026-04-15",
                  "2027-04-13", "2027-04-14", "2027-04-15"], -3, 3, 15.0),
    ("new_year", ["2025-01-01", "2026-01-01", "2027-01-01"], -1, 1, 10.0),
    ("labor_day", ["2025-05-01", "2026-05-01", "2027-05-01"], -1, 1, 10.0),
    ("national_day", ["2025-12-05", "2026-12-05", "2027-12-05"], -1, 1, 10.0),
    ("constitution_day", ["2025-12-10", "2026-12-10", "2027-12-10"], -1, 1, 10.0),
    ("coronation_day", ["2025-05-05", "2026-05-04", "2027-05-05"], -1, 1, 10.0),
    ("visakha_bucha", ["2025-05-12", "2026-05-01", "2027-05-20"], -1, 1, 10.0),
    ("asanha_bucha", ["2025-07-10", "2026-06-29", "2027-07-18"], -1, 1, 10.0),
    ("king_bday", ["2025-07-28", "2026-07-28", "2027-07-28"], -1, 1, 10.0),
    ("mother_day", ["2025-08-12", "2026-08-12", "2027-08-12"], -1, 1, 10.0),
    ("long_weekend", ["2025-02-12", "2025-05-02", "2025-05-06", "2025-07-29"], -1, 1, 10.0),
    ("free_transit_week", ["2025-01-25", "2025-01-26", "2025-01-27", "2025-01-28",
                           "2025-01-29", "2025-01-30", "2025-01-31"], 0, 0, 20.0),
]

# event, first day, last day
EVENTS = [
    ("สงกรานต์ 2025", "2025-04-12", "2025-04-16"),
    ("ปีใหม่ 2026", "2025-12-31", "2026-01-02"),
    ("รถไฟฟ้าฟรี ม.ค. 2025", "2025-01-25", "2025-01-31"),
]
EARLY_EVENT = ("ปีใหม่ 2025", "2024-12-31", "2025-01-02")

FELL, ROSE = "Drop", "Spike"
# --- end of fixed values -------------------------------------------------------------

HOLIDAY_COLUMNS = ("holiday string, ds date, lower_window int, upper_window int, "
                   "prior_scale double")


def local_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A local relation.

    Rows handed over as a list become a scan of unknown size, which the planner would join
    by shuffling the large side; an Arrow table keeps its size.
    """
    schema = T._parse_datatype_string(ddl)
    columns = list(zip(*rows)) or [[] for _ in schema]
    arrow = to_arrow_schema(schema)
    table = pa.table([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)],
                     schema=arrow)
    return spark.createDataFrame(table, schema)


def _day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def mapping(spark: SparkSession, pairs: Mapping[str, str], key: str, item: str) -> DataFrame:
    return local_table(spark, list(pairs.items()), f"{key} string, {item} string")


def line_map(spark: SparkSession, pairs: Mapping[str, str] = LINE_OF_VEHICLE) -> DataFrame:
    return mapping(spark, pairs, "vehicle", "line")


def mode_map(spark: SparkSession,
             groups: Mapping[str, Sequence[str]] = LINES_OF_MODE) -> DataFrame:
    return mapping(spark, {line: m for m, lines in groups.items() for line in lines},
                   "line", "mode")


def lag_pairs(spark: SparkSession, pairs: Sequence[tuple[str, str]] = LAG_PAIRS) -> DataFrame:
    return local_table(spark, list(pairs), "line_a string, line_b string")


def holidays(spark: SparkSession, groups: Sequence[tuple] = HOLIDAYS) -> DataFrame:
    """One row per holiday date; groups are ``(name, dates, lower, upper[, prior])``."""
    rows = [(g[0], _day(d), g[2], g[3], float(g[4]) if len(g) > 4 else 10.0)
            for g in groups for d in g[1]]
    return local_table(spark, rows, HOLIDAY_COLUMNS)


def yearly_holidays(spark: SparkSession, rules: Sequence[tuple], first_year: int,
                    last_year: int) -> DataFrame:
    """Fixed-date holidays repeated every year; rules are
    ``(name, [(month, day), ...], lower, upper, prior)``."""
    rows = [(name, dt.date(year, m, d), lower, upper, float(prior))
            for name, days, lower, upper, prior in rules
            for year in range(first_year, last_year + 1) for m, d in days]
    return local_table(spark, rows, HOLIDAY_COLUMNS)


def events(spark: SparkSession, windows: Sequence[tuple[str, str, str]] = EVENTS) -> DataFrame:
    rows = [(name, _day(a), _day(b)) for name, a, b in windows]
    return local_table(spark, rows, "event string, start_date date, end_date date")


def listed_days(spark: SparkSession, days: Sequence[tuple[str, str]]) -> DataFrame:
    """Days with a name, as ``(date, event)``."""
    return local_table(spark, [(_day(d), name) for d, name in days], "date date, event string")


def events_for(spark: SparkSession, total: DataFrame) -> DataFrame:
    """The published events; the early one only when the data reaches back to it."""
    early = events(spark, [EARLY_EVENT])
    return events(spark).unionByName(
        early.where(F.col("start_date") >= total.agg(F.min("date")).scalar()))
