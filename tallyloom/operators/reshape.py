"""From clean long rows to dense daily series, and their calendar features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import day_name, is_weekend, percent, whole_number
from .rows import attach_row

TOTAL = "TOTAL"


def map_dimension(df: DataFrame, dim: DataFrame, key: str = "vehicle") -> DataFrame:
    """Look up ``line`` by name; names without an entry get null."""
    return df.join(dim, key, "left")


def unmapped_keys(df: DataFrame, dim: DataFrame, key: str = "vehicle") -> DataFrame:
    """Names without an entry, with the rows they lose."""
    return (df.groupBy(key).agg(F.count("*").alias("rows"))
            .join(dim, key, "left_anti").orderBy(key))


def mapped_only(df: DataFrame, dim: DataFrame, key: str = "vehicle") -> DataFrame:
    return df.join(dim, key)


def daily_cells(df: DataFrame, line: str = "line", day: str = "date",
                value: str = "qty") -> DataFrame:
    """One row per line and day: the sum of all rows of the cell."""
    return df.groupBy(F.col(line).alias("line"), F.col(day).alias("date")).agg(
        F.sum(value).alias("value"))


def pivot_daily(cells: DataFrame, lines: Sequence[str]) -> DataFrame:
    """Wide form for presentation.  The lines are given, so no extra pass finds them."""
    return cells.groupBy("date").pivot("line", list(lines)).agg(F.sum("value"))


def unpivot_daily(wide: DataFrame, lines: Sequence[str]) -> DataFrame:
    return wide.unpivot("date", list(lines), "line", "value")


def series_missing(cells: DataFrame) -> DataFrame:
    """Per line, the days present in the table but not in the line."""
    days = cells.agg(F.countDistinct("date")).scalar()
    per = cells.groupBy("line").agg(F.count("value").alias("_seen"))
    missing = days - F.col("_seen")
    return (per.select("line", missing.alias("missing_days"),
                       F.round(percent(missing, days), 1).alias("missing_pct"))
            .orderBy(F.desc("missing_days"), "line"))


def densify_daily(cells: DataFrame) -> DataFrame:
    """A row for every line and day between the first and last date of the table.

    Each row is stretched up to the day before the next row of its line (the first one
    also back to the common start), so the calendar is not joined to the data and the
    frame stays partitioned by line for the windows that follow.
    """
    by_date = Window.partitionBy("line").orderBy("date")
    ends = cells.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    opening = F.lag("date").over(by_date).isNull()
    until = F.coalesce(F.date_sub(F.lead("date").over(by_date), 1), F.col("_hi"))
    return (attach_row(cells, ends)
            .withColumns({"_from": F.when(opening, F.col("_lo")).otherwise(F.col("date")),
                          "_until": until})
            .select("line", F.col("date").alias("_own"), F.col("value").alias("_value"),
                    F.explode(F.sequence("_from", "_until")).alias("date"))
            .select("date", "line",
                    F.when(F.col("date") == F.col("_own"), F.col("_value")).alias("value")))


def interpolate_time(dense: DataFrame, limit: int = 3, inside: bool = True) -> DataFrame:
    """Time-weighted fill of at most ``limit`` days after a known value.

    With ``inside`` nothing is filled before the first or after the last known day;
    without it the last value is also carried forward, up to the limit.
    """
    upto = (Window.unboundedPreceding, Window.currentRow)
    by_date = Window.partitionBy("line").orderBy("date").rowsBetween(*upto)
    # the same growing frame from the other end: a frame that shrinks is quadratic
    by_date_back = Window.partitionBy("line").orderBy(F.desc("date")).rowsBetween(*upto)
    known = F.when(F.col("value").isNotNull(), F.struct("date", "value"))
    found = dense.withColumn("_p", F.last(known, ignorenulls=True).over(by_date)).withColumn(
        "_n", F.last(known, ignorenulls=True).over(by_date_back))
    after = F.datediff("date", "_p.date")
    between = F.col("_p.value") + (F.col("_n.value") - F.col("_p.value")) * after / F.datediff(
        "_n.date", "_p.date")
    if not inside:
        between = F.coalesce(between, F.col("_p.value"))
    filled = F.when(F.col("value").isNotNull(), F.col("value")).when(after <= limit, between)
    return found.select("date", "line", filled.alias("value"))


def zero_fill(dense: DataFrame) -> DataFrame:
    """What is still missing counts as a day without service."""
    return dense.withColumn("value", F.coalesce("value", F.lit(0.0)))


def fill_daily(cells: DataFrame, limit: int = 3) -> DataFrame:
    """Dense daily series without nulls."""
    return zero_fill(interpolate_time(densify_daily(cells), limit))


def integrity_check(daily: DataFrame, min_lines: int = 5) -> DataFrame:
    """One row per check of the dense table: value found, value expected, verdict."""
    per_line = daily.groupBy("line").agg(
        F.min("date").alias("lo"), F.max("date").alias("hi"), F.count("*").alias("rows"),
        F.countDistinct("date").alias("days"), F.count_if(F.col("value").isNull()).alias("nulls"))
    span = F.max(F.datediff("hi", "lo") + 1).cast("bigint")
    found = per_line.agg(
        F.count("*").alias("lines"), F.sum("rows").alias("rows"), F.sum("days").alias("days"),
        F.sum("nulls").alias("nulls"), span.alias("span"))
    grid = F.col("lines") * F.col("span")

    def check(name, value, wanted, ok):
        return F.struct(F.lit(name).alias("check_name"), value.cast("bigint").alias("found"),
                        wanted.cast("bigint").alias("expected"), ok.alias("passed"))

    return found.select(F.inline(F.array(
        check("one_row_per_day", F.col("rows"), F.col("days"), F.col("rows") == F.col("days")),
        check("no_missing_day", F.col("days"), grid, F.col("days") == grid),
        check("no_null", F.col("nulls"), F.lit(0), F.col("nulls") == 0),
        check("enough_lines", F.col("lines"), F.lit(min_lines), F.col("lines") >= min_lines))))


def calendar_features(daily: DataFrame) -> DataFrame:
    """Year, month, weekday name and number (Monday 0), weekend flag."""
    return daily.withColumns({
        "year": F.year("date"), "month": F.month("date"),
        "day_of_week": day_name(F.col("date")), "dow": F.weekday("date"),
        "is_weekend": is_weekend(F.col("date"))})


def network_total(daily: DataFrame) -> DataFrame:
    """The sum over all lines per day, as a whole number, as the series ``TOTAL``."""
    return daily.groupBy("date").agg(
        whole_number(F.sum("value")).cast("double").alias("value")).select(
        "date", F.lit(TOTAL).alias("line"), "value")
