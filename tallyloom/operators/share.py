"""Share of each mode in the whole, and growth between years."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import percent, percent_change
from .rows import attach_row


def by_mode(daily: DataFrame, modes: DataFrame) -> DataFrame:
    """Daily series of each mode: the sum of its lines."""
    return (daily.join(modes, "line").groupBy("mode", "date")
            .agg(F.sum("value").alias("value")))


def mode_share(daily: DataFrame, modes: DataFrame) -> DataFrame:
    """Total per mode and its share, to one decimal."""
    totals = daily.join(modes, "line").groupBy("mode").agg(F.sum("value").alias("_t"))
    everything = totals.agg(F.sum("_t")).scalar()
    return (totals.select("mode", F.round("_t", 4).cast("bigint").alias("total"),
                          F.round(percent(F.col("_t"), everything), 1).alias("share_pct"))
            .orderBy(F.desc("total"), "mode"))


def mode_share_daily(daily: DataFrame, modes: DataFrame) -> DataFrame:
    """Share per day and mode, to two decimals; null on a day without traffic."""
    each = by_mode(daily, modes)
    whole = each.groupBy("date").agg(F.sum("value").alias("_whole"))
    return each.join(whole, "date").select("date", "mode", F.round(
        percent(F.col("value"), F.col("_whole")), 2).alias("share_pct"))


def in_years(*years: int):
    """Days of any of the years, as bounds on the date, which a file scan can use."""
    found = F.lit(False)
    for y in years:
        found = found | F.col("date").between(F.make_date(F.lit(y), F.lit(1), F.lit(1)),
                                              F.make_date(F.lit(y), F.lit(12), F.lit(31)))
    return found


def yoy_mode(daily: DataFrame, modes: DataFrame, old: int, new: int,
             per_day: bool = True) -> DataFrame:
    """Growth of each mode between two years.

    Years may differ in length, so the mean per day is compared; ``per_day=False``
    compares plain totals.
    """
    def of(year: int):
        in_year = F.year("date") == year
        amount = F.sum(F.when(in_year, F.col("value")))
        return F.try_divide(amount, F.countDistinct(F.when(in_year, F.col("date")))) \
            if per_day else amount

    growth = F.round(percent_change(F.col("new_value"), F.col("old_value")), 2)
    return (daily.where(in_years(old, new)).join(modes, "line").groupBy("mode")
            .agg(of(old).alias("old_value"), of(new).alias("new_value"))
            .withColumn("growth_pct", growth).orderBy(F.desc("growth_pct"), "mode"))


def share_headline(daily: DataFrame, modes: DataFrame, old: int, new: int) -> DataFrame:
    """One row: leading mode, volume, and the fastest and weakest growth."""
    def first(df: DataFrame, *order):
        return df.orderBy(*order).limit(1)

    share, growth = mode_share(daily, modes), yoy_mode(daily, modes, old, new)
    top = first(share, F.desc("total"), "mode").select(
        F.col("mode").alias("top_mode"), F.col("share_pct").alias("top_share_pct"))
    size = daily.join(modes, "line").agg(
        F.round(F.sum("value"), 4).cast("bigint").alias("total"),
        (F.sum("value") / F.countDistinct("date")).alias("mean_per_day"))
    best = first(growth, F.desc("growth_pct"), "mode").select(
        F.col("mode").alias("fastest_mode"), F.col("growth_pct").alias("fastest_pct"))
    worst = first(growth, F.asc_nulls_last("growth_pct"), "mode").select(
        F.col("mode").alias("weakest_mode"), F.col("growth_pct").alias("weakest_pct"))
    return reduce(attach_row, (top, best, worst), size)
