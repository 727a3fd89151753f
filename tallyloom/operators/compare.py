"""Comparing series: levels, volatility, weekday and calendar profiles.

The input is the dense daily table, at most one row per line and day, so every window
below holds no more rows than the calendar has days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import day_name, percent, percent_change, year_week, zero_to_null
from .rows import attach_row


def by_line():
    return Window.partitionBy("line")


def by_date():
    return by_line().orderBy("date")


def full_window(aggregate, value: Column, before: int, after: int = 0,
                need: int | None = None) -> Column:
    """Rolling aggregate over rows, null unless ``need`` (default: all) rows have a value."""
    frame = by_date().rowsBetween(-before, after)
    need = before + after + 1 if need is None else need
    return F.when(F.count(value).over(frame) >= need, aggregate(value).over(frame))


def daily_series(daily: DataFrame) -> DataFrame:
    return daily.select("date", "line", "value")


def base_index(daily: DataFrame, days: int = 7) -> DataFrame:
    """Index 100 = mean of the first ``days`` positive values of the line; a line without
    a positive value is divided by 1."""
    positive = F.col("value") > 0
    running = F.count(F.when(positive, 1)).over(
        by_date().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.when(positive & (F.col("_k") <= days), F.col("value"))
    base = F.coalesce(F.avg(first).over(by_line()), F.lit(1.0))
    return daily.withColumn("_k", running).select(
        "date", "line", (F.col("value") / base * 100).alias("index_value"))


def line_volatility(daily: DataFrame) -> DataFrame:
    """Mean, deviation and their ratio with zero days counted, nothing rounded."""
    v = F.col("value")
    return (daily.groupBy("line").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
            .withColumn("cv_pct", percent(F.col("std"), F.col("mean"))))


def line_ranking(daily: DataFrame) -> DataFrame:
    """Mean and deviation without zero days, as whole numbers, their ratio, and the rank."""
    v = zero_to_null(F.col("value"))
    levels = daily.groupBy("line").agg(
        F.coalesce(F.round(F.avg(v)), F.lit(0.0)).cast("bigint").alias("avg_daily"),
        F.coalesce(F.round(F.stddev_samp(v)), F.lit(0.0)).cast("bigint").alias("std_daily"))
    cv = F.when(F.col("avg_daily") > 0,
                F.round(percent(F.col("std_daily"), F.col("avg_daily")), 1)).otherwise(0.0)
    return levels.withColumn("cv_pct", cv).orderBy(F.desc("avg_daily"), "line")


def volatility_ranking(daily: DataFrame) -> DataFrame:
    """The ranking by relative deviation, with the two ends marked."""
    ranking = line_ranking(daily)
    ends = ranking.agg(F.max_by("line", F.struct("cv_pct", "line")).alias("_hi"),
                       F.min_by("line", F.struct("cv_pct", "line")).alias("_lo"))
    role = (F.when(F.col("line") == F.col("_hi"), "most_volatile")
            .when(F.col("line") == F.col("_lo"), "least_volatile").otherwise("middle"))
    return attach_row(ranking, ends).select("line", "cv_pct", role.alias("role")).orderBy(
        F.desc("cv_pct"), F.desc("line"))


def complete_dates(df: DataFrame, valid: Column, lines: Column) -> DataFrame:
    """Keep the dates on which all lines are valid.

    Dates are counted by an aggregate with map-side combine, not a window: a day has as
    many rows as there are lines.
    """
    good = (df.groupBy("date").agg(F.count_if(valid).alias("_ok"))
            .where(F.col("_ok") == lines).select("date"))
    return df.join(good, "date", "left_semi")


def rolling_std30(daily: DataFrame, days: int = 30) -> DataFrame:
    """Rolling deviation without zero days; a date counts only if every line has it."""
    v = zero_to_null(F.col("value"))
    spread = daily.select("date", "line",
                          full_window(F.stddev_samp, v, days - 1).alias("rolling_std"))
    lines = daily.agg(F.countDistinct("line")).scalar()
    return complete_dates(spread, F.col("rolling_std").isNotNull(), lines)


def weekday_profile(daily: DataFrame) -> DataFrame:
    """Mean per weekday and line, zero days included, as whole numbers."""
    return (daily.groupBy("line", F.weekday("date").alias("dow"))
            .agg(F.any_value(day_name(F.col("date"))).alias("day_of_week"),
                 F.round(F.round(F.avg("value"), 4)).alias("avg_value"))
            .orderBy("line", "dow"))


def weekday_profile_norm(daily: DataFrame) -> DataFrame:
    """The profile divided by the mean of its seven values."""
    return weekday_profile(daily).withColumn(
        "relative", F.try_divide("avg_value", F.avg("avg_value").over(by_line())))


def rolling_yoy(series: DataFrame, days: int = 30, back: int = 365) -> DataFrame:
    """Rolling mean and its change against the row ``back`` days earlier, where known."""
    smooth = series.select("date", "line",
                           full_window(F.avg, F.col("value"), days - 1).alias("rolling_mean"))
    change = percent_change(F.col("rolling_mean"), F.lag("rolling_mean", back).over(by_date()))
    return smooth.withColumn("yoy_pct", change).where(F.col("yoy_pct").isNotNull())


def line_share(daily: DataFrame) -> DataFrame:
    """Share of each line in the day; null on a day without traffic."""
    whole = daily.groupBy("date").agg(F.sum("value").alias("_whole"))
    return daily.join(whole, "date").select(
        "date", "line", percent(F.col("value"), F.col("_whole")).alias("share_pct"))


def share_smoothed14(daily: DataFrame, days: int = 14) -> DataFrame:
    """Rolling mean of the shares, on the dates where every line has one."""
    smooth = line_share(daily).select(
        "date", "line", full_window(F.avg, F.col("share_pct"), days - 1).alias("share_pct"))
    lines = daily.agg(F.countDistinct("line")).scalar()
    return complete_dates(smooth, F.col("share_pct").isNotNull(), lines)


def box_stats(values: DataFrame, key: str) -> DataFrame:
    """The table behind a box plot: quartiles, whiskers and points outside them.

    Whiskers end at the last value within 1.5 interquartile ranges.
    """
    group = Window.partitionBy(key)
    marked = values.where(F.col("value").isNotNull()).withColumn(
        "_q", F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(group))
    q1, median, q3 = (F.col("_q")[k] for k in range(3))
    low, high = q1 - (q3 - q1) * 1.5, q3 + (q3 - q1) * 1.5
    inside = F.col("value").between(low, high)
    return marked.groupBy(key).agg(
        F.count("*").alias("n"), F.any_value(q1).alias("q1"), F.any_value(median).alias("median"),
        F.any_value(q3).alias("q3"), F.any_value(q3 - q1).alias("iqr"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers")).orderBy(key)


def line_box_stats(daily: DataFrame, zeros: bool = False) -> DataFrame:
    value = F.col("value") if zeros else zero_to_null(F.col("value"))
    return box_stats(daily.select("line", value.alias("value")), "line")


def calendar_grid(total: DataFrame, method: str = "median", iso_year: bool = False) -> DataFrame:
    """One cell per weekday and week label: the median (or mean) of its days."""
    pick = {"median": F.median, "mean": F.avg}[method]
    return (total.groupBy(F.weekday("date").alias("dow"),
                          year_week(F.col("date"), iso_year).alias("year_week"))
            .agg(pick("value").alias("value")).orderBy("year_week", "dow"))


def top_days(total: DataFrame, n: int = 10) -> DataFrame:
    return (total.select("date", "value", day_name(F.col("date")).alias("day_of_week"))
            .orderBy(F.desc("value"), "date").limit(n))


def weekday_weekend_ratio(daily: DataFrame, total: DataFrame) -> DataFrame:
    """Working day against weekend, once as the mean of the weekday means of the lines and
    once as the mean over the days of the total."""
    def ratio(df: DataFrame, value: str, dow: Column, method: str) -> DataFrame:
        working = F.avg(F.when(dow < 5, F.col(value)))
        weekend = F.avg(F.when(dow >= 5, F.col(value)))
        return df.agg(working.alias("weekday_mean"), weekend.alias("weekend_mean")).select(
            F.lit(method).alias("method"), "weekday_mean", "weekend_mean",
            F.when(F.col("weekend_mean") > 0,
                   F.try_divide("weekday_mean", "weekend_mean")).alias("ratio"))

    # equal group sizes: the mean of all profile cells is the mean of the line means
    return ratio(weekday_profile(daily), "avg_value", F.col("dow"), "mean_of_means").unionByName(
        ratio(total, "value", F.weekday("date"), "mean_of_days"))
