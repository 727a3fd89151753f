"""Anomalies, holidays and the impact of events.

All inputs are daily series, so windows and groups are bounded by the calendar.  Holiday
and event windows are spread to single days first, which turns range joins into equal
joins.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dimensions import FELL, ROSE, UNKNOWN_EVENT
from ..functions.columns import (day_name, is_weekend, percent, percent_change, whole_number,
                                 zero_to_null)
from .compare import box_stats, by_date, by_line, full_window
from .rows import attach_row

SPIKE, DROP, NORMAL = "spike", "drop", "normal"


def moving_avg_centered(series: DataFrame, half: int = 3) -> DataFrame:
    """Centered mean; null where the window is cut off."""
    return series.withColumn("rolling_mean", full_window(F.avg, F.col("value"), half, half))


def moving_avg_trailing(series: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    return series.withColumns({
        f"rolling_{n}": full_window(F.avg, F.col("value"), n - 1) for n in windows})


# ---------------------------------------------------------------- scores


def rolling_zscore(series: DataFrame, days: int = 30, min_days: int = 15,
                   floor: float = 0.1) -> DataFrame:
    """Distance from the mean of the ``days`` rows before, in their deviations.

    The day itself is not in its baseline.  The deviation is at least ``floor`` times that
    of the whole series; days with fewer than ``min_days`` rows before them are scored
    against the whole series.
    """
    v, frame = F.col("value"), by_date().rowsBetween(-days, -1)
    series = series.withColumns({
        "_n": F.count(v).over(frame), "_m": F.avg(v).over(frame),
        "_s": F.stddev_samp(v).over(frame),
        "_gm": F.avg(v).over(by_line()), "_gs": F.stddev_samp(v).over(by_line())})
    rolling = F.when(F.col("_n") >= min_days,
                     F.try_divide(v - F.col("_m"), F.greatest("_s", F.col("_gs") * floor)))
    overall = F.try_divide(v - F.col("_gm"), F.col("_gs"))
    return series.withColumn("z_score", F.coalesce(rolling, overall)).drop(
        "_n", "_m", "_s", "_gm", "_gs")


def global_zscore(series: DataFrame, limit: float = 3.0) -> DataFrame:
    """Distance from the mean of the series in population deviations."""
    v = F.col("value")
    z = F.try_divide(v - F.avg(v).over(by_line()), F.stddev_pop(v).over(by_line()))
    return series.withColumn("z_score", z).withColumn("is_anomaly", F.abs("z_score") > limit)


def anomaly_class(scored: DataFrame, limit: float = 3.0) -> DataFrame:
    z = F.col("z_score")
    kind = F.when(z > limit, SPIKE).when(z < -limit, DROP).otherwise(NORMAL)
    return scored.withColumns({
        "anomaly_type": kind, "day_of_week": day_name(F.col("date")),
        "is_weekend": is_weekend(F.col("date"))})


def anomalies(classed: DataFrame) -> DataFrame:
    return classed.where(F.col("anomaly_type") != NORMAL)


def soft_anomaly(scored: DataFrame, soft: float = 2.0, limit: float = 3.0) -> DataFrame:
    """Adds ``soft_type``: beyond the soft limit but not beyond the hard one."""
    z = F.col("z_score")
    near = (F.abs(z) > soft) & (F.abs(z) <= limit)
    kind = F.when(near & (z > 0), "soft_spike").when(near & (z < 0), "soft_drop") \
        .otherwise(NORMAL)
    return scored.withColumn("soft_type", kind)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum; empty bins are listed."""
    # rounding keeps a value on a bin border in the same bin whatever the summation order
    v = F.round(F.col(value), 9)
    width = (F.max(v) - F.min(v)) / F.lit(float(bins))
    ends = df.agg(F.min(v).alias("_lo"), width.alias("_w"))
    frame = ends.where(F.col("_lo").isNotNull()).select(
        "_lo", "_w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    place = F.floor(F.coalesce(F.try_divide(v - F.col("_lo"), F.col("_w")), F.lit(0.0)))
    counts = (attach_row(df.where(F.col(value).isNotNull()).select(value), ends)
              .groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
              .agg(F.count("*").alias("n")))
    return (frame.join(counts, "bin", "left")
            .select("bin", (F.col("_lo") + F.col("_w") * F.col("bin")).alias("bin_start"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).orderBy("bin"))


def z_histogram(scored: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(scored, "z_score", bins)


# ---------------------------------------------------------------- holidays


def holiday_days(holidays: DataFrame) -> DataFrame:
    """One row per holiday and day of its window, with the offset from the date itself."""
    return holidays.select(
        "holiday", "ds", "prior_scale",
        F.explode(F.sequence("lower_window", "upper_window")).alias("day_offset")).select(
        F.date_add("ds", F.col("day_offset")).alias("date"), "holiday", "day_offset",
        "prior_scale")


def holiday_expand(holidays: DataFrame) -> DataFrame:
    """Per day the sorted names of all holidays whose window covers it."""
    names = F.array_join(F.array_sort(F.collect_set("holiday")), ",")
    return holiday_days(holidays).groupBy("date").agg(names.alias("holiday"))


def anomaly_holiday_map(classed: DataFrame, holidays: DataFrame,
                        unknown: str = UNKNOWN_EVENT) -> DataFrame:
    """Anomalies with the holiday of their day, or the label for an unknown cause."""
    return (anomalies(classed).join(holiday_expand(holidays), "date", "left")
            .withColumn("holiday", F.coalesce("holiday", F.lit(unknown))))


def unknown_anomaly(classed: DataFrame, holidays: DataFrame) -> DataFrame:
    return anomalies(classed).join(holiday_expand(holidays), "date", "left_anti")


def holiday_hits(mapped: DataFrame) -> DataFrame:
    """Anomaly days per holiday label, the most frequent one marked."""
    counts = mapped.groupBy("holiday").agg(F.count("*").alias("days"))
    top = counts.orderBy(F.desc("days"), "holiday").limit(1).select("holiday").scalar()
    return counts.withColumn("is_top", F.col("holiday") == top).orderBy(
        F.desc("days"), "holiday")


def holiday_vs_mean(total: DataFrame, days: DataFrame) -> DataFrame:
    """Value on listed days (``date, event``) against the overall mean, in percent."""
    mean = total.agg(F.avg("value")).scalar()
    return total.join(days, "date").select(
        "date", "event", "value",
        F.round(percent_change(F.col("value"), mean), 1).alias("vs_mean_pct"))


# ---------------------------------------------------------------- impact


def _impact(found: DataFrame) -> DataFrame:
    change = percent_change(F.col("event_avg"), F.col("baseline_avg"))
    return found.where((F.col("baseline_avg") > 0) & F.col("event_avg").isNotNull()).withColumns({
        "impact_pct": F.round(change, 1),
        "direction": F.when(change < 0, FELL).otherwise(ROSE),
        "baseline_avg": whole_number(F.col("baseline_avg")),
        "event_avg": whole_number(F.col("event_avg"))})


def _spread(df: DataFrame, first: Column, last: Column) -> DataFrame:
    return df.withColumn("date", F.explode(F.sequence(first, last)))


def _baseline(starts: DataFrame, first_day: int, last_day: int) -> DataFrame:
    return _spread(starts, F.date_sub("first_date", first_day), F.date_sub("first_date", last_day))


def event_impact(total: DataFrame, events: DataFrame, first_day: int = 21,
                 last_day: int = 7) -> DataFrame:
    """Mean during each event against the days ``first_day`` to ``last_day`` before it.

    An event starts on its first day that has data; both ends of the baseline count.
    """
    during = (_spread(events, F.col("start_date"), F.col("end_date"))
              .join(total.select("date", "value"), "date").groupBy("event")
              .agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                   F.avg("value").alias("event_avg")))
    before = (_baseline(during.select("event", "first_date"), first_day, last_day)
              .join(total.select("date", "value"), "date")
              .groupBy("event").agg(F.avg("value").alias("baseline_avg")))
    return _impact(during.join(before, "event"))


def event_impact_by_line(daily: DataFrame, events: DataFrame, first_day: int = 21,
                         last_day: int = 7) -> DataFrame:
    """The same per line, zero days left out, from the stated start of the event."""
    v = zero_to_null(F.col("value"))
    parts = _spread(events.withColumn("first_date", F.col("start_date")),
                    F.col("start_date"), F.col("end_date")).select(
        "event", "date", F.lit(True).alias("_during"))
    quiet = _baseline(events.withColumn("first_date", F.col("start_date")),
                      first_day, last_day).select("event", "date", F.lit(False).alias("_during"))
    found = (parts.unionByName(quiet).join(daily, "date").groupBy("event", "line")
             .agg(F.avg(F.when(F.col("_during"), v)).alias("event_avg"),
                  F.avg(F.when(~F.col("_during"), v)).alias("baseline_avg")))
    return _impact(found).orderBy("event", F.desc("impact_pct"), "line")


def peak_in_window(total: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Day and value of the maximum inside a window; the earliest of equal days."""
    return (total.where(F.col("date").between(F.lit(first), F.lit(last)))
            .select("date", "value").orderBy(F.desc("value"), "date").limit(1))


def anomaly_line_ratio(daily: DataFrame, classed: DataFrame) -> DataFrame:
    """On anomaly days, each line against its own overall mean."""
    ratio = F.try_divide("value", F.avg("value").over(by_line()))
    days = anomalies(classed).select("date", "anomaly_type", "z_score")
    return daily.withColumn("ratio", ratio).join(days, "date")


# ---------------------------------------------------------------- summaries


def weekday_box(classed: DataFrame) -> DataFrame:
    """Box statistics of the totals per weekday, with the number of anomaly days."""
    classed = classed.withColumn("dow", F.weekday("date"))
    points = classed.groupBy("dow").agg(
        F.any_value("day_of_week").alias("day_of_week"),
        F.count_if(F.col("anomaly_type") != NORMAL).alias("anomaly_days"))
    return box_stats(classed.select("dow", "value"), "dow").join(points, "dow").orderBy("dow")


def weekday_points(classed: DataFrame) -> DataFrame:
    """The anomaly days drawn over the boxes."""
    return anomalies(classed).select("day_of_week", "date", "value", "anomaly_type")


def anomaly_summary(scored: DataFrame, soft: float = 2.0, limit: float = 3.0) -> DataFrame:
    """Counts by kind, the rate, and advice on the threshold."""
    z = F.abs("z_score")
    kind = soft_anomaly(anomaly_class(scored, limit), soft, limit)
    rate = percent(F.col("anomalies"), F.col("days"))
    advice = (F.when(rate < 0.5, "threshold may be too strict")
              .when(rate > 5, "threshold may be too loose").otherwise("ok"))
    weekend = F.col("is_weekend") == 1
    return kind.agg(
        F.count("*").alias("days"), F.count_if(z > limit).alias("anomalies"),
        F.count_if(F.col("anomaly_type") == SPIKE).alias("spikes"),
        F.count_if(F.col("anomaly_type") == DROP).alias("drops"),
        F.count_if(F.col("soft_type") != NORMAL).alias("soft"),
        F.count_if((z > limit) & ~weekend).alias("weekday_anomalies"),
        F.count_if((z > limit) & weekend).alias("weekend_anomalies")).withColumns({
            "rate_pct": F.round(rate, 4), "advice": advice})


def anomaly_crosstab(classed: DataFrame) -> DataFrame:
    """Anomalies by weekend flag and kind; absent combinations are zero."""
    return (anomalies(classed).groupBy("is_weekend").pivot("anomaly_type", [DROP, SPIKE])
            .agg(F.count(F.lit(1))).na.fill(0).orderBy("is_weekend"))
