"""Forecasts for any number of daily series by multiplicative decomposition.

    yhat = trend * weekday factor * month factor * holiday factor

Each part is a grouped mean or regression, so fitting all series (and all cut-offs of a
rolling evaluation) is one shuffle by the series key; the finer groups of the factors lie
inside that partitioning and only sort.  A group is one series at one cut-off: it is
bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import is_weekend, month_wave, percent_change, whole_number
from .events import holiday_days

TEST_DAYS = 30
HORIZON = 30
INTERVAL_Z = 1.2816        # two-sided 80 percent of the normal distribution


def with_regressors(frame: DataFrame, month_number: bool = False) -> DataFrame:
    """Weekend flag and the position of the month on the yearly circle, or its number."""
    if month_number:
        return frame.withColumns({"is_weekend": is_weekend(F.col("ds")),
                                  "month": F.month("ds").cast("bigint")})
    sine, cosine = month_wave(F.col("ds"))
    return frame.withColumns({"is_weekend": is_weekend(F.col("ds")),
                              "month_sin": sine, "month_cos": cosine})


def forecast_frame(series: DataFrame, month_number: bool = False) -> DataFrame:
    """``(line, ds, y)`` without nulls, negatives clipped, with regressors."""
    frame = series.where(F.col("value").isNotNull()).select(
        "line", F.col("date").alias("ds"), F.greatest("value", F.lit(0.0)).alias("y"))
    return with_regressors(frame, month_number)


def train_test_split(frame: DataFrame, test_days: int = TEST_DAYS) -> DataFrame:
    """Adds ``is_test``: the last rows of each line."""
    newest = Window.partitionBy("line").orderBy(F.desc("ds"))
    return frame.withColumn("is_test", F.row_number().over(newest) <= test_days)


def train_part(split: DataFrame) -> DataFrame:
    return split.where(~F.col("is_test")).drop("is_test")


def test_part(split: DataFrame) -> DataFrame:
    return split.where("is_test").drop("is_test")


def holiday_regressors(holidays: DataFrame) -> DataFrame:
    """Long form of the holiday dummies: one row per day and ``holiday_offset``."""
    name = F.concat("holiday", F.lit("_"), F.format_string("%+d", "day_offset"))
    return (holiday_days(holidays)
            .groupBy("date", name.alias("regressor"))
            .agg(F.max("prior_scale").alias("prior_scale")))


def holiday_keys(holidays: DataFrame) -> DataFrame:
    """Per day one key naming all its holiday offsets; equal keys share one effect."""
    return holiday_regressors(holidays).groupBy(F.col("date").alias("ds")).agg(
        F.array_join(F.array_sort(F.collect_set("regressor")), ",").alias("holiday_key"))


def future_frame(train: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The history and ``horizon`` days after it per line, with regressors."""
    by_day = Window.partitionBy("line").orderBy("ds")
    newest = F.lead("ds").over(by_day).isNull()
    until = F.when(newest, F.date_add("ds", horizon)).otherwise(F.col("ds"))
    # the last row of a line is stretched over the horizon: one pass, and no join
    frame = (train.select("line", F.col("ds").alias("_own"), F.col("y").alias("_y"),
                          until.alias("_until"))
             .select("line", "_own", "_y", F.explode(F.sequence("_own", "_until")).alias("ds")))
    ahead = F.col("ds") > F.col("_own")
    return with_regressors(frame.select(
        "line", "ds", F.when(~ahead, F.col("_y")).alias("y"), ahead.alias("is_future")))


YEARLY_DAYS = 365          # history from which on months have a factor of their own


def decompose(frame: DataFrame, keys: Sequence[str],
              yearly_days: int = YEARLY_DAYS) -> DataFrame:
    """Fit on the rows that have ``y`` and evaluate on all rows of the frame.

    Needs ``keys``, ``ds``, ``y`` and ``holiday_key``; adds the components, ``yhat`` and
    its interval.  With less than ``yearly_days`` of history the month factor is 1, as
    months and trend could not be told apart; so is the effect of a holiday never seen.
    """
    def over(*more: str):
        return Window.partitionBy(*keys, *more)

    def factor(divisor: Column, *more: str) -> Column:
        return F.coalesce(F.avg(F.try_divide(F.col("y"), divisor)).over(over(*more)), F.lit(1.0))

    seen = F.when(F.col("y").isNotNull(), F.col("ds"))
    first = F.min(seen).over(over())
    frame = frame.withColumns({
        "_x": F.datediff("ds", first), "_span": F.datediff(F.max(seen).over(over()), first) + 1,
        "_dow": F.weekday("ds"), "_month": F.month("ds")})
    y, x = F.col("y"), F.when(F.col("y").isNotNull(), F.col("_x"))
    line = F.regr_intercept(y, x).over(over()) + F.regr_slope(y, x).over(over()) * F.col("_x")
    frame = frame.withColumn("trend", F.coalesce(line, F.avg(y).over(over())))
    level = F.when(F.col("trend") > 0, F.col("trend"))
    frame = frame.withColumn("weekly", factor(level, "_dow"))
    level = level * F.col("weekly")
    frame = frame.withColumn("yearly", F.when(F.col("_span") >= yearly_days, factor(level, "_month"))
                             .otherwise(1.0))
    level = level * F.col("yearly")
    frame = frame.withColumn("holiday_effect",
                             F.when(F.col("holiday_key").isNotNull(),
                                    factor(level, "holiday_key")).otherwise(1.0))
    product = F.col("trend") * F.col("weekly") * F.col("yearly") * F.col("holiday_effect")
    frame = frame.withColumn("yhat", F.greatest(product, F.lit(0.0)))
    miss = F.try_divide(y - F.col("yhat"), F.col("yhat"))
    margin = F.coalesce(F.stddev_samp(miss).over(over()), F.lit(0.0)) * INTERVAL_Z
    return frame.withColumns({
        "yhat_lower": F.greatest(F.col("yhat") * (1 - margin), F.lit(0.0)),
        "yhat_upper": F.col("yhat") * (1 + margin)}).drop("_x", "_span", "_dow", "_month")


COMPONENTS = ("trend", "weekly", "yearly", "holiday_effect")
FORECAST = ("yhat", "yhat_lower", "yhat_upper")


def forecast_components(train: DataFrame, holidays: DataFrame,
                        horizon: int = HORIZON) -> DataFrame:
    """All components per line and day, history and horizon."""
    frame = (future_frame(train, horizon).select("line", "ds", "y", "is_future")
             .join(holiday_keys(holidays), "ds", "left"))
    return decompose(frame, ["line"])


def forecast_lines(train: DataFrame, holidays: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Forecast and 80 percent interval per line and day, history and horizon."""
    return forecast_components(train, holidays, horizon).select(
        "line", "ds", "is_future", *FORECAST)


def future_only(forecast: DataFrame) -> DataFrame:
    return forecast.where("is_future").drop("is_future")


def forecast_summary(forecast: DataFrame) -> DataFrame:
    """Per line over the horizon: mean, minimum, maximum and change first to last day."""
    return (future_only(forecast).groupBy("line").agg(
        F.avg("yhat").alias("mean_yhat"), F.min("yhat").alias("min_yhat"),
        F.max("yhat").alias("max_yhat"),
        F.min_by("yhat", "ds").alias("first_yhat"), F.max_by("yhat", "ds").alias("last_yhat"))
        .withColumn("change_pct", percent_change(F.col("last_yhat"), F.col("first_yhat")))
        .orderBy("line"))


def forecast_vs_recent(forecast: DataFrame, train: DataFrame, days: int = 90) -> DataFrame:
    """Mean of the horizon against the mean of the last training rows."""
    newest = Window.partitionBy("line").orderBy(F.desc("ds"))
    recent = (train.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= days)
              .groupBy("line").agg(F.avg("y").alias("_actual")))
    ahead = future_only(forecast).groupBy("line").agg(F.avg("yhat").alias("_ahead"))
    change = F.when(F.col("_actual") > 0, percent_change(F.col("_ahead"), F.col("_actual")))
    return ahead.join(recent, "line").select(
        "line", whole_number(F.col("_ahead")).alias("forecast_avg"),
        whole_number(F.col("_actual")).alias("recent_avg"),
        F.round(change, 1).alias("change_pct")).orderBy("line")


def iso_year(day: Column) -> Column:
    """The year that the ISO week of a day belongs to: that of its Thursday."""
    return F.year(F.date_add(day, 3 - F.weekday(day)))


def forecast_outlook_weekly(forecast: DataFrame) -> DataFrame:
    """The horizon by ISO week: total, mean per day, weekend days."""
    return (future_only(forecast)
            .groupBy("line", iso_year(F.col("ds")).alias("year"), F.weekofyear("ds").alias("week"))
            .agg(F.min("ds").alias("first_date"),
                 whole_number(F.sum("yhat")).alias("total"),
                 whole_number(F.avg("yhat")).alias("mean_per_day"),
                 F.sum(is_weekend(F.col("ds"))).alias("weekend_days"))
            .orderBy("line", "first_date"))
