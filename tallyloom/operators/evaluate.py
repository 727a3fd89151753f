"""Forecast evaluation: errors, baselines, intervals, rolling origin, residuals.

Everything is per line (the network total is the line ``TOTAL``), so one query scores all
series; groups hold the test days of a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dimensions import BIAS_GRADES, MODEL, NAIVE, WEEKLY
from ..functions.columns import percent, safe_corr, whole_number
from .forecast import FORECAST, HORIZON, decompose, holiday_keys

PERIOD = 30


def by_day():
    return Window.partitionBy("line").orderBy("ds")


def eval_join(test: DataFrame, forecast: DataFrame) -> DataFrame:
    """Actual and forecast values of the test days that have both."""
    return test.select("line", "ds", "y").join(
        forecast.select("line", "ds", *FORECAST), ["line", "ds"])


def positive_only(joined: DataFrame) -> DataFrame:
    """The rows that percentage errors are defined on."""
    return joined.where(F.col("y") > 0)


def _errors(y: Column, guess: Column) -> dict[str, Column]:
    miss = F.abs(y - guess)
    return {
        "mae": F.avg(miss), "rmse": F.sqrt(F.avg(miss * miss)),
        "mape": F.avg(F.try_divide(miss, F.abs(y))) * 100,
        "smape": F.avg(F.try_divide(miss * 2, F.abs(y) + F.abs(guess))) * 100}


def error_metrics(clean: DataFrame) -> DataFrame:
    parts = _errors(F.col("y"), F.col("yhat"))
    return clean.groupBy("line").agg(
        F.count("*").alias("n"), *[c.alias(k) for k, c in parts.items()]).orderBy("line")


def baseline_compare(clean: DataFrame, min_rows: int = 3) -> DataFrame:
    """The model against yesterday's value and the value a week ago.

    The baselines shift rows of the cleaned test set, so they have one and seven rows
    fewer.  The seasonal baseline needs ``min_rows``.  ``gain_pct`` is the reduction of
    the mean error against yesterday's value.
    """
    shifted = clean.withColumns({"_naive": F.lag("y", 1).over(by_day()),
                                 "_week": F.lag("y", 7).over(by_day())})
    y = F.col("y")
    enough = F.count("_week") >= min_rows
    stats = shifted.groupBy("line").agg(*[
        expr.alias(f"{tag}_{k}")
        for tag, guess in (("naive", "_naive"), ("week", "_week"), ("model", "yhat"))
        for k, expr in _errors(y, F.col(guess)).items()], enough.alias("enough"),
        F.count("_naive").alias("naive_n"), F.count("_week").alias("week_n"),
        F.count("*").alias("model_n"))

    def row(name: str, tag: str, usable: Column, smape: bool = False) -> Column:
        def get(k, digits):
            return F.when(usable, F.round(F.round(F.col(f"{tag}_{k}"), digits + 4), digits))
        return F.struct(F.lit(name).alias("model"), F.col(f"{tag}_n").alias("n"),
                        get("mae", 0).alias("mae"), get("rmse", 0).alias("rmse"),
                        get("mape", 2).alias("mape"),
                        (get("smape", 2) if smape else F.lit(None).cast("double")).alias("smape"))

    gain = percent(F.col("naive_mae") - F.col("model_mae"), F.col("naive_mae"))
    return stats.select("line", (F.col("model_mae") < F.col("naive_mae")).alias("model_wins"),
                        F.round(gain, 1).alias("gain_pct"),
                        F.inline(F.array(
                            row(NAIVE, "naive", F.lit(True)),
                            row(WEEKLY, "week", F.col("enough")),
                            row(MODEL, "model", F.lit(True), smape=True)))).orderBy(
        "line", "model")


def residuals(clean: DataFrame) -> DataFrame:
    residual = F.col("y") - F.col("yhat")
    return clean.withColumn("residual", residual).withColumn(
        "pct_error", percent(residual, F.col("y")))


def residual_trend(with_residuals: DataFrame, min_rows: int = 4) -> DataFrame:
    """Regression of the residual on the actual value."""
    enough = F.count("*") >= min_rows
    return with_residuals.groupBy("line").agg(
        F.when(enough, F.regr_slope("residual", "y")).alias("slope"),
        F.when(enough, F.regr_intercept("residual", "y")).alias("intercept")).orderBy("line")


def residual_histogram(with_residuals: DataFrame, bins: int = 20) -> DataFrame:
    """Bins of each line's residuals, with their mean and deviation."""
    value = F.round("residual", 9)              # no noise at the borders of bins
    ends = with_residuals.groupBy("line").agg(
        F.min(value).alias("_lo"), ((F.max(value) - F.min(value)) / bins).alias("_w"),
        F.avg("residual").alias("mean"), F.stddev_samp("residual").alias("std"))
    place = F.floor(F.coalesce(F.try_divide(value - F.col("_lo"), F.col("_w")), F.lit(0.0)))
    counts = (with_residuals.where(F.col("residual").isNotNull()).join(ends, "line")
              .groupBy("line", F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
              .agg(F.count("*").alias("n")))
    frame = ends.where(F.col("_lo").isNotNull()).withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(counts, ["line", "bin"], "left").select(
        "line", "bin", (F.col("_lo") + F.col("_w") * F.col("bin")).alias("bin_start"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "mean", "std")


def _covered() -> Column:
    inside = (F.col("y") >= F.col("yhat_lower")) & (F.col("y") <= F.col("yhat_upper"))
    return F.avg(F.when(inside, 100.0).otherwise(0.0))


def interval_coverage(joined: DataFrame) -> DataFrame:
    """Share of days inside the interval, zero days included."""
    verdict = (F.when(F.col("coverage_pct") > 90, "too wide")
               .when(F.col("coverage_pct") < 70, "too narrow").otherwise("calibrated"))
    return joined.groupBy("line").agg(_covered().alias("coverage_pct")).withColumn(
        "verdict", verdict).orderBy("line")


def direction_accuracy(joined: DataFrame, good: float = 60.0) -> DataFrame:
    """Share of day-to-day changes with the right sign."""
    def sign(c: str) -> Column:
        return F.signum(F.col(c) - F.lag(c).over(by_day()))

    moves = joined.withColumn("_same", F.when(sign("y") == sign("yhat"), 100.0).otherwise(
        F.when(sign("y").isNotNull(), 0.0)))
    return moves.groupBy("line").agg(F.avg("_same").alias("direction_pct")).withColumn(
        "verdict", F.when(F.col("direction_pct") >= good, "better than random")
        .otherwise("no better than random")).orderBy("line")


# ---------------------------------------------------------------- rolling origin


def cv_cutoffs(train: DataFrame, period: int = PERIOD, horizon: int = HORIZON,
               initial: int | None = None) -> DataFrame:
    """Cut-off days per line, every ``period`` days back from the end.

    The first training span is sixty percent of the rows, at least 180 days and at most
    all but 60, unless ``initial`` is given.
    """
    span = train.groupBy("line").agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"),
                                     F.count("*").alias("n"))
    days = F.lit(initial) if initial is not None else F.least(
        F.greatest(F.floor(F.col("n") * F.lit(0.6)), F.lit(180)), F.col("n") - 60)
    last = F.date_sub("hi", horizon)
    room = F.datediff(last, "lo") - days
    return span.where(room >= 0).select("line", F.explode(F.sequence(
        F.lit(0), F.floor(room / F.lit(float(period))).cast("int"))).alias("_k"), "hi").select(
        "line", F.date_sub(F.date_sub("hi", horizon),
                           F.col("_k") * period).alias("cutoff"))


def cv_errors(train: DataFrame, holidays: DataFrame, period: int = PERIOD,
              horizon: int = HORIZON, initial: int | None = None) -> DataFrame:
    """Refit at every cut-off and compare the following ``horizon`` days.

    Series and cut-off together are the key: every refit is one bounded group of the same
    shuffled plan.
    """
    cutoffs = cv_cutoffs(train, period, horizon, initial)
    # holidays first: afterwards each row is there once per later cut-off
    rows = train.select("line", "ds", "y").join(holiday_keys(holidays), "ds", "left")
    rows = rows.join(cutoffs, "line").where(F.col("ds") <= F.date_add("cutoff", horizon))
    ahead = F.col("ds") > F.col("cutoff")
    frame = rows.select(
        "line", "cutoff", "ds", "holiday_key", F.when(~ahead, F.col("y")).alias("y"),
        F.when(ahead, F.col("y")).alias("actual"))
    fitted = decompose(frame, ["line", "cutoff"]).where(F.col("ds") > F.col("cutoff"))
    return fitted.select("line", "cutoff", "ds", F.datediff("ds", "cutoff").alias("horizon_day"),
                         F.col("actual").alias("y"), *FORECAST)


def cv_by_horizon(errors: DataFrame) -> DataFrame:
    """Errors by distance from the cut-off; percentage errors where y is positive."""
    miss = F.abs(F.col("y") - F.col("yhat"))
    return errors.groupBy("line", "horizon_day").agg(
        F.count("*").alias("n"), F.avg(miss).alias("mae"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        (F.avg(F.when(F.col("y") > 0, miss / F.col("y"))) * 100).alias("mape"))


# ---------------------------------------------------------------- calibrated intervals


def interval_calibration(errors: DataFrame, coverage: float = 0.8, spread: int = 3,
                         horizon: int = HORIZON) -> DataFrame:
    """``line, horizon_day, n, margin``: the interval's half width as a share of ``yhat``,
    from errors made on days that no fit had seen.

    The score of an error of ``cv_errors`` is ``|y - yhat| / yhat``.  A horizon day takes
    the scores of the days up to ``spread`` before and after it, as one day has a score per
    cut-off only; the margin is the order statistic of rank ``ceil((n + 1) * coverage)``, or
    the largest score where there are too few.  Errors without ``y`` or with ``yhat`` zero have
    no score, and days without a score have no row.  A group has at most ``2 * spread + 1``
    scores per cut-off: it is bounded by the calendar.
    """
    scores = errors.where((F.col("yhat") > 0) & F.col("y").isNotNull()).select(
        "line", (F.abs(F.col("y") - F.col("yhat")) / F.col("yhat")).alias("_score"),
        F.explode(F.sequence(F.greatest(F.col("horizon_day") - spread, F.lit(1)),
                             F.least(F.col("horizon_day") + spread, F.lit(horizon))))
        .alias("horizon_day"))
    grouped = scores.groupBy("line", "horizon_day").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list("_score")).alias("_sorted"))
    rank = F.least(F.ceil((F.col("n") + 1) * F.lit(coverage)), F.col("n")).cast("int")
    return grouped.select("line", "horizon_day", "n",
                          F.element_at("_sorted", rank).alias("margin"))


def calibrated(forecast: DataFrame, calibration: DataFrame) -> DataFrame:
    """The forecast with the intervals of ``interval_calibration`` over the horizon.

    The history keeps its interval, and so do days and lines without a calibration.
    """
    own = Window.partitionBy("line")
    last = F.max(F.when(~F.col("is_future"), F.col("ds"))).over(own)
    days = forecast.withColumn("horizon_day", F.when(F.col("is_future"), F.datediff("ds", last)))
    guess, margin = F.col("yhat"), F.col("margin")
    low = F.when(margin.isNotNull(), F.greatest(guess * (1 - margin), F.lit(0.0)))
    return (days.join(calibration.select("line", "horizon_day", "margin"),
                      ["line", "horizon_day"], "left")
            .withColumns({
                "yhat_lower": F.coalesce(low, F.col("yhat_lower")),
                "yhat_upper": F.coalesce(guess * (1 + margin), F.col("yhat_upper"))})
            .select(*forecast.columns))


# ---------------------------------------------------------------- verdicts


def residual_acf(with_residuals: DataFrame, lags: int = 7, high: float = 0.4) -> DataFrame:
    """Autocorrelation of the residuals at lags 1 to ``lags``; the largest is marked."""
    shifted = with_residuals.select("line", "residual", *[
        F.lag("residual", k).over(by_day()).alias(f"_{k}") for k in range(1, lags + 1)])
    wide = shifted.groupBy("line").agg(*[
        safe_corr(F.col("residual"), F.col(f"_{k}")).alias(f"_{k}") for k in range(1, lags + 1)])
    long = wide.select("line", F.inline(F.array(*[
        F.struct(F.lit(k).alias("lag"), F.col(f"_{k}").alias("acf"))
        for k in range(1, lags + 1)])))
    strongest = F.row_number().over(
        Window.partitionBy("line").orderBy(F.desc(F.abs("acf")), "lag")) == 1
    return long.withColumns({
        "is_strongest": strongest & F.col("acf").isNotNull(),
        "significant": F.abs("acf") > high}).orderBy("line", "lag")


def line_scorecard(clean: DataFrame, min_rows: int = 5) -> DataFrame:
    """Per line: errors, interval coverage, whether it beats yesterday's value, grade."""
    y = F.col("y")
    model, naive = _errors(y, F.col("yhat")), _errors(y, F.col("_naive"))
    stats = (clean.withColumn("_naive", F.lag("y").over(by_day())).groupBy("line").agg(
        F.count("*").alias("n"), model["mae"].alias("mae"), model["rmse"].alias("rmse"),
        model["mape"].alias("mape"), _covered().alias("coverage_pct"),
        naive["mae"].alias("_naive_mae")).where(F.col("n") >= min_rows))
    grade = (F.when(F.col("mape") < 5, "very good").when(F.col("mape") < 10, "good")
             .when(F.col("mape") < 20, "fair").otherwise("poor"))
    return stats.select(
        "line", "n", whole_number(F.col("mae")).alias("mae"),
        whole_number(F.col("rmse")).alias("rmse"), F.round("mape", 2).alias("mape"),
        F.round("coverage_pct", 1).alias("coverage_pct"),
        F.coalesce(F.col("mae") < F.col("_naive_mae"), F.lit(False)).alias("beats_naive"),
        grade.alias("grade")).orderBy("mape", "line")


def bias_grade(clean: DataFrame) -> DataFrame:
    bias = percent(F.abs("mean_residual"), F.col("_level"))
    best, fair, poor = BIAS_GRADES
    grade = F.when(bias < 1, best).when(bias < 3, fair).otherwise(poor)
    return clean.groupBy("line").agg(
        F.avg(F.col("y") - F.col("yhat")).alias("mean_residual"),
        F.avg("y").alias("_level")).select(
        "line", "mean_residual", bias.alias("bias_pct"), grade.alias("grade")).orderBy("line")


def acceptance(clean: DataFrame, joined: DataFrame) -> DataFrame:
    """The three gates of a usable model: error below 15 percent, better than the weekly
    baseline, interval coverage of at least 70 percent."""
    shifted = clean.withColumn("_week", F.lag("y", 7).over(by_day()))
    model, week = _errors(F.col("y"), F.col("yhat")), _errors(F.col("y"), F.col("_week"))
    gates = shifted.groupBy("line").agg(
        (model["mape"] < 15).alias("low_error"), (model["mae"] < week["mae"]).alias("beats_weekly"))
    covered = joined.groupBy("line").agg((_covered() >= 70).alias("covered"))
    return gates.join(covered, "line").withColumn(
        "usable", F.col("low_error") & F.col("beats_weekly") & F.col("covered")).orderBy("line")
