"""Key figures, the per-line dashboard, and the ordered table of findings.

The inputs are daily series and the small tables made from them; the results have a row
per figure, line or finding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dimensions import MODEL, NAIVE
from ..functions.columns import is_weekend, percent, percent_change, whole_number, zero_to_null
from .rows import attach_row


def _line_levels(daily: DataFrame) -> DataFrame:
    """Per line: mean with and without zero days, relative deviation, weekday and weekend
    means without zero days."""
    v = zero_to_null(F.col("value"))
    weekend = is_weekend(F.col("date")) == 1
    return daily.groupBy("line").agg(
        F.avg("value").alias("mean_all"), F.sum("value").alias("volume"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.avg(F.when(~weekend, v)).alias("weekday"),
        F.avg(F.when(weekend, v)).alias("weekend")).withColumn(
        "cv_pct", percent(F.col("std"), F.col("mean")))


def _figure(name: str, value: Column, label: Column | None = None) -> Column:
    label = F.lit(None).cast("string") if label is None else label
    return F.struct(F.lit(name).alias("metric"), label.alias("label"),
                    value.cast("double").alias("value"))


def _figures(row: DataFrame, *figures: Column) -> DataFrame:
    return row.select(F.inline(F.array(*figures)))


def edge_growth(daily: DataFrame, lines: Sequence[str] | None = None,
                days: int = 30) -> DataFrame:
    """Mean of the first and of the last ``days`` rows of a group of lines, and growth."""
    part = daily if lines is None else daily.where(F.col("line").isin(*lines))
    series = part.groupBy("date").agg(F.sum("value").alias("value")).withColumn(
        "_all", F.lit(0))           # one row per day of the calendar
    order = Window.partitionBy("_all")
    ranked = series.withColumns({
        "_first": F.row_number().over(order.orderBy("date")),
        "_last": F.row_number().over(order.orderBy(F.desc("date")))})
    return ranked.agg(
        F.avg(F.when(F.col("_first") <= days, F.col("value"))).alias("first_mean"),
        F.avg(F.when(F.col("_last") <= days, F.col("value"))).alias("last_mean")).withColumn(
        "growth_pct", F.when(F.col("first_mean") > 0,
                             percent_change(F.col("last_mean"), F.col("first_mean"))))


def key_metrics(daily: DataFrame, total: DataFrame, pairs: DataFrame, impact: DataFrame,
                focus_line: str, focus_pair: tuple[str, str], group: Sequence[str],
                event_word: str) -> DataFrame:
    """All key figures as ``(metric, label, value)``.

    ``pairs`` is the raw correlation matrix, ``impact`` the event impact; the focus line,
    pair, group of lines and the word in the event names select the named figures.
    """
    levels = _line_levels(daily)
    each = levels.select(F.lit("line_mean").alias("metric"), F.col("line").alias("label"),
                         F.col("mean_all").alias("value"))
    top = F.max_by("line", F.struct("mean_all", "line"))
    focus = F.col("line") == focus_line
    over_lines = levels.agg(
        F.sum("volume").alias("total"), F.sum("mean_all").alias("all_mean"),
        F.max("mean_all").alias("top_mean"), top.alias("top_line"),
        F.max(F.when(focus, F.try_divide("weekday", "weekend"))).alias("focus_ratio"),
        F.max(F.struct("cv_pct", "line")).alias("high"),
        F.min(F.when(F.col("cv_pct").isNotNull(), F.struct("cv_pct", "line"))).alias("low"))
    line_figures = _figures(
        over_lines,
        _figure("total_volume", F.round("total", 4)),
        _figure("top_line_mean", F.col("top_mean"), F.col("top_line")),
        _figure("top_line_share_pct", percent(F.col("top_mean"), F.col("all_mean")),
                F.col("top_line")),
        _figure("focus_weekday_weekend_ratio", F.col("focus_ratio"), F.lit(focus_line)),
        _figure("highest_cv_pct", F.col("high.cv_pct"), F.col("high.line")),
        _figure("lowest_cv_pct", F.col("low.cv_pct"), F.col("low.line")))

    weekend = F.weekday("date") >= 5
    years = total.agg(F.min(F.year("date")).alias("lo"), F.max(F.year("date")).alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    day_figures = attach_row(total, years).groupBy("lo", "hi").agg(
        F.avg(F.when(~weekend, F.col("value"))).alias("wd"),
        F.avg(F.when(weekend, F.col("value"))).alias("we"),
        F.avg(F.when(F.year("date") == lo, F.col("value"))).alias("y0"),
        F.avg(F.when(F.year("date") == hi, F.col("value"))).alias("y1"))
    several = hi > lo
    growth = F.when(several & (F.col("y0") > 0), percent_change(F.col("y1"), F.col("y0")))
    day_figures = _figures(
        day_figures,
        _figure("weekday_mean", F.col("wd")), _figure("weekend_mean", F.col("we")),
        _figure("weekday_weekend_ratio", F.when(F.col("we") > 0, F.try_divide("wd", "we"))),
        _figure("first_year_mean", F.when(several, F.col("y0")), lo.cast("string")),
        _figure("last_year_mean", F.when(several, F.col("y1")), hi.cast("string")),
        _figure("yoy_pct", growth, F.concat(lo.cast("string"), F.lit("-"), hi.cast("string"))))

    a, b = sorted(focus_pair)
    wanted = (F.col("a") == a) & (F.col("b") == b)
    names = F.concat("a", F.lit(" / "), "b")
    # rounding keeps noise from deciding between equal pairs
    strongest = F.struct(F.round("r", 9), F.col("a"), F.col("b"))
    pair_figures = _figures(
        pairs.where(F.col("r").isNotNull()).agg(
            F.max("r").alias("r"), F.max_by(names, strongest).alias("pair"),
            F.max(F.when(wanted, F.col("r"))).alias("focus_r")),
        _figure("top_pair_r", F.col("r"), F.col("pair")),
        _figure("focus_pair_r", F.col("focus_r"), F.lit(f"{a} / {b}")))

    event_figures = _figures(
        impact.where(F.contains("event", F.lit(event_word))).agg(F.avg("impact_pct").alias("p")),
        _figure("event_impact_pct", F.col("p"), F.lit(event_word)))
    group_figures = _figures(
        edge_growth(daily, group),
        _figure("group_growth_pct", F.col("growth_pct"), F.lit(", ".join(group))))
    out = each
    for part in (line_figures, day_figures, pair_figures, event_figures, group_figures):
        out = out.unionByName(part)
    return out


def line_dashboard(daily: DataFrame, scorecard: DataFrame) -> DataFrame:
    """Per line: level, relative deviation, weekday and weekend means, model error."""
    ratio = F.when(F.col("weekend") > 0, F.round(F.try_divide("weekday", "weekend"), 2))
    return (_line_levels(daily)
            .join(scorecard.select("line", F.round("mape", 1).alias("model_mape")), "line", "left")
            .select("line", whole_number(F.col("mean")).alias("mean_per_day"),
                    F.round("cv_pct", 1).alias("cv_pct"),
                    whole_number(F.col("weekday")).alias("weekday_mean"),
                    whole_number(F.col("weekend")).alias("weekend_mean"),
                    ratio.alias("ratio"), "model_mape").orderBy("line"))


def model_metrics(score: DataFrame, direction: DataFrame, coverage: DataFrame,
                  line: str) -> DataFrame:
    """Model quality of one line as figures, to be united with ``key_metrics``.

    The error is that of days with traffic; coverage counts all days.
    """
    one = F.col("line") == line
    row = attach_row(score.where(one).drop("coverage_pct"),
                     direction.where(one).select("direction_pct"))
    row = attach_row(row, coverage.where(one).select(
        F.round(F.round("coverage_pct", 5), 1).alias("coverage_pct")))
    return _figures(row, _figure("model_mape", F.col("mape"), F.col("line")),
                    _figure("model_coverage_pct", F.col("coverage_pct"), F.col("line")),
                    _figure("model_direction_pct", F.col("direction_pct"), F.col("line")))


def network_evidence(summary: DataFrame, hubs: DataFrame, path_length: DataFrame,
                     forecast: DataFrame, baselines: DataFrame, line: str) -> DataFrame:
    """What the second table of findings rests on, as ``(metric, label, value)``: density and
    clustering of the network, its hub and mean path, the mean forecast of one line and the
    points of MAPE its model gains over the naive guess."""
    hub = hubs.where("is_hub").select(
        F.lit("hub_betweenness").alias("metric"), F.col("line").alias("label"),
        F.col("betweenness").alias("value"))
    none = F.lit(None).cast("string")
    net = _figures(attach_row(summary, path_length),
                   _figure("network_density", F.col("density"), none),
                   _figure("network_clustering", F.col("avg_clustering"), none),
                   _figure("network_mean_path", F.col("mean_path_length"), none))
    ahead = forecast.where(F.col("is_future") & (F.col("line") == line)).agg(
        F.avg("yhat").alias("v")).select(F.lit("forecast_mean").alias("metric"),
                                         F.lit(line).alias("label"), F.col("v").alias("value"))
    of = lambda model: F.max(F.when(F.col("model") == model, F.col("mape")))
    gain = baselines.where(F.col("line") == line).agg(
        (of(NAIVE) - of(MODEL)).alias("v")).select(
        F.lit("mape_gain_over_naive").alias("metric"), F.lit(line).alias("label"),
        F.col("v").alias("value"))
    return net.unionByName(hub).unionByName(ahead).unionByName(gain)


def insight_rows(metrics: DataFrame, policy: DataFrame) -> DataFrame:
    """The ordered findings: title, evidence from the figures, confidence, impact.

    ``policy`` is the one-row impact of the policy event.
    """
    def value(name: str) -> Column:
        return F.max(F.when(F.col("metric") == name, F.col("value")))

    def label(name: str) -> Column:
        return F.max(F.when(F.col("metric") == name, F.col("label")))

    names = ("top_line_mean", "top_line_share_pct", "group_growth_pct", "yoy_pct",
             "first_year_mean", "last_year_mean", "focus_weekday_weekend_ratio",
             "weekday_weekend_ratio", "event_impact_pct", "top_pair_r", "highest_cv_pct",
             "lowest_cv_pct", "weekday_mean", "weekend_mean", "model_mape",
             "model_coverage_pct", "model_direction_pct")
    row = metrics.agg(*[value(n).alias(n) for n in names],
                      *[label(n).alias(f"{n}_of") for n in names])
    event = policy.agg(F.max_by("event", "impact_pct").alias("policy"),
                       F.max("impact_pct").alias("policy_pct"))
    row = attach_row(row, event)

    def num(name: str, digits: int = 0) -> Column:
        text = F.format_number(F.round(F.round(F.col(name), digits + 4), digits), digits)
        return F.coalesce(text, F.lit("N/A"))

    def signed(name: str) -> Column:
        v = F.round(F.round(F.col(name), 5), 1)
        sign = F.when(v >= 0, "+").otherwise("")
        return F.coalesce(F.concat(sign, F.format_number(v, 1), F.lit("%")), F.lit("N/A"))

    def of(name: str) -> Column:
        return F.coalesce(F.col(f"{name}_of"), F.lit("N/A"))

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    high, medium = "High", "Medium"
    findings = [
        (text(of("top_line_mean"), " carries the largest share"),
         text(num("top_line_mean"), " per day, ", num("top_line_share_pct", 1), "% of all lines"),
         high, high),
        (text("Line group change ", signed("group_growth_pct")),
         text("last 30 against first 30 days of ", of("group_growth_pct"), ": ",
              signed("group_growth_pct")), high, high),
        (text("Yearly change ", of("yoy_pct"), ": ", signed("yoy_pct")),
         text("mean per day ", num("first_year_mean"), " to ", num("last_year_mean"), " (",
              signed("yoy_pct"), ")"), medium, high),
        (text(of("focus_weekday_weekend_ratio"), " has its own weekend pattern"),
         text("weekday to weekend ", num("focus_weekday_weekend_ratio", 2), ", all lines ",
              num("weekday_weekend_ratio", 2)), high, medium),
        (text("Effect of ", of("event_impact_pct")),
         text("mean impact ", signed("event_impact_pct"), " against the weeks before"),
         high, high),
        (text("Policy event: ", F.coalesce(F.col("policy"), F.lit("N/A"))),
         text("impact ", signed("policy_pct"), " against the weeks before"), high, high),
        (text(of("top_pair_r"), " move together"),
         text("r = ", num("top_pair_r", 3)), high, high),
        (text(of("highest_cv_pct"), " fluctuates most"),
         text("deviation ", num("highest_cv_pct", 1), "% of the mean; steadiest ",
              of("lowest_cv_pct"), " ", num("lowest_cv_pct", 1), "%"), high, medium),
        (text("Weekday pattern"),
         text("weekday ", num("weekday_mean"), ", weekend ", num("weekend_mean"), ", ratio ",
              num("weekday_weekend_ratio", 2)), high, high),
        (text("Forecast quality"),
         text("MAPE ", num("model_mape", 2), "%, coverage ", num("model_coverage_pct", 1),
              "%, direction ", num("model_direction_pct", 1), "%"), high, high),
    ]
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("position"), title.alias("title"), evidence.alias("evidence"),
                 F.lit(sure).alias("confidence"), F.lit(weight).alias("impact"))
        for k, (title, evidence, sure, weight) in enumerate(findings, 1)]))).orderBy("position")
