"""The three end-to-end flows, for whole tables.

Tables that several later passes read are written once to the shared folder: the clean
rows, the daily cells and the dense series.  Everything after the daily sum is small
against the raw rows, whatever their number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import dimensions as dim
from ..functions.columns import DAY_FIRST
from ..operators import evaluate, events, forecast, quality, reshape
from ..session import staged
from ..sources.tables import (csv_header, require_rows, require_same_columns, scan_csv,
                              union_sources)


def read_years(spark: SparkSession, paths: Sequence[str],
               headers: Mapping[str, str] = dim.RAW_HEADERS) -> DataFrame:
    """Yearly CSV files as one numbered raw table.

    The files must have the same columns, in any order; ``headers`` gives our names for the
    published ones.  The table is written, so text is read once and later passes take only
    the columns they need.
    """
    first, *others = [csv_header(spark, p) for p in paths]
    for other in others:
        require_same_columns(first, other)
    parts = [scan_csv(spark, p, headers=headers, source=k) for k, p in enumerate(paths)]
    return require_rows(staged(union_sources(*parts)), "input")


@dataclass(frozen=True)
class CleaningRules:
    """What counts as a valid row; the defaults are those of the published analysis."""
    unit: str = dim.PERSONS
    mode: str = dim.RAIL_MODE
    ownership: str = dim.PUBLIC
    first_year: int = 2025
    last_year: int = 2026
    date_formats: Sequence[str] = DAY_FIRST
    fill_limit: int = 3


def clean_rows(raw: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Raw text rows to clean rows of all modes.

    The order of the steps matters: interpolation sees duplicates and negative values.
    """
    rows = quality.unit_filter(quality.drop_empty_rows(raw), rules.unit)
    rows = quality.parse_dates(rows, rules.date_formats)
    rows = quality.year_range_filter(rows, rules.first_year, rules.last_year)
    # row interpolation reads its input for the rows and again for the summaries
    rows = quality.interpolate_rows(staged(quality.clean_numeric(rows)), limit=rules.fill_limit)
    rows = quality.dedup_first(quality.drop_unresolved(rows))
    return quality.negative_filter(rows)


@dataclass(frozen=True)
class Series:
    clean: DataFrame
    daily: DataFrame
    total: DataFrame


def to_daily(raw: DataFrame, lines: DataFrame, rules: CleaningRules = CleaningRules()) -> Series:
    """Raw rows to the dense daily table and the network total."""
    clean = staged(quality.flag_outliers(staged(clean_rows(require_rows(raw, "raw"), rules))))
    inside = quality.domain_filter(clean, rules.mode, rules.ownership)
    mapped = require_rows(reshape.mapped_only(inside, lines), "mapped rows")
    cells = staged(reshape.daily_cells(mapped))
    daily = staged(reshape.fill_daily(cells, rules.fill_limit))
    return Series(clean, daily, reshape.network_total(daily))


@dataclass(frozen=True)
class Findings:
    classed: DataFrame
    mapped: DataFrame
    impact: DataFrame
    impact_by_line: DataFrame
    line_ratio: DataFrame
    summary: DataFrame


def detect(series: Series, holidays: DataFrame, windows: DataFrame) -> Findings:
    """Score the total, name the anomalies, measure the events."""
    scored = events.rolling_zscore(series.total)
    classed = events.anomaly_class(scored)
    return Findings(
        classed, events.anomaly_holiday_map(classed, holidays),
        events.event_impact(series.total, windows),
        events.event_impact_by_line(series.daily, windows),
        events.anomaly_line_ratio(series.daily, classed), events.anomaly_summary(scored))


@dataclass(frozen=True)
class Evaluation:
    forecast: DataFrame
    joined: DataFrame
    errors: DataFrame
    baselines: DataFrame
    scorecard: DataFrame
    by_horizon: DataFrame


def predict(series: Series, holidays: DataFrame) -> Evaluation:
    """Fit all lines and the total on all but the last days and judge the forecasts."""
    frame = forecast.forecast_frame(series.daily.unionByName(series.total))
    split = staged(forecast.train_test_split(frame))
    train, test = forecast.train_part(split), forecast.test_part(split)
    predicted = staged(forecast.forecast_lines(train, holidays))
    joined = evaluate.eval_join(test, predicted)
    clean = evaluate.positive_only(joined)
    return Evaluation(
        predicted, joined, evaluate.error_metrics(clean), evaluate.baseline_compare(clean),
        evaluate.line_scorecard(clean),
        evaluate.cv_by_horizon(evaluate.cv_errors(train, holidays)))
