"""Second forecast method: a regularised piecewise-linear trend with multiplicative
seasonal, holiday and regressor effects, per series.

The structure follows the public decomposable model (Taylor and Letham, 2018); the fit is
alternating ridge regression, so it is deterministic and needs numpy only.  Spark puts
each series in one group, which is bounded by the calendar.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_by_value
from .forecast import HORIZON, INTERVAL_Z, future_frame, holiday_regressors

ship_by_value(__name__)

KNOTS = 25
KNOT_RANGE = 0.8
TREND_SCALE = 0.05
SEASON_SCALE = 10.0
YEARLY_ORDER = 10
WEEKLY_ORDER = 3
ROUNDS = 8

OUTPUT = ("line string, ds date, is_future boolean, yhat double, yhat_lower double, "
          "yhat_upper double")


def _waves(day: np.ndarray, period: float, order: int) -> np.ndarray:
    angle = 2 * np.pi * day[:, None] * np.arange(1, order + 1)[None, :] / period
    return np.hstack([np.sin(angle), np.cos(angle)])


def _effects(rows: pd.DataFrame, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the multiplicative part and their prior scales."""
    columns = [_waves(day, 365.25, YEARLY_ORDER), _waves(day, 7.0, WEEKLY_ORDER),
               rows[["is_weekend", "month_sin", "month_cos"]].to_numpy(dtype=float)]
    scales = [np.full(c.shape[1], SEASON_SCALE) for c in columns]
    marks: dict[str, float] = {}
    cells: list[tuple[int, str]] = []
    for k, items in enumerate(rows["regressors"]):
        for item in (items if items is not None else ()):
            marks[item["regressor"]] = item["prior_scale"]
            cells.append((k, item["regressor"]))
    if marks:
        place = {name: j for j, name in enumerate(sorted(marks))}
        dummies = np.zeros((len(rows), len(place)))
        for k, name in cells:
            dummies[k, place[name]] = 1.0
        columns.append(dummies)
        scales.append(np.array([marks[name] for name in place]))
    return np.hstack(columns), np.concatenate(scales)


def _ridge(design: np.ndarray, target: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    left = design.T @ design + np.diag(penalty + 1e-10)
    return np.linalg.solve(left, design.T @ target)


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    rows = group.sort_values("ds").reset_index(drop=True)
    day = np.array([d.toordinal() for d in rows["ds"]], dtype=float)
    y = rows["y"].to_numpy(dtype=float)
    known = ~np.isnan(y)
    scale = max(np.abs(y[known]).max(initial=0.0), 1e-12)
    start, end = day[known].min(), day[known].max()
    t = (day - start) / max(end - start, 1.0)
    knots = np.linspace(0, KNOT_RANGE, KNOTS + 1)[1:]
    trend = np.column_stack([np.ones_like(t), t, np.maximum(t[:, None] - knots[None, :], 0.0)])
    effect, prior = _effects(rows, day)

    target = y[known] / scale
    beta = np.zeros(effect.shape[1])
    noise = max(float(np.var(target)), 1e-6)
    for _ in range(ROUNDS):
        stretch = 1.0 + effect[known] @ beta
        bends = np.concatenate([[0.0, 0.0], np.full(len(knots), noise / (2 * TREND_SCALE ** 2))])
        theta = _ridge(trend[known] * stretch[:, None], target, bends)
        level = trend[known] @ theta
        beta = _ridge(effect[known] * level[:, None], target - level, noise / prior ** 2)
        noise = max(float(np.var(target - level * (1.0 + effect[known] @ beta))), 1e-9)
    yhat = np.maximum((trend @ theta) * (1.0 + effect @ beta) * scale, 0.0)
    margin = INTERVAL_Z * np.sqrt(noise) * scale
    return pd.DataFrame({
        "line": rows["line"], "ds": rows["ds"], "is_future": rows["is_future"], "yhat": yhat,
        "yhat_lower": np.maximum(yhat - margin, 0.0), "yhat_upper": yhat + margin})


def forecast_lines_ridge(train: DataFrame, holidays: DataFrame,
                         horizon: int = HORIZON) -> DataFrame:
    marks = holiday_regressors(holidays).groupBy(F.col("date").alias("ds")).agg(
        F.collect_list(F.struct("regressor", "prior_scale")).alias("regressors"))
    frame = future_frame(train, horizon).join(marks, "ds", "left")
    return frame.groupBy("line").applyInPandas(_fit, OUTPUT)
