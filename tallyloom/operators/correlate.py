"""Correlation between series, and lead/lag relations.

The matrix has one result per pair of lines.  It is computed by blocks: each line is one
row holding its values, lines are put in blocks of bounded size, and each pair of blocks
is one task-sized product of two matrices.  Rows of the daily table are never paired.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dimensions import LEADS, TOGETHER
from ..functions.columns import safe_corr, zero_to_null
from ..session import ship_by_value

ship_by_value(__name__)

BLOCK_LINES = 512       # two blocks of ten years of days take some 60 MB


def _matrix(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, values and presence of the lines of one group, on a common axis."""
    names = group["name"].to_numpy()
    points, at = np.unique(np.concatenate(group["axis"].to_list()), return_inverse=True)
    row = np.repeat(np.arange(len(names)), [len(a) for a in group["axis"]])
    values = np.zeros((len(names), len(points)))
    known = np.zeros_like(values)
    values[row, at] = np.concatenate(group["cells"].to_list())
    known[row, at] = 1.0
    return names, values, known


def _pearson(x: np.ndarray, m: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Pairwise-complete correlation of rows ``left`` with rows ``right``."""
    mean = x.sum(axis=1, keepdims=True) / m.sum(axis=1, keepdims=True)
    scale = np.abs(x).max(axis=1)
    c = (x - mean) * m
    a, b, ma, mb = c[left], c[right], m[left], m[right]
    n = ma @ mb.T
    with np.errstate(divide="ignore", invalid="ignore"):
        sa, sb = a @ mb.T, ma @ b.T
        cov = a @ b.T - sa * sb / n
        va = (a * a) @ mb.T - sa * sa / n
        vb = ma @ (b * b).T - sb * sb / n
        # a constant side leaves nothing but rounding noise
        flat_a = va <= n * (scale[left] * 1e-12)[:, None] ** 2
        flat_b = vb <= n * (scale[right] * 1e-12)[None, :] ** 2
        r = cov / np.sqrt(va * vb)
    r[(n < 2) | flat_a | flat_b] = np.nan
    return n, np.clip(r, -1.0, 1.0)


MIRROR = {"sa": "sb", "sb": "sa", "saa": "sbb", "sbb": "saa", "ta": "tb", "tb": "ta"}
SUMS = ("sa", "sb", "saa", "sbb", "sab", "ta", "tb")


def _co_moments(x: np.ndarray, m: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Common days, and sums, squares, products and largest sizes over them, per pair."""
    a, b, ma, mb = x[left] * m[left], x[right] * m[right], m[left], m[right]
    shape = len(left), len(right)
    top = np.abs(x * m).max(axis=1, initial=0.0)
    return (ma @ mb.T, a @ mb.T, ma @ b.T, (a * a) @ mb.T, ma @ (b * b).T, a @ b.T,
            np.broadcast_to(top[left][:, None], shape), np.broadcast_to(top[right], shape))


def _r_of_sums(sums: DataFrame) -> DataFrame:
    """``a, b, n, r`` from co-moments of parts of the axis, which add up."""
    total = sums.groupBy("a", "b").agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in SUMS[:5]],
        *[F.max(c).alias(c) for c in SUMS[5:]])
    n = F.col("n")
    va, vb = (F.col(s + s[1]) - F.col(s) * F.col(s) / n for s in ("sa", "sb"))
    # a constant side leaves nothing but rounding noise
    flat = (va <= n * F.pow(F.col("ta") * 1e-12, 2)) | (vb <= n * F.pow(F.col("tb") * 1e-12, 2))
    r = (F.col("sab") - F.col("sa") * F.col("sb") / n) / (F.sqrt(va) * F.sqrt(vb))
    return total.select("a", "b", "n", F.when((n >= 2) & ~flat, F.greatest(
        F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))


def _square_distance(x: np.ndarray, m: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Squared Euclidean distance between rows; a missing cell counts as zero."""
    a, b = x[left], x[right]
    n = m[left] @ m[right].T
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return n, np.maximum(square, 0.0)


def _paired(measure: Callable, least: float | None, fields: Sequence[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        names, x, m = _matrix(group)
        block = group["block"].to_numpy()
        lo, hi = group["lo"].iloc[0], group["hi"].iloc[0]
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        n, *found = measure(x, m, left, right)
        i, j = np.meshgrid(left, right, indexing="ij")
        a, b, n = names[i.ravel()], names[j.ravel()], n.ravel().astype("int64")
        found = [f.ravel() for f in found]
        wanted = np.ones(len(n), bool)
        if lo == hi:                     # each pair of a diagonal block once
            wanted &= a < b
        if least is not None:            # only what is wanted leaves the worker
            wanted &= np.abs(found[0]) > least
        if len(fields) > 1:              # sums over no common point say nothing
            wanted &= n > 0
        swap = a > b
        out = {"a": np.where(swap, b, a), "b": np.where(swap, a, b), "n": n}
        for name, f in zip(fields, found):      # sums of the two sides change places with them
            other = found[fields.index(MIRROR[name])] if name in MIRROR else f
            out[name] = np.where(swap, other, f)
        # an undefined measure is NaN here and becomes null on the way back
        return pd.DataFrame({c: v[wanted] for c, v in out.items()})
    return run


def all_pairs(cells: DataFrame, name: str, axis: Column, value: Column, measure: Callable,
              out: str, block_lines: int = BLOCK_LINES, pairs: DataFrame | None = None,
              least: float | None = None, axis_part: Column | None = None,
              fields: Sequence[str] = ("r",)) -> DataFrame:
    """``measure`` for every unordered pair of names, ``a < b``.

    ``pairs(a, b)`` restricts the names to those it has and the result to its pairs;
    ``least`` keeps, inside the workers already, pairs with a larger absolute measure.
    ``axis_part`` cuts a long axis: the measure then comes for each part by itself.

    A name is one row: its list has one entry per axis point (a day, or a line), never
    one per source row.  A row travels once per block, and a group holds two blocks.
    """
    if pairs is not None:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        wanted = pairs.select(F.explode(F.array("a", "b")).alias(name)).distinct()
        cells = cells.join(wanted, name, "left_semi")
    part = F.lit(0).cast("bigint") if axis_part is None else axis_part
    rows = (cells.select(F.col(name).alias("name"), axis.alias("x"), value.alias("v"),
                         part.alias("part"))
            .where(F.col("v").isNotNull())
            .groupBy("name", "part").agg(F.collect_list(F.struct("x", "v")).alias("_c"))
            .select("name", "part", F.col("_c.x").alias("axis"), F.col("_c.v").alias("cells")))
    blocks = cells.agg(F.ceil(F.countDistinct(name) / F.lit(block_lines))).scalar()
    rows = (rows.withColumn("_blocks", blocks)
            .withColumn("block", F.pmod(F.xxhash64("name"), F.col("_blocks")))
            .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                       F.col("_blocks") - 1)))
            .select("name", "part", "axis", "cells", "block",
                    F.least("block", "_other").alias("lo"),
                    F.greatest("block", "_other").alias("hi")))
    found = rows.groupBy("lo", "hi", "part").applyInPandas(
        _paired(measure, least, fields),
        "a string, b string, n bigint, " + ", ".join(f"{f} double" for f in fields))
    if pairs is not None:
        found = found.join(pairs, ["a", "b"], "left_semi")
    return found.withColumnRenamed("r", out)


def _days(day: str = "date") -> Column:
    return F.unix_date(day)


def _prepared(daily: DataFrame, log: bool) -> Column:
    """Raw values count zero days; ``log`` leaves zero days out and takes ``ln(1 + v)``."""
    return F.log1p(zero_to_null(F.col("value"))) if log else F.col("value")


def shifted(daily: DataFrame, log: bool) -> DataFrame:
    """``line, date, value`` less the mean of the line, so that sums of squares stay small
    beside the squares they are taken from; a correlation does not change by it."""
    v = daily.select("line", "date", _prepared(daily, log).alias("value")).where(
        "value IS NOT NULL")
    return v.withColumn("value", F.col("value") - F.avg("value").over(
        Window.partitionBy("line")))


def corr_matrix(daily: DataFrame, log: bool = False, pairs: DataFrame | None = None,
                least: float | None = None, part_days: int | None = None) -> DataFrame:
    """Pearson correlation of every pair of lines over their common days.

    Raw values count zero days; ``log`` leaves zero days out and takes ``ln(1 + v)``.

    With ``part_days``, a list holds no more than so many days of a line: parts of the day
    axis give co-moments, which add up.  Pairs without a common day are left out then.
    """
    if part_days is None:
        return all_pairs(daily, "line", _days(), _prepared(daily, log), _pearson, "r",
                         pairs=pairs, least=least)
    part = F.floor(_days() / F.lit(part_days)).cast("bigint")
    found = _r_of_sums(all_pairs(shifted(daily, log), "line", _days(), F.col("value"),
                                 _co_moments, "r", pairs=pairs, axis_part=part, fields=SUMS))
    return found if least is None else found.where(F.abs("r") > least)


def corr_pairs(matrix: DataFrame) -> DataFrame:
    """Pairs with a correlation, to three decimals, strongest first."""
    return (matrix.where(F.col("r").isNotNull())
            .select("a", "b", F.round("r", 3).alias("r"))
            .orderBy(F.desc("r"), "a", "b"))


def corr_ends(matrix: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` strongest and the ``n`` weakest pairs."""
    known = matrix.where(F.col("r").isNotNull())
    top = known.orderBy(F.desc("r"), "a", "b").limit(n).withColumn("part", F.lit("top"))
    low = known.orderBy("r", "a", "b").limit(n).withColumn("part", F.lit("bottom"))
    return top.unionByName(low).select("part", "a", "b", F.round("r", 3).alias("r"))


def both_ways(matrix: DataFrame, lines: DataFrame) -> DataFrame:
    """The full square: both directions, and 1 on the diagonal."""
    there = matrix.select("a", "b", "r")
    back = matrix.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    own = lines.select(F.col("line").alias("a"), F.col("line").alias("b"),
                       F.lit(1.0).alias("r"))
    return there.unionByName(back).unionByName(own)


def corr_profile_distance(daily: DataFrame, axis_lines: int = 4096) -> DataFrame:
    """Distance between the rows of the matrix ``1 - r`` for every pair of lines.

    The axis is the other line, so it is cut into parts of ``axis_lines``, and the squares
    of the parts are added up: no task holds a row of all lines.
    """
    lines = daily.select("line").distinct()
    square = both_ways(corr_matrix(daily, log=True), lines)
    parts = daily.agg(F.ceil(F.countDistinct("line") / F.lit(axis_lines))).scalar()
    apart = square.select(F.col("a").alias("line"), F.col("b").alias("other"),
                          (1 - F.coalesce("r", F.lit(0.0))).alias("value"),
                          F.pmod(F.xxhash64("b"), parts).alias("part"))
    sums = all_pairs(apart, "line", F.col("other"), F.col("value"), _square_distance, "square",
                     axis_part=F.col("part"))
    return sums.groupBy("a", "b").agg(F.sum("n").alias("n"),
                                      F.sqrt(F.sum("square")).alias("distance"))


def nearest_line(distances: DataFrame) -> DataFrame:
    """For each line the one at the smallest distance."""
    there = distances.select(F.col("a").alias("line"), F.col("b").alias("other"), "distance")
    back = distances.select(F.col("b").alias("line"), F.col("a").alias("other"), "distance")
    near = F.min(F.struct(F.round("distance", 9).alias("distance"), F.col("other")))
    return (there.unionByName(back).groupBy("line").agg(near.alias("_m"))
            .select("line", F.col("_m.other").alias("nearest"), F.col("_m.distance")))


def lag_corr(daily: DataFrame, pairs: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Correlation at lag 0 and one day either way for given pairs, with a verdict."""
    wanted = pairs.select(F.explode(F.array("line_a", "line_b")).alias("line")).distinct()
    daily = daily.join(wanted, "line", "left_semi")
    by_date = Window.partitionBy("line").orderBy("date")
    shifted = daily.select("date", "line", "value",
                           F.lead("value").over(by_date).alias("next_day"),
                           F.lag("value").over(by_date).alias("day_before"))
    a = daily.select("date", F.col("line").alias("line_a"), F.col("value").alias("_a"))
    b = shifted.withColumnRenamed("line", "line_b")
    joined = a.join(pairs, "line_a").join(b, ["line_b", "date"])
    x = F.col("_a")
    stats = joined.groupBy("line_a", "line_b").agg(
        safe_corr(x, F.col("value")).alias("lag0"),
        safe_corr(x, F.col("next_day")).alias("a_leads"),
        safe_corr(x, F.col("day_before")).alias("b_leads"))
    verdict = (F.when(F.col("a_leads") > F.col("lag0") + threshold,
                      F.concat("line_a", F.lit(LEADS), "line_b"))
               .when(F.col("b_leads") > F.col("lag0") + threshold,
                     F.concat("line_b", F.lit(LEADS), "line_a"))
               .otherwise(TOGETHER))
    return stats.select("line_a", "line_b", *[F.round(c, 3).alias(c) for c in
                        ("lag0", "a_leads", "b_leads")], verdict.alias("verdict"))
