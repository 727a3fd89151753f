"""Exact quantiles that never gather a whole column or a hot group in one task.

The built-in ``percentile`` keeps every distinct value of a group in one buffer.  Here the
wanted ranks are located by counting, for groups of every size alike: a coarse monotone
bucket of the value, then a fine bucket inside the hit buckets, then the distinct values
inside those.  Each step is a partial aggregation followed by a cumulative count over the
buckets of a group, whose number has a bound (some 360,000 for all doubles).

Daily series are bounded by the calendar and call the built-in directly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import all_of

COARSE_PER_EFOLD = 256    # buckets per factor e of the value
FINE_BUCKETS = 65536      # buckets inside a coarse one


def _coarse(value: Column) -> Column:
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * F.lit(COARSE_PER_EFOLD))


def _fine(value: Column) -> Column:
    share = F.try_divide(value - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return F.floor(F.coalesce(share, F.lit(0.0)) * F.lit(FINE_BUCKETS))


def _hits(hist: DataFrame, groups: Sequence[str], order: str) -> DataFrame:
    """Cumulate counts within ``groups`` and keep the rows that hold a wanted rank."""
    below = F.sum("_n").over(
        Window.partitionBy(*groups).orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    return (hist.withColumn("_base", F.col("_base") + below)
            .withColumn("_ranks", F.filter(
                "_ranks", lambda r: (r >= F.col("_base")) & (r < F.col("_base") + F.col("_n"))))
            .where(F.size("_ranks") > 0))


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float],
                    keys: Sequence[str] = ()) -> DataFrame:
    """One row per key (one row in all without keys); a column per entry of ``probs``.

    Linear interpolation between the two neighbouring order statistics.
    """
    groups = list(keys)
    source = df.select(*keys, F.col(value).cast("double").alias("_v"))
    source = source.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if not groups:              # one group, named by a constant
        source, groups = source.withColumn("_all", F.lit(0)), ["_all"]
        return _by_counting(source, probs, groups).drop("_all")
    source = source.where(all_of([F.col(g).isNotNull() for g in groups]))
    return _by_counting(source, probs, groups)


def _by_counting(source: DataFrame, probs: Mapping[str, float],
                 groups: Sequence[str]) -> DataFrame:
    source = source.withColumn("_b", _coarse(F.col("_v")))
    hist = source.groupBy(*groups, "_b").agg(
        F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    last = F.sum("_n").over(Window.partitionBy(*groups)) - 1
    wanted = []
    for p in probs.values():
        wanted += [F.floor(last * F.lit(p)), F.ceil(last * F.lit(p))]
    hist = (hist.withColumn("_last", last)
            .withColumn("_ranks", F.array_distinct(F.array(*wanted)))
            .withColumn("_base", F.lit(0).cast("bigint")))
    # at most two buckets per probability are left of each group
    coarse = _hits(hist, groups, "_b").drop("_n")
    inside = source.join(coarse, [*groups, "_b"]).withColumn("_f", _fine(F.col("_v")))

    bucket, carried = [*groups, "_b"], ["_base", "_ranks", "_last"]
    hist = inside.groupBy(*bucket, "_f").agg(
        F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in carried])
    fine = _hits(hist, bucket, "_f").select(*bucket, "_f", *carried)
    values = (inside.drop(*carried).join(fine, [*bucket, "_f"])
              .groupBy(*bucket, "_f", "_v")
              .agg(F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in carried]))
    found = _hits(values, [*bucket, "_f"], "_v").select(
        *groups, "_v", "_last", F.explode("_ranks").alias("_r"))

    outputs = []
    for name, p in probs.items():
        at = F.col("_last") * F.lit(p)
        low = F.max(F.when(F.col("_r") == F.floor(at), F.col("_v")))
        high = F.max(F.when(F.col("_r") == F.ceil(at), F.col("_v")))
        outputs.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return found.groupBy(*groups).agg(*outputs)
