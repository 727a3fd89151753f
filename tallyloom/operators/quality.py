"""Cleaning, predicates and data-quality reports over the raw long table.

These run on the raw size, so none of them puts all rows of a key in one task: first
rows come from aggregates with map-side combine, later rows from joins on the full row
identity, and quantiles from counting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import DAY_FIRST, all_of, parse_day, parse_number, percent
from ..sources.tables import RAW_COLUMNS
from .quantiles import exact_quantiles
from .rows import attach_row
from .segments import filled_cells

# ---------------------------------------------------------------- profiles


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, columns and cells."""
    width = len(df.columns)
    return df.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(width).cast("bigint").alias("columns"),
        (F.col("rows") * width).alias("cells"))


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, non-null, null and null share, from a single pass."""
    kinds = dict(df.dtypes)
    counts = df.agg(F.count("*").alias("rows"),
                    *[F.count(F.col(c)).alias(f"n_{i}") for i, c in enumerate(df.columns)])
    lines = [F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("dtype"),
                      F.col(f"n_{i}").alias("non_null")) for i, c in enumerate(df.columns)]
    nulls = F.col("rows") - F.col("non_null")
    return (counts.select("rows", F.inline(F.array(*lines)))
            .select("column_name", "dtype", "non_null", nulls.alias("nulls"),
                    F.round(percent(nulls, F.col("rows")), 2).alias("null_pct"))
            .orderBy(F.desc("null_pct"), "column_name"))


def missing_report(df: DataFrame) -> DataFrame:
    """Nulls per column and their share to one decimal."""
    rows = F.col("non_null") + F.col("nulls")
    return (column_profile(df)
            .select("column_name", F.col("nulls").alias("missing"),
                    F.round(percent(F.col("nulls"), rows), 1).alias("missing_pct"))
            .orderBy(F.desc("missing"), "column_name"))


def head_rows(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, keys: Sequence[str], n: int = 5, seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` rows: the smallest seeded hashes of the row key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return df.orderBy(F.md5(text), *keys).limit(n)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values with their row count."""
    return (df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("item"))
            .agg(F.count("*").alias("rows")).orderBy("item"))


def value_counts(df: DataFrame, column: str, keep_nulls: bool = False) -> DataFrame:
    """Rows per value, most frequent first; nulls are no value unless asked for."""
    df = df if keep_nulls else df.where(F.col(column).isNotNull())
    return (df.groupBy(F.col(column).alias("item")).agg(F.count("*").alias("rows"))
            .orderBy(F.desc("rows"), "item"))


# ---------------------------------------------------------------- filters


def step_counts(df: DataFrame, keep: Column) -> DataFrame:
    """Rows before and after a filter, from one pass."""
    counted = df.agg(F.count("*").alias("rows_before"), F.count_if(keep).alias("rows_after"))
    return counted.withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


def has_any_value(columns: Sequence[str] = RAW_COLUMNS) -> Column:
    return ~all_of([F.col(c).isNull() for c in columns])


def drop_empty_rows(df: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Remove rows in which every source column is null."""
    return df.na.drop(how="all", subset=list(columns))


def unit_filter(df: DataFrame, unit: str) -> DataFrame:
    return df.where(F.col("unit") == unit)


def evaluated_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns behind a generator.

    A plain projection is folded into every later filter and expression that mentions the
    column, and text would be parsed once for each of them.
    """
    fields = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(fields)))


def with_date(df: DataFrame, formats: Sequence[str] = DAY_FIRST) -> DataFrame:
    return evaluated_once(df, date=parse_day(F.col("date_raw"), formats))


def parse_dates(df: DataFrame, formats: Sequence[str] = DAY_FIRST) -> DataFrame:
    """Rows whose day could be read, with ``date``."""
    return with_date(df, formats).where(F.col("date").isNotNull())


def rejected_dates(df: DataFrame, formats: Sequence[str] = DAY_FIRST) -> DataFrame:
    return with_date(df, formats).where(F.col("date").isNull()).drop("date")


def year_distribution(df: DataFrame) -> DataFrame:
    return (df.groupBy(F.year("date").cast("bigint").alias("year"))
            .agg(F.count("*").alias("rows")).orderBy("year"))


def valid_year(first: int, last: int) -> Column:
    """As bounds on the date, which a file scan can use."""
    return F.col("date").between(F.make_date(F.lit(first), F.lit(1), F.lit(1)),
                                 F.make_date(F.lit(last), F.lit(12), F.lit(31)))


def year_range_filter(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.where(valid_year(first, last))


def date_summary(df: DataFrame) -> DataFrame:
    return (df.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
            .withColumn("days", (F.datediff("last_date", "first_date") + 1).cast("bigint")))


def clean_numeric(df: DataFrame, text: str = "qty_raw", out: str = "qty") -> DataFrame:
    return evaluated_once(df, **{out: parse_number(F.col(text))})


def numeric_report(df: DataFrame, text: str = "qty_raw") -> DataFrame:
    """Missing quantities before and after the conversion."""
    number = parse_number(F.col(text))
    lost = number.isNull() | F.isnan(number)
    return (df.agg(F.count_if(F.col(text).isNull()).alias("null_before"),
                   F.count_if(lost).alias("null_after"))
            .withColumn("null_added", F.col("null_after") - F.col("null_before")))


def drop_unresolved(df: DataFrame, value: str = "qty") -> DataFrame:
    return df.where(F.col(value).isNotNull())


def negative_filter(df: DataFrame, value: str = "qty") -> DataFrame:
    return df.where(F.col(value) >= 0)


def negative_rows(df: DataFrame, value: str = "qty") -> DataFrame:
    return df.where(F.col(value) < 0)


# ---------------------------------------------------------------- duplicates

DAY_KEY = ("date", "vehicle")


def _firsts(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    rest = [c for c in df.columns if c not in {*keys, seq}]
    return df.groupBy(*keys).agg(
        F.min(F.col(seq)).alias(seq),
        F.min_by(F.struct(*rest), F.col(seq)).alias("_row"),
        F.count("*").alias("_copies"))


def dedup_first(df: DataFrame, keys: Sequence[str] = DAY_KEY,
                seq: str = "ingest_seq") -> DataFrame:
    """Keep the first row per key in the order of ``seq`` (unique per row).

    An aggregate with map-side combine, so a key with very many copies costs one row per
    input task in the shuffle.
    """
    return _firsts(df, keys, seq).select(*keys, seq, "_row.*").select(*df.columns)


def duplicate_keys(df: DataFrame, keys: Sequence[str] = DAY_KEY,
                   seq: str = "ingest_seq") -> DataFrame:
    """The second and later rows of each key.

    The anti join runs on key *and* sequence, which is unique, so the copies of a hot key
    spread over all tasks.
    """
    first = df.groupBy(*keys).agg(F.min(seq).alias("_first")).select(F.struct(
        *keys, "_first").alias("_f"))
    same = F.col(seq) == F.col("_f._first")
    for key in keys:                # missing keys are equal to each other
        same = same & df[key].eqNullSafe(F.col(f"_f.{key}"))
    return df.join(first, same, "left_anti")


def duplicate_summary(df: DataFrame, keys: Sequence[str] = DAY_KEY) -> DataFrame:
    """Rows, repeats and rows left after keeping one per key."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(F.sum("n").alias("rows"),
                       (F.sum("n") - F.count("*")).alias("repeats"),
                       F.count("*").alias("distinct_keys"))


def duplicate_cells(df: DataFrame, keys: Sequence[str] = ("date", "line"),
                    seq: str = "ingest_seq") -> DataFrame:
    """All rows of every key that occurs more than once."""
    first = _firsts(df, keys, seq)
    opening = (first.where(F.col("_copies") > 1)
               .select(*keys, seq, "_row.*").select(*df.columns))
    return duplicate_keys(df, keys, seq).unionByName(opening)


def dedup_full_row(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


# ---------------------------------------------------------------- interpolation by row


def interpolate_rows(df: DataFrame, value: str = "qty", series: str = "vehicle",
                     day: str = "date", seq: str = "ingest_seq", limit: int = 3,
                     block_rows: int = 1 << 20) -> DataFrame:
    """Linear fill of null values by row position within each series.

    Up to ``limit`` cells are filled after a known value; a longer gap keeps the rest
    null, a trailing gap repeats the last value, a leading gap stays null.  Rows of no
    series lose their value.  ``seq`` tells rows of a series and day apart; empty rows that
    agree in all three get the same value.

    A series may hold a large part of the table, so it is not one window: the four columns
    are put in order by ranges and scanned in segments of at most ``block_rows`` rows, and
    only the values found for empty cells are joined to the rows.  The scan runs when the
    frame is made; its cells lie in the shared folder.
    """
    narrow = df.select(F.col(series).alias("series"), F.col(day).alias("day"),
                       F.col(seq).alias("seq"), F.col(value).cast("double").alias("value"))
    cells = (filled_cells(narrow, limit, block_rows).groupBy("series", "day", "seq")
             .agg(F.min("filled").alias("_filled")))
    own = df.alias("own")
    match = all_of([F.col(f"own.`{mine}`").eqNullSafe(F.col(f"cells.{other}")) for mine, other in
                    ((series, "series"), (day, "day"), (seq, "seq"))])
    match = match & F.col(f"own.`{value}`").isNull()
    filled = F.when(F.col(f"own.`{series}`").isNotNull(),
                    F.coalesce(F.col(f"own.`{value}`"), F.col("cells._filled")))
    return own.join(cells.alias("cells"), match, "left").select(
        *[filled.alias(c) if c == value else F.col(f"own.`{c}`") for c in df.columns])


# ---------------------------------------------------------------- distributions

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def describe(df: DataFrame, value: str = "qty") -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, in one row."""
    v = F.col(value)
    basic = df.agg(F.count(v).alias("count"), F.avg(v).alias("mean"),
                   F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return attach_row(basic, exact_quantiles(df, value, QUARTILES)).select(
        "count", "mean", "std", "min", *QUARTILES, "max")


def describe_by(df: DataFrame, keys: Sequence[str], value: str = "qty") -> DataFrame:
    """``describe`` for each key."""
    v = F.col(value)
    basic = df.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    marks = exact_quantiles(df, value, QUARTILES, keys)
    return basic.join(marks, list(keys)).select(
        *keys, "count", "mean", "std", "min", *QUARTILES, "max")


def skew_flags(df: DataFrame, value: str = "qty") -> DataFrame:
    """Four warnings about the distribution."""
    return describe(df, value).select(
        (F.col("min") < 0).alias("has_negative"),
        (F.col("mean") > F.col("median")).alias("right_skewed"),
        (F.col("std") > F.col("mean")).alias("high_spread"),
        (F.col("max") > F.col("mean") * 3).alias("extreme_max"))


def quantile_thresholds(df: DataFrame, value: str = "qty") -> DataFrame:
    """95th and 99th percentile and the maximum, which is the last order statistic."""
    return exact_quantiles(df, value, {"p95": 0.95, "p99": 0.99, "max": 1.0})


def flag_outliers(df: DataFrame, value: str = "qty", prob: float = 0.99) -> DataFrame:
    """Adds ``is_outlier``: above the quantile of the whole column."""
    limit = exact_quantiles(df, value, {"limit": prob}).scalar()
    return df.withColumn("is_outlier", F.col(value) > limit)


def outlier_report(flagged: DataFrame) -> DataFrame:
    """Outlier count, share and severity."""
    ratio = percent(F.col("outliers"), F.col("rows"))
    severity = (F.when(ratio < 1, "low").when(ratio < 5, "medium").otherwise("high"))
    return (flagged.agg(F.count("*").alias("rows"), F.count_if("is_outlier").alias("outliers"))
            .select("rows", "outliers", F.round(ratio, 4).alias("outlier_pct"),
                    severity.alias("severity")))


def outlier_top(flagged: DataFrame, value: str = "qty", n: int = 10) -> DataFrame:
    """The ``n`` largest outliers."""
    return (flagged.where("is_outlier").select("date", "vehicle", value, "ingest_seq")
            .orderBy(F.desc(value), "ingest_seq").limit(n))


def outlier_by_key(flagged: DataFrame, key: str = "vehicle", n: int = 5) -> DataFrame:
    return value_counts(flagged.where("is_outlier"), key).limit(n)


def group_stats(df: DataFrame, key: str = "vehicle", value: str = "qty") -> DataFrame:
    """Per series: days, mean, median, p95, max, deviation (whole numbers), the ratio of
    deviation to mean, the ratio of maximum to p95, and the place in three orders."""
    v = F.col(value)
    basic = df.groupBy(key).agg(F.count(v).alias("days"), F.avg(v).alias("mean"),
                                F.max(v).alias("max"), F.stddev_samp(v).alias("std"))
    marks = exact_quantiles(df, value, {"median": 0.5, "p95": 0.95}, [key])
    whole = {c: F.round(F.round(F.col(c), 4)) for c in ("mean", "median", "p95", "max", "std")}
    stats = (basic.join(marks, key).withColumns(whole)
             .withColumns({"cv": F.round(F.try_divide("std", "mean"), 2),
                           "spike_ratio": F.round(F.try_divide("max", "p95"), 2)}))
    return stats


def rank_stats(stats: DataFrame, by: str, n: int, key: str = "vehicle") -> DataFrame:
    return stats.orderBy(F.desc(by), key).limit(n)


def risk_counts(stats: DataFrame, cv: float = 1.0, spike: float = 2.0) -> DataFrame:
    return stats.agg(F.count_if(F.col("cv") > cv).alias("high_cv"),
                     F.count_if(F.col("spike_ratio") > spike).alias("high_spike"))


# ---------------------------------------------------------------- coverage


def key_inventory(df: DataFrame, key: str = "vehicle", patterns: Sequence[str] = ("BTS", "MRT"),
                  many: int = 15) -> DataFrame:
    """Distinct names, with a mark on those that match a pattern and on a long list."""
    names = df.where(F.col(key).isNotNull()).select(F.col(key).alias("item")).distinct()
    suspect = F.lit(False)
    for p in patterns:
        suspect = suspect | F.contains(F.col("item"), F.lit(p))
    counted = attach_row(names, names.agg(F.count("*").alias("distinct_items")))
    return counted.select("item", suspect.alias("suspect"), "distinct_items",
                          (F.col("distinct_items") > many).alias("too_many")).orderBy("item")


def _gaps(df: DataFrame) -> DataFrame:
    """First and last day of each run of days without a row.  The window holds one row per
    day of the calendar at most, whatever the size of the table."""
    seen = df.where(F.col("date").isNotNull()).select("date").distinct()
    later = F.lead("date").over(Window.partitionBy(F.lit(0)).orderBy("date"))
    return (seen.withColumn("_next", later).where(F.datediff("_next", "date") > 1)
            .select(F.date_add("date", 1).alias("gap_start"),
                    F.date_sub("_next", 1).alias("gap_end")))


def missing_days(df: DataFrame) -> DataFrame:
    """Days between the first and last date on which no series has a row."""
    return _gaps(df).select(F.explode(F.sequence("gap_start", "gap_end")).alias("date"))


def calendar_missing(df: DataFrame) -> DataFrame:
    """Observed and missing days of the whole table, with the share missing."""
    observed = df.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                      F.countDistinct("date").alias("observed_days"))
    total = (F.datediff("last_date", "first_date") + 1).cast("bigint")
    return observed.withColumns({"missing_days": total - F.col("observed_days")}).withColumn(
        "missing_pct", F.round(percent(F.col("missing_days"), total), 4))


def gap_islands(df: DataFrame, short: int = 3) -> DataFrame:
    """Runs of consecutive missing days, with length and whether it is short."""
    return (_gaps(df).withColumn("gap_days", (F.datediff("gap_end", "gap_start") + 1)
                                 .cast("bigint"))
            .withColumn("short_gap", F.col("gap_days") <= short).orderBy("gap_start"))


def longest_gap(df: DataFrame) -> DataFrame:
    return gap_islands(df).agg(F.coalesce(F.max("gap_days"), F.lit(0)).alias("longest_gap"))


def series_gaps(df: DataFrame, key: str = "vehicle") -> DataFrame:
    """Missing days inside the span of each series."""
    span = (F.datediff(F.max("date"), F.min("date")) + 1).cast("bigint")
    per = df.groupBy(key).agg(F.countDistinct("date").alias("_seen"), span.alias("total_days"))
    missing = F.col("total_days") - F.col("_seen")
    return (per.select(key, missing.alias("missing_days"), "total_days",
                       F.round(percent(missing, F.col("total_days")), 1).alias("missing_pct"))
            .orderBy(F.desc("missing_days"), key))


def gap_counts(gaps: DataFrame) -> DataFrame:
    return gaps.agg(F.count("*").alias("series"),
                    F.count_if(F.col("missing_days") > 0).alias("series_with_gaps"))


def in_domain(mode: str, ownership: str) -> Column:
    return (F.col("mode") == mode) & (F.col("ownership") == ownership)


def domain_filter(df: DataFrame, mode: str, ownership: str) -> DataFrame:
    return df.where(in_domain(mode, ownership))


def domain_coverage(df: DataFrame, mode: str, ownership: str) -> DataFrame:
    """Share of rows inside the domain; below ten percent hints at a wrong filter."""
    ratio = percent(F.col("domain_rows"), F.col("rows"))
    verdict = (F.when(F.col("domain_rows") == 0, "empty").when(ratio < 10, "unusually_low")
               .otherwise("ok"))
    inside = F.coalesce(in_domain(mode, ownership), F.lit(False))
    return (df.agg(F.count("*").alias("rows"), F.count_if(inside).alias("domain_rows"))
            .select("rows", "domain_rows", F.round(ratio, 2).alias("coverage_pct"),
                    verdict.alias("verdict")))


def date_coverage(df: DataFrame) -> DataFrame:
    """Days with data against days expected."""
    found = df.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                   F.countDistinct("date").alias("unique_days"))
    expected = (F.datediff("last_date", "first_date") + 1).cast("bigint")
    ratio = percent(F.col("unique_days"), expected)
    verdict = F.when(ratio == 100, "complete").when(ratio > 95, "nearly_complete") \
        .otherwise("gaps")
    return found.select("first_date", "last_date", "unique_days",
                        expected.alias("expected_days"),
                        (expected - F.col("unique_days")).alias("missing_days"),
                        F.round(ratio, 2).alias("coverage_pct"), verdict.alias("verdict"))
