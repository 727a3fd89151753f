"""Sources and ingestion, cleaning and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators import quality as q
from tallyloom.session import new_folder
from tallyloom.sources import tables

from . import inputs as i
from .registry import query, rnd, with_ctes

RAW_COLS = "mode, purpose, ownership, agency, vehicle, date_raw, unit, qty_raw"


def raw_sql(body: str, needs: str = "raw") -> str:
    return with_ctes(i.RAW, body, needs)


# ------------------------------------------------------------------ 2.1 sources


@query("scan_csv", raw_sql(f"""
SELECT {RAW_COLS}, CAST(count(*) AS BIGINT) AS rows FROM (
  SELECT * REPLACE (CASE WHEN qty_raw NOT IN ('n/a', 'nan', '') THEN qty_raw END AS qty_raw)
  FROM raw) GROUP BY ALL"""))
def scan_csv(spark, sf):
    folder = new_folder(spark, "csv")
    text = i.raw(spark, sf).select(*tables.RAW_COLUMNS)
    rail = F.coalesce(F.col("mode") == "rail", F.lit(False))
    # one folder per half of the data, as the publisher has one file per year; the second
    # has its columns the other way round
    for half, part in (("rail", text.where(rail)),
                       ("other", text.where(~rail).select(*reversed(tables.RAW_COLUMNS)))):
        part.write.options(header=True, emptyValue='""', ignoreLeadingWhiteSpace=False,
                           ignoreTrailingWhiteSpace=False).csv(f"{folder}/{half}")
    back = tables.scan_csv(spark, [f"{folder}/rail", f"{folder}/other"])
    return back.groupBy(*tables.RAW_COLUMNS).agg(F.count("*").alias("rows"))


# every order as a line; by its key it lacks a field, has thousands commas without quotes,
# goes on over a line end, or leaves a quote open
DAMAGE = """
SELECT *, CASE WHEN o_orderkey % 17 = 0 THEN 'too few fields'
               WHEN o_orderkey % 19 = 0 THEN 'too many fields'
               WHEN o_orderkey % 23 = 0 THEN 'two lines'
               WHEN o_orderkey % 29 = 0 THEN 'open quote' END AS kind,
       CAST(o_orderkey AS {text}) AS k, o_orderpriority AS p FROM orders"""
DAMAGED_LINE = """CASE kind WHEN 'too few fields' THEN concat(k, ',', p)
  WHEN 'too many fields' THEN concat(k, ',', p, ',1,234')
  WHEN 'two lines' THEN concat(k, ',"', p, {line_end}, ' ""x"", y",5')
  WHEN 'open quote' THEN concat(k, ',"', p, ',7') ELSE concat(k, ',', p, ',9') END"""


@query("scan_csv_rejects", f"""
WITH d AS ({DAMAGE.format(text="VARCHAR")})
SELECT CASE WHEN kind <> 'two lines' THEN kind END AS reason,
  CASE WHEN kind IS NULL THEN concat(k, '|', p, '|9')
       WHEN kind = 'two lines' THEN concat(k, '|', p, chr(10), ' "x", y|5')
       ELSE {DAMAGED_LINE.format(line_end="chr(10)")} END AS record
FROM d""")
def scan_csv_rejects(spark, sf):
    """A damaged file of orders, read whole: sound rows and rejects."""
    folder = new_folder(spark, "csv")
    orders = tables.scan_table(spark, sf, "orders")
    lines = spark.sql(DAMAGE.format(text="STRING").replace("FROM orders", "FROM {orders}"),
                      orders=orders).select(F.expr(
                          DAMAGED_LINE.format(line_end="char(10)")).alias("value"))
    # the header goes before the first line of each part
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines.withColumn("value", F.when(first, F.concat(
        F.lit("order_key,priority,n\n"), "value")).otherwise(F.col("value"))).write.text(folder)
    schema = T.StructType([T.StructField(c, T.StringType())
                           for c in ("order_key", "priority", "n")])
    good, rejects = tables.scan_csv_rejects(spark, folder, schema)
    return good.select(F.lit(None).cast("string").alias("reason"),
                       F.concat_ws("|", "order_key", "priority", "n").alias("record")).unionByName(
        rejects.select("reason", "record"))


@query("schema_check", """
SELECT column_name, true AS in_left, column_name <> 'o_orderkey' AS in_right,
  column_name <> 'o_orderkey' AS matches
FROM (DESCRIBE orders)""")
def schema_check(spark, sf):
    orders = tables.scan_table(spark, sf, "orders")
    return tables.schema_check(orders, orders.drop("o_orderkey"))


@query("union_sources", raw_sql(
    f"SELECT {RAW_COLS}, ingest_seq FROM raw"))
def union_sources(spark, sf):
    rows = i.raw(spark, sf)
    rail = F.coalesce(F.col("mode") == "rail", F.lit(False))
    other = rows.where(~rail)
    return tables.union_sources(rows.where(rail), other.select(*reversed(other.columns)))


@query("nonempty_guard", raw_sql(
    "SELECT CAST(count(*) AS BIGINT) AS rows, count(*) > 0 AS nonempty FROM raw"))
def nonempty_guard(spark, sf):
    return tables.nonempty_guard(i.raw(spark, sf))


@query("dataset_summary", raw_sql("""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(9 AS BIGINT) AS columns,
  CAST(count(*) * 9 AS BIGINT) AS cells FROM raw"""))
def dataset_summary(spark, sf):
    return q.dataset_summary(i.raw(spark, sf))


def _profile(columns, table):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS dtype, CAST(count({c}) AS BIGINT) AS non_null, "
        f"CAST(count(*) - count({c}) AS BIGINT) AS nulls, "
        f"{rnd(f'100.0 * (count(*) - count({c})) / count(*)', 2)} AS null_pct FROM {table}"
        for c, t in columns)


TEXT = [(c, "string") for c in tables.RAW_COLUMNS]


@query("column_profile", raw_sql(_profile([*TEXT, ("ingest_seq", "bigint")], "raw")))
def column_profile(spark, sf):
    return q.column_profile(i.raw(spark, sf))


@query("missing_report", raw_sql(f"""
SELECT column_name, nulls AS missing,
  {rnd('100.0 * nulls / (nulls + non_null)', 1)} AS missing_pct FROM (
  {_profile([*TEXT, ('ingest_seq', 'bigint'), ('date', 'date'), ('qty', 'double')], 'numbered')})
""", "numbered"))
def missing_report(spark, sf):
    return q.missing_report(i.numbered(spark, sf))


@query("head_rows", raw_sql("SELECT * FROM raw ORDER BY ingest_seq LIMIT 5"))
def head_rows(spark, sf):
    return q.head_rows(i.raw(spark, sf), ["ingest_seq"])


@query("sample_rows", raw_sql("""
SELECT * FROM raw ORDER BY md5('42|' || CAST(ingest_seq AS VARCHAR)), ingest_seq LIMIT 5"""))
def sample_rows(spark, sf):
    return q.sample_rows(i.raw(spark, sf), ["ingest_seq"])


@query("distinct_values", raw_sql("""
SELECT vehicle AS item, CAST(count(*) AS BIGINT) AS rows FROM raw
WHERE vehicle IS NOT NULL GROUP BY ALL"""))
def distinct_values(spark, sf):
    return q.distinct_values(i.raw(spark, sf), "vehicle")


# ------------------------------------------------------------------ 2.2 cleaning


@query("drop_empty_rows", raw_sql("SELECT * FROM filled_rows", "filled_rows"))
def drop_empty_rows(spark, sf):
    return q.drop_empty_rows(i.raw(spark, sf))


def _steps(keep: str, table: str) -> str:
    return f"""SELECT CAST(count(*) AS BIGINT) AS rows_before,
  CAST(count(*) FILTER ({keep}) AS BIGINT) AS rows_after,
  CAST(count(*) - count(*) FILTER ({keep}) AS BIGINT) AS rows_removed FROM {table}"""


@query("drop_empty_counts", raw_sql(_steps(
    "NOT (" + " AND ".join(f"{c} IS NULL" for c in tables.RAW_COLUMNS) + ")", "raw")))
def drop_empty_counts(spark, sf):
    return q.step_counts(i.raw(spark, sf), q.has_any_value())


@query("value_counts", raw_sql(
    "SELECT unit AS item, CAST(count(*) AS BIGINT) AS rows FROM raw WHERE unit IS NOT NULL "
    "GROUP BY ALL"))
def value_counts(spark, sf):
    return q.value_counts(i.raw(spark, sf), "unit")


@query("unit_filter", raw_sql("SELECT * FROM one_unit", "one_unit"))
def unit_filter(spark, sf):
    return i.one_unit(spark, sf)


@query("unit_filter_counts", raw_sql(_steps("unit = 'persons'", "filled_rows"), "filled_rows"))
def unit_filter_counts(spark, sf):
    return q.step_counts(q.drop_empty_rows(i.raw(spark, sf)), F.col("unit") == i.UNIT)


@query("parse_dates", raw_sql("SELECT * FROM dated", "dated"))
def parse_dates(spark, sf):
    return i.dated(spark, sf)


@query("parse_dates_rejected", raw_sql(
    "SELECT * EXCLUDE (date) FROM with_date WHERE date IS NULL", "with_date"))
def parse_dates_rejected(spark, sf):
    return q.rejected_dates(i.one_unit(spark, sf))


@query("parse_dates_iso_fallback", raw_sql("""
SELECT * FROM (SELECT * EXCLUDE (date), coalesce(CAST(try_strptime(date_raw, '%d/%m/%Y') AS DATE),
  CAST(try_strptime(date_raw, '%Y-%m-%d') AS DATE)) AS date FROM with_date)
WHERE date IS NOT NULL""", "with_date"))
def parse_dates_iso_fallback(spark, sf):
    return q.parse_dates(i.one_unit(spark, sf), ("d/M/yyyy", "yyyy-M-d"))


@query("year_distribution", raw_sql("""
SELECT CAST(year(date) AS BIGINT) AS year, CAST(count(*) AS BIGINT) AS rows
FROM dated GROUP BY ALL""", "dated"))
def year_distribution(spark, sf):
    return q.year_distribution(i.dated(spark, sf))


@query("year_range_filter", raw_sql("SELECT * FROM in_years", "in_years"))
def year_range_filter(spark, sf):
    return i.in_years(spark, sf)


@query("year_range_counts", raw_sql(_steps("year(date) BETWEEN 1995 AND 2000", "dated"), "dated"))
def year_range_counts(spark, sf):
    return q.step_counts(i.dated(spark, sf), q.valid_year(*i.YEARS))


@query("year_range_rejected", raw_sql(
    "SELECT date, vehicle, ingest_seq FROM dated WHERE NOT (year(date) BETWEEN 1995 AND 2000)",
    "dated"))
def year_range_rejected(spark, sf):
    return i.dated(spark, sf).where(~q.valid_year(*i.YEARS)).select(
        "date", "vehicle", "ingest_seq")


@query("date_summary", raw_sql("""
SELECT min(date) AS first_date, max(date) AS last_date,
  CAST(max(date) - min(date) + 1 AS BIGINT) AS days FROM in_years""", "in_years"))
def date_summary(spark, sf):
    return q.date_summary(i.in_years(spark, sf))


@query("clean_numeric", raw_sql("SELECT * FROM numbered", "numbered"))
def clean_numeric(spark, sf):
    return i.numbered(spark, sf)


@query("clean_numeric_counts", raw_sql("""
SELECT CAST(count(*) FILTER (qty_raw IS NULL) AS BIGINT) AS null_before,
  CAST(count(*) FILTER (qty IS NULL) AS BIGINT) AS null_after,
  CAST(count(*) FILTER (qty IS NULL) - count(*) FILTER (qty_raw IS NULL) AS BIGINT) AS null_added
FROM numbered""", "numbered"))
def clean_numeric_counts(spark, sf):
    return q.numeric_report(i.in_years(spark, sf))


@query("interpolate_rows", raw_sql(
    f"SELECT * EXCLUDE (qty), {rnd('qty', 4)} AS qty FROM interpolated", "interpolated"))
def interpolate_rows(spark, sf):
    return i.rounded(i.interpolated(spark, sf))


@query("drop_unresolved", raw_sql(
    f"SELECT * EXCLUDE (qty), {rnd('qty', 4)} AS qty FROM resolved", "resolved"))
def drop_unresolved(spark, sf):
    return i.rounded(i.resolved(spark, sf))


@query("duplicate_keys", raw_sql(f"""
SELECT date, vehicle, ingest_seq, {rnd('qty', 4)} AS qty FROM occurrences
WHERE occurrence > 1""", "occurrences"))
def duplicate_keys(spark, sf):
    return i.rounded(q.duplicate_keys(i.resolved(spark, sf)).select(
        "date", "vehicle", "ingest_seq", "qty"))


@query("duplicate_summary", raw_sql("""
SELECT CAST(count(*) AS BIGINT) AS rows,
  CAST(count(*) FILTER (occurrence > 1) AS BIGINT) AS repeats,
  CAST(count(*) FILTER (occurrence = 1) AS BIGINT) AS distinct_keys FROM occurrences""",
    "occurrences"))
def duplicate_summary(spark, sf):
    return q.duplicate_summary(i.resolved(spark, sf))


@query("duplicate_cells_null_keys", with_ctes(i.LOOSE, """
SELECT date, vehicle, ingest_seq, qty FROM loose_numbered WHERE copies > 1""", "loose_numbered"))
def duplicate_cells_null_keys(spark, sf):
    return q.duplicate_cells(i.loose(spark, sf), ("date", "vehicle"))


@query("duplicate_keys_null_keys", with_ctes(i.LOOSE, """
SELECT date, vehicle, ingest_seq, qty FROM loose_numbered WHERE occurrence > 1""",
    "loose_numbered"))
def duplicate_keys_null_keys(spark, sf):
    return q.duplicate_keys(i.loose(spark, sf))


@query("duplicate_summary_null_keys", with_ctes(i.LOOSE, """
SELECT CAST(count(*) AS BIGINT) AS rows,
  CAST(count(*) FILTER (occurrence > 1) AS BIGINT) AS repeats,
  CAST(count(*) FILTER (occurrence = 1) AS BIGINT) AS distinct_keys FROM loose_numbered""",
    "loose_numbered"))
def duplicate_summary_null_keys(spark, sf):
    return q.duplicate_summary(i.loose(spark, sf))


@query("dedup_first_null_keys", with_ctes(i.LOOSE, """
SELECT date, vehicle, ingest_seq, qty FROM loose_numbered WHERE occurrence = 1""",
    "loose_numbered"))
def dedup_first_null_keys(spark, sf):
    return q.dedup_first(i.loose(spark, sf))


@query("dedup_first", raw_sql(
    f"SELECT * EXCLUDE (qty), {rnd('qty', 4)} AS qty FROM deduped", "deduped"))
def dedup_first(spark, sf):
    return i.rounded(q.dedup_first(i.resolved(spark, sf)))


@query("dedup_lineitem", """
SELECT * EXCLUDE (rn) FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  l_extendedprice, CAST(l_shipdate AS DATE) AS shipped, row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem)
WHERE rn = 1""")
def dedup_lineitem(spark, sf):
    items = tables.scan_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", F.col("l_shipdate").cast("date").alias("shipped"))
    order = F.struct("shipped", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return q.dedup_first(items.withColumn("seq", order), ("l_orderkey", "l_linenumber"),
                         "seq").drop("seq")


@query("dedup_full_row", """
SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS shipped, l_returnflag
FROM lineitem""")
def dedup_full_row(spark, sf):
    return q.dedup_full_row(tables.scan_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("shipped"),
        "l_returnflag"))


@query("negative_filter", raw_sql(
    f"SELECT * EXCLUDE (qty), {rnd('qty', 4)} AS qty FROM nonneg", "nonneg"))
def negative_filter(spark, sf):
    return i.rounded(i.nonneg(spark, sf))


@query("negative_rows", raw_sql(f"""
SELECT date, vehicle, ingest_seq, {rnd('qty', 4)} AS qty FROM deduped WHERE qty < 0""", "deduped"))
def negative_rows(spark, sf):
    return i.rounded(q.negative_rows(q.dedup_first(i.resolved(spark, sf))).select(
        "date", "vehicle", "ingest_seq", "qty"))


def _describe(v, table):
    return f"""SELECT CAST(count({v}) AS BIGINT) AS count, {rnd(f'avg({v})', 4)} AS mean,
  {rnd(f'stddev_samp({v})', 4)} AS std, {rnd(f'min({v})', 4)} AS min,
  {rnd(f'quantile_cont({v}, 0.25)', 4)} AS q25, {rnd(f'quantile_cont({v}, 0.5)', 4)} AS median,
  {rnd(f'quantile_cont({v}, 0.75)', 4)} AS q75, {rnd(f'max({v})', 4)} AS max FROM {table}"""


@query("describe", raw_sql(_describe("qty", "nonneg"), "nonneg"))
def describe(spark, sf):
    return i.rounded(q.describe(i.clean_table(spark, sf, "qty")))


@query("describe_by_vehicle", raw_sql(_describe("qty", "nonneg").replace(
    "SELECT ", "SELECT vehicle, ", 1) + " WHERE vehicle IS NOT NULL GROUP BY vehicle", "nonneg"))
def describe_by_vehicle(spark, sf):
    return i.rounded(q.describe_by(i.clean_table(spark, sf, "vehicle", "qty"), ["vehicle"]))


@query("describe_prices", _describe("l_extendedprice", "lineitem"))
def describe_prices(spark, sf):
    return i.rounded(q.describe(tables.scan_table(spark, sf, "lineitem"), "l_extendedprice"))


@query("skew_flags", raw_sql("""
SELECT min(qty) < 0 AS has_negative, avg(qty) > median(qty) AS right_skewed,
  stddev_samp(qty) > avg(qty) AS high_spread, max(qty) > 3 * avg(qty) AS extreme_max
FROM nonneg""", "nonneg"))
def skew_flags(spark, sf):
    return q.skew_flags(i.clean_table(spark, sf, "qty"))


@query("key_inventory", raw_sql("""
SELECT item, contains(item, 'URGENT') OR contains(item, 'LOW') AS suspect,
  CAST(count(*) OVER () AS BIGINT) AS distinct_items, count(*) OVER () > 15 AS too_many
FROM (SELECT DISTINCT vehicle AS item FROM nonneg WHERE vehicle IS NOT NULL)""", "nonneg"))
def key_inventory(spark, sf):
    return q.key_inventory(i.nonneg(spark, sf), patterns=("URGENT", "LOW"))


ABSENT = """absent AS (
  SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(
    CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM {t})
  WHERE CAST(d AS DATE) NOT IN (SELECT date FROM {t})),
islands AS (
  SELECT min(date) AS gap_start, max(date) AS gap_end, CAST(count(*) AS BIGINT) AS gap_days
  FROM (SELECT date, date - CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS grp FROM absent)
  GROUP BY grp)
"""


def gap_sql(body):
    return raw_sql("", "domain").rstrip() + ",\n" + ABSENT.format(t="domain") + body


@query("calendar_missing", gap_sql(f"""
SELECT min(date) AS first_date, max(date) AS last_date,
  CAST(count(DISTINCT date) AS BIGINT) AS observed_days,
  CAST((SELECT count(*) FROM absent) AS BIGINT) AS missing_days,
  {rnd('100.0 * (SELECT count(*) FROM absent) / (max(date) - min(date) + 1)', 4)} AS missing_pct
FROM domain"""))
def calendar_missing(spark, sf):
    return q.calendar_missing(i.domain(spark, sf))


@query("missing_days", gap_sql("SELECT date FROM absent"))
def missing_days(spark, sf):
    return q.missing_days(i.domain(spark, sf))


@query("gap_islands", gap_sql(
    "SELECT gap_start, gap_end, gap_days, gap_days <= 3 AS short_gap FROM islands"))
def gap_islands(spark, sf):
    return q.gap_islands(i.domain(spark, sf))


@query("longest_gap", gap_sql(
    "SELECT CAST(coalesce(max(gap_days), 0) AS BIGINT) AS longest_gap FROM islands"))
def longest_gap(spark, sf):
    return q.longest_gap(i.domain(spark, sf))


GAPS = f"""SELECT vehicle,
  CAST(max(date) - min(date) + 1 - count(DISTINCT date) AS BIGINT) AS missing_days,
  CAST(max(date) - min(date) + 1 AS BIGINT) AS total_days,
  {rnd('100.0 * (max(date) - min(date) + 1 - count(DISTINCT date)) / (max(date) - min(date) + 1)', 1)}
    AS missing_pct
FROM nonneg GROUP BY vehicle"""


@query("series_gaps", raw_sql(GAPS, "nonneg"))
def series_gaps(spark, sf):
    return q.series_gaps(i.nonneg(spark, sf))


@query("series_gap_counts", raw_sql(f"""
SELECT CAST(count(*) AS BIGINT) AS series,
  CAST(count(*) FILTER (missing_days > 0) AS BIGINT) AS series_with_gaps FROM ({GAPS})""", "nonneg"))
def series_gap_counts(spark, sf):
    return q.gap_counts(q.series_gaps(i.nonneg(spark, sf)))


@query("quantile_thresholds", raw_sql(f"""
SELECT {rnd('quantile_cont(qty, 0.95)', 4)} AS p95, {rnd('quantile_cont(qty, 0.99)', 4)} AS p99,
  {rnd('max(qty)', 4)} AS max FROM nonneg""", "nonneg"))
def quantile_thresholds(spark, sf):
    return i.rounded(q.quantile_thresholds(i.clean_table(spark, sf, "qty")))


@query("outlier_flag", raw_sql(f"""
SELECT date, vehicle, ingest_seq, {rnd('qty', 4)} AS qty, is_outlier FROM flagged""", "flagged"))
def outlier_flag(spark, sf):
    return i.rounded(i.flagged(spark, sf).select(
        "date", "vehicle", "ingest_seq", "qty", "is_outlier"))


@query("outlier_report", raw_sql(f"""
SELECT rows, outliers, {rnd('100.0 * outliers / rows', 4)} AS outlier_pct,
  CASE WHEN 100.0 * outliers / rows < 1 THEN 'low' WHEN 100.0 * outliers / rows < 5 THEN 'medium'
       ELSE 'high' END AS severity
FROM (SELECT CAST(count(*) AS BIGINT) AS rows,
        CAST(count(*) FILTER (is_outlier) AS BIGINT) AS outliers FROM flagged)""", "flagged"))
def outlier_report(spark, sf):
    return q.outlier_report(i.flagged(spark, sf))


@query("outlier_top", raw_sql(f"""
SELECT date, vehicle, {rnd('qty', 4)} AS qty, ingest_seq FROM flagged WHERE is_outlier
ORDER BY flagged.qty DESC, ingest_seq LIMIT 10""", "flagged"))
def outlier_top(spark, sf):
    return i.rounded(q.outlier_top(i.flagged(spark, sf)))


@query("outlier_by_vehicle", raw_sql("""
SELECT vehicle AS item, CAST(count(*) AS BIGINT) AS rows FROM flagged WHERE is_outlier
GROUP BY ALL ORDER BY rows DESC, item LIMIT 5""", "flagged"))
def outlier_by_vehicle(spark, sf):
    return q.outlier_by_key(i.flagged(spark, sf))


STATS = f"""SELECT vehicle, days, mean, max, std, median, p95, {rnd('std / mean', 2)} AS cv,
  {rnd('max / p95', 2)} AS spike_ratio
FROM (SELECT vehicle, CAST(count(qty) AS BIGINT) AS days, {rnd('round(avg(qty), 4)', 0)} AS mean,
  {rnd('round(median(qty), 4)', 0)} AS median, {rnd('round(quantile_cont(qty, 0.95), 4)', 0)} AS p95,
  {rnd('round(max(qty), 4)', 0)} AS max, {rnd('round(stddev_samp(qty), 4)', 0)} AS std
  FROM nonneg GROUP BY vehicle)"""


@query("group_stats", raw_sql(STATS, "nonneg"))
def group_stats(spark, sf):
    return q.group_stats(i.clean_table(spark, sf, "vehicle", "qty"))


@query("group_stats_by_part", f"""
SELECT part, days, mean, max, std, median, p95, {rnd('std / nullif(mean, 0)', 2)} AS cv,
  {rnd('max / nullif(p95, 0)', 2)} AS spike_ratio
FROM (SELECT l_partkey AS part, CAST(count(*) AS BIGINT) AS days,
  {rnd('round(avg(l_extendedprice), 4)', 0)} AS mean,
  {rnd('round(median(l_extendedprice), 4)', 0)} AS median,
  {rnd('round(quantile_cont(l_extendedprice, 0.95), 4)', 0)} AS p95,
  {rnd('round(max(l_extendedprice), 4)', 0)} AS max,
  {rnd('round(stddev_samp(l_extendedprice), 4)', 0)} AS std FROM lineitem GROUP BY ALL)""")
def group_stats_by_part(spark, sf):
    items = tables.scan_table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("qty"))
    return q.group_stats(items, "part")


@query("group_stats_top_cv", raw_sql(
    f"SELECT * FROM ({STATS}) ORDER BY cv DESC, vehicle LIMIT 3", "nonneg"))
def group_stats_top_cv(spark, sf):
    return q.rank_stats(q.group_stats(i.clean_table(spark, sf, "vehicle", "qty")), "cv", 3)


@query("group_stats_top_spike", raw_sql(
    f"SELECT * FROM ({STATS}) ORDER BY spike_ratio DESC, vehicle LIMIT 3", "nonneg"))
def group_stats_top_spike(spark, sf):
    return q.rank_stats(q.group_stats(i.clean_table(spark, sf, "vehicle", "qty")), "spike_ratio", 3)


@query("risk_counts", raw_sql(f"""
SELECT CAST(count(*) FILTER (cv > 0.5) AS BIGINT) AS high_cv,
  CAST(count(*) FILTER (spike_ratio > 1.05) AS BIGINT) AS high_spike FROM ({STATS})""", "nonneg"))
def risk_counts(spark, sf):
    return q.risk_counts(q.group_stats(i.clean_table(spark, sf, "vehicle", "qty")), 0.5, 1.05)


@query("domain_filter", raw_sql(f"""
SELECT * EXCLUDE (qty, is_outlier), {rnd('qty', 4)} AS qty FROM domain""", "domain"))
def domain_filter(spark, sf):
    return i.rounded(i.domain(spark, sf))


@query("domain_coverage", raw_sql(f"""
SELECT rows, domain_rows, {rnd('100.0 * domain_rows / rows', 2)} AS coverage_pct,
  CASE WHEN domain_rows = 0 THEN 'empty' WHEN 100.0 * domain_rows / rows < 10
       THEN 'unusually_low' ELSE 'ok' END AS verdict
FROM (SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (
  mode = 'rail' AND ownership = 'public') AS BIGINT) AS domain_rows FROM nonneg)""", "nonneg"))
def domain_coverage(spark, sf):
    return q.domain_coverage(i.nonneg(spark, sf), i.MODE, i.OWNER)


@query("date_coverage", raw_sql(f"""
SELECT first_date, last_date, unique_days, expected_days,
  expected_days - unique_days AS missing_days,
  {rnd('100.0 * unique_days / expected_days', 2)} AS coverage_pct,
  CASE WHEN unique_days = expected_days THEN 'complete'
       WHEN 100.0 * unique_days / expected_days > 95 THEN 'nearly_complete' ELSE 'gaps' END AS verdict
FROM (SELECT min(date) AS first_date, max(date) AS last_date,
  CAST(count(DISTINCT date) AS BIGINT) AS unique_days,
  CAST(max(date) - min(date) + 1 AS BIGINT) AS expected_days FROM domain)""", "domain"))
def date_coverage(spark, sf):
    return q.date_coverage(i.domain(spark, sf))
