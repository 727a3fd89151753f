"""Inputs of the registered queries: the given tables brought into the shape of the
library's raw and daily tables, in Spark and in SQL.

The raw table is text as a publisher would deliver it, derived from every row of
``orders``.  Some cells are damaged by a rule on the order number (blank rows, wrong unit,
impossible or ISO dates, unreadable or negative numbers), so each cleaning step has work.
No row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import dimensions
from tallyloom.operators import quality, reshape
from tallyloom.session import staged
from tallyloom.sources.tables import scan_table

UNIT, MODE, OWNER = "persons", "rail", "public"
YEARS = (1995, 2000)

LINES = {"1-URGENT": "Red", "2-HIGH": "Blue", "3-MEDIUM": "Green", "4-NOT SPECIFIED": "Pink"}
MODES = {"metro": ["1-URGENT", "2-HIGH"], "tram": ["3-MEDIUM"],
         "bus": ["4-NOT SPECIFIED", "5-LOW"]}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Round every double column, so that summation order does not show."""
    return df.select(*[
        F.round(F.col(c), special.get(c, digits)).alias(c) if t == "double" else F.col(c)
        for c, t in df.dtypes])


# ---------------------------------------------------------------- raw and clean rows


def raw(spark: SparkSession, sf: str) -> DataFrame:
    o = scan_table(spark, sf, "orders")
    n = F.col("o_orderkey")
    price = F.format_number("o_totalprice", 2)
    blank = n % 211 == 0

    def text(column):
        return F.when(~blank, column)

    return o.select(
        text(F.when(F.col("o_orderstatus") == "O", "rail")
             .when(F.col("o_orderstatus") == "F", "road").otherwise("water")).alias("mode"),
        text(F.when(F.col("o_custkey") % 2 == 0, "inter").otherwise("intra")).alias("purpose"),
        text(F.when(n % 4 == 3, "private").otherwise("public")).alias("ownership"),
        text(F.concat(F.lit("agency-"), (F.col("o_custkey") % 7).cast("string"))).alias("agency"),
        text(F.col("o_orderpriority")).alias("vehicle"),
        text(F.when(n % 97 == 5, "31/02/1999")
             .when(n % 101 == 6, F.date_format("o_orderdate", "yyyy-MM-dd"))
             .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))).alias("date_raw"),
        text(F.when(n % 50 == 7, "vehicles").otherwise("persons")).alias("unit"),
        text(F.when(n % 89 == 3, "n/a").when(n % 83 == 4, "").when(n % 79 == 2, "nan")
             .when(n % 73 == 1, F.concat(F.lit("-"), price))
             .otherwise(F.concat(F.lit(" "), price, F.lit(" ")))).alias("qty_raw"),
        n.alias("ingest_seq"))


RAW = {
    "raw": """
  SELECT CASE WHEN NOT b THEN CASE o_orderstatus WHEN 'O' THEN 'rail' WHEN 'F' THEN 'road'
              ELSE 'water' END END AS mode,
         CASE WHEN NOT b THEN CASE WHEN o_custkey % 2 = 0 THEN 'inter' ELSE 'intra' END END AS purpose,
         CASE WHEN NOT b THEN CASE WHEN n % 4 = 3 THEN 'private' ELSE 'public' END END AS ownership,
         CASE WHEN NOT b THEN 'agency-' || CAST(o_custkey % 7 AS VARCHAR) END AS agency,
         CASE WHEN NOT b THEN o_orderpriority END AS vehicle,
         CASE WHEN NOT b THEN CASE WHEN n % 97 = 5 THEN '31/02/1999'
              WHEN n % 101 = 6 THEN strftime(o_orderdate, '%Y-%m-%d')
              ELSE strftime(o_orderdate, '%d/%m/%Y') END END AS date_raw,
         CASE WHEN NOT b THEN CASE WHEN n % 50 = 7 THEN 'vehicles' ELSE 'persons' END END AS unit,
         CASE WHEN NOT b THEN CASE WHEN n % 89 = 3 THEN 'n/a' WHEN n % 83 = 4 THEN ''
              WHEN n % 79 = 2 THEN 'nan'
              WHEN n % 73 = 1 THEN '-' || format('{:,.2f}', o_totalprice)
              ELSE ' ' || format('{:,.2f}', o_totalprice) || ' ' END END AS qty_raw,
         n AS ingest_seq
  FROM (SELECT *, o_orderkey AS n, o_orderkey % 211 = 0 AS b FROM orders)""",
    "filled_rows": """
  SELECT * FROM raw WHERE mode IS NOT NULL OR purpose IS NOT NULL OR ownership IS NOT NULL
     OR agency IS NOT NULL OR vehicle IS NOT NULL OR date_raw IS NOT NULL
     OR unit IS NOT NULL OR qty_raw IS NOT NULL""",
    "one_unit": "SELECT * FROM filled_rows WHERE unit = 'persons'",
    "with_date": """
  SELECT *, CAST(try_strptime(date_raw, '%d/%m/%Y') AS DATE) AS date FROM one_unit""",
    "dated": "SELECT * FROM with_date WHERE date IS NOT NULL",
    "in_years": "SELECT * FROM dated WHERE year(date) BETWEEN 1995 AND 2000",
    "numbered": """
  SELECT * EXCLUDE (q), CASE WHEN isnan(q) THEN NULL ELSE q END AS qty
  FROM (SELECT *, try_cast(trim(replace(qty_raw, ',', '')) AS DOUBLE) AS q FROM in_years)""",
    "placed": """
  SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY date, ingest_seq) AS pos
  FROM numbered""",
    "bracketed": """
  SELECT *,
    last_value(CASE WHEN qty IS NOT NULL THEN pos END IGNORE NULLS) OVER u AS p0,
    last_value(qty IGNORE NULLS) OVER u AS v0,
    first_value(CASE WHEN qty IS NOT NULL THEN pos END IGNORE NULLS) OVER d AS p1,
    first_value(qty IGNORE NULLS) OVER d AS v1
  FROM placed
  WINDOW u AS (PARTITION BY vehicle ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         d AS (PARTITION BY vehicle ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "interpolated": """
  SELECT * EXCLUDE (pos, p0, v0, p1, v1, qty),
    CASE WHEN qty IS NOT NULL THEN qty
         WHEN pos - p0 <= 3 AND v1 IS NOT NULL THEN v0 + (v1 - v0) * (pos - p0) / (p1 - p0)
         WHEN pos - p0 <= 3 THEN v0 END AS qty
  FROM bracketed""",
    "resolved": "SELECT * FROM interpolated WHERE qty IS NOT NULL",
    "occurrences": """
  SELECT *, row_number() OVER (PARTITION BY date, vehicle ORDER BY ingest_seq) AS occurrence
  FROM resolved""",
    "deduped": "SELECT * EXCLUDE (occurrence) FROM occurrences WHERE occurrence = 1",
    "nonneg": "SELECT * FROM deduped WHERE qty >= 0",
    "flagged": """
  SELECT *, qty > (SELECT quantile_cont(qty, 0.99) FROM nonneg) AS is_outlier FROM nonneg""",
    "domain": "SELECT * FROM flagged WHERE mode = 'rail' AND ownership = 'public'",
    "line_map": """
  SELECT * FROM (VALUES ('1-URGENT', 'Red'), ('2-HIGH', 'Blue'), ('3-MEDIUM', 'Green'),
    ('4-NOT SPECIFIED', 'Pink')) AS t(vehicle, line)""",
    "mapped": "SELECT d.*, m.line FROM domain d JOIN line_map m USING (vehicle)",
}


def one_unit(spark, sf):
    return quality.unit_filter(quality.drop_empty_rows(raw(spark, sf)), UNIT)


def dated(spark, sf):
    return quality.parse_dates(one_unit(spark, sf))


def in_years(spark, sf):
    return quality.year_range_filter(dated(spark, sf), *YEARS)


def numbered(spark, sf):
    return quality.clean_numeric(in_years(spark, sf))


def interpolated(spark, sf):
    return quality.interpolate_rows(numbered(spark, sf))


def resolved(spark, sf):
    return quality.drop_unresolved(interpolated(spark, sf))


def nonneg(spark, sf):
    return quality.negative_filter(quality.dedup_first(resolved(spark, sf)))


def clean_table(spark, sf, *columns):
    """The wanted columns of the clean rows as a written table, for reports that pass over
    them repeatedly."""
    rows = nonneg(spark, sf)
    return staged(rows.select(*columns) if columns else rows)


def loose(spark, sf):
    """Orders by day and priority, of which every seventh has lost the priority."""
    o = scan_table(spark, sf, "orders")
    return o.select(F.col("o_orderdate").cast("date").alias("date"),
                    F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("vehicle"),
                    F.col("o_orderkey").alias("ingest_seq"), F.col("o_totalprice").alias("qty"))


LOOSE = {
    "loose": """
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS ingest_seq, o_totalprice AS qty,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS vehicle FROM orders""",
    "loose_numbered": """
  SELECT *, row_number() OVER (PARTITION BY date, vehicle ORDER BY ingest_seq) AS occurrence,
    count(*) OVER (PARTITION BY date, vehicle) AS copies FROM loose""",
}


def flagged(spark, sf):
    return quality.flag_outliers(clean_table(spark, sf))


def domain(spark, sf):
    return quality.domain_filter(nonneg(spark, sf), MODE, OWNER)


def line_dim(spark):
    return dimensions.line_map(spark, LINES)


# ---------------------------------------------------------------- daily series


def order_cells(spark, sf):
    """Sparse daily sums of order prices by priority (five lines with real gaps)."""
    o = scan_table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("line"), F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_totalprice").alias("qty"))
    # whole numbers, so that neither the order of summation nor halves show in the checks;
    # the inner rounding removes the noise below a cent
    return reshape.daily_cells(o).withColumn("value", F.round(F.round("value", 2)))


def daily(spark, sf):
    return reshape.fill_daily(order_cells(spark, sf))


def total(spark, sf):
    return reshape.network_total(daily(spark, sf))


def ship_cells(spark, sf):
    """Daily shipped quantity by return flag and line status (six nearly dense lines)."""
    rows = scan_table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("line"),
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").alias("qty"))
    return reshape.daily_cells(rows)


def ship_daily(spark, sf):
    return reshape.fill_daily(ship_cells(spark, sf))


def ship_total(spark, sf):
    return reshape.network_total(ship_daily(spark, sf))


def event_total(spark, sf):
    """Thirty days of event counts: half of them have no rolling baseline."""
    rows = scan_table(spark, sf, "events").select(
        F.col("event_type").alias("line"), F.col("ts").cast("date").alias("date"),
        F.lit(1.0).alias("qty"))
    return reshape.network_total(reshape.fill_daily(reshape.daily_cells(rows)))


def mode_dim(spark):
    return dimensions.mode_map(spark, MODES)


def _filled(prefix: str, cells: str) -> dict[str, str]:
    """CTEs from sparse cells to the dense filled table and its total."""
    p = prefix
    return {
        f"{p}cells": cells,
        f"{p}ends": f"SELECT min(date) AS lo, max(date) AS hi FROM {p}cells",
        f"{p}grid": f"""
  SELECT l.line, CAST(g.d AS DATE) AS date
  FROM (SELECT DISTINCT line FROM {p}cells) l,
       (SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
                      INTERVAL 1 DAY)) AS d FROM {p}ends) g""",
        f"{p}dense": f"""
  SELECT g.date, g.line, c.value FROM {p}grid g LEFT JOIN {p}cells c USING (line, date)""",
        f"{p}known": f"""
  SELECT *,
    last_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER u AS d0,
    last_value(value IGNORE NULLS) OVER u AS v0,
    first_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER f AS d1,
    first_value(value IGNORE NULLS) OVER f AS v1
  FROM {p}dense
  WINDOW u AS (PARTITION BY line ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY line ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
        f"{p}timed": f"""
  SELECT date, line, CASE WHEN value IS NOT NULL THEN value
      WHEN date - d0 <= 3 AND v1 IS NOT NULL THEN v0 + (v1 - v0) * (date - d0) / (d1 - d0) END AS value
  FROM {p}known""",
        f"{p}daily": f"SELECT date, line, coalesce(value, 0.0) AS value FROM {p}timed",
        f"{p}total": f"""
  SELECT date, 'TOTAL' AS line, round(round(sum(value), 4)) + 0.0 AS value
  FROM {p}daily GROUP BY date""",
    }


MODE_MAP = """
  SELECT * FROM (VALUES ('1-URGENT', 'metro'), ('2-HIGH', 'metro'), ('3-MEDIUM', 'tram'),
    ('4-NOT SPECIFIED', 'bus'), ('5-LOW', 'bus')) AS t(line, mode)"""

DAILY = {
    **_filled("", """
  SELECT o_orderpriority AS line, CAST(o_orderdate AS DATE) AS date,
         round(round(sum(o_totalprice), 2)) AS value FROM orders GROUP BY ALL"""),
    "mode_map": MODE_MAP,
    "modal": "SELECT d.*, m.mode FROM daily d JOIN mode_map m USING (line)",
}

SHIP = _filled("s_", """
  SELECT l_returnflag || '-' || l_linestatus AS line, CAST(l_shipdate AS DATE) AS date,
         sum(l_quantity) AS value FROM lineitem GROUP BY ALL""")

EVENT = _filled("e_", """
  SELECT event_type AS line, CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS value
  FROM events GROUP BY ALL""")
