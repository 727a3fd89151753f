"""The network of series that move together: daily quantity shipped per supplier nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import evaluate, graph, insight, reshape
from tallyloom.operators import forecast as f
from tallyloom.session import staged
from tallyloom.sources.tables import scan_table

from . import inputs as i
from .detection import holidays
from .forecasting import TOTAL
from .registry import query, rnd, with_ctes

THRESHOLD = 0.03

NET = {
    **i._filled("n_", """
  SELECT n_name AS line, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY ALL"""),
    "nodes": """
  SELECT line, avg(nullif(value, 0)) AS avg_demand FROM n_daily GROUP BY line""",
    "edges": f"""
  SELECT a, b, r FROM (
    SELECT x.line AS a, y.line AS b, corr(x.value, y.value) AS r FROM n_daily x JOIN n_daily y
      ON x.date = y.date AND x.line < y.line GROUP BY ALL) WHERE abs(r) > {THRESHOLD}""",
    "sym": "SELECT a AS s, b AS t FROM edges UNION ALL SELECT b, a FROM edges",
    "deg": "SELECT n.line, count(s.t) AS d FROM nodes n LEFT JOIN sym s ON s.s = n.line GROUP BY n.line",
    "bfs": """
  SELECT line AS s, line AS t, 0 AS d FROM nodes
  UNION SELECT b.s, e.t, b.d + 1 FROM bfs b JOIN sym e ON b.t = e.s
  WHERE b.d < (SELECT count(*) FROM nodes)""",
    "dist": "SELECT s, t, min(d) AS d FROM bfs GROUP BY s, t",
    "walks": """
  SELECT line AS s, line AS t, 0 AS d FROM nodes
  UNION ALL SELECT w.s, e.t, w.d + 1 FROM walks w JOIN sym e ON w.t = e.s
  JOIN dist x ON x.s = w.s AND x.t = e.t AND x.d = w.d + 1""",
    "sigma": "SELECT s, t, any_value(d) AS d, count(*) AS c FROM walks GROUP BY s, t",
}


def net_sql(body: str, needs: str) -> str:
    return with_ctes(NET, body, needs, recursive=True)


def nation_daily(spark, sf):
    items = scan_table(spark, sf, "lineitem").select(
        "l_suppkey", F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").alias("qty"))
    named = scan_table(spark, sf, "supplier").join(
        scan_table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    # no hint: the planner broadcasts the suppliers while they are small, and splits a hot
    # supplier in the shuffle join it takes otherwise
    rows = items.join(named, F.col("l_suppkey") == F.col("s_suppkey"))
    return reshape.fill_daily(reshape.daily_cells(rows, line="n_name"))


def network(spark, sf):
    """Nodes and edges; the series are written once, as both read them."""
    daily = staged(nation_daily(spark, sf))
    edges = graph.corr_edges(daily, THRESHOLD)
    return graph.graph_nodes(daily), staged(edges)


BETWEEN = """
  SELECT n.line, coalesce(sum(1.0 * sv.c * vt.c / st.c), 0)
        / ((SELECT count(*) - 1 FROM nodes) * (SELECT count(*) - 2 FROM nodes)) AS b
  FROM nodes n LEFT JOIN (sigma sv JOIN sigma vt ON sv.t = vt.s
    JOIN sigma st ON st.s = sv.s AND st.t = vt.t AND st.d = sv.d + vt.d)
    ON sv.t = n.line AND sv.s <> n.line AND vt.t <> n.line AND sv.s <> vt.t
  GROUP BY n.line"""


@query("corr_edges", net_sql(f"SELECT a, b, {rnd('r', 6)} AS r FROM edges", "edges"))
def corr_edges(spark, sf):
    return i.rounded(network(spark, sf)[1], 6)


# each line and two more that move with it and against it
TWINS = """SELECT date, line, value FROM d
  UNION ALL SELECT date, line || '+', 2 * value + day % 7 FROM d
  UNION ALL SELECT date, line || '-', 2 * (day % 5) - value FROM d"""


@query("corr_edges_search", net_sql("", "n_daily").rstrip() + f""",
d AS (SELECT *, date - DATE '1970-01-01' AS day FROM n_daily), t AS ({TWINS})
SELECT x.line AS a, y.line AS b, {rnd('corr(x.value, y.value)', 6)} AS r
FROM t x JOIN t y ON x.date = y.date AND x.line < y.line GROUP BY ALL
HAVING abs(corr(x.value, y.value)) > 0.9""")
def corr_edges_search(spark, sf):
    daily = nation_daily(spark, sf).withColumn("day", F.unix_date("date"))
    twins = staged(spark.sql(TWINS.replace("FROM d", "FROM {d}"), d=daily))
    return i.rounded(graph.corr_edges(twins, 0.9, search=True), 6)


@query("graph_nodes", net_sql(
    f"SELECT line, {rnd('avg_demand', 4)} AS avg_demand FROM nodes", "nodes"))
def graph_nodes(spark, sf):
    return i.rounded(graph.graph_nodes(nation_daily(spark, sf)))


TRI = """SELECT x.s AS line, count(*) / 2 AS tri FROM sym x JOIN sym y ON x.s = y.s AND x.t <> y.t
  JOIN sym z ON z.s = x.t AND z.t = y.t GROUP BY x.s"""


@query("graph_summary", net_sql(f"""
SELECT CAST(count(*) AS BIGINT) AS nodes, CAST(sum(d) // 2 AS BIGINT) AS edges,
  {rnd('avg(CASE WHEN d < 2 THEN 0.0 ELSE 2.0 * coalesce(tri, 0) / (d * (d - 1)) END)', 6)} AS avg_clustering,
  {rnd('CAST(sum(d) AS DOUBLE) / (count(*) * (count(*) - 1))', 6)} AS density
FROM deg LEFT JOIN ({TRI}) USING (line)""", "deg"))
def graph_summary(spark, sf):
    return i.rounded(graph.graph_summary(*network(spark, sf)), 6)


@query("graph_clustering", net_sql(f"""
SELECT line, CAST(d AS BIGINT) AS degree,
  {rnd('CASE WHEN d < 2 THEN 0.0 ELSE 2.0 * coalesce(tri, 0) / (d * (d - 1)) END', 6)} AS clustering
FROM deg LEFT JOIN ({TRI}) USING (line)""", "deg"))
def graph_clustering(spark, sf):
    return i.rounded(graph.clustering(*network(spark, sf)), 6)


@query("graph_components", net_sql(
    "SELECT s AS line, min(t) AS component FROM dist GROUP BY s", "dist"))
def graph_components(spark, sf):
    return graph.graph_components(*network(spark, sf))


@query("graph_component_sizes", net_sql("""
SELECT component, CAST(count(*) AS BIGINT) AS lines
FROM (SELECT s, min(t) AS component FROM dist GROUP BY s) GROUP BY component""", "dist"))
def graph_component_sizes(spark, sf):
    return graph.component_sizes(graph.graph_components(*network(spark, sf)))


@query("graph_paths", net_sql(
    "SELECT s AS a, t AS b, CAST(d AS BIGINT) AS hops FROM dist WHERE s < t", "dist"))
def graph_paths(spark, sf):
    return graph.graph_paths(*network(spark, sf))


@query("graph_mean_path", net_sql(f"""
SELECT CASE WHEN count(*) = (SELECT count(*) * (count(*) - 1) / 2 FROM nodes)
  THEN {rnd('avg(d)', 6)} END AS mean_path_length FROM dist WHERE s < t""", "dist"))
def graph_mean_path(spark, sf):
    nodes, edges = network(spark, sf)
    return i.rounded(graph.mean_path_length(nodes, graph.graph_paths(nodes, edges)), 6)


@query("graph_betweenness", net_sql(f"""
SELECT line, {rnd('b', 6)} AS betweenness,
  row_number() OVER (ORDER BY round(b, 9) DESC, line) = 1 AS is_hub
FROM ({BETWEEN})""", "sigma"))
def graph_betweenness(spark, sf):
    return i.rounded(graph.graph_betweenness(*network(spark, sf)), 6)


JUDGED = {
    **NET, **TOTAL,
    "judged": """
  SELECT y, yhat, lag(y) OVER (ORDER BY ds) AS naive
  FROM (SELECT t.ds, t.y, c.yhat FROM t_test t JOIN t_fc c USING (line, ds) WHERE t.y > 0)""",
}


@query("network_evidence", with_ctes(JUDGED, f"""
SELECT metric, label, {rnd('value', 4)} AS value FROM (
  SELECT 'network_density' AS metric, NULL AS label,
    CAST(sum(d) AS DOUBLE) / (count(*) * (count(*) - 1)) AS value FROM deg
  UNION ALL SELECT 'network_clustering', NULL, avg(CASE WHEN d < 2 THEN 0.0
    ELSE 2.0 * coalesce(tri, 0) / (d * (d - 1)) END) FROM deg LEFT JOIN ({TRI}) USING (line)
  UNION ALL SELECT 'network_mean_path', NULL, CASE WHEN count(*) = (
    SELECT count(*) * (count(*) - 1) / 2 FROM nodes) THEN avg(d) END FROM dist WHERE s < t
  UNION ALL SELECT 'hub_betweenness', line, b FROM (
    SELECT *, row_number() OVER (ORDER BY round(b, 9) DESC, line) AS k FROM ({BETWEEN})) WHERE k = 1
  UNION ALL SELECT 'forecast_mean', 'TOTAL', avg(yhat) FROM t_fc WHERE is_future
  UNION ALL SELECT 'mape_gain_over_naive', 'TOTAL', round(avg(abs(y - naive) / y) * 100, 2)
    - round(avg(abs(y - yhat) / y) * 100, 2) FROM judged)""", "judged", recursive=True))
def network_evidence(spark, sf):
    nodes, edges = network(spark, sf)
    total = reshape.network_total(i.ship_daily(spark, sf))
    split = staged(f.train_test_split(f.forecast_frame(total)))
    forecast = staged(f.forecast_lines(f.train_part(split), holidays(spark)))
    clean = evaluate.positive_only(evaluate.eval_join(f.test_part(split), forecast))
    rows = insight.network_evidence(
        graph.graph_summary(nodes, edges), graph.graph_betweenness(nodes, edges),
        graph.mean_path_length(nodes, graph.graph_paths(nodes, edges)), forecast,
        evaluate.baseline_compare(clean), reshape.TOTAL)
    return i.rounded(rows)
