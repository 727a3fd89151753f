"""The network of series that move together.

Nodes are lines, edges are pairs with a strong correlation, so the graph is simple and a
node has at most as many edges as there are other lines.  Iterations cut their lineage
with a reliable checkpoint; the driver sees one number per round, to know when to stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import zero_to_null
from ..session import cut_lineage
from .correlate import corr_matrix
from .similar import corr_search

THRESHOLD = 0.6
SALTS = 64                  # tasks that the lines of one component spread over


def corr_edges(daily: DataFrame, threshold: float = THRESHOLD, log: bool = False,
               pairs: DataFrame | None = None, search: bool = False) -> DataFrame:
    """Pairs with an absolute correlation above the threshold; no other pair leaves the
    workers.  ``pairs`` restricts the search to candidates.

    With ``search``, sketches propose the pairs instead of all being computed, for more
    lines than have a matrix; see :func:`~.similar.candidate_pairs` for what may be missed.
    """
    if search:
        return corr_search(daily, threshold, log).select("a", "b", "r")
    return corr_matrix(daily, log=log, pairs=pairs, least=threshold).select("a", "b", "r")


def graph_nodes(daily: DataFrame) -> DataFrame:
    """All lines with their mean without zero days."""
    return daily.groupBy("line").agg(F.avg(zero_to_null(F.col("value"))).alias("avg_demand"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    return neighbours(edges).groupBy(F.col("src").alias("line")).agg(
        F.count("*").alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles per node.

    Edges point from the lower to the higher degree, which bounds the out-neighbours of
    any node by the square root of twice the edges; each edge intersects two such lists,
    so no pairs of neighbours are enumerated.
    """
    d = degrees(edges)
    ranked = (edges.join(d.select(F.col("line").alias("a"), F.col("degree").alias("_da")), "a")
              .join(d.select(F.col("line").alias("b"), F.col("degree").alias("_db")), "b"))
    forward = F.struct("_da", "a") < F.struct("_db", "b")
    directed = ranked.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("u"),
                             F.when(forward, F.col("b")).otherwise(F.col("a")).alias("v"))
    lists = directed.groupBy("u").agg(F.collect_list("v").alias("out"))
    common = (directed.join(lists, "u")
              .join(lists.select(F.col("u").alias("v"), F.col("out").alias("_out_v")), "v")
              .select("u", "v", F.explode(F.array_intersect("out", "_out_v")).alias("w")))
    return (common.select(F.explode(F.array("u", "v", "w")).alias("line"))
            .groupBy("line").agg(F.count("*").alias("triangles")))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of neighbour pairs that are linked; 0 with fewer than two neighbours."""
    d = F.coalesce("degree", F.lit(0))
    share = F.try_divide(F.coalesce("triangles", F.lit(0)) * 2.0, d * (d - 1))
    return (nodes.select("line").join(degrees(edges), "line", "left")
            .join(triangles(edges), "line", "left")
            .select("line", d.cast("bigint").alias("degree"),
                    F.coalesce(share, F.lit(0.0)).alias("clustering")))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, density and mean clustering in one row."""
    n, m = F.col("nodes"), F.col("edges")
    return clustering(nodes, edges).agg(
        F.count("*").alias("nodes"), F.floor(F.sum("degree") / 2).alias("edges"),
        F.avg("clustering").alias("avg_clustering")).withColumn(
        "density", F.coalesce(F.try_divide(m * 2.0, n * (n - 1)), F.lit(0.0)))


def graph_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components, named by their smallest line.

    Every round takes the smallest label among the neighbours and then the label of that
    label, so long chains shrink by halves.
    """
    links = cut_lineage(neighbours(edges))
    labels = cut_lineage(nodes.select("line", F.col("line").alias("component")))
    while True:
        near = (links.join(labels.select(F.col("line").alias("dst"), "component"), "dst")
                .groupBy(F.col("src").alias("line")).agg(F.min("component").alias("_near")))
        hop = labels.join(near, "line", "left").select(
            "line", "component", F.least("component", "_near").alias("_new"))
        # many lines carry one label: look up each label once, and let the join on it deal
        # a frequent one out over several tasks
        hop = cut_lineage(hop.withColumn("_salt", F.pmod(F.xxhash64("line"), F.lit(SALTS))))
        used = hop.select("_new", "_salt").distinct()
        jump = used.join(hop.select(F.col("line").alias("_new"), F.col("_new").alias("_root")),
                         "_new")
        step = cut_lineage(hop.join(jump, ["_new", "_salt"]).select(
            "line", "component", F.least("_new", "_root").alias("_new")))
        moved = step.where(F.col("_new") != F.col("component")).count()
        labels = step.select("line", F.col("_new").alias("component"))
        if moved == 0:
            return labels


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("lines")).orderBy("component")


def _levels(nodes: DataFrame, links: DataFrame) -> list[DataFrame]:
    """Breadth-first levels from every node at once: ``(s, t, sigma)`` per distance,
    ``sigma`` being the number of shortest paths."""
    level = cut_lineage(nodes.select(F.col("line").alias("s"), F.col("line").alias("t"),
                                     F.lit(1.0).alias("sigma")))
    levels = []
    seen = level.select("s", "t")
    while not level.isEmpty():
        levels.append(level)
        level = cut_lineage(
            level.join(links, level["t"] == links["src"])
            .groupBy("s", F.col("dst").alias("t")).agg(F.sum("sigma").alias("sigma"))
            .join(seen, ["s", "t"], "left_anti"))
        # a step leads back to the previous level, stays, or goes on
        seen = levels[-1].select("s", "t").unionByName(level.select("s", "t"))
    return levels


def graph_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Hop distance of every connected pair, ``a < b``."""
    levels = _levels(nodes, cut_lineage(neighbours(edges)))
    out = None
    for d, level in enumerate(levels):
        part = level.where("s < t").select(F.col("s").alias("a"), F.col("t").alias("b"),
                                           F.lit(d).cast("bigint").alias("hops"))
        out = part if out is None else out.unionByName(part)
    return out


def mean_path_length(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Mean hop distance; null unless every pair is connected."""
    n = nodes.agg(F.count("*")).scalar()
    whole = (F.count("*") == n * (n - 1) / 2) & (n > 1)
    return paths.agg(F.when(whole, F.avg("hops")).alias("mean_path_length"))


def graph_betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Normalised betweenness of every line; the hub is marked.

    Dependencies are summed level by level from the far end of the breadth-first search,
    so the work is one pass over the links per level, not one over all triples of nodes.
    """
    links = cut_lineage(neighbours(edges))
    levels = _levels(nodes, links)
    delta = None          # dependency of s on the nodes of the level below
    total = None
    for d in range(len(levels) - 1, 0, -1):
        far = levels[d]
        far = far.withColumn("delta", F.lit(0.0)) if delta is None else far.join(
            delta, ["s", "t"], "left").na.fill(0.0, ["delta"])
        far = far.select("s", F.col("t").alias("w"),
                         ((1 + F.col("delta")) / F.col("sigma")).alias("_share"))
        near = levels[d - 1].select("s", F.col("t").alias("v"), "sigma")
        delta = cut_lineage(
            far.join(links, far["w"] == links["src"]).withColumnRenamed("dst", "v")
            .join(near, ["s", "v"]).groupBy("s", F.col("v").alias("t"))
            .agg(F.sum(F.col("sigma") * F.col("_share")).alias("delta")))
        part = delta.where("s <> t").select(F.col("t").alias("line"), "delta")
        total = part if total is None else total.unionByName(part)
    n = nodes.agg(F.count("*")).scalar()
    scale = F.when(n > 2, 1.0 / ((n - 1) * (n - 2)).cast("double")).otherwise(0.5)
    if total is None:
        scores = nodes.select("line", F.lit(0.0).alias("betweenness"))
    else:
        sums = total.groupBy("line").agg(F.sum("delta").alias("_b"))
        scores = nodes.select("line").join(sums, "line", "left").select(
            "line", (F.coalesce("_b", F.lit(0.0)) * scale).alias("betweenness"))
    # equal scores: the smallest name; rounding keeps noise from deciding
    hub = scores.orderBy(F.desc(F.round("betweenness", 9)), "line").limit(1) \
        .select("line").scalar()
    return scores.withColumn("is_hub", F.col("line") == hub)
