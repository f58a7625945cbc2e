"""Walks over edge tables by frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.runtime import cut


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of each edge, once; loops and nulls dropped."""
    rows = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    return rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighborhood(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): least number of edges (src, dst) from any seed, up to ``max_depth``.

    Each round joins only the newest frontier and drops nodes seen before; lineage is cut.
    """
    seen = cut(seeds.select("node", F.lit(0).alias("depth")).distinct())
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def degrees(both_ways: DataFrame) -> DataFrame:
    return both_ways.groupBy("src").agg(F.count("*").alias("degree"))


def walk(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(query, node, depth): least number of edges (src, dst) from each query's seeds (query, node), up to ``max_depth``.

    All queries walk at once; a round joins only the newest frontier and drops what its query has seen.
    """
    edges = cut(edges.select("src", "dst").distinct())
    seen = cut(seeds.select("query", "node", F.lit(0).alias("depth")).distinct())
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("query", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, ["query", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def layers(edges: DataFrame) -> DataFrame:
    """(node, layer) of edges (src, dst) that read "src requires dst": 0 for what requires nothing, else one more than the deepest requirement.

    Each round settles the nodes whose requirements are all settled (Kahn); what never gets there is on
    a circle or requires one, and has layer -1. Rounds are as many as the longest chain.
    """
    rest = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    nodes = cut(rest.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    settled = None
    layer = 0
    while True:
        waiting = rest.select(F.col("src").alias("node")).distinct()
        ready = cut(nodes.join(waiting, "node", "left_anti").withColumn("layer", F.lit(layer)))
        if ready.isEmpty():
            last = nodes.withColumn("layer", F.lit(-1))
            return last if settled is None else settled.unionByName(last)
        settled = ready if settled is None else settled.unionByName(ready)
        nodes = cut(nodes.join(ready.select("node"), "node", "left_anti"))
        rest = cut(rest.join(ready.select(F.col("node").alias("dst")), "dst", "left_anti"))
        layer += 1
