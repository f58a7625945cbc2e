"""Consolidating pairwise matches into groups by hash-to-min.

Each vertex v holds a cluster C(v), at first its neighbours and itself. In a round every
vertex sends C(v) to the smallest member m and m to every member; the new C(v) is the union
of what v receives. When nothing changes, the smallest vertex of a component holds all of it
and every other vertex holds that smallest one (Rastogi et al., "Finding connected components
in MapReduce in logarithmic rounds").

A cluster is never one value: C is kept as rows (v, u), so a group of any size, or a vertex
with a third of all pairs, is spread over tasks. The minimum is a partial aggregation that is
written as a table before it is joined back: only a join of two plain shuffles, without an
aggregate between shuffle and sort, is split by AQE where one vertex holds most rows. The union
is deduplicated on the whole row (v, u).

Defined results: pairs with a null, or of a vertex with itself, link nothing; either order and
repeated pairs count once; an empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.runtime import cut, release


def hash_to_min(pairs: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(vertex, group): the smallest vertex reachable over ``pairs``, for each linked vertex."""
    edges = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = cut(edges)
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")), F.struct(F.col("a").alias("v"), F.col("a").alias("u")), F.struct(F.col("b").alias("v"), F.col("b").alias("u")))).alias("x"))
    cluster = cut(both.select("x.v", "x.u").distinct())
    seen = None
    for _ in range(max_rounds):
        least = cut(cluster.groupBy("v").agg(F.min("u").alias("m")))
        sent = with_least(cluster, least)
        received = sent.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x"))
        before, cluster = cluster, cut(received.select("x.v", "x.u").distinct())
        now = cluster.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        release(before)
        if now == seen:
            # nothing changed: the minima of the round before are those of the end
            ends = edges.join(least.select(F.col("v").alias("a"), F.col("m").alias("ga")), "a").join(least.select(F.col("v").alias("b"), F.col("m").alias("gb")), "b")
            if ends.where("ga <> gb").isEmpty():
                release(cluster)
                release(edges)
                return least.select(F.col("v").alias("vertex"), F.col("m").alias("group"))
        release(least)
        seen = now
    raise RuntimeError(f"hash-to-min did not settle in {max_rounds} rounds")


def with_least(cluster: DataFrame, least: DataFrame) -> DataFrame:
    """The rows of the clusters with the smallest member of each; ``least`` must be a plain table (see above)."""
    return cluster.join(least, "v")
