import random

from pyspark.sql import functions as F

from foliomill.llm.groups import hash_to_min, with_least
from foliomill.runtime import cut


def brute(pairs):
    group = {}
    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        group.setdefault(a, {a})
        group.setdefault(b, {b})
        if group[a] is not group[b]:
            both = group[a] | group[b]
            for x in both:
                group[x] = both
    return {x: min(g) for x, g in group.items()}


def solve(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long").selectExpr("*", "1 as v", "2 as u", "3 as m")
    return {r.vertex: r.group for r in hash_to_min(df, "a", "b").collect()}


def test_random_pairs(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(None, 1), (2, None), (None, None), (7, 7), (500, 500)]
    assert solve(spark, pairs) == brute(pairs)


def test_chain_star_and_repeats(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    pairs = chain + star + star + [(b, a) for a, b in chain[::3]]
    assert solve(spark, pairs) == brute(pairs)


def test_empty(spark):
    assert solve(spark, []) == {}


def test_join_on_a_hot_vertex_is_split(spark):
    limits = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    rows = spark.range(0, 60_000, 1, 4).selectExpr("if(id % 6 = 0, id, 0) as v", "id as u")
    for key, value in limits.items():
        spark.conf.set(key, value)
    try:
        cluster = cut(rows)
        joined = with_least(cluster, cut(cluster.groupBy("v").agg(F.min("u").alias("m"))))
        assert len(joined.collect()) == 60_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        star = spark.range(1, 20_001).selectExpr("0 as a", "id as b").union(spark.range(30_000, 32_000).selectExpr("id - id % 4 as a", "id as b"))
        groups = hash_to_min(star, "a", "b").groupBy("group").count().orderBy("group").collect()
        assert groups[0]["count"] == 20_001 and {r["count"] for r in groups[1:]} == {4}
    finally:
        for key in limits:
            spark.conf.unset(key)
