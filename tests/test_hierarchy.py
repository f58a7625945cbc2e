import random

import pytest

from foliomill.operators.hierarchy import BLOCK, MERGE_ROWS, descendant_counts, descendants, latest_links, resolve_forest, weighted_forest
from foliomill.plans.hierarchy import QUERIES


def brute(parents):
    out = {}
    for node in parents:
        chain, at = [node], node
        while parents[at] is not None and parents[at] in parents and len(chain) <= len(parents):
            at = parents[at]
            chain.append(at)
        out[node] = (-1, -1, None) if len(chain) > len(parents) else (chain[-1], len(chain) - 1, chain[::-1])
    return out


def links(spark, parents):
    return spark.createDataFrame(list(parents.items()), "node long, parent long")


def solve(spark, parents, block, merge_rows=MERGE_ROWS):
    return {r.node: (r.root, r.depth, r.path) for r in resolve_forest(links(spark, parents), block=block, paths=True, merge_rows=merge_rows).collect()}


@pytest.mark.parametrize(("seed", "block", "merge_rows"), [(1, 1, MERGE_ROWS), (2, 7, MERGE_ROWS), (3, BLOCK, MERGE_ROWS), (4, 1, 0), (5, 1, 40)])
def test_random_graphs_with_circles(spark, seed, block, merge_rows):
    rng = random.Random(seed)
    ids = rng.sample(range(-50, 300), 120)
    parents = {i: rng.choice([None, rng.choice(ids), rng.choice(ids), 10_000]) for i in ids}
    assert solve(spark, parents, block, merge_rows) == brute(parents)


@pytest.mark.parametrize("merge_rows", [MERGE_ROWS, 0])
def test_long_chain_and_long_circle_over_many_blocks(spark, merge_rows):
    chain = {i: i - 1 if i else None for i in range(150)}
    circle = {1000 + i: 1000 + (i * 7 + 7) % 70 if i % 7 == 0 else 1000 + i - 1 for i in range(70)}
    below = {2000: 1003, 2001: 2000}
    parents = chain | circle | below
    assert solve(spark, parents, 4, merge_rows) == brute(parents)


def test_weighted_forest():
    top, offset, circle = weighted_forest([-1, 0, 1, 4, 3, 4, 2], [0, 2, 3, 1, 1, 1, 5])
    assert (top[:3], offset[:3], top[6], offset[6]) == ([0, 0, 0], [0, 2, 5], 0, 10)
    assert circle == [False, False, False, True, True, True, False]


def test_chain_of_a_million_nodes(spark):
    n = 1_000_000
    chain = spark.range(n).selectExpr("id as node", "if(id < 999999, id + 1, null) as parent")
    got = resolve_forest(chain).selectExpr("count(*)", "count_if(root <> 999999)", "count_if(depth <> 999999 - node)").first()
    assert tuple(got) == (n, 0, 0)


def test_self_parent_missing_parent_and_null_node(spark):
    rows = [(1, 1, 5), (2, 99, 5), (3, 1, 5), (None, 1, 5), (4, None, None), (5, 2, 1), (5, 4, 2), (5, 4, 2), (5, 2, None)]
    df = spark.createDataFrame(rows, "n long, p long, v int").selectExpr("*", "'x' as node", "'y' as parent")
    got = {r.node: (r.root, r.depth) for r in resolve_forest(latest_links(df, "n", "p", "v")).collect()}
    assert got == {1: (-1, -1), 2: (2, 0), 3: (-1, -1), 4: (4, 0), 5: (4, 1)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "node long, parent long")
    assert resolve_forest(empty).count() == 0
    assert descendant_counts(empty, resolve_forest(empty)).count() == 0


def test_descendants(spark):
    rows = links(spark, {1: None, 2: 1, 3: 2, 4: 4})
    resolved = resolve_forest(rows, paths=True)
    assert sorted(map(tuple, descendants(resolved).collect())) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]
    assert sorted(map(tuple, descendant_counts(rows, resolved).collect())) == [(1, 2), (2, 1), (3, 0), (4, 0)]


def test_descendants_of_both_trees_are_a_query(spark, tmp_path):
    schema = "{0} long, {1} long, {2} timestamp_ntz"
    spark.createDataFrame([(1, None, None), (2, 1, None), (3, 2, None), (4, 4, None)], schema.format("chapter_id", "parent_chapter_id", "indexed_at")).write.parquet(f"{tmp_path}/chapter.parquet")
    spark.createDataFrame([(1, None, None), (5, 1, None)], schema.format("unit_id", "parent_unit_id", "created_at")).write.parquet(f"{tmp_path}/generated_unit.parquet")
    found = QUERIES["p3_descendant_pairs"](spark, str(tmp_path))
    assert sorted(map(tuple, found.select("tree", "node_id", "descendant_id", "distance").collect())) == [("chapter", 1, 2, 1), ("chapter", 1, 3, 2), ("chapter", 2, 3, 1), ("generated_unit", 1, 5, 1)]


def test_descendant_counts_of_random_trees(spark):
    rng = random.Random(9)
    parents = {i: rng.choice([None, rng.randrange(i)]) if i % 9 and i else None if i < 60 else i - 1 for i in range(150)} | {500: 501, 501: 500, 502: 500}
    rows = links(spark, parents)
    got = dict(map(tuple, descendant_counts(rows, resolve_forest(rows, block=8)).collect()))
    want = dict.fromkeys(parents, 0)
    for _, _, path in brute(parents).values():
        for node in (path or [])[:-1]:
            want[node] += 1
    assert got == want
