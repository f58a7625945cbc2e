"""Queries over the chapter and generated_unit trees (problem 3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators.hierarchy import descendant_counts, descendants, latest_links, resolve_forest
from foliomill.runtime import cut, table

TREES = {
    "chapter": ("chapter_id", "parent_chapter_id", "indexed_at"),
    "generated_unit": ("unit_id", "parent_unit_id", "created_at"),
}


def _trees(spark: SparkSession, sf_dir: str, paths: bool) -> list[tuple[str, DataFrame]]:
    return [(name, resolve_forest(latest_links(table(spark, sf_dir, name), *columns), paths=paths)) for name, columns in TREES.items()]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of each chapter and unit."""
    parts = [df.select(F.lit(name).alias("tree"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth") for name, df in _trees(spark, sf_dir, False)]
    return reduce(DataFrame.unionByName, parts)


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path from the root, as ids joined by '/'; null on or below a circle."""
    parts = [df.select(F.lit(name).alias("tree"), F.col("node").alias("node_id"), F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path")) for name, df in _trees(spark, sf_dir, True)]
    return reduce(DataFrame.unionByName, parts)


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of descendants of each node."""
    parts = []
    for name, columns in TREES.items():
        links = cut(latest_links(table(spark, sf_dir, name), *columns))
        parts.append(descendant_counts(links, resolve_forest(links)).select(F.lit(name).alias("tree"), F.col("node").alias("node_id"), "n_descendants"))
    return reduce(DataFrame.unionByName, parts)


def p3_descendant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every descendant of each node and how far below it stands."""
    parts = [descendants(df).select(F.lit(name).alias("tree"), F.col("node").alias("node_id"), F.col("descendant").alias("descendant_id"), "distance") for name, df in _trees(spark, sf_dir, True)]
    return reduce(DataFrame.unionByName, parts)


_LINKS = """
cl AS (SELECT 'chapter' AS tree, chapter_id AS id, list(parent_chapter_id ORDER BY indexed_at DESC NULLS LAST)[1] AS parent FROM chapter GROUP BY chapter_id
       UNION ALL
       SELECT 'generated_unit', unit_id, list(parent_unit_id ORDER BY created_at DESC NULLS LAST)[1] FROM generated_unit GROUP BY unit_id),
l AS (SELECT c.tree, c.id, p.id AS parent FROM cl c LEFT JOIN cl p ON p.tree = c.tree AND p.id = c.parent),
w(tree, id, root, depth, path) AS (
  SELECT tree, id, id, CAST(0 AS BIGINT), CAST(id AS VARCHAR) FROM l WHERE parent IS NULL
  UNION ALL
  SELECT l.tree, l.id, w.root, w.depth + 1, w.path || '/' || CAST(l.id AS VARCHAR) FROM l JOIN w ON l.tree = w.tree AND l.parent = w.id)
"""

QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p3_descendant_pairs": p3_descendant_pairs}

SQL = {
    "p3_found": f"WITH RECURSIVE {_LINKS} SELECT l.tree, l.id AS node_id, coalesce(w.root, -1) AS root_id, coalesce(w.depth, -1) AS depth FROM l LEFT JOIN w ON w.tree = l.tree AND w.id = l.id",
    "p3_paths": f"WITH RECURSIVE {_LINKS} SELECT l.tree, l.id AS node_id, w.path FROM l LEFT JOIN w ON w.tree = l.tree AND w.id = l.id",
    "p3_descendants": f"WITH RECURSIVE {_LINKS}, a AS (SELECT tree, CAST(unnest(string_split(path, '/')) AS BIGINT) AS node_id FROM w), n AS (SELECT tree, node_id, count(*) - 1 AS n FROM a GROUP BY ALL) "
    "SELECT l.tree, l.id AS node_id, coalesce(n.n, 0) AS n_descendants FROM l LEFT JOIN n ON n.tree = l.tree AND n.node_id = l.id",
    "p3_descendant_pairs": f"WITH RECURSIVE {_LINKS}, a AS (SELECT tree, id AS descendant_id, depth, unnest(string_split(path, '/')) AS node, generate_subscripts(string_split(path, '/'), 1) AS place FROM w) "
    "SELECT tree, CAST(node AS BIGINT) AS node_id, descendant_id, depth - place + 1 AS distance FROM a WHERE place <= depth",
}
