"""Queries over the typed concept graph: prerequisites, maps, patterns, coverage, landscapes.

Where the query set is "each concept", those whose id is divisible by 20 ask, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.operators import graph as G
from foliomill.operators.retrieval import top_per
from foliomill.plans.common import CHAPTERS, CONCEPTS, chapters, concepts
from foliomill.plans.relations import RELATIONS, both_ends, edges, relations
from foliomill.runtime import cut, table

#: Depths and limits of the walks (fixed values).
PREREQUISITE_DEPTH, MAP_DEPTH, MAP_NODES, PATTERN_DEPTH, MAX_OPTIONS = 3, 2, 60, 2, 5
MIN_OVERLAP, LENGTH_NORM = 3, 0.75
#: Points of a technology: chapters, documents, neighbours (at most so many), for the composite score (fixed values).
CHAPTER_POINTS, SECTION_POINTS, NEIGHBOUR_POINTS, MOST_NEIGHBOURS = 1.0, 3.0, 0.5, 30
#: Views of the corpus: preferred relations and concept types.
VIEWS = {"builder": (("IMPLEMENTS", "REQUIRES"), ("Tool", "Framework")), "critic": (("CONTRASTS_WITH",), ("Concept",)), "architect": (("EXTENDS", "IMPLEMENTS"), ("Pattern",))}


def _asking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts(spark, sf_dir, "name").where("concept_id % 20 = 0").select(F.col("concept_id").alias("query"), F.col("concept_id").alias("node"))


def _directed(rows: DataFrame, *kinds: str) -> DataFrame:
    return rows.where(F.col("relation_type").isin(*kinds)).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))


def _named(df: DataFrame, spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return df.join(concepts(spark, sf_dir, *columns).withColumnRenamed("concept_id", "node"), "node")


def _coverage(rows: DataFrame) -> DataFrame:
    """(concept_id, n_chapters, n_sections): distinct sources of each kind that relate the concept."""
    kind = lambda k: F.countDistinct(F.when(F.col("source_type") == k, F.col("source_id")))
    return both_ends(rows).groupBy("concept_id").agg(kind("chapter").alias("n_chapters"), kind("doc_section").alias("n_sections"))


def a01_edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of two concepts by type: how many, and the surest."""
    return relations(spark, sf_dir).groupBy("from_id", "to_id", "relation_type").agg(F.count("*").alias("weight"), F.max("confidence").alias("confidence"))


def a02_node_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct chapters and documents of every concept, 0 where it has none."""
    counts = _coverage(relations(spark, sf_dir))
    return concepts(spark, sf_dir, "name").join(counts, "concept_id", "left").select("concept_id", "name", F.coalesce("n_chapters", F.lit(0)).alias("n_chapters"), F.coalesce("n_sections", F.lit(0)).alias("n_sections"))


def a04_domain_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best five chapters of each domain: distinct concepts of it, then mentions; a relation between two of them counts for its first end."""
    kinds = concepts(spark, sf_dir, "domain").where("domain is not null")
    rows = relations(spark, sf_dir).where("source_type = 'chapter'")
    rows = rows.join(kinds.select(F.col("concept_id").alias("from_id"), F.col("domain").alias("from_domain")), "from_id", "left").join(kinds.select(F.col("concept_id").alias("to_id"), F.col("domain").alias("to_domain")), "to_id", "left")
    first = rows.where("from_domain is not null").select(F.col("from_domain").alias("domain"), F.col("from_id").alias("hit"), "source_id")
    second = rows.where("to_domain is not null and not (from_domain <=> to_domain)").select(F.col("to_domain").alias("domain"), F.col("to_id").alias("hit"), "source_id")
    hits = first.unionByName(second).groupBy("domain", F.col("source_id").alias("chapter_id")).agg(F.countDistinct("hit").alias("hits"), F.count("*").alias("mentions"))
    return top_per(hits, "domain", [F.col("hits").desc(), F.col("mentions").desc(), F.col("chapter_id")], 5)


def a05_reading_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that relate at least one concept of a query's prerequisite path, with how many."""
    rows = cut(relations(spark, sf_dir))
    path = G.walk(_directed(rows, "REQUIRES", "EXTENDS"), _asking(spark, sf_dir), 4)
    in_chapters = both_ends(rows.where("source_type = 'chapter'")).select(F.col("concept_id").alias("node"), F.col("source_id").alias("chapter_id")).distinct()
    return path.join(in_chapters, "node").groupBy("query", "chapter_id").agg(F.countDistinct("node").alias("concept_hits"))


def a06_source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that share at least MIN_OVERLAP concepts with the two-step neighbourhood of a domain's concepts."""
    rows = cut(relations(spark, sf_dir))
    seeds = concepts(spark, sf_dir, "domain").where("domain is not null and concept_id % 20 = 0").select(F.col("domain").alias("query"), F.col("concept_id").alias("node"))
    around = G.walk(both_ends(rows).select(F.col("concept_id").alias("src"), F.col("other_id").alias("dst")), seeds, 2)
    held = _source_concepts(spark, sf_dir, rows)
    totals = held.groupBy("source").agg(F.count("*").alias("total"))
    overlap = held.join(around.select("query", "node"), "node").groupBy("query", "source").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= MIN_OVERLAP)
    return overlap.join(totals, "source").select(F.col("query").alias("domain"), "source", "overlap", "total")


def _source_concepts(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "source")
    return both_ends(rows.where("source_type = 'doc_section'")).join(documents, "source_id").select("source", F.col("concept_id").alias("node")).distinct()


def a07_technology_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite score of tools and frameworks: chapters, documents and neighbours."""
    rows = cut(relations(spark, sf_dir))
    near = both_ends(rows).groupBy("concept_id").agg(F.countDistinct("other_id").alias("n_neighbours"))
    found = concepts(spark, sf_dir, "name", "concept_type").where("concept_type in ('Tool', 'Framework')").join(_coverage(rows), "concept_id").join(near, "concept_id")
    score = CHAPTER_POINTS * F.col("n_chapters") + SECTION_POINTS * F.col("n_sections") + NEIGHBOUR_POINTS * F.least(F.col("n_neighbours"), F.lit(MOST_NEIGHBOURS))
    return found.select("concept_id", "name", "n_chapters", "n_sections", "n_neighbours", score.alias("score"))


def a08_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each concept is used: as an end of a relation and on alignment edges."""
    related = both_ends(relations(spark, sf_dir)).select("concept_id")
    aligned = edges(spark, sf_dir).select("concept_id").where("concept_id is not null")
    return related.unionByName(aligned).groupBy("concept_id").agg(F.count("*").alias("coverage"))


def a14_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best twelve relations of a query by name and confidence; REQUIRES and EXTENDS are also read backwards."""
    rows = cut(relations(spark, sf_dir))
    ahead = rows.select(F.col("from_id").alias("query"), F.col("to_id").alias("node"), F.col("relation_type").alias("rel"), "confidence")
    back = rows.where("relation_type in ('REQUIRES', 'EXTENDS')").select(F.col("to_id").alias("query"), F.col("from_id").alias("node"), F.when(F.col("relation_type") == "REQUIRES", "IS_REQUIRED_BY").otherwise("SPECIALIZED_BY").alias("rel"), "confidence")
    best = _named(ahead.unionByName(back), spark, sf_dir, "name").groupBy("query", "rel", "name").agg(F.max("confidence").alias("confidence"))
    return top_per(best, "query", [F.col("confidence").desc(), F.col("name"), F.col("rel")], 12)


def a23_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten sources that relate a concept most often."""
    counts = both_ends(relations(spark, sf_dir)).groupBy("concept_id", "source_type", "source_id").agg(F.count("*").alias("n"))
    return top_per(counts, "concept_id", [F.col("n").desc(), F.col("source_type"), F.col("source_id")], 10)


def a24_view_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a related concept fits each view: 2 per preferred relation, 3 for a preferred type, 1 per chapter."""
    rows = cut(relations(spark, sf_dir))
    counts = both_ends(rows).groupBy("concept_id").agg(*[F.count_if(F.col("relation_type").isin(*kinds)).alias(view) for view, (kinds, _) in VIEWS.items()])
    joined = concepts(spark, sf_dir, "concept_type").join(counts, "concept_id").join(_coverage(rows), "concept_id")
    points = [F.struct(F.lit(view).alias("view"), (2 * F.col(view) + F.when(F.col("concept_type").isin(*types), 3).otherwise(0) + F.col("n_chapters")).cast("long").alias("score")) for view, (_, types) in VIEWS.items()]
    return joined.select("concept_id", F.explode(F.array(*points)).alias("v")).select("concept_id", "v.view", "v.score")


def a25_central_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most related concepts of each domain: words for a retrieval query."""
    mentions = both_ends(relations(spark, sf_dir)).groupBy("concept_id").agg(F.count("*").alias("mentions"))
    rows = concepts(spark, sf_dir, "name", "domain").where("domain is not null").join(mentions, "concept_id", "left").select("domain", "concept_id", "name", F.coalesce("mentions", F.lit(0)).alias("mentions"))
    return top_per(rows, "domain", [F.col("mentions").desc(), F.col("name"), F.col("concept_id")], 3)


def w02_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that share a name, apart from case: the most related one first, then the smallest id."""
    degree = both_ends(relations(spark, sf_dir)).groupBy("concept_id").agg(F.count("*").alias("n_edges"))
    rows = concepts(spark, sf_dir, "name").where("name is not null").join(degree, "concept_id", "left").select("concept_id", F.lower("name").alias("lower_name"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
    shared = rows.groupBy("lower_name").agg(F.count("*").alias("n")).where("n > 1").select("lower_name")
    order = Window.partitionBy("lower_name").orderBy(F.col("n_edges").desc(), "concept_id")
    return rows.join(shared, "lower_name").withColumn("nth", F.row_number().over(order))


def g01_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a query requires, directly or over others, with the least depth."""
    found = G.walk(_directed(relations(spark, sf_dir), "REQUIRES"), _asking(spark, sf_dir), PREREQUISITE_DEPTH)
    return _named(found.where("depth > 0"), spark, sf_dir, "name").select("query", F.col("node").alias("concept_id"), "name", "depth")


def g02_domain_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nearest prerequisites of all queries of a domain together: nearest first, then the best covered; one per name."""
    rows = cut(relations(spark, sf_dir))
    seeds = concepts(spark, sf_dir, "domain").where("domain is not null and concept_id % 20 = 0").select(F.col("domain").alias("query"), F.col("concept_id").alias("node"))
    found = G.walk(_directed(rows, "REQUIRES"), seeds, 2).where("depth > 0")
    covered = _named(found, spark, sf_dir, "name").join(_coverage(rows).select(F.col("concept_id").alias("node"), (F.col("n_chapters") + F.col("n_sections")).alias("coverage")), "node")
    order = [F.col("depth"), F.col("coverage").desc(), F.col("name"), F.col("node")]
    once = covered.withColumn("nth", F.row_number().over(Window.partitionBy("query", F.lower("name")).orderBy(*order))).where("nth = 1").drop("nth")
    return top_per(once, "query", order, 4).select(F.col("query").alias("domain"), F.col("node").alias("concept_id"), "name", "depth", "coverage", "rank")


def _map(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (query, node, depth, degree, name, rank) of each query's map, and the undirected relations."""
    ways = cut(both_ends(relations(spark, sf_dir)))
    around = cut(G.walk(ways.select(F.col("concept_id").alias("src"), F.col("other_id").alias("dst")), _asking(spark, sf_dir), MAP_DEPTH))
    inside = ways.select("concept_id", "other_id", "relation_type").distinct().join(around.where(F.col("depth") < MAP_DEPTH).select("query", F.col("node").alias("concept_id")), "concept_id")
    # an edge is seen from an end that was expanded; it counts for both of its ends
    seen = inside.select("query", F.least("concept_id", "other_id").alias("a"), F.greatest("concept_id", "other_id").alias("b"), "relation_type").distinct()
    degree = seen.select("query", F.explode(F.array("a", "b")).alias("node")).groupBy("query", "node").agg(F.count("*").alias("degree"))
    nodes = _named(around, spark, sf_dir, "name").join(degree, ["query", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return top_per(nodes, "query", [F.col("depth"), F.col("degree").desc(), F.col("name"), F.col("node")], MAP_NODES), ways


def g04_concept_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts within two relations of a query, at most MAP_NODES: nearest, best connected, then by name."""
    return _map(spark, sf_dir)[0].select("query", F.col("node").alias("concept_id"), "depth", "degree", "rank")


def g05_learning_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts below a query over REQUIRES and EXTENDS, foundations first."""
    found = G.walk(_directed(relations(spark, sf_dir), "REQUIRES", "EXTENDS"), _asking(spark, sf_dir), 4)
    return top_per(_named(found, spark, sf_dir, "name"), "query", [F.col("depth").desc(), F.col("name"), F.col("node")], 30).select("query", F.col("node").alias("concept_id"), "depth", F.col("rank").alias("stage"))


def g07_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What extends a query, directly or over others."""
    backwards = _directed(relations(spark, sf_dir), "EXTENDS").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.walk(backwards, _asking(spark, sf_dir), 2).where("depth > 0").select("query", F.col("node").alias("concept_id"), "depth")


def g11_authors_of_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors who write about a concept, with the number of their chapters that relate it."""
    used = both_ends(relations(spark, sf_dir).where("source_type = 'chapter'")).select("concept_id", F.col("source_id").alias("chapter_id")).distinct()
    links = table(spark, sf_dir, "book_author").where("book_id is not null and author_id is not null").select("book_id", "author_id").distinct()
    rows = used.join(chapters(spark, sf_dir, "book_id"), "chapter_id").join(links, "book_id")
    return rows.groupBy("concept_id", "author_id").agg(F.count("*").alias("n_chapters"))


def g12_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns within two IMPLEMENTS, EXTENDS or REQUIRES steps of a query, best covered by chapters first."""
    rows = cut(relations(spark, sf_dir))
    ways = both_ends(rows.where("relation_type in ('IMPLEMENTS', 'EXTENDS', 'REQUIRES')")).select(F.col("concept_id").alias("src"), F.col("other_id").alias("dst"))
    found = _named(G.walk(ways, _asking(spark, sf_dir), PATTERN_DEPTH).where("depth > 0"), spark, sf_dir, "concept_type").where(F.contains("concept_type", F.lit("Pattern")))
    covered = found.join(_coverage(rows).withColumnRenamed("concept_id", "node"), "node")
    return top_per(covered.select("query", F.col("node").alias("concept_id"), "n_chapters"), "query", [F.col("n_chapters").desc(), F.col("concept_id")], 30)


def g13_pattern_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts by the pattern they implement that most others implement too; 'standalone' (-1) where none is shared."""
    rows = relations(spark, sf_dir).where("relation_type = 'IMPLEMENTS'").select(F.col("from_id").alias("concept_id"), F.col("to_id").alias("target")).distinct()
    popular = rows.groupBy("target").agg(F.count("*").alias("n"))
    best = rows.join(popular, "target").groupBy("concept_id").agg(F.max(F.struct("n", (-F.col("target")).alias("t"))).alias("b"))
    return best.select("concept_id", F.when(F.col("b.n") >= 2, -F.col("b.t")).otherwise(-1).alias("family"))


def g14_anti_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that contrast with patterns without being patterns, with the number of those."""
    kinds = concepts(spark, sf_dir, "concept_type").select(F.col("concept_id").alias("node"), F.contains("concept_type", F.lit("Pattern")).alias("pattern"))
    ways = both_ends(relations(spark, sf_dir).where("relation_type = 'CONTRASTS_WITH'")).select("concept_id", "other_id").distinct()
    joined = ways.join(kinds.where("pattern").select(F.col("node").alias("concept_id")), "concept_id").join(kinds.where("not coalesce(pattern, false)").select(F.col("node").alias("other_id")), "other_id")
    return joined.groupBy(F.col("other_id").alias("concept_id")).agg(F.count("*").alias("n_patterns"))


def g15_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of a decision: the concept itself and what contrasts with it, at most MAX_OPTIONS, with their chapters."""
    rows = cut(relations(spark, sf_dir))
    ways = both_ends(rows.where("relation_type = 'CONTRASTS_WITH'")).select(F.col("concept_id").alias("query"), F.col("other_id").alias("node")).distinct()
    options = ways.select("query", "node", F.lit(1).alias("other")).unionByName(ways.select("query", F.col("query").alias("node"), F.lit(0).alias("other")).distinct())
    picked = top_per(options, "query", [F.col("other"), F.col("node")], MAX_OPTIONS)
    covered = _coverage(rows).select(F.col("concept_id").alias("node"), "n_chapters", "n_sections")
    return picked.join(covered, "node").select("query", F.col("node").alias("option_id"), F.col("rank").alias("place"), "n_chapters", "n_sections")


def g16_migration_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradicted chapters of a query's concepts (itself and its neighbours) with the document that contradicts."""
    ways = both_ends(relations(spark, sf_dir)).select(F.col("concept_id").alias("src"), F.col("other_id").alias("dst"))
    around = G.walk(ways, _asking(spark, sf_dir), 1)
    against = edges(spark, sf_dir).where("relation_type = 'CONTRADICTS'").select(F.col("concept_id").alias("node"), "alignment_edge_id", F.col("from_doc_section_id").alias("doc_id"), F.col("to_chapter_id").alias("chapter_id"))
    return around.join(against, "node").select("query", F.col("node").alias("concept_id"), "alignment_edge_id", "doc_id", "chapter_id")


def g21_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources against domains: shared concepts, each worth 1 / ln(sources that have it + 1), over a norm of the source's size."""
    held = cut(_source_concepts(spark, sf_dir, relations(spark, sf_dir)))
    rare = held.groupBy("node").agg((1 / F.log(F.count("*") + 1.0)).alias("worth"))
    sizes = held.groupBy("source").agg(F.count("*").alias("size"))
    norm = sizes.join(F.broadcast(sizes.agg(F.avg("size").alias("usual")))).select("source", (1 - LENGTH_NORM + LENGTH_NORM * F.col("size") / F.col("usual")).alias("norm"))
    shared = _named(held.join(rare, "node"), spark, sf_dir, "domain").where("domain is not null").groupBy("source", "domain").agg(F.count("*").alias("coverage"), F.sum("worth").alias("worth"))
    return shared.join(norm, "source").select("source", "domain", "coverage", F.round(F.col("worth") / F.col("norm"), 6).alias("score"))


def g31_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three surest concepts of the same type that contrast with a concept."""
    best = both_ends(relations(spark, sf_dir).where("relation_type = 'CONTRASTS_WITH'")).groupBy("concept_id", "other_id").agg(F.max("confidence").alias("confidence"))
    kinds = concepts(spark, sf_dir, "concept_type", "name")
    rows = best.join(kinds.select("concept_id", F.col("concept_type").alias("own")), "concept_id").join(kinds.withColumnRenamed("concept_id", "other_id"), "other_id").where("own = concept_type")
    return top_per(rows.select(F.col("concept_id").alias("query"), "other_id", "name", "confidence"), "query", [F.col("confidence").desc(), F.col("name"), F.col("other_id")], 3)


QUERIES = {
    f.__name__: f
    for f in (
        a01_edge_weights, a02_node_coverage, a04_domain_chapters, a05_reading_list, a06_source_overlap, a07_technology_scores, a08_coverage, a14_related, a23_sources, a24_view_scores, a25_central_names, w02_duplicate_names,
        g01_prerequisites, g02_domain_prerequisites, g04_concept_map, g05_learning_path, g07_extensions, g11_authors_of_concepts, g12_patterns, g13_pattern_families, g14_anti_patterns, g15_options, g16_migration_diffs, g21_landscape, g31_alternatives,
    )
}

_W = f"WITH RECURSIVE {CHAPTERS}, {CONCEPTS}, {RELATIONS}, q AS (SELECT concept_id AS query FROM co WHERE concept_id % 20 = 0), dq AS (SELECT domain AS query, concept_id AS node FROM co WHERE concept_id % 20 = 0 AND domain IS NOT NULL)"
_COV = "cv AS (SELECT concept_id, count(DISTINCT source_id) FILTER (source_type = 'chapter') AS n_chapters, count(DISTINCT source_id) FILTER (source_type = 'doc_section') AS n_sections FROM be GROUP BY 1)"


def _walk(step: str, depth: int, seeds: str = "SELECT query, query AS node FROM q") -> str:
    """CTEs w (query, node, depth): least depths along the steps (src, dst)."""
    return f"s AS ({step}), u(query, node, depth) AS (SELECT query, node, 0 FROM ({seeds}) UNION SELECT query, dst, depth + 1 FROM u JOIN s ON src = node WHERE depth < {depth}), w AS (SELECT query, node, min(depth) AS depth FROM u GROUP BY 1, 2)"


def _top(rows: str, key: str, order: str, n: int) -> str:
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS INTEGER) AS rank FROM ({rows}) QUALIFY rank <= {n}"


_BOTH = "SELECT DISTINCT concept_id AS src, other_id AS dst FROM be"
_HELD = "hl AS (SELECT DISTINCT source, concept_id AS node FROM be JOIN documents ON doc_id = source_id WHERE source_type = 'doc_section')"
_VIEWS = " UNION ALL ".join(
    f"SELECT concept_id, '{view}' AS view, CAST(2 * count(*) FILTER (relation_type IN ({', '.join(map(repr, kinds))})) + CASE WHEN any_value(co.concept_type) IN ({', '.join(map(repr, types))}) THEN 3 ELSE 0 END + any_value(n_chapters) AS BIGINT) AS score FROM be JOIN co USING (concept_id) JOIN cv USING (concept_id) GROUP BY 1"
    for view, (kinds, types) in (("builder", (["IMPLEMENTS", "REQUIRES"], ["Tool", "Framework"])), ("critic", (["CONTRASTS_WITH"], ["Concept"])), ("architect", (["EXTENDS", "IMPLEMENTS"], ["Pattern"])))
)

SQL = {
    "a01_edge_weights": f"{_W} SELECT from_id, to_id, relation_type, count(*) AS weight, max(confidence) AS confidence FROM rl GROUP BY 1, 2, 3",
    "a02_node_coverage": f"{_W}, {_COV} SELECT concept_id, name, coalesce(n_chapters, 0) AS n_chapters, coalesce(n_sections, 0) AS n_sections FROM co LEFT JOIN cv USING (concept_id)",
    "a04_domain_chapters": f"""{_W}, x AS (SELECT r.*, f.domain AS fd, t.domain AS td FROM rl r JOIN co f ON f.concept_id = from_id JOIN co t ON t.concept_id = to_id WHERE source_type = 'chapter'),
h AS (SELECT fd AS domain, from_id AS hit, source_id FROM x WHERE fd IS NOT NULL UNION ALL SELECT td, to_id, source_id FROM x WHERE td IS NOT NULL AND td IS DISTINCT FROM fd) {_top("SELECT domain, source_id AS chapter_id, count(DISTINCT hit) AS hits, count(*) AS mentions FROM h GROUP BY 1, 2", "domain", "hits DESC, mentions DESC, chapter_id", 5)}""",
    "a05_reading_list": f"{_W}, {_walk('''SELECT DISTINCT from_id AS src, to_id AS dst FROM rl WHERE relation_type IN ('REQUIRES', 'EXTENDS')''', 4)} SELECT query, source_id AS chapter_id, count(DISTINCT node) AS concept_hits FROM w JOIN be ON concept_id = node WHERE source_type = 'chapter' GROUP BY 1, 2",
    "a06_source_overlap": f"{_W}, {_HELD}, {_walk(_BOTH, 2, 'SELECT * FROM dq')}, t AS (SELECT source, count(*) AS total FROM hl GROUP BY 1) SELECT query AS domain, source, count(*) AS overlap, any_value(total) AS total FROM hl JOIN w USING (node) JOIN t USING (source) GROUP BY 1, 2 HAVING count(*) >= 3",
    "a07_technology_scores": f"{_W}, {_COV}, n AS (SELECT concept_id, count(DISTINCT other_id) AS n_neighbours FROM be GROUP BY 1) SELECT concept_id, name, n_chapters, n_sections, n_neighbours, CAST(n_chapters + 3 * n_sections + 0.5 * least(n_neighbours, 30) AS DOUBLE) AS score FROM co JOIN cv USING (concept_id) JOIN n USING (concept_id) WHERE concept_type IN ('Tool', 'Framework')",
    "a08_coverage": f"{_W} SELECT concept_id, count(*) AS coverage FROM (SELECT concept_id FROM be UNION ALL SELECT concept_id FROM ed WHERE concept_id IS NOT NULL) GROUP BY 1",
    "a14_related": f"""{_W}, x AS (SELECT from_id AS query, to_id AS node, relation_type AS rel, confidence FROM rl UNION ALL SELECT to_id, from_id, CASE relation_type WHEN 'REQUIRES' THEN 'IS_REQUIRED_BY' ELSE 'SPECIALIZED_BY' END, confidence FROM rl WHERE relation_type IN ('REQUIRES', 'EXTENDS'))
{_top("SELECT query, rel, name, max(confidence) AS confidence FROM x JOIN co ON concept_id = node GROUP BY 1, 2, 3", "query", "confidence DESC, name, rel", 12)}""",
    "a23_sources": f"{_W} {_top('SELECT concept_id, source_type, source_id, count(*) AS n FROM be GROUP BY 1, 2, 3', 'concept_id', 'n DESC, source_type, source_id', 10)}",
    "a24_view_scores": f"{_W}, {_COV} {_VIEWS}",
    "a25_central_names": f"{_W}, m AS (SELECT concept_id, count(*) AS mentions FROM be GROUP BY 1) {_top('SELECT domain, concept_id, name, coalesce(mentions, 0) AS mentions FROM co LEFT JOIN m USING (concept_id) WHERE domain IS NOT NULL', 'domain', 'mentions DESC, name, concept_id', 3)}",
    "w02_duplicate_names": f"{_W}, d AS (SELECT concept_id, count(*) AS n_edges FROM be GROUP BY 1), x AS (SELECT concept_id, lower(name) AS lower_name, coalesce(n_edges, 0) AS n_edges FROM co LEFT JOIN d USING (concept_id) WHERE name IS NOT NULL) SELECT *, CAST(row_number() OVER (PARTITION BY lower_name ORDER BY n_edges DESC, concept_id) AS INTEGER) AS nth FROM x QUALIFY count(*) OVER (PARTITION BY lower_name) > 1",
    "g01_prerequisites": f"{_W}, {_walk('''SELECT DISTINCT from_id AS src, to_id AS dst FROM rl WHERE relation_type = 'REQUIRES' ''', 3)} SELECT query, concept_id, name, depth FROM w JOIN co ON concept_id = node WHERE depth > 0",
    "g02_domain_prerequisites": f"""{_W}, {_COV}, {_walk("SELECT DISTINCT from_id AS src, to_id AS dst FROM rl WHERE relation_type = 'REQUIRES'", 2, "SELECT * FROM dq")}, x AS (SELECT query AS domain, node AS concept_id, name, depth, n_chapters + n_sections AS coverage FROM w JOIN co ON co.concept_id = node JOIN cv ON cv.concept_id = node WHERE depth > 0),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY domain, lower(name) ORDER BY depth, coverage DESC, name, concept_id) = 1) {_top("SELECT * FROM y", "domain", "depth, coverage DESC, name, concept_id", 4)}""",
    "g04_concept_map": f"""{_W}, {_walk(_BOTH, 2)}, e AS (SELECT DISTINCT query, least(concept_id, other_id) AS a, greatest(concept_id, other_id) AS b, relation_type FROM be JOIN w ON node = concept_id WHERE depth < 2), d AS (SELECT query, node, count(*) AS degree FROM (SELECT query, a AS node FROM e UNION ALL SELECT query, b FROM e) GROUP BY 1, 2)
SELECT query, node AS concept_id, depth, coalesce(degree, 0) AS degree, CAST(row_number() OVER (PARTITION BY query ORDER BY depth, coalesce(degree, 0) DESC, name, node) AS INTEGER) AS rank FROM w JOIN co ON concept_id = node LEFT JOIN d USING (query, node) QUALIFY rank <= 60""",
    "g05_learning_path": f"{_W}, {_walk('''SELECT DISTINCT from_id AS src, to_id AS dst FROM rl WHERE relation_type IN ('REQUIRES', 'EXTENDS')''', 4)} SELECT query, concept_id, depth, CAST(row_number() OVER (PARTITION BY query ORDER BY depth DESC, name, concept_id) AS INTEGER) AS stage FROM w JOIN co ON concept_id = node QUALIFY stage <= 30",
    "g07_extensions": f"{_W}, {_walk('''SELECT DISTINCT to_id AS src, from_id AS dst FROM rl WHERE relation_type = 'EXTENDS' ''', 2)} SELECT query, node AS concept_id, depth FROM w WHERE depth > 0",
    "g11_authors_of_concepts": f"{_W}, u AS (SELECT DISTINCT concept_id, source_id AS chapter_id FROM be WHERE source_type = 'chapter'), l AS (SELECT DISTINCT book_id, author_id FROM book_author WHERE book_id IS NOT NULL AND author_id IS NOT NULL) SELECT concept_id, author_id, count(*) AS n_chapters FROM u JOIN ch USING (chapter_id) JOIN l USING (book_id) GROUP BY 1, 2",
    "g12_patterns": f"{_W}, {_COV}, {_walk('''SELECT DISTINCT concept_id AS src, other_id AS dst FROM be WHERE relation_type IN ('IMPLEMENTS', 'EXTENDS', 'REQUIRES')''', 2)} {_top('''SELECT query, node AS concept_id, n_chapters FROM w JOIN co ON co.concept_id = node JOIN cv ON cv.concept_id = node WHERE depth > 0 AND concept_type LIKE '%Pattern%' ''', 'query', 'n_chapters DESC, concept_id', 30)}",
    "g13_pattern_families": f"{_W}, i AS (SELECT DISTINCT from_id AS concept_id, to_id AS target FROM rl WHERE relation_type = 'IMPLEMENTS'), p AS (SELECT target, count(*) AS n FROM i GROUP BY 1) SELECT concept_id, CASE WHEN n >= 2 THEN target ELSE -1 END AS family FROM i JOIN p USING (target) QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY n DESC, target) = 1",
    "g14_anti_patterns": f"{_W}, c AS (SELECT DISTINCT concept_id, other_id FROM be WHERE relation_type = 'CONTRASTS_WITH') SELECT other_id AS concept_id, count(*) AS n_patterns FROM c JOIN co p ON p.concept_id = c.concept_id JOIN co o ON o.concept_id = other_id WHERE p.concept_type LIKE '%Pattern%' AND NOT coalesce(o.concept_type LIKE '%Pattern%', false) GROUP BY 1",
    "g15_options": f"{_W}, {_COV}, c AS (SELECT DISTINCT concept_id AS query, other_id AS node FROM be WHERE relation_type = 'CONTRASTS_WITH'), o AS (SELECT query, node, 1 AS other FROM c UNION SELECT query, query, 0 FROM c), p AS (SELECT query, node, CAST(row_number() OVER (PARTITION BY query ORDER BY other, node) AS INTEGER) AS place FROM o QUALIFY place <= 5) SELECT query, node AS option_id, place, n_chapters, n_sections FROM p JOIN cv ON concept_id = node",
    "g16_migration_diffs": f"{_W}, {_walk(_BOTH, 1)} SELECT query, node AS concept_id, alignment_edge_id, from_doc_section_id AS doc_id, to_chapter_id AS chapter_id FROM w JOIN ed ON concept_id = node WHERE relation_type = 'CONTRADICTS'",
    "g21_landscape": f"{_W}, {_HELD}, r AS (SELECT node, 1 / ln(count(*) + 1) AS worth FROM hl GROUP BY 1), z AS (SELECT source, count(*) AS size FROM hl GROUP BY 1), n AS (SELECT source, 0.25 + 0.75 * size / (SELECT avg(size) FROM z) AS norm FROM z) SELECT source, domain, count(*) AS coverage, round(sum(worth) / any_value(norm), 6) AS score FROM hl JOIN r USING (node) JOIN n USING (source) JOIN co ON concept_id = node WHERE domain IS NOT NULL GROUP BY 1, 2",
    "g31_alternatives": f"{_W}, b AS (SELECT concept_id, other_id, max(confidence) AS confidence FROM be WHERE relation_type = 'CONTRASTS_WITH' GROUP BY 1, 2) {_top('SELECT b.concept_id AS query, other_id, o.name, confidence FROM b JOIN co c ON c.concept_id = b.concept_id JOIN co o ON o.concept_id = other_id WHERE c.concept_type = o.concept_type', 'query', 'confidence DESC, name, other_id', 3)}",
}
