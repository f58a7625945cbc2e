"""Resolution and hygiene of concepts: lookups, nearest vectors, aliases, twins, rewritten relations.

Aliases stand for matches: a concept is also known by the name of any concept that it is matched with.
A concept's vector is the one with its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.functions import text as X
from foliomill.operators import retrieval as R
from foliomill.plans.common import CHAPTERS, CONCEPTS, chapters, concepts
from foliomill.plans.relations import RELATIONS, both_ends, relations
from foliomill.runtime import cut, table

#: Cosines from which a candidate is the concept, and from which a person should look (fixed values).
SAME, BORDERLINE = 0.90, 0.75


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(concept_id, alias): names of matched concepts, once each apart from case, other than the concept's own."""
    names = concepts(spark, sf_dir, "name").where("name is not null")
    pairs = table(spark, sf_dir, "concept_match").where("concept_id_a <> concept_id_b").select("concept_id_a", "concept_id_b")
    both = pairs.toDF("concept_id", "other").unionByName(pairs.toDF("other", "concept_id")).distinct()
    named = both.join(names.select(F.col("concept_id").alias("other"), F.col("name").alias("alias")), "other").join(names, "concept_id").where("lower(alias) <> lower(name)")
    return named.groupBy("concept_id", F.lower("alias").alias("lower_alias")).agg(F.min("alias").alias("alias")).select("concept_id", "alias")


def _richest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lower_name, concept_id): the concept of a name that has most relations, then the smallest id."""
    degree = both_ends(relations(spark, sf_dir)).groupBy("concept_id").agg(F.count("*").alias("degree"))
    rows = concepts(spark, sf_dir, "name").where("name is not null").join(degree, "concept_id", "left")
    best = rows.groupBy(F.lower("name").alias("lower_name")).agg(F.min(F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), "concept_id")).alias("b"))
    return best.select("lower_name", F.col("b.concept_id").alias("concept_id"))


def r20_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each name typed for a generated unit, chapter or concept resolves to: a concept of that name, else one known by it."""
    units = table(spark, sf_dir, "generated_unit").select("name")
    typed = units.unionByName(chapters(spark, sf_dir, "title").select(F.col("title").alias("name"))).unionByName(concepts(spark, sf_dir, "name").select("name"))
    known = aliases(spark, sf_dir)
    typed = typed.unionByName(known.select(F.col("alias").alias("name"))).where("name is not null").select(F.lower(F.trim("name")).alias("lower_name")).distinct()
    second = known.groupBy(F.lower("alias").alias("lower_name")).agg(F.min("concept_id").alias("by_alias"))
    joined = typed.join(_richest(spark, sf_dir).withColumnRenamed("concept_id", "by_name"), "lower_name", "left").join(second, "lower_name", "left")
    return joined.where("by_name is not null or by_alias is not null").select("lower_name", F.coalesce("by_name", "by_alias").alias("concept_id"), F.when(F.col("by_name").isNotNull(), "exact").otherwise("alias").alias("stage"))


def code_tokens(name: Column) -> Column:
    """Sorted codes in a name (capitals with a digit, ^ or _), with _ read as ^."""
    found = F.regexp_extract_all(name, F.lit(r"(?<![A-Za-z0-9])((?=[A-Z0-9_^]*[0-9_^])[A-Z][A-Z0-9]*(?:[_^][A-Z0-9]+)*)(?![A-Za-z0-9])"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.translate(x, "_", "^"))))


def r23_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other concept of each query concept by vector, and what follows: match, borderline or new (also where codes conflict)."""
    named = concepts(spark, sf_dir, "name").where("name is not null")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where("embedding is not null").join(named.select(F.col("concept_id").alias("vec_id")), "vec_id", "left_semi")
    near = R.vector_search(vectors, "vec_id", "embedding", vectors.where("vec_id % 20 = 0"), 2).where("query <> doc")
    first = near.groupBy("query").agg(F.max(F.struct("score", (-F.col("doc")).alias("d"))).alias("b")).select("query", (-F.col("b.d")).alias("nearest_id"), F.col("b.score").alias("similarity"))
    ends = first.join(named.select(F.col("concept_id").alias("query"), F.col("name").alias("q_name")), "query").join(named.select(F.col("concept_id").alias("nearest_id"), F.col("name").alias("n_name")), "nearest_id")
    conflict = (F.size(code_tokens(F.col("q_name"))) > 0) & (F.size(code_tokens(F.col("n_name"))) > 0) & (code_tokens(F.col("q_name")) != code_tokens(F.col("n_name")))
    action = F.when(conflict, "new").when(F.col("similarity") >= SAME, "match").when(F.col("similarity") >= BORDERLINE, "borderline").otherwise("new")
    return ends.select("query", "nearest_id", "similarity", action.alias("action"))


def r24_new_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that may be registered: none is the name of a concept already, and each goes to one concept."""
    taken = concepts(spark, sf_dir, "name").where("name is not null").select(F.lower("name").alias("lower_alias")).distinct()
    rows = aliases(spark, sf_dir).withColumn("lower_alias", F.lower(F.regexp_replace("alias", r"\s+v?\d+$", "")))
    free = rows.join(taken, "lower_alias", "left_anti")
    return free.groupBy("lower_alias").agg(F.min("concept_id").alias("concept_id"))


def r53_without_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that need aliases: known by no other name (anti join)."""
    return concepts(spark, sf_dir, "name", "concept_type").join(aliases(spark, sf_dir).select("concept_id").distinct(), "concept_id", "left_anti")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(twin, keep): concepts to be merged by spelling rules, each into the smallest concept it is matched with."""
    rows = table(spark, sf_dir, "concept_match").where("match_rule in ('spelling', 'acronym-variant') and concept_id_a <> concept_id_b")
    return rows.groupBy(F.greatest("concept_id_a", "concept_id_b").alias("twin")).agg(F.min(F.least("concept_id_a", "concept_id_b")).alias("keep"))


def r25_merged_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations after twins are merged: both ends rewritten, no self loops, one row per (from, to, type, source), the surest."""
    rows, twins = relations(spark, sf_dir), cut(_merged(spark, sf_dir))
    for end in ("from_id", "to_id"):
        rows = rows.join(twins.toDF(end, "keep"), end, "left").withColumn(end, F.coalesce("keep", end)).drop("keep")
    return rows.where("from_id <> to_id").groupBy("from_id", "to_id", "relation_type", "source_type", "source_id").agg(F.max("confidence").alias("confidence"))


def r28_twin_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of concepts whose names are twins by spelling, by a part in brackets or by initials (equi-joins on keys)."""
    rows = cut(concepts(spark, sf_dir, "name").where("name is not null").select("concept_id", "name", F.regexp_replace(F.lower("name"), "[^a-z0-9]", "").alias("key")))
    keyed = rows.where("key <> ''")
    first = keyed.groupBy("key").agg(F.min("concept_id").alias("first"))
    # one link to the first concept of a spelling joins them all
    spelling = keyed.join(first, "key").where("concept_id > first").select(F.col("first").alias("a"), F.col("concept_id").alias("b"), F.lit("spelling").alias("rule"))
    parts = rows.where(F.col("name").rlike(r"^.+ \(.+\)$")).select(F.col("concept_id").alias("x"), F.explode(F.array(F.regexp_extract("name", r"^(.+) \(.+\)$", 1), F.regexp_extract("name", r"\((.+)\)$", 1))).alias("part"))
    part_key = F.regexp_replace(F.lower("part"), "[^a-z0-9]", "")
    bracket = parts.select("x", part_key.alias("key")).join(first, "key").where("x <> first").select(F.least("x", "first").alias("a"), F.greatest("x", "first").alias("b"), F.lit("parenthetical").alias("rule"))
    letters = F.array_join(F.transform(F.regexp_extract_all("name", F.lit("([A-Za-z0-9]+)"), F.lit(1)), lambda w: F.substring(w, 1, 1)), "")
    long = rows.where(F.size(F.split("name", " ")) > 1).select(F.col("concept_id").alias("x"), F.upper(letters).alias("short"))
    short = rows.where(F.col("name").rlike("^[A-Z][A-Z0-9]{1,5}$")).select(F.col("concept_id").alias("y"), F.col("name").alias("short"))
    acronym = long.join(short, "short").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit("acronym").alias("rule"))
    return spelling.unionByName(bracket).unionByName(acronym).distinct()


def r29_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each name, apart from case and punctuation, the concept that is kept: the best covered one, then the smallest id."""
    covered = both_ends(relations(spark, sf_dir)).groupBy("concept_id").agg(F.count("*").alias("coverage"))
    rows = concepts(spark, sf_dir, "name").where("name is not null").select("concept_id", F.regexp_replace(F.lower("name"), "[^a-z0-9]", "").alias("key")).where("key <> ''").join(covered, "concept_id", "left")
    best = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct((-F.coalesce("coverage", F.lit(0))).alias("c"), "concept_id")).alias("b")).where("n > 1")
    return best.select("key", "n", F.col("b.concept_id").alias("canonical_id"), (-F.col("b.c")).alias("coverage"))


def t_code_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched concepts whose names hold different codes."""
    named = concepts(spark, sf_dir, "name").where("name is not null").select("concept_id", F.array_join(code_tokens(F.col("name")), " ").alias("codes"))
    pairs = table(spark, sf_dir, "concept_match").select(F.least("concept_id_a", "concept_id_b").alias("a"), F.greatest("concept_id_a", "concept_id_b").alias("b")).where("a < b").distinct()
    joined = pairs.join(named.toDF("a", "codes_a"), "a").join(named.toDF("b", "codes_b"), "b")
    return joined.where("codes_a <> '' and codes_b <> '' and codes_a <> codes_b").select("a", "b", "codes_a", "codes_b")


def w03_one_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each concept and source the document of the surest edge."""
    rows = table(spark, sf_dir, "alignment_edge").where("from_doc_section_id is not null and concept_id is not null").select("concept_id", F.col("from_doc_section_id").alias("doc_id"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    order = Window.partitionBy("concept_id", "source").orderBy(F.col("confidence").desc(), "doc_id")
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("concept_id", "source", "doc_id")


def s_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that are both aligned and matched, and those that are aligned only (intersect and except)."""
    aligned = table(spark, sf_dir, "alignment_edge").select("concept_id").where("concept_id is not null")
    matched = table(spark, sf_dir, "concept_match").select(F.explode(F.array("concept_id_a", "concept_id_b")).alias("concept_id")).where("concept_id is not null")
    return aligned.intersect(matched).withColumn("found", F.lit("both")).unionByName(aligned.subtract(matched).withColumn("found", F.lit("aligned only")))


QUERIES = {f.__name__: f for f in (r20_lookup, r23_resolutions, r24_new_aliases, r25_merged_relations, r28_twin_pairs, r29_canonical, r53_without_aliases, t_code_conflicts, w03_one_per_source, s_intersections)}

_C = f"WITH {CHAPTERS}, {CONCEPTS}"
_AL = """al AS (SELECT concept_id, min(alias) AS alias FROM (SELECT c.concept_id, o.name AS alias, c.name FROM (SELECT concept_id_a AS a, concept_id_b AS b FROM concept_match WHERE concept_id_a <> concept_id_b UNION SELECT concept_id_b, concept_id_a FROM concept_match WHERE concept_id_a <> concept_id_b) m JOIN co c ON c.concept_id = a JOIN co o ON o.concept_id = b WHERE lower(o.name) <> lower(c.name)) GROUP BY concept_id, lower(alias))"""
_KEY = "k AS (SELECT concept_id, name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key FROM co WHERE name IS NOT NULL)"
_DG = "dg AS (SELECT concept_id, count(*) AS degree FROM be GROUP BY 1)"


def _codes(name: str) -> str:
    # the letters around a code are checked by splitting at everything that is no part of one
    return f"list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array({name}, '[^A-Za-z0-9_^]+'), lambda x: regexp_full_match(x, '[A-Z][A-Z0-9]*([_^][A-Z0-9]+)*') AND regexp_matches(x, '[0-9_^]')), lambda x: replace(x, '_', '^'))))"


SQL = {
    "r20_lookup": f"""{_C}, {RELATIONS}, {_AL}, {_DG}, ty AS (SELECT DISTINCT lower(trim(name, ' ')) AS lower_name FROM (SELECT name FROM generated_unit UNION ALL SELECT title FROM ch UNION ALL SELECT name FROM co UNION ALL SELECT alias FROM al) WHERE name IS NOT NULL),
ri AS (SELECT lower(name) AS lower_name, concept_id AS by_name FROM co LEFT JOIN dg USING (concept_id) WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY coalesce(degree, 0) DESC, concept_id) = 1), se AS (SELECT lower(alias) AS lower_name, min(concept_id) AS by_alias FROM al GROUP BY 1)
SELECT lower_name, coalesce(by_name, by_alias) AS concept_id, CASE WHEN by_name IS NOT NULL THEN 'exact' ELSE 'alias' END AS stage FROM ty LEFT JOIN ri USING (lower_name) LEFT JOIN se USING (lower_name) WHERE by_name IS NOT NULL OR by_alias IS NOT NULL""",
    "r23_resolutions": f"""{_C}, ve AS (SELECT vec_id, name, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings JOIN co ON concept_id = vec_id WHERE embedding IS NOT NULL AND name IS NOT NULL),
ne AS (SELECT a.vec_id AS query, b.vec_id AS nearest_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity, {_codes("a.name")} AS qc, {_codes("b.name")} AS nc FROM ve a, ve b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.vec_id) = 1)
SELECT query, nearest_id, similarity, CASE WHEN len(qc) > 0 AND len(nc) > 0 AND qc <> nc THEN 'new' WHEN similarity >= 0.90 THEN 'match' WHEN similarity >= 0.75 THEN 'borderline' ELSE 'new' END AS action FROM ne""",
    "r24_new_aliases": rf"{_C}, {_AL}, r AS (SELECT concept_id, lower(regexp_replace(alias, '\s+v?\d+$', '')) AS lower_alias FROM al) SELECT lower_alias, min(concept_id) AS concept_id FROM r WHERE lower_alias NOT IN (SELECT lower(name) FROM co WHERE name IS NOT NULL) GROUP BY 1",
    "r53_without_aliases": f"{_C}, {_AL} SELECT concept_id, name, concept_type FROM co WHERE concept_id NOT IN (SELECT concept_id FROM al)",
    "r25_merged_relations": f"""{_C}, {RELATIONS}, tw AS (SELECT greatest(concept_id_a, concept_id_b) AS twin, min(least(concept_id_a, concept_id_b)) AS keep FROM concept_match WHERE match_rule IN ('spelling', 'acronym-variant') AND concept_id_a <> concept_id_b GROUP BY 1),
m AS (SELECT coalesce(f.keep, from_id) AS from_id, coalesce(t.keep, to_id) AS to_id, relation_type, source_type, source_id, confidence FROM rl LEFT JOIN tw f ON f.twin = from_id LEFT JOIN tw t ON t.twin = to_id) SELECT from_id, to_id, relation_type, source_type, source_id, max(confidence) AS confidence FROM m WHERE from_id <> to_id GROUP BY 1, 2, 3, 4, 5""",
    "r28_twin_pairs": rf"""{_C}, {_KEY}, f AS (SELECT key, min(concept_id) AS first FROM k WHERE key <> '' GROUP BY 1), p AS (SELECT concept_id AS x, unnest([regexp_extract(name, '^(.+) \(.+\)$', 1), regexp_extract(name, '\((.+)\)$', 1)]) AS part FROM k WHERE regexp_full_match(name, '.+ \(.+\)')),
l AS (SELECT concept_id AS x, upper(list_aggregate(list_transform(regexp_extract_all(name, '[A-Za-z0-9]+'), lambda w: w[1]), 'string_agg', '')) AS short FROM k WHERE len(string_split(name, ' ')) > 1), s AS (SELECT concept_id AS y, name AS short FROM k WHERE regexp_full_match(name, '[A-Z][A-Z0-9]{{1,5}}'))
SELECT first AS a, concept_id AS b, 'spelling' AS rule FROM k JOIN f USING (key) WHERE concept_id > first UNION SELECT least(x, first), greatest(x, first), 'parenthetical' FROM p JOIN f ON key = regexp_replace(lower(part), '[^a-z0-9]', '', 'g') WHERE x <> first UNION SELECT least(x, y), greatest(x, y), 'acronym' FROM l JOIN s USING (short)""",
    "r29_canonical": f"{_C}, {RELATIONS}, {_KEY}, {_DG}, r AS (SELECT key, concept_id, coalesce(degree, 0) AS d FROM k LEFT JOIN dg USING (concept_id) WHERE key <> '') SELECT key, count(*) OVER (PARTITION BY key) AS n, concept_id AS canonical_id, d AS coverage FROM r QUALIFY n > 1 AND row_number() OVER (PARTITION BY key ORDER BY d DESC, concept_id) = 1",
    "t_code_conflicts": f"{_C}, n AS (SELECT concept_id, array_to_string({_codes('name')}, ' ') AS codes FROM co WHERE name IS NOT NULL), p AS (SELECT DISTINCT least(concept_id_a, concept_id_b) AS a, greatest(concept_id_a, concept_id_b) AS b FROM concept_match WHERE concept_id_a <> concept_id_b) SELECT a, b, x.codes AS codes_a, y.codes AS codes_b FROM p JOIN n x ON x.concept_id = a JOIN n y ON y.concept_id = b WHERE x.codes <> '' AND y.codes <> '' AND x.codes <> y.codes",
    "w03_one_per_source": "SELECT concept_id, source, doc_id FROM alignment_edge JOIN documents ON doc_id = from_doc_section_id WHERE concept_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY concept_id, source ORDER BY coalesce(confidence, 0) DESC, doc_id) = 1",
    "s_intersections": "WITH a AS (SELECT concept_id FROM alignment_edge WHERE concept_id IS NOT NULL), m AS (SELECT concept_id_a AS concept_id FROM concept_match WHERE concept_id_a IS NOT NULL UNION ALL SELECT concept_id_b FROM concept_match WHERE concept_id_b IS NOT NULL) SELECT concept_id, 'both' AS found FROM (SELECT concept_id FROM a INTERSECT SELECT concept_id FROM m) UNION ALL SELECT concept_id, 'aligned only' FROM (SELECT concept_id FROM a EXCEPT SELECT concept_id FROM m)",
}
