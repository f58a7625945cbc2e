"""Typed relations between concepts, derived from the alignment edges in Spark and in SQL alike.

Two concepts are related where alignment edges name them one after the other: in neighbouring
chapters of a book (source_type 'chapter') or in neighbouring documents of a source ('doc_section');
the later one points to the earlier one. Matched concepts are related too ('match', by rule), which
gives the graph a hub. Neighbours are looked for within stretches of ``STRETCH``
chapter numbers or document ids, so a book or source with very many rows is no single group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.plans.common import chapters, concepts
from foliomill.runtime import table

STRETCH = 64
#: The relation that each rule of a match stands for.
RULES = {"acronym": "REQUIRES", "acronym-variant": "REQUIRES", "parenthetical": "EXTENDS", "spelling": "EXTENDS", "embedding": "IMPLEMENTS", "reviewer": "CONTRASTS_WITH"}


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored alignment edges, each once."""
    columns = ("concept_id", "from_doc_section_id", "to_chapter_id", "to_doc_section_id", "relation_type", "confidence")
    rows = table(spark, sf_dir, "alignment_edge").groupBy("alignment_edge_id").agg(F.max(F.struct("created_at", *columns)).alias("row"))
    return rows.select("alignment_edge_id", *[F.col(f"row.{c}").alias(c) for c in columns])


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_id, to_id, relation_type, confidence, source_type, source_id)."""
    rows = edges(spark, sf_dir).select("alignment_edge_id", "concept_id", "relation_type", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.col("to_chapter_id").alias("chapter_id"), F.col("from_doc_section_id").alias("doc_id"))
    in_books = rows.join(chapters(spark, sf_dir, "book_id", "chapter_num"), "chapter_id")
    by_book = Window.partitionBy("book_id", F.expr(f"chapter_num div {STRETCH}")).orderBy("chapter_num", "chapter_id", "alignment_edge_id")
    in_sources = rows.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    by_source = Window.partitionBy("source", F.expr(f"doc_id div {STRETCH}")).orderBy("doc_id", "alignment_edge_id")
    parts = [(in_books, by_book, "chapter", "chapter_id"), (in_sources, by_source, "doc_section", "doc_id")]
    pairs = [df.select(F.col("concept_id").alias("from_id"), F.lag("concept_id").over(order).alias("to_id"), F.col("relation_type").alias("aligned"), "confidence", F.lit(kind).alias("source_type"), F.col(key).alias("source_id")) for df, order, kind, key in parts]
    found = pairs[0].unionByName(pairs[1]).where("to_id is not null and from_id <> to_id")
    known = concepts(spark, sf_dir, "concept_type", "domain")
    ends = [known.select(F.col("concept_id").alias(f"{end}_id"), F.col("concept_type").alias(f"{end}_type"), F.col("domain").alias(f"{end}_domain")) for end in ("from", "to")]
    typed = found.join(ends[0], "from_id").join(ends[1], "to_id")
    kind = F.when(F.col("aligned") == "CONTRADICTS", "CONTRASTS_WITH").when(F.col("to_type") == "Pattern", "IMPLEMENTS").when(F.col("from_domain") == F.col("to_domain"), "EXTENDS").otherwise("REQUIRES")
    neighbours = typed.select("from_id", "to_id", kind.alias("relation_type"), "confidence", "source_type", "source_id")
    rule = F.coalesce(*[F.when(F.col("match_rule") == name, kind) for name, kind in RULES.items()])
    matches = table(spark, sf_dir, "concept_match").select(F.col("concept_id_a").alias("from_id"), F.col("concept_id_b").alias("to_id"), rule.alias("relation_type"), F.coalesce("similarity", F.lit(0.5)).alias("confidence"), F.lit("match").alias("source_type"), F.lit(None).cast("long").alias("source_id"))
    for end in ("from_id", "to_id"):
        matches = matches.join(known.select(F.col("concept_id").alias(end)), end, "left_semi")
    return neighbours.unionByName(matches.where("from_id <> to_id and relation_type is not null").distinct())


def both_ends(rows: DataFrame) -> DataFrame:
    """Each relation once for each of its concepts: (concept_id, other_id, ...)."""
    rest = [c for c in rows.columns if c not in ("from_id", "to_id")]
    return rows.select(F.col("from_id").alias("concept_id"), F.col("to_id").alias("other_id"), *rest).unionByName(rows.select(F.col("to_id").alias("concept_id"), F.col("from_id").alias("other_id"), *rest))


#: The same in SQL, as CTEs over CHAPTERS and CONCEPTS.
RELATIONS = f"""ed AS (SELECT * FROM alignment_edge QUALIFY row_number() OVER (PARTITION BY alignment_edge_id ORDER BY created_at DESC NULLS LAST, concept_id DESC NULLS LAST) = 1),
rc AS (SELECT concept_id AS from_id, lag(concept_id) OVER (PARTITION BY book_id, chapter_num // {STRETCH} ORDER BY chapter_num, chapter_id, alignment_edge_id) AS to_id, relation_type AS aligned, coalesce(confidence, 0.5) AS confidence, 'chapter' AS source_type, chapter_id AS source_id FROM ed JOIN ch ON chapter_id = to_chapter_id),
rd AS (SELECT concept_id, lag(concept_id) OVER (PARTITION BY source, doc_id // {STRETCH} ORDER BY doc_id, alignment_edge_id), relation_type, coalesce(confidence, 0.5), 'doc_section', doc_id FROM ed JOIN documents ON doc_id = from_doc_section_id),
rl AS (SELECT from_id, to_id, CASE WHEN aligned = 'CONTRADICTS' THEN 'CONTRASTS_WITH' WHEN t.concept_type = 'Pattern' THEN 'IMPLEMENTS' WHEN f.domain = t.domain THEN 'EXTENDS' ELSE 'REQUIRES' END AS relation_type, confidence, source_type, source_id
  FROM (SELECT * FROM rc UNION ALL SELECT * FROM rd) r JOIN co f ON f.concept_id = from_id JOIN co t ON t.concept_id = to_id WHERE to_id IS NOT NULL AND from_id <> to_id
  UNION ALL SELECT DISTINCT concept_id_a, concept_id_b, CASE match_rule WHEN 'acronym' THEN 'REQUIRES' WHEN 'acronym-variant' THEN 'REQUIRES' WHEN 'parenthetical' THEN 'EXTENDS' WHEN 'spelling' THEN 'EXTENDS' WHEN 'embedding' THEN 'IMPLEMENTS' WHEN 'reviewer' THEN 'CONTRASTS_WITH' END AS rule, coalesce(similarity, 0.5), 'match', NULL
  FROM concept_match WHERE concept_id_a <> concept_id_b AND rule IS NOT NULL AND concept_id_a IN (SELECT concept_id FROM co) AND concept_id_b IN (SELECT concept_id FROM co)),
be AS (SELECT from_id AS concept_id, to_id AS other_id, relation_type, confidence, source_type, source_id FROM rl UNION ALL SELECT to_id, from_id, relation_type, confidence, source_type, source_id FROM rl)"""
