"""Queries p1, p2 and p4 to p8, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import consensus
from foliomill.llm.groups import hash_to_min
from foliomill.llm.leaks import find_leaks
from foliomill.llm.names import entities, same_pairs
from foliomill.llm.reference_list import match_values
from foliomill.llm.sentences import split_sentences
from foliomill.llm.tokens import decode, default_rank_file, encode_corpus
from foliomill.runtime import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of author rows that name the same person or body."""
    return same_pairs(entities(table(spark, sf_dir, "author"), "author_id", "name"), "author_id_a", "author_id_b")


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest author_id of its person or body for each author row (membership, without the pairs)."""
    return entities(table(spark, sf_dir, "author"), "author_id", "name").select(F.col("id").alias("author_id"), F.col("entity").alias("entity_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest concept_id of its group for each linked concept."""
    known = table(spark, sf_dir, "concept").select("concept_id").distinct()
    matches = table(spark, sf_dir, "concept_match").select(F.col("concept_id_a").alias("a"), F.col("concept_id_b").alias("b"))
    for side in ("a", "b"):
        matches = matches.join(known.withColumnRenamed("concept_id", side), side, "left_semi")
    return hash_to_min(matches, "a", "b").select(F.col("vertex").alias("concept_id"), F.col("group").alias("group_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The publisher_ref entry each book's publisher means, or -1."""
    books = table(spark, sf_dir, "book").select("book_id", "publisher", "updated_at").where("book_id is not null")
    # a table of its own, so that the join back can be split where one publisher holds most books
    matched = cut(match_values(books, "publisher", table(spark, sf_dir, "publisher_ref"), "publisher_id", "name"))
    named = books.join(matched.withColumnRenamed("value", "publisher"), "publisher")
    latest = named.groupBy("book_id").agg(F.max(F.struct("updated_at", "entry")).alias("row"))
    return latest.select("book_id", F.coalesce("row.entry", F.lit(-1)).cast("long").alias("publisher_id"))


def p4_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values that name no entry, with the number of rows they stand in."""
    books = table(spark, sf_dir, "book").select("publisher")
    matched = match_values(books, "publisher", table(spark, sf_dir, "publisher_ref"), "publisher_id", "name")
    counts = books.groupBy("publisher").agg(F.count("*").alias("n_rows"))
    return matched.where("entry is null").join(counts, F.col("value") == F.col("publisher")).select("publisher", "n_rows")


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.counted_votes(table(spark, sf_dir, "alignment_vote"), "alignment_edge_id", "sample", "verdict", "confidence", "created_at")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict that holds for each edge voted on."""
    result = consensus.fit(consensus.with_outcomes(_votes(spark, sf_dir)))
    return consensus.verdicts(result).select(F.col("item").alias("alignment_edge_id"), "verdict")


def p5_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of each annotator with its posterior interval."""
    result = consensus.fit(consensus.with_outcomes(_votes(spark, sf_dir)))
    return consensus.reliability(result).withColumnRenamed("who", "sample")


def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes and share of agreeing pairs of each edge."""
    return consensus.item_agreement(_votes(spark, sf_dir)).withColumnRenamed("item", "alignment_edge_id")


def p5_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Krippendorff's alpha over all edges."""
    return consensus.krippendorff(_votes(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document by byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", default_rank_file())


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the ids of each document give its text again, byte for byte (null for null); and how many they are."""
    rank_file = default_rank_file()
    encoded = encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", rank_file)
    decoded = decode(encoded, "ids", rank_file).select("doc_id", F.size("ids").alias("n_ids"), F.md5(F.encode("text", "UTF-8")).alias("decoded"))
    digests = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("digest"))
    return decoded.join(digests, "doc_id").select("doc_id", "n_ids", (F.col("decoded") == F.col("digest")).alias("same"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation item that leaked into them."""
    found = find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_item"), "item_id", "text")
    return found.select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of each document as offsets into its text."""
    return split_sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found,
    "p1_entities": p1_entities,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_misses": p4_misses,
    "p5_found": p5_found,
    "p5_reliability": p5_reliability,
    "p5_agreement": p5_agreement,
    "p5_alpha": p5_alpha,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_found": p7_found,
    "p8_found": p8_found,
}

_VOTES = """
WITH x AS (SELECT alignment_edge_id AS e, sample AS s, created_at, regexp_replace(upper(verdict), '[^A-Z]', '', 'g') AS u FROM alignment_vote WHERE alignment_edge_id IS NOT NULL),
y AS (SELECT e, created_at, s, CASE WHEN u LIKE 'CORROBORAT%' THEN 0 WHEN u LIKE 'CONTRADICT%' THEN 1 WHEN u LIKE 'SUPERSED%' THEN 2 WHEN u LIKE 'UNRELATED%' OR u LIKE 'NOTRELATED%' THEN 3 END AS k FROM x),
v AS (SELECT e, k FROM y QUALIFY row_number() OVER (PARTITION BY e, s ORDER BY created_at DESC NULLS LAST, k DESC NULLS LAST) = 1),
c AS (SELECT e, k, count(*) AS n FROM v WHERE k IS NOT NULL GROUP BY e, k)
"""

SQL = {
    "p2_found": """
WITH RECURSIVE k AS (SELECT DISTINCT concept_id AS id FROM concept),
e AS (SELECT concept_id_a AS a, concept_id_b AS b FROM concept_match WHERE concept_id_a <> concept_id_b AND concept_id_a IN (SELECT id FROM k) AND concept_id_b IN (SELECT id FROM k)),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, o) AS (SELECT a, least(a, b) FROM s UNION SELECT s.b, r.o FROM r JOIN s ON s.a = r.id WHERE r.o < s.b)
SELECT id AS concept_id, min(o) AS group_id FROM r GROUP BY id
""",
    "p5_agreement": f"{_VOTES} SELECT e AS alignment_edge_id, CAST(sum(n) AS BIGINT) AS n_votes, CASE WHEN sum(n) > 1 THEN sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) END AS agreement FROM c GROUP BY e",
    "p5_alpha": f"""{_VOTES}, m AS (SELECT e, sum(n) AS m FROM c GROUP BY e HAVING sum(n) > 1), p AS (SELECT c.*, m.m FROM c JOIN m USING (e)),
i AS (SELECT count(DISTINCT e) AS n_items, CAST(sum(n) AS BIGINT) AS n_votes, sum(n * (m - n) / (m - 1)) AS o FROM p), q AS (SELECT sum(t * t) AS sq FROM (SELECT sum(n) AS t FROM p GROUP BY k))
SELECT n_items, n_votes, 1 - o / ((CAST(n_votes AS DOUBLE) * n_votes - sq) / (n_votes - 1)) AS alpha FROM i, q""",
}
