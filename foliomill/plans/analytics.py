"""Aggregates, windows, joins, entity hygiene, graph walks and text statistics over the knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.functions import text as X
from foliomill.functions.verdicts import label_index
from foliomill.operators import graph as G
from foliomill.plans.common import BOOKS, CHAPTERS, CONCEPTS, books, chapters, concepts
from foliomill.runtime import table


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "book_author").where("book_id is not null and author_id is not null").select("book_id", "author_id", "position").groupBy("book_id", "author_id").agg(F.min("position").alias("position"))


def a11_authors_by_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a book's authors in order of position, then name."""
    named = _links(spark, sf_dir).join(table(spark, sf_dir, "author"), "author_id")
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("position", F.lit(1 << 30)).alias("p"), F.col("name"))))
    return named.groupBy("book_id").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), "; ").alias("authors"))


def a12_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chapter of each content of a book, and how many chapters share it."""
    rows = chapters(spark, sf_dir, "book_id", "content_hash").where("content_hash is not null")
    return rows.groupBy("book_id", "content_hash").agg(F.min("chapter_id").alias("chapter_id"), F.count("*").alias("n_chapters")).where("n_chapters > 1")


def a13_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books and chapters by status of the book."""
    counts = chapters(spark, sf_dir, "book_id").groupBy("book_id").agg(F.count("*").alias("n"))
    joined = books(spark, sf_dir, "status").join(counts, "book_id", "left")
    return joined.groupBy("status").agg(F.count("*").alias("n_books"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chapters"), F.count_if(F.col("n").isNull()).alias("n_empty"))


def a17_majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision of each edge by a strict majority of the planned samples.

    Every sample of an edge was planned; values that are no vote count for nothing. CONTRADICTS and SUPERSEDED
    are one side, and the larger of the two names the verdict. Confidence is the winners' mean times their share.
    """
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0))))
    rows = table(spark, sf_dir, "alignment_vote").where("alignment_edge_id is not null").select("alignment_edge_id", "sample", F.struct("created_at", "verdict", sure.alias("confidence")).alias("row"))
    latest = rows.groupBy("alignment_edge_id", "sample").agg(F.max("row").alias("row")).select("alignment_edge_id", label_index(F.col("row.verdict")).alias("label"), "row.confidence")
    side = {"for": F.col("label") == 0, "against": F.col("label").isin(1, 2), "apart": F.col("label") == 3}
    counts = latest.groupBy("alignment_edge_id").agg(
        F.count("*").alias("n_samples"),
        F.count("label").alias("n_votes"),
        F.count_if(F.col("label") == 2).alias("n_superseded"),
        *[F.count_if(test).alias(f"n_{name}") for name, test in side.items()],
        *[F.coalesce(F.sum(F.when(test, F.col("confidence").cast("decimal(20,9)"))), F.lit(0)).cast("double").alias(f"c_{name}") for name, test in side.items()],
    )
    most = {name: F.col(f"n_{name}") * 2 > F.col("n_samples") for name in side}
    against = F.when(F.col("n_superseded") * 2 > F.col("n_against"), "SUPERSEDED").otherwise("CONTRADICTS")
    decision = F.when(F.col("n_votes") == 0, "NO_DATA").when(most["for"], "CORROBORATES").when(most["against"], against).when(most["apart"], "UNRELATED").otherwise("NO_MAJORITY")
    won = F.when(most["for"], F.col("c_for")).when(most["against"], F.col("c_against")).when(most["apart"], F.col("c_apart")).otherwise(0.0)
    return counts.select("alignment_edge_id", "n_samples", "n_votes", "n_for", "n_against", decision.alias("verdict"), F.round(won / F.col("n_samples"), 3).alias("confidence"))


def a17_majority_of_spelt_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a17_majority_vote, with verdicts told by ``label_index``; values that are no vote are no samples."""
    latest = table(spark, sf_dir, "alignment_vote").where("alignment_edge_id is not null").groupBy("alignment_edge_id", "sample").agg(F.max(F.struct("created_at", "verdict")).alias("row"))
    votes = latest.select("alignment_edge_id", label_index(F.col("row.verdict")).alias("label")).where("label is not null")
    counts = votes.groupBy("alignment_edge_id").agg(F.count("*").alias("n_samples"), F.count_if(F.col("label") == 0).alias("n_for"), F.count_if(F.col("label").isin(1, 2)).alias("n_against"))
    verdict = F.when(F.col("n_for") * 2 > F.col("n_samples"), "CORROBORATES").when(F.col("n_against") * 2 > F.col("n_samples"), "CONTRADICTS").otherwise("UNRELATED")
    return counts.select("alignment_edge_id", "n_samples", "n_for", "n_against", verdict.alias("verdict"))


def a18_edge_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the decision means for each stored edge: update to a relation, delete, or keep where nothing was decided."""
    rows = table(spark, sf_dir, "alignment_edge").select("alignment_edge_id", "relation_type").distinct().join(a17_majority_vote(spark, sf_dir).select("alignment_edge_id", "verdict"), "alignment_edge_id")
    action = F.when(F.col("verdict").isin("CONTRADICTS", "SUPERSEDED", "CORROBORATES"), "update").when(F.col("verdict") == "UNRELATED", "delete").otherwise("keep")
    relation = F.when(F.col("verdict").isin("CONTRADICTS", "SUPERSEDED"), "CONTRADICTS").when(F.col("verdict") == "CORROBORATES", "CORROBORATES")
    return rows.select("alignment_edge_id", "relation_type", action.alias("action"), relation.alias("new_relation"))


def a18_actions_of_spelt_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a18_edge_actions, after a17_majority_of_spelt_votes."""
    return _edge_actions(spark, sf_dir, a17_majority_of_spelt_votes(spark, sf_dir))


def _edge_actions(spark: SparkSession, sf_dir: str, majority: DataFrame) -> DataFrame:
    edges = table(spark, sf_dir, "alignment_edge").select("alignment_edge_id", "relation_type").distinct()
    joined = edges.join(majority.select("alignment_edge_id", "verdict"), "alignment_edge_id", "left")
    action = F.when(F.col("verdict").isNull() | (F.col("verdict") == F.col("relation_type")), "keep").when(F.col("verdict") == "UNRELATED", "delete").otherwise("update")
    return joined.groupBy(action.alias("action"), "relation_type").agg(F.count("*").alias("n"))


def a16_chapter_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per book: consecutive chapter versions that hang on another parent, times the log of the versions."""
    versions = table(spark, sf_dir, "chapter").where("indexed_at is not null").select("chapter_id", "book_id", "indexed_at", "parent_chapter_id").distinct()
    step = Window.partitionBy("chapter_id").orderBy("indexed_at")
    pairs = versions.withColumn("next", F.lead("parent_chapter_id").over(step)).withColumn("more", F.lead("book_id").over(step))
    moved = F.count_if(F.col("more").isNotNull() & ~F.col("next").eqNullSafe(F.col("parent_chapter_id")))
    return pairs.groupBy("book_id").agg(F.count("*").alias("n_versions"), moved.alias("n_moves")).where("n_moves > 0").withColumn("volatility", F.round(F.col("n_moves") * F.log(F.col("n_versions") + 1.0), 6))


def i_pending_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters per book that were never extracted or have been indexed again since."""
    rows = chapters(spark, sf_dir, "book_id", "indexed_at", "extraction_attempted_at")
    stale = F.col("extraction_attempted_at").isNull() | (F.col("extraction_attempted_at") < F.col("indexed_at"))
    return rows.groupBy("book_id").agg(F.count_if(stale).alias("n_pending"), F.count("*").alias("n_chapters"))


def i_orphan_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and edges whose other end is missing, by kind (anti joins)."""
    edges = table(spark, sf_dir, "alignment_edge")
    checks = {
        "edge_chapter": (edges.select(F.col("to_chapter_id").alias("k")), table(spark, sf_dir, "chapter").select(F.col("chapter_id").alias("k"))),
        "edge_concept": (edges.select(F.col("concept_id").alias("k")), table(spark, sf_dir, "concept").select(F.col("concept_id").alias("k"))),
        "edge_document": (edges.select(F.col("from_doc_section_id").alias("k")), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"))),
        "vote_edge": (table(spark, sf_dir, "alignment_vote").select(F.col("alignment_edge_id").alias("k")), edges.select(F.col("alignment_edge_id").alias("k"))),
        "link_book": (table(spark, sf_dir, "book_author").select(F.col("book_id").alias("k")), table(spark, sf_dir, "book").select(F.col("book_id").alias("k"))),
    }
    out = None
    for kind, (left, right) in checks.items():
        part = left.where("k is not null").join(right.distinct(), "k", "left_anti").agg(F.count("*").alias("n_rows"), F.countDistinct("k").alias("n_keys")).select(F.lit(kind).alias("kind"), "n_rows", "n_keys")
        out = part if out is None else out.unionByName(part)
    return out


def w01_first_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three chapters of each author, by book and number."""
    rows = _links(spark, sf_dir).join(chapters(spark, sf_dir, "book_id", "chapter_num"), "book_id")
    order = Window.partitionBy("author_id").orderBy("book_id", "chapter_num", "chapter_id")
    return rows.select("author_id", "book_id", "chapter_id", F.row_number().over(order).alias("n")).where("n <= 3")


def g33_top_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty authors with most books."""
    counts = _links(spark, sf_dir).join(table(spark, sf_dir, "author"), "author_id").groupBy("author_id", "name").agg(F.countDistinct("book_id").alias("n_books"))
    return counts.orderBy(F.col("n_books").desc(), "author_id").limit(20)


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.undirected(table(spark, sf_dir, "concept_match").where("concept_id_a is not null and concept_id_b is not null"), "concept_id_a", "concept_id_b")


def g03_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts within two matches of any concept whose id is divisible by 20."""
    seeds = concepts(spark, sf_dir, "name").where("concept_id % 20 = 0").select(F.col("concept_id").alias("node"))
    return G.neighborhood(_graph(spark, sf_dir), seeds, 2)


def g41_degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of concepts by number of matches."""
    return G.degrees(_graph(spark, sf_dir)).groupBy("degree").agg(F.count("*").alias("n_concepts"))


def r20_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concept that each lower-case name resolves to: most matches, then smallest id."""
    degree = G.degrees(_graph(spark, sf_dir)).withColumnRenamed("src", "concept_id")
    rows = concepts(spark, sf_dir, "name").where("name is not null").join(degree, "concept_id", "left")
    best = rows.groupBy(F.lower("name").alias("lower_name")).agg(F.min(F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), F.col("concept_id"))).alias("b"), F.count("*").alias("n_candidates"))
    return best.select("lower_name", F.col("b.concept_id").alias("concept_id"), "n_candidates")


def r27_orphan_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that share the letters of a name with a smaller id and have no edge (anti join)."""
    rows = concepts(spark, sf_dir, "name").where("name is not null").withColumn("key", F.regexp_replace(F.lower("name"), "[^a-z0-9]", ""))
    first = rows.groupBy("key").agg(F.min("concept_id").alias("first_id"))
    later = rows.join(first, "key").where("concept_id > first_id")
    linked = table(spark, sf_dir, "alignment_edge").select("concept_id").where("concept_id is not null").distinct()
    return later.join(linked, "concept_id", "left_anti").select("concept_id", "first_id", "name")


def r28_acronym_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of concepts of which one's name ends in the initials of the other's words (equi-join on first word and initials)."""
    rows = concepts(spark, sf_dir, "name").where("name is not null")
    words = F.split("name", " ")
    initials = F.array_join(F.transform(F.slice(words, 2, 9), lambda w: F.substring(w, 1, 1)), "")
    long = rows.where(F.col("name").rlike("^[A-Za-z]+( [A-Z][a-z]+){2,4}$")).select(F.col("concept_id").alias("long_id"), F.concat_ws(" ", words[0], initials).alias("key"))
    short = rows.where(F.col("name").rlike("^[A-Za-z]+ [A-Z]{2,4}$")).select(F.col("concept_id").alias("short_id"), F.col("name").alias("key"))
    return short.join(long, "key").select("short_id", "long_id", "key")


def d_domain_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts, pending reviews and queries by domain and type, with subtotals."""
    rows = concepts(spark, sf_dir, "domain", "concept_type", "pending_review", "query_count")
    return rows.rollup("domain", "concept_type").agg(F.count("*").alias("n"), F.count_if(F.col("pending_review")).alias("n_pending"), F.sum("query_count").alias("queries"), F.grouping_id().alias("level"))


def u_unit_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting units by type and the keys of their JSON metadata."""
    rows = table(spark, sf_dir, "generated_unit").where("unit_id is not null").groupBy("unit_id").agg(F.max(F.struct("created_at", "unit_type", "metadata_json")).alias("row"))
    keys = rows.select(F.col("row.unit_type").alias("unit_type"), F.explode_outer(F.expr("json_object_keys(row.metadata_json)")).alias("key"))
    return keys.groupBy("unit_type", "key").agg(F.count("*").alias("n"))


def t_title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significant tokens of chapter titles with their document frequency and weight."""
    rows = chapters(spark, sf_dir, "title")
    tokens = rows.select("chapter_id", F.explode(F.array_distinct(X.significant_tokens(F.col("title")))).alias("token"))
    n = rows.agg(F.count("*").alias("n"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n))
    return df.select("token", "df", F.round(F.log(1 + F.col("n") / (1 + F.col("df"))), 6).alias("weight"))


def t_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronyms of the documents with the number of documents they stand in."""
    found = table(spark, sf_dir, "documents").select(F.explode(X.acronyms(F.col("text"))).alias("acronym"))
    return found.groupBy("acronym").agg(F.count("*").alias("n_documents"))


def t_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs that several concept names share."""
    rows = concepts(spark, sf_dir, "name").where("name is not null").select("concept_id", X.slug(F.col("name")).alias("slug"))
    return rows.groupBy("slug").agg(F.count("*").alias("n"), F.min("concept_id").alias("first_id")).where("n > 1")


def t_first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the first sentence of each counting chapter."""
    return chapters(spark, sf_dir, "content").select("chapter_id", F.length(X.first_sentence(F.col("content"))).alias("n_chars"))


_LK = "lk AS (SELECT book_id, author_id, min(position) AS position FROM book_author WHERE book_id IS NOT NULL AND author_id IS NOT NULL GROUP BY ALL)"
_GR = "gr AS (SELECT concept_id_a AS src, concept_id_b AS dst FROM concept_match WHERE concept_id_a <> concept_id_b UNION SELECT concept_id_b, concept_id_a FROM concept_match WHERE concept_id_a <> concept_id_b)"
_MV = """vt AS (SELECT alignment_edge_id, regexp_replace(upper(verdict), '[^A-Z]', '', 'g') AS u, greatest(0, least(1, coalesce(confidence, 0))) AS c FROM alignment_vote WHERE alignment_edge_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY alignment_edge_id, sample ORDER BY created_at DESC NULLS LAST, verdict DESC NULLS LAST, confidence DESC NULLS LAST) = 1),
vl AS (SELECT alignment_edge_id, c, CASE WHEN u LIKE 'CORROBORAT%' THEN 'F' WHEN u LIKE 'CONTRADICT%' THEN 'C' WHEN u LIKE 'SUPERSED%' THEN 'S' WHEN u LIKE 'UNRELATED%' OR u LIKE 'NOTRELATED%' THEN 'U' END AS l FROM vt),
mc AS (SELECT alignment_edge_id, count(*) AS n_samples, count(l) AS n_votes, count(*) FILTER (l = 'F') AS n_for, count(*) FILTER (l IN ('C', 'S')) AS n_against, count(*) FILTER (l = 'S') AS n_sup, count(*) FILTER (l = 'U') AS n_un,
  coalesce(sum(CAST(c AS DECIMAL(20, 9))) FILTER (l = 'F'), 0) AS cf, coalesce(sum(CAST(c AS DECIMAL(20, 9))) FILTER (l IN ('C', 'S')), 0) AS ca, coalesce(sum(CAST(c AS DECIMAL(20, 9))) FILTER (l = 'U'), 0) AS cu FROM vl GROUP BY 1),
mv AS (SELECT alignment_edge_id, n_samples, n_votes, n_for, n_against, CASE WHEN n_votes = 0 THEN 'NO_DATA' WHEN n_for * 2 > n_samples THEN 'CORROBORATES' WHEN n_against * 2 > n_samples THEN CASE WHEN n_sup > n_against - n_sup THEN 'SUPERSEDED' ELSE 'CONTRADICTS' END WHEN n_un * 2 > n_samples THEN 'UNRELATED' ELSE 'NO_MAJORITY' END AS verdict,
  round(CAST(CASE WHEN n_for * 2 > n_samples THEN cf WHEN n_against * 2 > n_samples THEN ca WHEN n_un * 2 > n_samples THEN cu ELSE 0 END AS DOUBLE) / n_samples, 3) AS confidence FROM mc)"""
_SV = """st AS (SELECT alignment_edge_id, regexp_replace(upper(verdict), '[^A-Z]', '', 'g') AS u FROM alignment_vote WHERE alignment_edge_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY alignment_edge_id, sample ORDER BY created_at DESC NULLS LAST, verdict DESC NULLS LAST) = 1),
sc AS (SELECT alignment_edge_id, count(*) AS n_samples, count(*) FILTER (u LIKE 'CORROBORAT%') AS n_for, count(*) FILTER (u LIKE 'CONTRADICT%' OR u LIKE 'SUPERSED%') AS n_against FROM st
  WHERE u LIKE 'CORROBORAT%' OR u LIKE 'CONTRADICT%' OR u LIKE 'SUPERSED%' OR u LIKE 'UNRELATED%' OR u LIKE 'NOTRELATED%' GROUP BY 1),
sv AS (SELECT *, CASE WHEN n_for * 2 > n_samples THEN 'CORROBORATES' WHEN n_against * 2 > n_samples THEN 'CONTRADICTS' ELSE 'UNRELATED' END AS verdict FROM sc)"""
_STOP = "'a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'can', 'do', 'does', 'for', 'from', 'how', 'in', 'into', 'is', 'it', 'its', 'of', 'on', 'or', 'should', 'that', 'the', 'this', 'to', 'use', 'using', 'vs', 'was', 'what', 'when', 'where', 'which', 'who', 'why', 'will', 'with', 'you', 'your'"
_TITLE_STOP = "'a', 'an', 'and', 'as', 'at', 'be', 'by', 'do', 'for', 'from', 'how', 'in', 'is', 'it', 'its', 'of', 'on', 'or', 'that', 'the', 'this', 'to', 'vs', 'what', 'when', 'where', 'why', 'with', 'your'"
_NO_ACRONYM = "'AND', 'OR', 'OF', 'TO', 'IN', 'AT', 'BY', 'IS', 'IT', 'AS', 'ON', 'AN', 'DO', 'BE', 'GO', 'I', 'A', 'THE', 'FOR', 'NEW', 'THIS', 'WITH'"

QUERIES = {
    f.__name__: f
    for f in (
        a11_authors_by_book, a12_representatives, a13_status_counts, a16_chapter_moves, a17_majority_vote, a17_majority_of_spelt_votes, a18_edge_actions, a18_actions_of_spelt_votes, i_pending_extraction, i_orphan_links, w01_first_chapters,
        g03_neighborhood, g33_top_authors, g41_degree_histogram, r20_name_lookup, r27_orphan_duplicates, r28_acronym_pairs, d_domain_rollup, u_unit_metadata,
        t_title_tokens, t_acronyms, t_slugs, t_first_sentences,
    )
}


def _orphans(kind: str, left: str, lk: str, right: str, rk: str) -> str:
    return f"SELECT '{kind}' AS kind, count(*) AS n_rows, count(DISTINCT {lk}) AS n_keys FROM {left} WHERE {lk} IS NOT NULL AND {lk} NOT IN (SELECT {rk} FROM {right} WHERE {rk} IS NOT NULL)"


SQL = {
    "a11_authors_by_book": f"WITH {_LK} SELECT book_id, string_agg(name, '; ' ORDER BY coalesce(position, 1073741824), name COLLATE \"C\") AS authors FROM lk JOIN author USING (author_id) GROUP BY book_id",
    "a12_representatives": f"WITH {CHAPTERS} SELECT book_id, content_hash, min(chapter_id) AS chapter_id, count(*) AS n_chapters FROM ch WHERE content_hash IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "a13_status_counts": f"WITH {CHAPTERS}, {BOOKS}, c AS (SELECT book_id, count(*) AS n FROM ch GROUP BY 1) SELECT status, count(*) AS n_books, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_chapters, count(*) FILTER (n IS NULL) AS n_empty FROM bk LEFT JOIN c USING (book_id) GROUP BY status",
    "a16_chapter_moves": """WITH v AS (SELECT DISTINCT chapter_id, book_id, indexed_at, parent_chapter_id FROM chapter WHERE indexed_at IS NOT NULL),
p AS (SELECT *, lead(parent_chapter_id) OVER w AS nx, lead(book_id) OVER w AS more FROM v WINDOW w AS (PARTITION BY chapter_id ORDER BY indexed_at)),
g AS (SELECT book_id, count(*) AS n_versions, count(*) FILTER (more IS NOT NULL AND nx IS DISTINCT FROM parent_chapter_id) AS n_moves FROM p GROUP BY 1) SELECT *, round(n_moves * ln(n_versions + 1), 6) AS volatility FROM g WHERE n_moves > 0""",
    "a17_majority_vote": f"WITH {_MV} SELECT * FROM mv",
    "a18_edge_actions": f"""WITH {_MV}, e AS (SELECT DISTINCT alignment_edge_id, relation_type FROM alignment_edge)
SELECT alignment_edge_id, relation_type, CASE WHEN verdict IN ('CONTRADICTS', 'SUPERSEDED', 'CORROBORATES') THEN 'update' WHEN verdict = 'UNRELATED' THEN 'delete' ELSE 'keep' END AS action, CASE WHEN verdict IN ('CONTRADICTS', 'SUPERSEDED') THEN 'CONTRADICTS' WHEN verdict = 'CORROBORATES' THEN 'CORROBORATES' END AS new_relation FROM e JOIN mv USING (alignment_edge_id)""",
    "a17_majority_of_spelt_votes": f"WITH {_SV} SELECT * FROM sv",
    "a18_actions_of_spelt_votes": f"""WITH {_SV}, e AS (SELECT DISTINCT alignment_edge_id, relation_type FROM alignment_edge)
SELECT CASE WHEN verdict IS NULL OR verdict = relation_type THEN 'keep' WHEN verdict = 'UNRELATED' THEN 'delete' ELSE 'update' END AS action, relation_type, count(*) AS n FROM e LEFT JOIN sv USING (alignment_edge_id) GROUP BY 1, 2""",
    "i_pending_extraction": f"WITH {CHAPTERS} SELECT book_id, count(*) FILTER (extraction_attempted_at IS NULL OR extraction_attempted_at < indexed_at) AS n_pending, count(*) AS n_chapters FROM ch GROUP BY 1",
    "i_orphan_links": " UNION ALL ".join(
        _orphans(*x)
        for x in (
            ("edge_chapter", "alignment_edge", "to_chapter_id", "chapter", "chapter_id"), ("edge_concept", "alignment_edge", "concept_id", "concept", "concept_id"),
            ("edge_document", "alignment_edge", "from_doc_section_id", "documents", "doc_id"), ("vote_edge", "alignment_vote", "alignment_edge_id", "alignment_edge", "alignment_edge_id"),
            ("link_book", "book_author", "book_id", "book", "book_id"),
        )
    ),
    "w01_first_chapters": f"WITH {CHAPTERS}, {_LK} SELECT author_id, book_id, chapter_id, CAST(row_number() OVER (PARTITION BY author_id ORDER BY book_id, chapter_num NULLS FIRST, chapter_id) AS INTEGER) AS n FROM lk JOIN ch USING (book_id) QUALIFY n <= 3",
    "g33_top_authors": f"WITH {_LK} SELECT author_id, name, count(DISTINCT book_id) AS n_books FROM lk JOIN author USING (author_id) GROUP BY 1, 2 ORDER BY n_books DESC, author_id LIMIT 20",
    "g03_neighborhood": f"WITH {CONCEPTS}, {_GR}, s AS (SELECT concept_id AS node FROM co WHERE concept_id % 20 = 0), a AS (SELECT node, 0 AS depth FROM s UNION ALL SELECT dst, 1 FROM s JOIN gr ON src = node UNION ALL SELECT h.dst, 2 FROM s JOIN gr g ON g.src = node JOIN gr h ON h.src = g.dst) SELECT node, min(depth) AS depth FROM a GROUP BY node",
    "g41_degree_histogram": f"WITH {_GR}, d AS (SELECT src, count(*) AS degree FROM gr GROUP BY 1) SELECT degree, count(*) AS n_concepts FROM d GROUP BY 1",
    "r20_name_lookup": f"WITH {CONCEPTS}, {_GR}, d AS (SELECT src, count(*) AS degree FROM gr GROUP BY 1), x AS (SELECT lower(name) AS lower_name, concept_id, coalesce(degree, 0) AS dg FROM co LEFT JOIN d ON src = concept_id WHERE name IS NOT NULL) SELECT lower_name, concept_id, count(*) OVER (PARTITION BY lower_name) AS n_candidates FROM x QUALIFY row_number() OVER (PARTITION BY lower_name ORDER BY dg DESC, concept_id) = 1",
    "r27_orphan_duplicates": f"WITH {CONCEPTS}, k AS (SELECT concept_id, name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key FROM co WHERE name IS NOT NULL), x AS (SELECT concept_id, min(concept_id) OVER (PARTITION BY key) AS first_id, name FROM k) SELECT * FROM x WHERE concept_id > first_id AND concept_id NOT IN (SELECT concept_id FROM alignment_edge WHERE concept_id IS NOT NULL)",
    "r28_acronym_pairs": f"WITH {CONCEPTS}, l AS (SELECT concept_id AS long_id, string_split(name, ' ') AS ws FROM co WHERE regexp_full_match(name, '[A-Za-z]+( [A-Z][a-z]+){{2,4}}')), m AS (SELECT long_id, ws[1] || ' ' || list_aggregate(list_transform(ws[2:], lambda x: x[1]), 'string_agg', '') AS key FROM l), s AS (SELECT concept_id AS short_id, name AS key FROM co WHERE regexp_full_match(name, '[A-Za-z]+ [A-Z]{{2,4}}')) SELECT short_id, long_id, key FROM s JOIN m USING (key)",
    "d_domain_rollup": f"WITH {CONCEPTS} SELECT domain, concept_type, count(*) AS n, count(*) FILTER (pending_review) AS n_pending, CAST(sum(query_count) AS BIGINT) AS queries, CAST(grouping_id(domain, concept_type) AS BIGINT) AS level FROM co GROUP BY ROLLUP (domain, concept_type)",
    "u_unit_metadata": "WITH u AS (SELECT * FROM generated_unit WHERE unit_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY created_at DESC NULLS LAST) = 1), k AS (SELECT unit_type, CASE WHEN metadata_json IS NULL OR NOT json_valid(metadata_json) THEN [NULL] WHEN len(json_keys(metadata_json)) = 0 THEN [NULL] ELSE json_keys(metadata_json) END AS ks FROM u), e AS (SELECT unit_type, unnest(ks) AS key FROM k) SELECT unit_type, key, count(*) AS n FROM e GROUP BY 1, 2",
    "t_title_tokens": f"WITH {CHAPTERS}, t AS (SELECT DISTINCT chapter_id, unnest(list_filter(list_transform(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9_-]+'), lambda x: lower(x)), lambda x: x NOT IN ({_TITLE_STOP}))) AS token FROM ch) SELECT token, count(*) AS df, round(ln(1 + (SELECT count(*) FROM ch) / (1 + count(*))), 6) AS weight FROM t GROUP BY token",
    "t_acronyms": "WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\b([A-Z][A-Z0-9]{1,5})\\b', 1))) AS acronym FROM documents) SELECT acronym, count(*) AS n_documents FROM t WHERE acronym NOT IN (" + _NO_ACRONYM + ") GROUP BY 1",
    "t_slugs": f"WITH {CONCEPTS}, s AS (SELECT concept_id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM co WHERE name IS NOT NULL) SELECT slug, count(*) AS n, min(concept_id) AS first_id FROM s GROUP BY 1 HAVING count(*) > 1",
    "t_first_sentences": f"WITH {CHAPTERS} SELECT chapter_id, CAST(length(trim(regexp_extract(content, '^\\s*([^.!?\\n]+[.!?]?)', 1))) AS INTEGER) AS n_chars FROM ch",
}
