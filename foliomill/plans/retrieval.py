"""Retrieval and ranking queries. Queries are the names of every concept whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import text as X
from foliomill.operators import retrieval as R
from foliomill.operators import vector_index as V
from foliomill.plans.common import CHAPTERS, CONCEPTS, chapters, concepts
from foliomill.runtime import cut, table

TOP = 10
#: The day that ages are counted to.
TODAY = "2026-01-01"
WEIGHTS = {"relevance": 0.4, "recency": 0.2, "alignment": 0.2, "corroboration": 0.2}


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, term) of the query set."""
    rows = concepts(spark, sf_dir, "name").where("concept_id % 20 = 0")
    return rows.select(F.col("concept_id").alias("query"), F.explode(X.index_terms(F.col("name"))).alias("term")).distinct()


def chapter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.versions(table(spark, sf_dir, "chapter"), "chapter_id", F.col("indexed_at"), F.col("content"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.versions(table(spark, sf_dir, "documents"), "doc_id", None, F.concat_ws(" ", "title", "text"))


def r01_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and term frequency of each term of the chapter index."""
    index = R.postings(chapters(spark, sf_dir, "content"), "chapter_id", F.col("content"))
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def r03_bm25_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best chapters of each query by BM25 over the content."""
    return R.bm25(chapter_texts(spark, sf_dir), asked(spark, sf_dir), TOP)


def r04_bm25_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best documents of each query by BM25 over title and text."""
    return R.bm25(document_texts(spark, sf_dir), asked(spark, sf_dir), TOP)


def r06_vss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best vectors by cosine for every vector whose id is divisible by 20, against all."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return R.vector_search(vectors, "vec_id", "embedding", vectors.where("vec_id % 20 = 0"), TOP)


def r08_indexed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As r06_vss through an index of cells, of which a query visits those next to it."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return V.indexed_search(vectors, "vec_id", "embedding", vectors.where("vec_id % 20 = 0"), TOP)


def r08_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact nearest vectors that the index finds."""
    return V.recall(r08_indexed_vectors(spark, sf_dir), r06_vss(spark, sf_dir))


def r12_title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters by the share of inverse-frequency weight of the query's terms that stands in the title."""
    return R.title_search(chapters(spark, sf_dir, "title").withColumnRenamed("chapter_id", "doc"), asked(spark, sf_dir), TOP)


def r30_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of content and title search."""
    return R.rrf({"bm25": r03_bm25_chapters(spark, sf_dir), "title": r12_title_search(spark, sf_dir)}, TOP)


def r40_alignment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment share, corroboration and recency of each chapter that edges point to."""
    edges = table(spark, sf_dir, "alignment_edge").where("to_chapter_id is not null")
    stats = edges.groupBy(F.col("to_chapter_id").alias("chapter_id")).agg(F.count_if(F.col("relation_type") == "CORROBORATES").alias("n_for"), F.count_if(F.col("relation_type") == "CONTRADICTS").alias("n_against"))
    aged = chapters(spark, sf_dir, "indexed_at").join(stats, "chapter_id")
    days = F.datediff(F.to_date(F.lit(TODAY)), F.col("indexed_at").cast("date")).cast("double")
    return aged.select(
        "chapter_id",
        "n_for",
        "n_against",
        F.round(R.alignment_share(F.col("n_for"), F.col("n_against")), 6).alias("alignment"),
        F.round(R.corroboration(F.col("n_for")), 6).alias("corroboration"),
        F.round(R.recency(days), 6).alias("recency"),
    )


def r45_search_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end: two modalities, fusion, relevance, alignment and recency, combined; best five per query."""
    content, title = cut(r03_bm25_chapters(spark, sf_dir)), cut(r12_title_search(spark, sf_dir))
    fused = R.rrf({"bm25": content, "title": title}, TOP)
    scored = fused.select("query", "doc", "rrf").join(content.select("query", "doc", F.col("score").alias("bm25")), ["query", "doc"], "left").join(title.select("query", "doc", F.col("score").alias("title")), ["query", "doc"], "left")
    signals = r40_alignment_scores(spark, sf_dir).withColumnRenamed("chapter_id", "doc").select("doc", "alignment", "corroboration")
    days = F.datediff(F.to_date(F.lit(TODAY)), F.col("indexed_at").cast("date")).cast("double")
    ages = chapters(spark, sf_dir, "indexed_at").select(F.col("chapter_id").alias("doc"), R.recency(days).alias("recency"))
    joined = scored.join(signals, "doc", "left").join(ages, "doc")
    title_score = F.coalesce("title", F.lit(0.0))
    parts = {
        "relevance": R.relevance(F.coalesce("bm25", F.lit(0.0)), F.lit(0.0), F.lit(0.0), title_score, title_score),
        "recency": F.col("recency"),
        "alignment": F.coalesce("alignment", F.lit(0.5)),
        "corroboration": F.coalesce("corroboration", F.lit(0.0)),
    }
    ranked = joined.select("query", "doc", "rrf", F.round(R.combined(parts, WEIGHTS), 4).alias("combined"))
    return R.top_per(ranked, "query", [F.col("combined").desc(), F.col("rrf").desc(), F.col("doc")], 5)


_STOP = "'a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'can', 'do', 'does', 'for', 'from', 'how', 'in', 'into', 'is', 'it', 'its', 'of', 'on', 'or', 'should', 'that', 'the', 'this', 'to', 'use', 'using', 'vs', 'was', 'what', 'when', 'where', 'which', 'who', 'why', 'will', 'with', 'you', 'your'"


def _terms(expr: str) -> str:
    return f"list_filter(regexp_extract_all(lower({expr}), '[a-z]+'), lambda t: t NOT IN ({_STOP}))"


_ASKED = f"{CONCEPTS}, q AS (SELECT DISTINCT concept_id AS query, unnest({_terms('name')}) AS term FROM co WHERE concept_id % 20 = 0)"


def _postings(source: str, key: str, expr: str) -> str:
    return f"t AS (SELECT {key} AS doc, unnest({_terms(expr)}) AS term FROM {source}), p AS (SELECT doc, term, count(*) AS tf FROM t GROUP BY doc, term)"


_BM25 = f"""l AS (SELECT doc, sum(tf) AS len FROM p GROUP BY doc), s AS (SELECT count(*) AS n, avg(len) AS al FROM l), d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
b AS (SELECT query, p.doc, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * {R.K1 + 1} / (tf + {R.K1} * ({1 - R.B} + {R.B} * len / al))), 6) AS score FROM q JOIN p USING (term) JOIN d USING (term) JOIN l ON l.doc = p.doc, s GROUP BY query, p.doc),
bm AS (SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM b QUALIFY rank <= {TOP})"""
_TITLE = f"""tt AS (SELECT chapter_id AS doc, unnest({_terms("title")}) AS term FROM ch), tp AS (SELECT DISTINCT doc, term FROM tt), td AS (SELECT term, count(*) AS df FROM tp GROUP BY term),
tw AS (SELECT query, term, coalesce(ln(1 + (SELECT count(*) FROM ch) / (1 + df)), 0) AS w FROM q LEFT JOIN td USING (term)),
ts AS (SELECT query, doc, round(sum(w) / any_value(aw), 6) AS score FROM (SELECT *, sum(w) OVER (PARTITION BY query) AS aw FROM tw) JOIN tp USING (term) WHERE w > 0 GROUP BY query, doc),
ti AS (SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM ts QUALIFY rank <= {TOP})"""
_RRF = f"""fu AS (SELECT query, doc, round(sum(1.0 / ({R.RRF} + rank)), 9) AS rrf, count(*) AS n_modalities FROM (SELECT * FROM bm UNION ALL SELECT * FROM ti) GROUP BY query, doc),
rr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY rrf DESC, doc) AS INTEGER) AS rank FROM fu QUALIFY rank <= {TOP})"""
_AGE = f"CAST(date_diff('day', CAST(indexed_at AS DATE), DATE '{TODAY}') AS DOUBLE)"
_RECENCY = f"CASE WHEN {_AGE} IS NULL THEN 0.5 WHEN {_AGE} <= 0 THEN 1.0 ELSE greatest(0.2, exp(-ln(2) * {_AGE} / 730)) END"
_ALIGN = f"""es AS (SELECT to_chapter_id AS chapter_id, count(*) FILTER (relation_type = 'CORROBORATES') AS n_for, count(*) FILTER (relation_type = 'CONTRADICTS') AS n_against FROM alignment_edge WHERE to_chapter_id IS NOT NULL GROUP BY 1),
al AS (SELECT chapter_id, n_for, n_against, round(CASE WHEN n_for + n_against = 0 THEN 0.5 ELSE n_for / (n_for + n_against) END, 6) AS alignment, round(1 - exp(-n_for / 3.0), 6) AS corroboration, round({_RECENCY}, 6) AS recency FROM ch JOIN es USING (chapter_id))"""
_CHAPTER_INDEX = _postings("ch", "chapter_id", "content")

QUERIES = {f.__name__: f for f in (r01_postings, r03_bm25_chapters, r04_bm25_sections, r06_vss, r08_indexed_vectors, r08_recall, r12_title_search, r30_rrf, r40_alignment_scores, r45_search_chapters)}

SQL = {
    "r01_postings": f"WITH {CHAPTERS}, {_CHAPTER_INDEX} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term",
    "r03_bm25_chapters": f"WITH {CHAPTERS}, {_ASKED}, {_CHAPTER_INDEX}, {_BM25} SELECT * FROM bm",
    "r04_bm25_sections": f"WITH {_ASKED}, {_postings('documents', 'doc_id', chr(99) + 'oncat_ws(chr(32), title, text)')}, {_BM25} SELECT * FROM bm",
    "r06_vss": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL)
SELECT a.vec_id AS query, b.vec_id AS doc, round(list_cosine_similarity(a.e, b.e), 6) AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.vec_id) AS INTEGER) AS rank
FROM v a, v b WHERE a.vec_id % 20 = 0 QUALIFY rank <= {TOP}""",
    "r12_title_search": f"WITH {CHAPTERS}, {_ASKED}, {_TITLE} SELECT * FROM ti",
    "r30_rrf": f"WITH {CHAPTERS}, {_ASKED}, {_CHAPTER_INDEX}, {_BM25}, {_TITLE}, {_RRF} SELECT * FROM rr",
    "r40_alignment_scores": f"WITH {CHAPTERS}, {_ALIGN} SELECT * FROM al",
    "r45_search_chapters": f"""WITH {CHAPTERS}, {_ASKED}, {_CHAPTER_INDEX}, {_BM25}, {_TITLE}, {_RRF}, {_ALIGN},
x AS (SELECT rr.query, rr.doc, rr.rrf, coalesce(bm.score, 0) AS b, coalesce(ti.score, 0) AS t, coalesce(al.alignment, 0.5) AS a, coalesce(al.corroboration, 0) AS c, {_RECENCY} AS r
  FROM rr JOIN ch ON ch.chapter_id = rr.doc LEFT JOIN bm ON bm.query = rr.query AND bm.doc = rr.doc LEFT JOIN ti ON ti.query = rr.query AND ti.doc = rr.doc LEFT JOIN al ON al.chapter_id = rr.doc),
y AS (SELECT *, greatest(1 - exp(-b / 5), 0.5 * t) * (1 + 0.8 * t) AS raw FROM x),
z AS (SELECT query, doc, rrf, round({WEIGHTS["relevance"]} * (CASE WHEN raw <= 0.85 THEN raw ELSE 0.85 + 0.15 * (1 - exp(-(raw - 0.85) / 0.5)) END) + {WEIGHTS["recency"]} * r + {WEIGHTS["alignment"]} * a + {WEIGHTS["corroboration"]} * c, 4) AS combined FROM y)
SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY combined DESC, rrf DESC, doc) AS INTEGER) AS rank FROM z QUALIFY rank <= 5""",
}
