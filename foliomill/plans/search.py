"""Search over chapters and documents end to end: nine modalities, fusion, six weight profiles, two rankers.

Queries are the names of every concept whose id is divisible by 20. A result is (kind, id) with kind
'chapter' or 'doc_section' (a document). Vectors stand for whatever has their number as its id: the
query concept, chapters and documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.functions import text as X
from foliomill.operators import retrieval as R
from foliomill.plans import retrieval as PR
from foliomill.plans.analytics import _GR, _graph
from foliomill.plans.common import BOOKS, CHAPTERS, CONCEPTS, _latest, books, chapters, concepts
from foliomill.runtime import cut, small_or_shuffled, table

#: Results of a modality, of the pool that is scored and of the answer (fixed values).
PER_MODALITY, POOL, LIMIT = 20, 25, 5
#: Different results up to so many are broadcast to what is known of them; more are shuffled.
MAX_RESULTS = 200_000
#: Weights of recency, alignment, relevance, corroboration and authority (fixed values).
PROFILES = {
    "balanced_interactive": (0.10, 0.10, 0.45, 0.15, 0.20),
    "currency_critical_interactive": (0.40, 0.25, 0.20, 0.10, 0.05),
    "foundational_interactive": (0.05, 0.10, 0.35, 0.30, 0.20),
    "skill_recent_doc": (0.30, 0.30, 0.25, 0.05, 0.10),
    "skill_consensus": (0.05, 0.10, 0.30, 0.35, 0.20),
    "skill_authority": (0.05, 0.10, 0.25, 0.10, 0.50),
}
#: Words of a query that ask for the reference of an API (fixed values).
API_WORDS = ("api", "endpoint", "endpoints", "request", "response", "parameter", "parameters", "rest", "http", "curl", "sdk", "payload", "schema")
#: Factors of API pages for other queries and of titles of another year, least relevance of a full title match, BM25 below which results are thin, neutral corroboration (fixed values).
API_FACTOR, YEAR_FACTOR, FULL_TITLE, THIN, NEUTRAL = 0.85, 0.9, 0.95, 2.5, 0.5
MODALITIES = {"fts": ("chapter", "doc_section"), "vss": ("chapter", "doc_section"), "graph": ("chapter", "doc_section"), "title": ("chapter", "doc_section"), "api": ("doc_section",)}


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, name, api) of the query set; ``api``: whether it asks for the reference of an API."""
    rows = concepts(spark, sf_dir, "name").where("concept_id % 20 = 0 and name is not null")
    words = F.regexp_extract_all(F.lower("name"), F.lit("([a-z0-9_']+)"), F.lit(1))
    return rows.select(F.col("concept_id").alias("query"), "name", F.arrays_overlap(words, F.array(*[F.lit(w) for w in API_WORDS])).alias("api"))


def r05_api_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over the documents of API sources, for queries that ask for the reference of an API."""
    asking = _queries(spark, sf_dir).where("api").select("query")
    rows = R.versions(table(spark, sf_dir, "documents").where(F.col("source").startswith("api:")), "doc_id", None, F.concat_ws(" ", "title", "text"))
    return R.bm25(rows, PR.asked(spark, sf_dir).join(asking, "query", "left_semi"), PER_MODALITY)


def _vectors(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where("embedding is not null")
    queries = vectors.join(_queries(spark, sf_dir).select(F.col("query").alias("vec_id")), "vec_id", "left_semi")
    return R.vector_search(vectors.join(rows.toDF("vec_id").distinct(), "vec_id", "left_semi"), "vec_id", "embedding", queries, PER_MODALITY)


def r07_vss_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest chapters of each query by exact cosine."""
    return _vectors(spark, sf_dir, table(spark, sf_dir, "chapter").select("chapter_id"))


def r07_vss_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest documents of each query by exact cosine."""
    return _vectors(spark, sf_dir, table(spark, sf_dir, "documents").select("doc_id"))


def _graph_search(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    queries = _queries(spark, sf_dir).select("query")
    near = queries.join(_graph(spark, sf_dir), F.col("query") == F.col("src")).select("query", F.col("dst").alias("concept_id"))
    wanted = queries.select("query", F.col("query").alias("concept_id")).unionByName(near).distinct()
    edges = table(spark, sf_dir, "alignment_edge").where(f"{column} is not null and concept_id is not null").select("concept_id", F.col(column).alias("doc"))
    hits = wanted.join(edges, "concept_id").groupBy("query", "doc").agg(F.countDistinct("concept_id").alias("hits"), F.count("*").alias("mentions"))
    return R.top_per(hits.select("query", "doc", F.round(F.col("hits") + 0.1 * F.col("mentions"), 6).alias("score")), "query", [F.col("score").desc(), F.col("doc")], PER_MODALITY)


def r11_graph_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each query by edges of its concept and of those matched with it: distinct concepts + 0.1 x mentions."""
    return _graph_search(spark, sf_dir, "from_doc_section_id")


def r13_title_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the share of the weight of the query's words that stands in the title."""
    return R.title_search(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "title"), PR.asked(spark, sf_dir), PER_MODALITY)


def r14_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, modality, kind, doc, score, rank) of all nine modalities."""
    terms = cut(PR.asked(spark, sf_dir))
    found = {
        ("fts", "chapter"): R.bm25(PR.chapter_texts(spark, sf_dir), terms, PER_MODALITY),
        ("fts", "doc_section"): R.bm25(PR.document_texts(spark, sf_dir), terms, PER_MODALITY),
        ("vss", "chapter"): r07_vss_chapters(spark, sf_dir),
        ("vss", "doc_section"): r07_vss_documents(spark, sf_dir),
        ("graph", "chapter"): _graph_search(spark, sf_dir, "to_chapter_id"),
        ("graph", "doc_section"): r11_graph_documents(spark, sf_dir),
        ("title", "chapter"): R.title_search(chapters(spark, sf_dir, "title").withColumnRenamed("chapter_id", "doc"), terms, PER_MODALITY),
        ("title", "doc_section"): r13_title_documents(spark, sf_dir),
        ("api", "doc_section"): r05_api_search(spark, sf_dir),
    }
    return reduce(DataFrame.unionByName, [df.select("query", F.lit(name).alias("modality"), F.lit(kind).alias("kind"), "doc", "score", "rank") for (name, kind), df in found.items()])


def r30_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of each query: reciprocal rank fusion over (kind, doc), with the best score of each modality."""
    return _pool(cut(r14_fanout(spark, sf_dir)))


def _pool(fanout: DataFrame) -> DataFrame:
    scores = [F.max(F.when(F.col("modality") == name, F.col("score"))).alias(name) for name in MODALITIES]
    fused = fanout.groupBy("query", "kind", "doc").agg(F.round(F.sum(1.0 / (R.RRF + F.col("rank"))), 9).alias("rrf"), *scores)
    return R.top_per(fused, "query", [F.col("rrf").desc(), F.col("kind"), F.col("doc")], POOL)


def _pages(spark: SparkSession, sf_dir: str, results: DataFrame) -> DataFrame:
    """(kind, doc, title, excerpt, book_title, day, authority, api_page) of what stands in a table ``results`` (kind, doc).

    Other rows are dropped and contents are cut to the excerpt before anything is shuffled.
    """

    def wanted(name: str, key: str, kind: str) -> DataFrame:
        ids = results.where(F.col("kind") == kind).select(F.col("doc").alias(key)).distinct()
        return table(spark, sf_dir, name).join(small_or_shuffled(ids, MAX_RESULTS), key, "left_semi")

    shelf = books(spark, sf_dir, "title", "publication_date", "publisher").select("book_id", F.col("title").alias("book_title"), F.col("publication_date").alias("day"), X.authority(F.col("publisher")).alias("authority"))
    texts = wanted("chapter", "chapter_id", "chapter").withColumn("excerpt", F.substring("content", 1, 160))
    parts = _latest(texts, "chapter_id", "indexed_at", ["book_id", "title", "excerpt"]).select(F.lit("chapter").alias("kind"), F.col("chapter_id").alias("doc"), "title", "excerpt", "book_id")
    in_books = parts.join(shelf, "book_id", "left").withColumn("api_page", F.lit(False))
    documents = wanted("documents", "doc_id", "doc_section").select(F.lit("doc_section").alias("kind"), F.col("doc_id").alias("doc"), "title", F.lit(None).cast("string").alias("excerpt"), F.lit(None).cast("string").alias("book_title"), F.col("collected_at").cast("date").alias("day"), F.lit(None).cast("double").alias("authority"), F.coalesce(F.col("source").startswith("api:"), F.lit(False)).alias("api_page"))
    return in_books.select(documents.columns).unionByName(documents)


def _alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, doc, n_for, n_against): edges that point to a chapter, edges that come from a document."""
    edges = table(spark, sf_dir, "alignment_edge")
    ends = edges.where("to_chapter_id is not null").select(F.lit("chapter").alias("kind"), F.col("to_chapter_id").alias("doc"), "relation_type").unionByName(edges.where("from_doc_section_id is not null").select(F.lit("doc_section").alias("kind"), F.col("from_doc_section_id").alias("doc"), "relation_type"))
    return ends.groupBy("kind", "doc").agg(F.count_if(F.col("relation_type") == "CORROBORATES").alias("n_for"), F.count_if(F.col("relation_type") == "CONTRADICTS").alias("n_against"))


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, token, w): distinct significant tokens of each query, weighted by the titles of chapters that hold them as a word."""
    titles = chapters(spark, sf_dir, "title")
    words = titles.select("chapter_id", F.explode(F.array_distinct(X.significant_tokens(F.col("title")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    n = titles.agg(F.count("*").alias("n"))
    tokens = _queries(spark, sf_dir).select("query", F.explode(F.array_distinct(X.significant_tokens(F.col("name")))).alias("token"))
    return tokens.join(words, "token", "left").join(F.broadcast(n)).select("query", "token", F.coalesce("df", F.lit(0)).alias("df"), "n", F.when(F.col("df") > 0, F.log(1 + F.col("n") / (1 + F.col("df")))).otherwise(0.0).alias("w"))


def t_seed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rarest token of each query of two tokens or more that stands in some title, but in no more than one in a hundred."""
    rows = _weights(spark, sf_dir)
    several = rows.groupBy("query").agg(F.count("*").alias("n_tokens")).where("n_tokens > 1").select("query")
    rare = rows.where((F.length("token") >= 4) & (F.col("df") > 0) & (F.col("df") <= F.greatest(F.lit(1.0), 0.01 * F.col("n"))))
    return rare.join(several, "query", "left_semi").groupBy("query").agg(F.min(F.struct("df", "token")).alias("b")).select("query", F.col("b.token").alias("token"), F.col("b.df").alias("df"))


def _scored(spark: SparkSession, sf_dir: str, pool: DataFrame) -> DataFrame:
    """The pool (a table) with the five components; results of one book and beginning are folded into the best."""
    rows = pool.drop("rank").join(_pages(spark, sf_dir, pool), ["kind", "doc"], "left")
    tokens = _weights(spark, sf_dir).groupBy("query").agg(F.collect_list(F.struct("token", "w")).alias("tokens"))
    asking = _queries(spark, sf_dir).select("query", F.col("api").alias("asks_api"), X.years(F.col("name")).alias("years"))
    rows = rows.join(tokens, "query", "left").join(asking, "query")
    title = F.lower(F.coalesce("title", F.lit("")))
    whole = F.aggregate("tokens", F.lit(0.0), lambda a, t: a + t["w"])
    there = F.aggregate(F.filter("tokens", lambda t: X.token_in_title(title, t["token"])), F.lit(0.0), lambda a, t: a + t["w"])
    full = (F.size("tokens") > 1) & F.forall("tokens", lambda t: F.contains(title, t["token"]))
    rows = rows.withColumn("coverage", F.coalesce(F.round(F.when(whole > 0, there / whole), 6), F.lit(0.0))).withColumn("full", F.coalesce(full, F.lit(False)))
    in_book = F.col("kind") == "chapter"
    twin = [F.when(in_book, F.col("book_title")), F.when(in_book, F.col("excerpt")).otherwise(F.concat(F.lit("#"), F.col("doc").cast("string")))]
    best = Window.partitionBy("query", "kind", *twin).orderBy(F.col("coverage").desc(), F.col("rrf").desc(), "doc")
    rows = rows.withColumn("nth", F.row_number().over(best)).where("nth = 1").join(_alignment(spark, sf_dir), ["kind", "doc"], "left")
    n_for, n_against = F.coalesce("n_for", F.lit(0)), F.coalesce("n_against", F.lit(0))
    text_score = F.greatest(F.coalesce("fts", F.lit(0.0)), F.coalesce("api", F.lit(0.0)))
    relevance = R.relevance(text_score, F.coalesce("vss", F.lit(0.0)), F.coalesce("graph", F.lit(0.0)), F.coalesce("title_score", F.lit(0.0)), F.col("coverage"))
    relevance = F.when(F.col("full"), F.greatest(relevance, F.lit(FULL_TITLE))).otherwise(relevance)
    relevance = relevance * F.when(F.col("api_page") & ~F.col("asks_api"), API_FACTOR).otherwise(1.0)
    dated = X.years(F.concat_ws(" ", "book_title", "title"))
    relevance = relevance * F.when((F.size("years") > 0) & (F.size(dated) > 0) & ~F.arrays_overlap("years", dated), YEAR_FACTOR).otherwise(1.0)
    age = F.datediff(F.to_date(F.lit(PR.TODAY)), F.col("day")).cast("double")
    return rows.select(
        "query", "kind", "doc", "rrf", "coverage", "full", n_for.alias("n_for"), n_against.alias("n_against"),
        F.round(R.recency(age), 6).alias("recency"), F.round(R.alignment_share(n_for, n_against), 6).alias("alignment"), F.round(relevance, 6).alias("relevance"),
        F.round(R.corroboration(n_for), 6).alias("corroboration"), F.coalesce("authority", F.lit(0.5)).alias("authority"),
    )


def _pool_for_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(r30_pool(spark, sf_dir).withColumnRenamed("title", "title_score"))


def r41_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five components of every result in the pools."""
    return _scored(spark, sf_dir, _pool_for_scores(spark, sf_dir))


def _combined(rows: DataFrame, profile: Column | None = None) -> DataFrame:
    """Adds profile, combined and place (by combined, rounded to 3 places, then rrf) for each profile."""
    parts = ("recency", "alignment", "relevance", "corroboration", "authority")
    for weights in PROFILES.values():
        if abs(sum(weights) - 1) > 1e-6:
            raise ValueError("weights must sum to 1")
    each = F.array(*[F.struct(F.lit(name).alias("profile"), reduce(Column.__add__, [F.col(c) * w for c, w in zip(parts, weights, strict=True)]).alias("combined")) for name, weights in PROFILES.items()])
    rows = rows.select("*", F.explode(each).alias("p")).select(*rows.columns, "p.profile", F.round("p.combined", 9).alias("combined"))
    order = Window.partitionBy("query", "profile").orderBy(F.round(F.col("combined") + 1e-9, 3).desc(), F.col("rrf").desc(), "kind", "doc")
    return rows.withColumn("place", F.row_number().over(order))


def r38_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best results of each query under each of the six weight profiles."""
    return _combined(r41_components(spark, sf_dir)).where(F.col("place") <= LIMIT).select("query", "profile", "kind", "doc", "combined", "place")


def r45_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end: the five best results of each query under the balanced profile, with their titles."""
    pool = _pool_for_scores(spark, sf_dir)
    best = _combined(_scored(spark, sf_dir, pool)).where((F.col("profile") == "balanced_interactive") & (F.col("place") <= LIMIT))
    return best.select("query", "kind", "doc", "combined", "place").join(_pages(spark, sf_dir, pool).select("kind", "doc", "title", "book_title"), ["kind", "doc"], "left")


def r43_interactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query the primary result, at most five that agree and at most five that contradict the primary (balanced profile)."""
    rows = cut(_combined(r41_components(spark, sf_dir)).where("profile = 'balanced_interactive'").select("query", "kind", "doc", "combined", "place"))
    primary = rows.where("place = 1").select("query", F.col("kind").alias("p_kind"), F.col("doc").alias("p_doc"))
    against = table(spark, sf_dir, "alignment_edge").where("relation_type = 'CONTRADICTS'")
    ways = [("chapter", "to_chapter_id", "doc_section", "from_doc_section_id"), ("doc_section", "from_doc_section_id", "chapter", "to_chapter_id"), ("doc_section", "from_doc_section_id", "doc_section", "to_doc_section_id")]
    pairs = reduce(DataFrame.unionByName, [against.select(F.lit(a).alias("p_kind"), F.col(x).alias("p_doc"), F.lit(b).alias("kind"), F.col(y).alias("doc")) for a, x, b, y in ways]).distinct()
    # joined by both ends: a result meets one pair at most, however many contradict its primary
    conflict = pairs.withColumn("found", F.lit("conflict"))
    role = F.when(F.col("place") == 1, "primary").otherwise(F.coalesce("found", F.lit("corroboration")))
    roles = rows.join(primary, "query").join(conflict, ["p_kind", "p_doc", "kind", "doc"], "left").select("query", "kind", "doc", "place", role.alias("role"))
    order = Window.partitionBy("query", "role").orderBy("place")
    return roles.withColumn("nth", F.row_number().over(order)).where("nth <= 5").select("query", "role", "kind", "doc", "nth")


def r44_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each selection strategy keeps, and why it drops the rest."""
    rows = cut(_combined(r41_components(spark, sf_dir)).where("profile in ('skill_recent_doc', 'skill_consensus', 'skill_authority')"))
    reason = (
        F.when((F.col("profile") == "skill_recent_doc") & (F.col("kind") == "chapter") & (F.col("n_against") > 0), "contradicted by current docs")
        .when((F.col("profile") == "skill_consensus") & (F.col("corroboration") < NEUTRAL), "single-source (no corroboration)")
    )
    best = Window.partitionBy("query", "profile").orderBy(F.col("authority").desc(), "place")
    rows = rows.withColumn("first", F.row_number().over(best)).withColumn("reason", reason)
    rows = rows.withColumn("reason", F.when((F.col("profile") == "skill_authority") & (F.col("first") > 1), "lower authority than chosen primary").otherwise(F.col("reason")))
    kept = F.row_number().over(Window.partitionBy("query", "profile", F.col("reason").isNull()).orderBy("place"))
    return rows.withColumn("nth", kept).where(F.col("reason").isNotNull() | (F.col("nth") <= LIMIT)).select("query", "profile", "kind", "doc", "reason")


def r46_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what was found for a query is thin: nothing by words and graph, or nothing by graph and only weak words."""
    found = cut(r14_fanout(spark, sf_dir)).groupBy("query").agg(F.max(F.when(F.col("modality") == "fts", F.col("score"))).alias("best"), F.count_if(F.col("modality") == "graph").alias("n_graph"))
    rows = _queries(spark, sf_dir).select("query").join(found, "query", "left")
    return rows.select("query", F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("n_graph", F.lit(0)).alias("n_graph"), ((F.coalesce("n_graph", F.lit(0)) == 0) & (F.coalesce("best", F.lit(0.0)) < THIN)).alias("thin"))


QUERIES = {f.__name__: f for f in (r05_api_search, r07_vss_chapters, r07_vss_documents, r11_graph_documents, r13_title_documents, r14_fanout, r30_pool, r38_profiles, r41_components, r43_interactive, r44_generation, r45_search, r46_thin, t_seed_tokens)}


def _bm(p: str, asked: str, top: int = PER_MODALITY) -> str:
    """BM25 over the terms of {p}t (doc, term) as {p}m."""
    return f"""{p}p AS (SELECT doc, term, count(*) AS tf FROM {p}t GROUP BY 1, 2), {p}l AS (SELECT doc, sum(tf) AS len FROM {p}p GROUP BY 1), {p}s AS (SELECT count(*) AS n, avg(len) AS al FROM {p}l), {p}d AS (SELECT term, count(*) AS df FROM {p}p GROUP BY 1),
{p}b AS (SELECT query, p.doc, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score FROM {asked} JOIN {p}p p USING (term) JOIN {p}d USING (term) JOIN {p}l l ON l.doc = p.doc, {p}s GROUP BY 1, 2),
{p}m AS (SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM {p}b QUALIFY rank <= {top})"""


def _vs(p: str, rows: str) -> str:
    return f"""{p} AS (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_cosine_similarity(a.e, b.e), 6) AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.vec_id) AS INTEGER) AS rank
FROM ve a, ve b WHERE a.vec_id IN (SELECT query FROM nq) AND b.vec_id IN ({rows}) QUALIFY rank <= 20)"""


def _gs(p: str, column: str) -> str:
    return f"{p} AS (SELECT query, doc, round(CAST(hits + 0.1 * mentions AS DOUBLE), 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY round(CAST(hits + 0.1 * mentions AS DOUBLE), 6) DESC, doc) AS INTEGER) AS rank FROM (SELECT query, {column} AS doc, count(DISTINCT concept_id) AS hits, count(*) AS mentions FROM wn JOIN alignment_edge USING (concept_id) WHERE {column} IS NOT NULL GROUP BY 1, 2) QUALIFY rank <= 20)"


def _ts(p: str, rows: str) -> str:
    return f"""{p}x AS (SELECT doc, title FROM ({rows})), {p}w AS (SELECT DISTINCT doc, unnest({PR._terms("title")}) AS term FROM {p}x), {p}d AS (SELECT term, count(*) AS df FROM {p}w GROUP BY 1),
{p}q AS (SELECT query, term, coalesce(ln(1 + (SELECT count(*) FROM {p}x) / (1 + df)), 0) AS w FROM q LEFT JOIN {p}d USING (term)),
{p}s AS (SELECT query, doc, round(sum(w) / any_value(aw), 6) AS score FROM (SELECT *, sum(w) OVER (PARTITION BY query) AS aw FROM {p}q) JOIN {p}w USING (term) WHERE w > 0 GROUP BY 1, 2),
{p} AS (SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM {p}s QUALIFY rank <= 20)"""


_Q = f"""{PR._ASKED}, nq AS (SELECT concept_id AS query, name, list_has_any(regexp_extract_all(lower(name), '[a-z0-9_'']+'), ['api', 'endpoint', 'endpoints', 'request', 'response', 'parameter', 'parameters', 'rest', 'http', 'curl', 'sdk', 'payload', 'schema']) AS api FROM co WHERE concept_id % 20 = 0 AND name IS NOT NULL)"""
_API = f"aq AS (SELECT q.* FROM q JOIN nq USING (query) WHERE api), ait AS (SELECT doc_id AS doc, unnest({PR._terms('concat_ws(chr(32), title, text)')}) AS term FROM documents WHERE source LIKE 'api:%'), {_bm('ai', 'aq')}"
_VE = "ve AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL)"
_VC, _VD = _vs("vc", "SELECT chapter_id FROM ch"), _vs("vd", "SELECT doc_id FROM documents")
_WN = f"{_GR}, wn AS (SELECT query, query AS concept_id FROM nq UNION SELECT query, dst FROM nq JOIN gr ON src = query)"
_GC, _GD = _gs("gc", "to_chapter_id"), _gs("gd", "from_doc_section_id")
_TC, _TD = _ts("tc", "SELECT chapter_id AS doc, title FROM ch"), _ts("td", "SELECT doc_id AS doc, title FROM documents")
_FAN = f"""{_Q}, cct AS (SELECT chapter_id AS doc, unnest({PR._terms("content")}) AS term FROM ch), {_bm("cc", "q")}, cdt AS (SELECT doc_id AS doc, unnest({PR._terms("concat_ws(chr(32), title, text)")}) AS term FROM documents), {_bm("cd", "q")}, {_API}, {_VE}, {_VC}, {_VD}, {_WN}, {_GC}, {_GD}, {_TC}, {_TD},
fo AS (SELECT query, 'fts' AS modality, 'chapter' AS kind, doc, score, rank FROM ccm UNION ALL SELECT query, 'fts', 'doc_section', doc, score, rank FROM cdm UNION ALL SELECT query, 'vss', 'chapter', doc, score, rank FROM vc UNION ALL SELECT query, 'vss', 'doc_section', doc, score, rank FROM vd
  UNION ALL SELECT query, 'graph', 'chapter', doc, score, rank FROM gc UNION ALL SELECT query, 'graph', 'doc_section', doc, score, rank FROM gd UNION ALL SELECT query, 'title', 'chapter', doc, score, rank FROM tc UNION ALL SELECT query, 'title', 'doc_section', doc, score, rank FROM td UNION ALL SELECT query, 'api', 'doc_section', doc, score, rank FROM aim)"""
_POOL = f"""{_FAN}, fu AS (SELECT query, kind, doc, round(sum(1.0 / (60 + rank)), 9) AS rrf, max(score) FILTER (modality = 'fts') AS fts, max(score) FILTER (modality = 'vss') AS vss, max(score) FILTER (modality = 'graph') AS graph, max(score) FILTER (modality = 'title') AS title, max(score) FILTER (modality = 'api') AS api FROM fo GROUP BY 1, 2, 3),
po AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY rrf DESC, kind, doc) AS INTEGER) AS rank FROM fu QUALIFY rank <= 25)"""
_SIG = "list_distinct(list_filter(list_transform(regexp_extract_all({}, '[A-Za-z][A-Za-z0-9_-]+'), lambda x: lower(x)), lambda x: x NOT IN ('a', 'an', 'and', 'as', 'at', 'be', 'by', 'do', 'for', 'from', 'how', 'in', 'is', 'it', 'its', 'of', 'on', 'or', 'that', 'the', 'this', 'to', 'vs', 'what', 'when', 'where', 'why', 'with', 'your')))"
_WT = f"""sw AS (SELECT token, count(*) AS df FROM (SELECT chapter_id, unnest({_SIG.format("title")}) AS token FROM ch) GROUP BY 1), sq AS (SELECT query, unnest({_SIG.format("name")}) AS token FROM nq),
wt AS (SELECT query, token, coalesce(df, 0) AS df, CASE WHEN df > 0 THEN ln(1 + (SELECT count(*) FROM ch) / (1 + df)) ELSE 0 END AS w FROM sq LEFT JOIN sw USING (token))"""
# no publisher of the test tables is a known one
_AUTHORITY = "0.6::DOUBLE"
_SCORED = f"""{_POOL}, {_WT}, {BOOKS}, au AS (SELECT book_id, title AS book_title, publication_date AS day, {_AUTHORITY} AS authority FROM bk),
pg AS (SELECT 'chapter' AS kind, chapter_id AS doc, title, substr(content, 1, 160) AS excerpt, book_title, day, authority, false AS api_page FROM ch LEFT JOIN au USING (book_id) UNION ALL SELECT 'doc_section', doc_id, title, NULL, NULL, CAST(collected_at AS DATE), NULL, coalesce(source LIKE 'api:%', false) FROM documents),
cw AS (SELECT p.*, g.title AS page_title, excerpt, book_title, day, authority, api_page, lower(coalesce(g.title, '')) AS lt FROM po p LEFT JOIN pg g USING (kind, doc)),
cx AS (SELECT query, kind, doc, sum(w) AS whole, coalesce(sum(w) FILTER (contains(lt, token) OR (length(token) > 4 AND token LIKE '%s' AND contains(lt, left(token, length(token) - 1)))), 0) AS there, count(*) > 1 AND bool_and(contains(lt, token)) AS full_match FROM cw JOIN wt USING (query) GROUP BY 1, 2, 3),
cy AS (SELECT cw.*, coalesce(CASE WHEN whole > 0 THEN round(there / whole, 6) END, 0) AS coverage, coalesce(full_match, false) AS "full" FROM cw LEFT JOIN cx USING (query, kind, doc)),
cz AS (SELECT * FROM cy QUALIFY row_number() OVER (PARTITION BY query, kind, CASE WHEN kind = 'chapter' THEN book_title END, CASE WHEN kind = 'chapter' THEN excerpt ELSE '#' || doc END ORDER BY coverage DESC, rrf DESC, doc) = 1),
ae AS (SELECT kind, doc, count(*) FILTER (relation_type = 'CORROBORATES') AS n_for, count(*) FILTER (relation_type = 'CONTRADICTS') AS n_against FROM (SELECT 'chapter' AS kind, to_chapter_id AS doc, relation_type FROM alignment_edge WHERE to_chapter_id IS NOT NULL UNION ALL SELECT 'doc_section', from_doc_section_id, relation_type FROM alignment_edge WHERE from_doc_section_id IS NOT NULL) GROUP BY 1, 2),
sa AS (SELECT cz.*, coalesce(n_for, 0) AS nf, coalesce(n_against, 0) AS na, CAST(date_diff('day', day, DATE '{PR.TODAY}') AS DOUBLE) AS age, greatest(1 - exp(-greatest(coalesce(fts, 0), coalesce(cz.api, 0)) / 5), least(1, greatest(0, coalesce(vss, 0))), 1 - exp(-coalesce(graph, 0) / 3), 0.5 * coalesce(cz.title, 0)) * (1 + 0.8 * coverage) AS raw,
  nq.api AS asks_api, regexp_extract_all(name, '\\b((?:19|20)\\d\\d)\\b', 1) AS qy, regexp_extract_all(concat_ws(' ', book_title, page_title), '\\b((?:19|20)\\d\\d)\\b', 1) AS ty FROM cz JOIN nq USING (query) LEFT JOIN ae USING (kind, doc)),
sb AS (SELECT *, CASE WHEN raw <= 0.85 THEN raw ELSE 0.85 + 0.15 * (1 - exp(-(raw - 0.85) / 0.5)) END AS soft FROM sa),
sc AS (SELECT query, kind, doc, rrf, coverage, "full", nf AS n_for, na AS n_against, round(CASE WHEN age IS NULL THEN 0.5 WHEN age <= 0 THEN 1.0 ELSE greatest(0.2, exp(-ln(2) * age / 730)) END, 6) AS recency, round(CASE WHEN nf + na = 0 THEN 0.5 ELSE nf / (nf + na) END, 6) AS alignment,
  round(CASE WHEN "full" THEN greatest(soft, 0.95) ELSE soft END * CASE WHEN api_page AND NOT asks_api THEN 0.85 ELSE 1 END * CASE WHEN len(qy) > 0 AND len(ty) > 0 AND NOT list_has_any(qy, ty) THEN 0.9 ELSE 1 END, 6) AS relevance, round(1 - exp(-nf / 3.0), 6) AS corroboration, coalesce(authority, 0.5) AS authority FROM sb)"""
_PROFILES = " UNION ALL ".join(
    f"SELECT *, '{name}' AS profile, round({a}::DOUBLE * recency + {b}::DOUBLE * alignment + {c}::DOUBLE * relevance + {d}::DOUBLE * corroboration + {e}::DOUBLE * authority, 9) AS combined FROM sc"
    for name, a, b, c, d, e in (("balanced_interactive", 0.1, 0.1, 0.45, 0.15, 0.2), ("currency_critical_interactive", 0.4, 0.25, 0.2, 0.1, 0.05), ("foundational_interactive", 0.05, 0.1, 0.35, 0.3, 0.2), ("skill_recent_doc", 0.3, 0.3, 0.25, 0.05, 0.1), ("skill_consensus", 0.05, 0.1, 0.3, 0.35, 0.2), ("skill_authority", 0.05, 0.1, 0.25, 0.1, 0.5))
)
_COMBINED = f"{_SCORED}, pr AS ({_PROFILES}), cb AS (SELECT *, CAST(row_number() OVER (PARTITION BY query, profile ORDER BY round(combined + 1e-9, 3) DESC, rrf DESC, kind, doc) AS INTEGER) AS place FROM pr)"
_WITH = f"WITH {CHAPTERS}, "

SQL = {
    "r05_api_search": f"{_WITH}{_Q}, {_API} SELECT * FROM aim",
    "r07_vss_chapters": f"{_WITH}{_Q}, {_VE}, {_VC} SELECT * FROM vc",
    "r07_vss_documents": f"{_WITH}{_Q}, {_VE}, {_VD} SELECT * FROM vd",
    "r11_graph_documents": f"{_WITH}{_Q}, {_WN}, {_GD} SELECT * FROM gd",
    "r13_title_documents": f"{_WITH}{_Q}, {_TD} SELECT * FROM td",
    "r14_fanout": f"{_WITH}{_FAN} SELECT * FROM fo",
    "r30_pool": f"{_WITH}{_POOL} SELECT * FROM po",
    "r38_profiles": f"{_WITH}{_COMBINED} SELECT query, profile, kind, doc, combined, place FROM cb WHERE place <= 5",
    "r41_components": f"{_WITH}{_SCORED} SELECT * FROM sc",
    "r43_interactive": f"""{_WITH}{_COMBINED}, bi AS (SELECT * FROM cb WHERE profile = 'balanced_interactive'), pm AS (SELECT query, kind AS pk, doc AS pd FROM bi WHERE place = 1),
ag AS (SELECT 'chapter' AS pk, to_chapter_id AS pd, 'doc_section' AS kind, from_doc_section_id AS doc FROM alignment_edge WHERE relation_type = 'CONTRADICTS' UNION SELECT 'doc_section', from_doc_section_id, 'chapter', to_chapter_id FROM alignment_edge WHERE relation_type = 'CONTRADICTS' UNION SELECT 'doc_section', from_doc_section_id, 'doc_section', to_doc_section_id FROM alignment_edge WHERE relation_type = 'CONTRADICTS'),
cf AS (SELECT query, kind, doc, 'conflict' AS found FROM pm JOIN ag USING (pk, pd)), ro AS (SELECT query, kind, doc, place, CASE WHEN place = 1 THEN 'primary' ELSE coalesce(found, 'corroboration') END AS role FROM bi LEFT JOIN cf USING (query, kind, doc)) SELECT query, role, kind, doc, CAST(row_number() OVER (PARTITION BY query, role ORDER BY place) AS INTEGER) AS nth FROM ro QUALIFY nth <= 5""",
    "r44_generation": f"""{_WITH}{_COMBINED}, ge AS (SELECT *, row_number() OVER (PARTITION BY query, profile ORDER BY authority DESC, place) AS nf1 FROM cb WHERE profile IN ('skill_recent_doc', 'skill_consensus', 'skill_authority')),
gr2 AS (SELECT query, profile, kind, doc, place, CASE WHEN profile = 'skill_authority' AND nf1 > 1 THEN 'lower authority than chosen primary' WHEN profile = 'skill_recent_doc' AND kind = 'chapter' AND n_against > 0 THEN 'contradicted by current docs' WHEN profile = 'skill_consensus' AND corroboration < 0.5 THEN 'single-source (no corroboration)' END AS reason FROM ge)
SELECT query, profile, kind, doc, reason FROM gr2 QUALIFY reason IS NOT NULL OR row_number() OVER (PARTITION BY query, profile, reason IS NULL ORDER BY place) <= 5""",
    "r45_search": f"{_WITH}{_COMBINED} SELECT query, kind, doc, combined, place, title, book_title FROM cb LEFT JOIN pg USING (kind, doc) WHERE profile = 'balanced_interactive' AND place <= 5",
    "r46_thin": f"{_WITH}{_FAN}, fm AS (SELECT query, max(score) FILTER (modality = 'fts') AS best, count(*) FILTER (modality = 'graph') AS n_graph FROM fo GROUP BY 1) SELECT query, coalesce(best, 0) AS best, coalesce(n_graph, 0) AS n_graph, coalesce(n_graph, 0) = 0 AND coalesce(best, 0) < 2.5 AS thin FROM nq LEFT JOIN fm USING (query)",
    "t_seed_tokens": f"{_WITH}{_Q}, {_WT} SELECT query, token, df FROM wt WHERE length(token) >= 4 AND df > 0 AND df <= greatest(1, 0.01 * (SELECT count(*) FROM ch)) AND query IN (SELECT query FROM wt GROUP BY 1 HAVING count(*) > 1) QUALIFY row_number() OVER (PARTITION BY query ORDER BY df, token) = 1",
}
