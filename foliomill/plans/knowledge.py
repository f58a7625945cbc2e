"""Knowledge-base reports: evidence, gaps, quality, change, evaluation and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.functions import text as X
from foliomill.operators import graph as G
from foliomill.operators import retrieval as R
from foliomill.plans import retrieval as PR
from foliomill.plans.analytics import _GR, _STOP, _graph
from foliomill.plans.common import BOOKS, CHAPTERS, CONCEPTS, books, chapters, concepts
from foliomill.runtime import table

#: Least length of a quotation (fixed value).
QUOTE = 12


def r10_graph_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of each concept query by edges of the concept and of those matched with it: distinct concepts + 0.1 x mentions."""
    queries = concepts(spark, sf_dir, "name").where("concept_id % 20 = 0").select(F.col("concept_id").alias("query"))
    near = queries.join(_graph(spark, sf_dir), F.col("query") == F.col("src")).select("query", F.col("dst").alias("concept_id"))
    wanted = queries.select("query", F.col("query").alias("concept_id")).unionByName(near).distinct()
    edges = table(spark, sf_dir, "alignment_edge").where("to_chapter_id is not null and concept_id is not null").select("concept_id", F.col("to_chapter_id").alias("doc"))
    hits = wanted.join(edges, "concept_id").groupBy("query", "doc").agg(F.countDistinct("concept_id").alias("hits"), F.count("*").alias("mentions"))
    scored = hits.select("query", "doc", "hits", "mentions", F.round(F.col("hits") + 0.1 * F.col("mentions"), 6).alias("score"))
    return R.top_per(scored, "query", [F.col("score").desc(), F.col("doc")], PR.TOP)


def r31_distinct_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content search with chapters of equal content and book folded into the best of them."""
    rows = PR.r03_bm25_chapters(spark, sf_dir).join(chapters(spark, sf_dir, "book_id", "content_hash").withColumnRenamed("chapter_id", "doc"), "doc")
    first = Window.partitionBy("query", "book_id", "content_hash").orderBy("rank")
    return rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("query", "doc", "rank")


def r47_concept_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title words of documents that stand in no concept name (anti join)."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(X.index_terms(F.col("title")))).alias("word"))
    known = concepts(spark, sf_dir, "name").select(F.explode(X.index_terms(F.col("name"))).alias("word")).distinct()
    return words.join(known, "word", "left_anti").groupBy("word").agg(F.count("*").alias("n_documents"))


def r48_confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the best hit of a query dominates: 'one', 'many', or 'none' below the floor."""
    top = PR.r03_bm25_chapters(spark, sf_dir)
    best = top.groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"))
    gate = F.when(F.col("s1") < 2.5, "none").when(F.col("s2").isNull() | ((F.col("s1") - F.col("s2")) / F.col("s1") >= 0.2), "one").otherwise("many")
    return best.select("query", "s1", "s2", gate.alias("gate"))


def a20_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 1 and 10 and mean reciprocal rank of fused search, gold being the chapters of a concept's edges."""
    gold = table(spark, sf_dir, "alignment_edge").where("concept_id % 20 = 0 and to_chapter_id is not null").select(F.col("concept_id").alias("query"), F.col("to_chapter_id").alias("doc")).distinct()
    ranks = gold.join(PR.r30_rrf(spark, sf_dir).select("query", "doc", "rank"), ["query", "doc"], "left").groupBy("query").agg(F.min("rank").alias("best"))
    share = lambda k: F.round(F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)), 6)
    return ranks.agg(F.count("*").alias("n_queries"), share(1).alias("recall_1"), share(10).alias("recall_10"), F.round(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 6).alias("mrr"))


def a09_source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the documents of each source: missing, blank, unlabelled and mis-measured ones, and the time covered."""
    blank = ~F.col("text").rlike(r"[^\s\x{A0}\x{3000}\x{FEFF}]")
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("text").isNull()).alias("n_null"),
        F.count_if(F.col("text").isNotNull() & blank).alias("n_blank"),
        F.count_if(F.col("lang").isNull()).alias("n_no_lang"),
        F.count_if(F.col("n_chars") != F.length("text")).alias("n_wrong_size"),
        F.countDistinct(F.md5("text")).alias("n_distinct"),
        F.min("collected_at").cast("string").alias("first"),
        F.max("collected_at").cast("string").alias("last"),
    )


def i20_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the first document of the same text, where there is one."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, "h").where("doc_id > first_id").select("doc_id", "first_id")


def a15_monthly_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a source's words of a month that did not stand in its month before (1 - Jaccard of word sets)."""
    rows = table(spark, sf_dir, "documents").where("collected_at is not null").select("source", F.date_format("collected_at", "yyyy-MM").alias("month"), F.explode(X.index_terms(F.col("text"))).alias("word")).distinct()
    months = rows.select("source", "month").distinct().withColumn("before", F.lag("month").over(Window.partitionBy("source").orderBy("month")))
    sizes = rows.groupBy("source", "month").agg(F.count("*").alias("n"))
    now = rows.join(months.where("before is not null"), ["source", "month"])
    was = rows.select("source", F.col("month").alias("before"), "word")
    both = now.join(was, ["source", "before", "word"]).groupBy("source", "month").agg(F.count("*").alias("shared"))
    joined = months.where("before is not null").join(sizes, ["source", "month"]).join(sizes.select("source", F.col("month").alias("before"), F.col("n").alias("m")), ["source", "before"]).join(both, ["source", "month"], "left")
    shared = F.coalesce("shared", F.lit(0))
    return joined.select("source", "month", F.round(1 - shared / (F.col("n") + F.col("m") - shared), 6).alias("churn"))


def a10_label_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of the vectors of a label with the label's mean direction."""
    vectors = table(spark, sf_dir, "embeddings").where("embedding is not null").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    cells = vectors.withColumn("norm", norm).where("norm > 0").select("label", "vec_id", "norm", F.posexplode("v").alias("i", "x"))
    centre = cells.groupBy("label", "i").agg(F.avg(F.col("x") / F.col("norm")).alias("c"), F.count("*").alias("n"))
    length = centre.groupBy("label").agg(F.first("n").alias("n_vectors"), F.sum(F.col("c") * F.col("c")).alias("square"))
    return length.select("label", "n_vectors", F.round(F.sqrt("square"), 6).alias("cohesion"))


def x22_concept_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each word of a concept's name first stands in the chapters its edges point to."""
    edges = table(spark, sf_dir, "alignment_edge").where("to_chapter_id is not null").select("concept_id", F.col("to_chapter_id").alias("chapter_id")).distinct()
    rows = edges.join(concepts(spark, sf_dir, "name"), "concept_id").join(chapters(spark, sf_dir, "content"), "chapter_id")
    words = rows.select("concept_id", "chapter_id", "content", F.explode(F.array_distinct(X.index_terms(F.col("name")))).alias("word"))
    at = words.withColumn("at", F.expr("locate(word, lower(content))")).where("at > 0")
    return at.select("concept_id", "chapter_id", "word", F.expr("substring(content, greatest(at - 40, 1), 100)").alias("window"))


def x23_quoted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book claims of votes that stand in the chapter of the edge, spaces and case apart; shorter ones than QUOTE characters prove nothing."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[ \t\n\f\r]+", " ")))
    votes = table(spark, sf_dir, "alignment_vote").where("book_claim is not null").select("alignment_vote_id", "alignment_edge_id", "book_claim").distinct()
    edges = table(spark, sf_dir, "alignment_edge").select("alignment_edge_id", F.col("to_chapter_id").alias("chapter_id")).distinct()
    rows = votes.join(edges, "alignment_edge_id").join(chapters(spark, sf_dir, "content"), "chapter_id", "left")
    quote = F.trim(plain("book_claim"), F.lit("\"'“”…. "))
    found = F.coalesce((F.length(quote) >= QUOTE) & F.contains(plain("content"), quote), F.lit(False))
    return rows.groupBy("alignment_edge_id").agg(F.count("*").alias("n_claims"), F.count_if(found).alias("n_quoted"))


def x13_year_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that name years, with the factor of a query for 2024: 0.9 where only other years stand."""
    rows = chapters(spark, sf_dir, "content").select("chapter_id", X.years(F.col("content")).alias("years")).where(F.size("years") > 0)
    return rows.select("chapter_id", F.array_join("years", ",").alias("years"), F.when(F.array_contains("years", "2024"), 1.0).otherwise(0.9).alias("factor"))


def g34_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cited for each concept, at most two per source, source by source in turn."""
    edges = table(spark, sf_dir, "alignment_edge").where("from_doc_section_id is not null and concept_id is not null").select("concept_id", F.col("from_doc_section_id").alias("doc_id")).distinct()
    rows = edges.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    per_source = rows.withColumn("nth", F.row_number().over(Window.partitionBy("concept_id", "source").orderBy("doc_id"))).where("nth <= 2")
    turn = Window.partitionBy("concept_id").orderBy("nth", "source", "doc_id")
    return per_source.select("concept_id", "doc_id", "nth", F.row_number().over(turn).alias("place"))


def g42_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles each concept takes part in; edges point from the smaller to the larger (degree, id), which bounds the fan-out of hubs."""
    both = _graph(spark, sf_dir)
    degree = G.degrees(both)
    ranked = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("degree").alias("degree2")), "dst")
    ahead = ranked.where("struct(degree, src) < struct(degree2, dst)").select("src", "dst")
    wedges = ahead.alias("a").join(ahead.alias("b"), F.col("a.src") == F.col("b.src")).where("a.dst < b.dst").select(F.col("a.src").alias("x"), F.col("a.dst").alias("y"), F.col("b.dst").alias("z"))
    closed = wedges.join(both, (F.col("y") == F.col("src")) & (F.col("z") == F.col("dst"))).select("x", "y", "z")
    return closed.select(F.explode(F.array("x", "y", "z")).alias("concept_id")).groupBy("concept_id").agg(F.count("*").alias("n_triangles"))


def i14_markdown_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books as markdown sections, one line per field that is set."""
    line = lambda label, c: F.when(c.isNotNull() & (F.trim(c) != ""), F.concat(F.lit(f"- {label}: "), c))
    rows = books(spark, sf_dir, "title", "publisher", "publication_date", "status")
    fields = [line("publisher", F.col("publisher")), line("published", F.col("publication_date").cast("string")), line("status", F.col("status"))]
    return rows.select("book_id", F.concat_ws("\n", F.concat(F.lit("## "), F.col("book_id").cast("string"), F.lit(" "), F.coalesce("title", F.lit("untitled"))), *fields).alias("markdown"))


def i_book_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books whose stored totals differ from those of their counting chapters."""
    sums = chapters(spark, sf_dir, "book_id", "token_count").groupBy("book_id").agg(F.sum("token_count").alias("tokens"), F.count("*").alias("n"))
    rows = books(spark, sf_dir, "total_tokens", "chapter_count").join(sums, "book_id", "left")
    differs = reduce(lambda a, b: a | b, [~F.col(a).eqNullSafe(F.col(b)) for a, b in (("total_tokens", "tokens"), ("chapter_count", "n"))])
    return rows.where(differs).select("book_id", "total_tokens", "tokens", "chapter_count", F.col("n").alias("n_chapters"))


QUERIES = {
    f.__name__: f
    for f in (
        r10_graph_chapters, r31_distinct_results, r47_concept_gaps, r48_confidence_gate, a20_retrieval_metrics, a09_source_status, i20_exact_duplicates, a15_monthly_churn,
        a10_label_cohesion, x22_concept_windows, x23_quoted_claims, x13_year_factor, g34_citations, g42_triangles, i14_markdown_records, i_book_totals,
    )
}

_BM = f"{CHAPTERS}, {PR._ASKED}, {PR._CHAPTER_INDEX}, {PR._BM25}"
_WORDS = f"list_filter(regexp_extract_all(lower({{}}), '[a-z]+'), lambda t: t NOT IN ({_STOP}))"

SQL = {
    "r10_graph_chapters": f"""WITH {CONCEPTS}, {_GR}, q AS (SELECT concept_id AS query FROM co WHERE concept_id % 20 = 0), w AS (SELECT query, query AS concept_id FROM q UNION SELECT query, dst FROM q JOIN gr ON src = query),
h AS (SELECT query, to_chapter_id AS doc, count(DISTINCT concept_id) AS hits, count(*) AS mentions FROM w JOIN alignment_edge USING (concept_id) WHERE to_chapter_id IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, round(CAST(hits + 0.1 * mentions AS DOUBLE), 6) AS score FROM h)
SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM s QUALIFY rank <= {PR.TOP}""",
    "r31_distinct_results": f"WITH {_BM} SELECT query, doc, rank FROM bm JOIN ch ON chapter_id = doc QUALIFY row_number() OVER (PARTITION BY query, book_id, content_hash ORDER BY rank) = 1",
    "r47_concept_gaps": f"WITH {CONCEPTS}, w AS (SELECT DISTINCT doc_id, unnest({_WORDS.format('title')}) AS word FROM documents), k AS (SELECT DISTINCT unnest({_WORDS.format('name')}) AS word FROM co) SELECT word, count(*) AS n_documents FROM w WHERE word NOT IN (SELECT word FROM k) GROUP BY 1",
    "r48_confidence_gate": f"WITH {_BM}, g AS (SELECT query, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2 FROM bm GROUP BY 1) SELECT *, CASE WHEN s1 < 2.5 THEN 'none' WHEN s2 IS NULL OR (s1 - s2) / s1 >= 0.2 THEN 'one' ELSE 'many' END AS gate FROM g",
    "a20_retrieval_metrics": f"""WITH {_BM}, {PR._TITLE}, {PR._RRF}, g AS (SELECT DISTINCT concept_id AS query, to_chapter_id AS doc FROM alignment_edge WHERE concept_id % 20 = 0 AND to_chapter_id IS NOT NULL), be AS (SELECT query, min(rank) AS best FROM g LEFT JOIN rr USING (query, doc) GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN best <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1.0 / best, 0)), 6) AS mrr FROM be""",
    "a09_source_status": r"""SELECT source, count(*) AS n, count(*) FILTER (text IS NULL) AS n_null, count(*) FILTER (NOT regexp_matches(text, '[^\s\x{A0}\x{3000}\x{FEFF}]')) AS n_blank, count(*) FILTER (lang IS NULL) AS n_no_lang,
count(*) FILTER (n_chars <> length(text)) AS n_wrong_size, count(DISTINCT md5(text)) AS n_distinct, CAST(min(collected_at) AS VARCHAR) AS first, CAST(max(collected_at) AS VARCHAR) AS last FROM documents GROUP BY source""",
    "i20_exact_duplicates": "SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents WHERE text IS NOT NULL) WHERE doc_id > first_id",
    "a15_monthly_churn": f"""WITH r AS (SELECT DISTINCT source, strftime(collected_at, '%Y-%m') AS month, unnest({_WORDS.format("text")}) AS word FROM documents WHERE collected_at IS NOT NULL), m AS (SELECT source, month, lag(month) OVER (PARTITION BY source ORDER BY month) AS before FROM (SELECT DISTINCT source, month FROM r)),
s AS (SELECT source, month, count(*) AS n FROM r GROUP BY 1, 2), b AS (SELECT r.source, r.month, count(*) AS shared FROM r JOIN m ON m.source = r.source AND m.month = r.month JOIN r w ON w.source = r.source AND w.month = m.before AND w.word = r.word GROUP BY 1, 2)
SELECT m.source, m.month, round(1 - coalesce(shared, 0) / (s.n + t.n - coalesce(shared, 0)), 6) AS churn FROM m JOIN s ON s.source = m.source AND s.month = m.month JOIN s t ON t.source = m.source AND t.month = m.before LEFT JOIN b ON b.source = m.source AND b.month = m.month""",
    "a10_label_cohesion": """WITH v AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL), u AS (SELECT label, sqrt(list_dot_product(e, e)) AS norm, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
c AS (SELECT label, i, avg(x / norm) AS c, count(*) AS n FROM u WHERE norm > 0 GROUP BY 1, 2) SELECT label, any_value(n) AS n_vectors, round(sqrt(sum(c * c)), 6) AS cohesion FROM c GROUP BY 1""",
    "x22_concept_windows": f"""WITH {CHAPTERS}, {CONCEPTS}, e AS (SELECT DISTINCT concept_id, to_chapter_id AS chapter_id FROM alignment_edge WHERE to_chapter_id IS NOT NULL), w AS (SELECT DISTINCT concept_id, chapter_id, content, unnest({_WORDS.format("name")}) AS word FROM e JOIN co USING (concept_id) JOIN ch USING (chapter_id))
SELECT concept_id, chapter_id, word, substr(content, greatest(instr(lower(content), word) - 40, 1), 100) AS "window" FROM w WHERE instr(lower(content), word) > 0""",
    "x23_quoted_claims": rf"""WITH {CHAPTERS}, v AS (SELECT DISTINCT alignment_vote_id, alignment_edge_id, trim(lower(trim(regexp_replace(book_claim, '[ \t\n\f\r]+', ' ', 'g'), ' ')), '"''“”…. ') AS q FROM alignment_vote WHERE book_claim IS NOT NULL), e AS (SELECT DISTINCT alignment_edge_id, to_chapter_id AS chapter_id FROM alignment_edge)
SELECT alignment_edge_id, count(*) AS n_claims, count(*) FILTER (coalesce(length(q) >= 12 AND contains(lower(trim(regexp_replace(content, '[ \t\n\f\r]+', ' ', 'g'), ' ')), q), false)) AS n_quoted FROM v JOIN e USING (alignment_edge_id) LEFT JOIN ch USING (chapter_id) GROUP BY 1""",
    "x13_year_factor": rf"WITH {CHAPTERS}, y AS (SELECT chapter_id, list_sort(list_distinct(regexp_extract_all(content, '\b((?:19|20)\d\d)\b', 1))) AS ys FROM ch) SELECT chapter_id, array_to_string(ys, ',') AS years, CAST(CASE WHEN list_contains(ys, '2024') THEN 1.0 ELSE 0.9 END AS DOUBLE) AS factor FROM y WHERE len(ys) > 0",
    "g34_citations": "WITH e AS (SELECT DISTINCT concept_id, from_doc_section_id AS doc_id FROM alignment_edge WHERE from_doc_section_id IS NOT NULL AND concept_id IS NOT NULL), r AS (SELECT concept_id, doc_id, source, CAST(row_number() OVER (PARTITION BY concept_id, source ORDER BY doc_id) AS INTEGER) AS nth FROM e JOIN documents USING (doc_id) QUALIFY nth <= 2) SELECT concept_id, doc_id, nth, CAST(row_number() OVER (PARTITION BY concept_id ORDER BY nth, source NULLS FIRST, doc_id) AS INTEGER) AS place FROM r",
    "g42_triangles": f"WITH {_GR}, t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM gr a JOIN gr b ON a.dst = b.src JOIN gr c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND b.src < b.dst), u AS (SELECT unnest([x, y, z]) AS concept_id FROM t) SELECT concept_id, count(*) AS n_triangles FROM u GROUP BY 1",
    "i14_markdown_records": f"""WITH {BOOKS} SELECT book_id, concat_ws(chr(10), '## ' || CAST(book_id AS VARCHAR) || ' ' || coalesce(title, 'untitled'), CASE WHEN trim(publisher, ' ') <> '' THEN '- publisher: ' || publisher END, '- published: ' || CAST(publication_date AS VARCHAR), CASE WHEN trim(status) <> '' THEN '- status: ' || status END) AS markdown FROM bk""",
    "i_book_totals": f"WITH {CHAPTERS}, {BOOKS}, s AS (SELECT book_id, CAST(sum(token_count) AS BIGINT) AS tokens, count(*) AS n FROM ch GROUP BY 1) SELECT book_id, total_tokens, tokens, chapter_count, n AS n_chapters FROM bk LEFT JOIN s USING (book_id) WHERE total_tokens IS DISTINCT FROM tokens OR chapter_count IS DISTINCT FROM n",
}
