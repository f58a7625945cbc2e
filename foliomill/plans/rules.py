"""Rules over names, titles and typed values, gated and capped walks, and evaluation reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.functions import deid as D
from foliomill.functions import text as X
from foliomill.operators import graph as G
from foliomill.operators.retrieval import top_per
from foliomill.plans.analytics import _MV, a17_majority_vote
from foliomill.plans.common import BOOKS, CHAPTERS, CONCEPTS, books, chapters, concepts
from foliomill.plans.concepts import _asking
from foliomill.plans.deid import SALT, _hmac
from foliomill.plans.relations import RELATIONS, both_ends, relations
from foliomill.runtime import checkpoint_dir, cut, table
from foliomill.sources import sinks

#: Categories of a procedure with the words that tell them, first match wins (fixed values).
CATEGORIES = (
    ("CRUD", ("create", "drop", "delete", "insert", "update", "select", "alter", "add column", "rename")),
    ("Configuration", ("configure", "config", "set option", "set flag", "set parameter", "settings", "environment variable", "enable", "disable")),
    ("Performance", ("tune", "optimize", "performance", "index", "vacuum", "compact", "partition", "cache", "parallel")),
    ("Errors", ("error", "exception", "fail", "retry", "rollback", "recover", "debug", "troubleshoot")),
    ("Integration", ("connect", "integrate", "import", "export", "load from", "write to", "register", "publish")),
    ("Install", ("install", "setup", "bootstrap", "initialize")),
    ("Operations", ("start", "stop", "restart", "deploy", "monitor")),
)
#: Parts of titles that tell pages of a kind (fixed values).
PAGE_NAMES = {"release_notes": ("release notes", "changelog", "what's new", "whats new"), "error_reference": ("error class", "error condition", "error code")}
#: Least cosine with the query, and most concepts of a neighbourhood (fixed values).
GATE, MOST_CONCEPTS = 0.25, 200
#: The seven forms that dates are typed in.
TYPED = ("yyyy-MM-dd", "yyyyMMdd", "MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyyMMddHHmmss", "yyyyMMddHHmm")


def stem(word: Column) -> Column:
    """A crude stem: ing, ed, es or s is cut where four letters are left."""
    out = word
    for end in ("s", "es", "ed", "ing"):
        out = F.when(word.endswith(end) & (F.length(word) >= 4 + len(end)), F.substring(word, F.lit(1), F.length(word) - len(end))).otherwise(out)
    return out


def t_page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source by kind of page: release notes and error references by title, API references by source."""
    title = F.lower(F.coalesce("title", F.lit("")))
    told = {kind: F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(title, n)) for kind, names in PAGE_NAMES.items()}
    kind = F.when(told["release_notes"], "release_notes").when(told["error_reference"], "error_reference").when(F.col("source").startswith("api:"), "api_reference").otherwise("guide")
    return table(spark, sf_dir, "documents").groupBy("source", kind.alias("kind")).agg(F.count("*").alias("n"))


def t_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of the words of concept names with the number of concepts."""
    words = F.filter(F.regexp_extract_all(F.lower("name"), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: (F.length(w) >= 3) & ~w.isin(*X.STOPWORDS))
    rows = concepts(spark, sf_dir, "name").select("concept_id", F.explode(words).alias("word")).select("concept_id", stem(F.col("word")).alias("stem")).distinct()
    return rows.groupBy("stem").agg(F.count("*").alias("n_concepts"))


def t_unit_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category of each counting unit by words in its name and the first 200 characters of its content."""
    rows = table(spark, sf_dir, "generated_unit").where("unit_id is not null").select("unit_id", F.struct("created_at", F.coalesce("name", F.lit("")).alias("name"), F.coalesce(F.substring("content_markdown", 1, 200), F.lit("")).alias("head")).alias("row"))
    latest = rows.groupBy("unit_id").agg(F.max("row").alias("row"))
    body = F.lower(F.concat_ws("\n", "row.name", "row.head"))
    kind = F.lit("General")
    for name, words in reversed(CATEGORIES):
        kind = F.when(body.rlike("|".join(words)), name).otherwise(kind)
    return latest.select("unit_id", kind.alias("category"))


def t_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean subjects of books: paths split, once each apart from case, without 'general' and over-long ones."""
    parts = books(spark, sf_dir, "subjects").select("book_id", F.posexplode("subjects").alias("at", "subject")).select("book_id", "at", F.posexplode(F.split("subject", r"\s+/\s+")).alias("nth", "part"))
    clean = parts.withColumn("part", F.trim("part")).where("part <> '' and length(part) <= 80 and lower(part) <> 'general'")
    first = clean.groupBy("book_id", F.lower("part").alias("key")).agg(F.min(F.struct("at", "nth", "part")).alias("b"))
    return first.groupBy(F.col("b.part").alias("subject")).agg(F.count("*").alias("n_books"))


def t_name_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched concepts with the Jaccard overlap of the words of their names, subtitles and brackets apart."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.regexp_replace(F.lower("name"), r"\(.*?\)|:.*$", ""), F.lit("([a-z0-9#+]+)"), F.lit(1)), lambda w: ~w.isin(*X.STOPWORDS)))
    named = concepts(spark, sf_dir, "name").where("name is not null").select("concept_id", words.alias("words"))
    pairs = table(spark, sf_dir, "concept_match").select(F.least("concept_id_a", "concept_id_b").alias("a"), F.greatest("concept_id_a", "concept_id_b").alias("b")).where("a < b").distinct()
    joined = pairs.join(named.toDF("a", "words_a"), "a").join(named.toDF("b", "words_b"), "b")
    both, either = F.size(F.array_intersect("words_a", "words_b")), F.size(F.array_union("words_a", "words_b"))
    return joined.select("a", "b", F.round(F.when(either > 0, both / either).otherwise(0.0), 6).alias("overlap"))


def i32_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each chapter among the chapters of its parent (of its book, where it has none)."""
    rows = chapters(spark, sf_dir, "book_id", "parent_chapter_id", "chapter_num")
    order = Window.partitionBy("book_id", "parent_chapter_id").orderBy(F.col("chapter_num").asc_nulls_last(), "chapter_id")
    return rows.select("chapter_id", "parent_chapter_id", (F.row_number().over(order) - 1).alias("ordinal"))


def g03_capped_neighborhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts within three relations of each query, at most MOST_CONCEPTS, by depth and id."""
    ways = both_ends(relations(spark, sf_dir)).select(F.col("concept_id").alias("src"), F.col("other_id").alias("dst"))
    found = G.walk(ways, _asking(spark, sf_dir), 3)
    return top_per(found, "query", [F.col("depth"), F.col("node")], MOST_CONCEPTS).select("query", F.col("node").alias("concept_id"), "depth")


def g10_gated_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each query; those whose vector has a cosine below GATE with the query's are off topic, those without one pass."""
    ways = both_ends(relations(spark, sf_dir)).select(F.col("concept_id").alias("query"), F.col("other_id").alias("concept_id")).distinct()
    near = ways.join(_asking(spark, sf_dir).select("query"), "query", "left_semi")
    vectors = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    joined = near.join(vectors.toDF("query", "q"), "query", "left").join(vectors.toDF("concept_id", "v"), "concept_id", "left")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = F.round(dot("q", "v") / F.sqrt(dot("q", "q") * dot("v", "v")), 6)
    return joined.select("query", "concept_id", cosine.alias("similarity"), (cosine.isNull() | (cosine >= GATE)).alias("kept"))


def g23_domain_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains that require one another, with the number of concepts pairs behind it."""
    kinds = concepts(spark, sf_dir, "domain").where("domain is not null")
    rows = relations(spark, sf_dir).where("relation_type = 'REQUIRES'").select("from_id", "to_id").distinct()
    joined = rows.join(kinds.toDF("from_id", "domain"), "from_id").join(kinds.toDF("to_id", "needs"), "to_id").where("domain <> needs")
    return joined.groupBy("domain", "needs").agg(F.count("*").alias("n"))


def a19_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages with the number of counting units, of their types and of those with content."""
    rows = table(spark, sf_dir, "generated_unit").where("unit_id is not null").groupBy("unit_id").agg(F.max(F.struct("created_at", "package_id", "unit_type", (F.length("content_markdown") > 0).alias("filled"))).alias("row"))
    return rows.groupBy(F.col("row.package_id").alias("package_id")).agg(F.count("*").alias("n_units"), F.countDistinct("row.unit_type").alias("n_types"), F.count_if(F.coalesce("row.filled", F.lit(False))).alias("n_filled"))


def a21_relation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of the stored relations against what the votes decide."""
    gold = a17_majority_vote(spark, sf_dir).select("alignment_edge_id", F.when(F.col("verdict") == "SUPERSEDED", "CONTRADICTS").otherwise(F.col("verdict")).alias("gold")).where("gold in ('CORROBORATES', 'CONTRADICTS', 'UNRELATED')")
    rows = cut(table(spark, sf_dir, "alignment_edge").select("alignment_edge_id", "relation_type").distinct().join(gold, "alignment_edge_id"))
    each = rows.select(F.explode(F.array_distinct(F.array("relation_type", "gold"))).alias("relation"), (F.col("relation_type") == F.col("gold")).alias("both"), "relation_type", "gold")
    counts = each.groupBy("relation").agg(F.count_if("both").alias("tp"), F.count_if(F.col("relation_type") == F.col("relation")).alias("n_stored"), F.count_if(F.col("gold") == F.col("relation")).alias("n_gold"))
    precision = F.when(F.col("n_stored") > 0, F.col("tp") / F.col("n_stored")).otherwise(0.0)
    recall = F.when(F.col("n_gold") > 0, F.col("tp") / F.col("n_gold")).otherwise(0.0)
    f1 = F.when(F.col("tp") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return counts.select("relation", "tp", "n_stored", "n_gold", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def a22_lookup_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many matched concepts would meet by their names alone (letters and digits), by the rule of the match."""
    named = concepts(spark, sf_dir, "name").where("name is not null").select("concept_id", F.regexp_replace(F.lower("name"), "[^a-z0-9]", "").alias("key"))
    pairs = table(spark, sf_dir, "concept_match").where("concept_id_a <> concept_id_b").select("match_rule", F.least("concept_id_a", "concept_id_b").alias("a"), F.greatest("concept_id_a", "concept_id_b").alias("b")).distinct()
    joined = pairs.join(named.toDF("a", "key_a"), "a").join(named.toDF("b", "key_b"), "b")
    return joined.groupBy("match_rule").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("key_a") == F.col("key_b"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


def r47_unknown_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of document titles that look like names of libraries and stand in no concept name and no chapter title."""
    shape = F.filter(F.regexp_extract_all("title", F.lit("([A-Za-z][A-Za-z0-9_.-]+)"), F.lit(1)), lambda t: (F.length(t) >= 3) & t.rlike("[A-Z]|[0-9._-]") & ~F.lower(t).isin(*X.STOPWORDS))
    terms = table(spark, sf_dir, "documents").select("doc_id", F.explode(shape).alias("term")).select("doc_id", F.lower("term").alias("term")).distinct()
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit("([a-z][a-z0-9_.-]+)"), F.lit(1))).alias("term")
    known = concepts(spark, sf_dir, "name").select(words("name")).unionByName(chapters(spark, sf_dir, "title").select(words("title"))).distinct()
    return terms.join(known, "term", "left_anti").groupBy("term").agg(F.count("*").alias("n_documents"))


def h04_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the year alone of their typed date."""
    return table(spark, sf_dir, "orders").groupBy(D.year_only(F.col("o_orderdate").cast("date").cast("string")).alias("year")).agg(F.count("*").alias("n"))


def h03_typed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates typed in seven forms, moved by the customer's offset, each in its own form."""
    at = F.col("o_orderdate").cast("timestamp")
    form = F.pmod("o_orderkey", F.lit(len(TYPED)))
    typed = F.lit(None).cast("string")
    for i, pattern in enumerate(TYPED):
        typed = F.when(form == i, F.date_format(at, pattern)).otherwise(typed)
    offset = D.subject_offset(F.col("o_custkey").cast("string"), SALT)
    return table(spark, sf_dir, "orders").select("o_orderkey", typed.alias("typed"), offset.alias("days")).select("o_orderkey", "typed", D.shifted(F.col("typed"), F.col("days")).alias("moved"))


def i07_author_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of each book, each once, numbered in order of their position (nulls last), then id."""
    links = table(spark, sf_dir, "book_author").where("book_id is not null and author_id is not null").groupBy("book_id", "author_id").agg(F.min("position").alias("position"))
    return links.select("book_id", "author_id", F.row_number().over(Window.partitionBy("book_id").orderBy(F.col("position").asc_nulls_last(), "author_id")).alias("nth"))


def a03_stored_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters and documents that edges tie to a concept, those alone that exist (semi joins)."""
    rows = table(spark, sf_dir, "alignment_edge").where("concept_id is not null")
    in_chapters = rows.select("concept_id", F.col("to_chapter_id").alias("chapter_id")).join(table(spark, sf_dir, "chapter").select("chapter_id"), "chapter_id", "left_semi").groupBy("concept_id").agg(F.countDistinct("chapter_id").alias("n_chapters"))
    in_documents = rows.select("concept_id", F.explode(F.array("from_doc_section_id", "to_doc_section_id")).alias("doc_id")).join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi").groupBy("concept_id").agg(F.countDistinct("doc_id").alias("n_documents"))
    joined = in_chapters.join(in_documents, "concept_id", "full")
    return joined.select("concept_id", F.coalesce("n_chapters", F.lit(0)).alias("n_chapters"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def g24_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts in the order that REQUIRES and EXTENDS ask for: 0 for foundations, -1 for circles."""
    rows = relations(spark, sf_dir).where("relation_type in ('REQUIRES', 'EXTENDS')").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return G.layers(rows).select(F.col("node").alias("concept_id"), "layer")


def h10_audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of an audit trail that two steps over the customers left in a JSON sink."""
    path = f"{checkpoint_dir(spark)}/audit-{uuid.uuid4().hex}"
    customers = table(spark, sf_dir, "customer")
    sinks.record(customers, path, "pseudonymise", F.col("c_custkey"), F.col("c_name"))
    sinks.record(customers.where("c_acctbal < 0"), path, "suppress", F.col("c_custkey"), F.col("c_mktsegment"))
    return sinks.summary(spark, path)


def s_partitioned_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language as read back from a Parquet sink partitioned by kind."""
    path = f"{checkpoint_dir(spark)}/sink-{uuid.uuid4().hex}"
    sinks.write_parquet(table(spark, sf_dir, "documents").where("doc_kind is not null").select("doc_id", "lang", "doc_kind"), path, ["doc_kind"])
    return spark.read.parquet(path).groupBy("doc_kind", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


QUERIES = {
    f.__name__: f
    for f in (
        t_page_kinds, t_stems, t_unit_categories, t_subjects, t_name_overlap, i32_ordinals, g03_capped_neighborhoods, g10_gated_neighbours, g23_domain_dependencies, a19_packages, a21_relation_metrics, a22_lookup_accuracy,
        r47_unknown_terms, h04_years, h03_typed_dates, i07_author_positions, a03_stored_coverage, g24_layers, h10_audit_trail, s_partitioned_sink,
    )
}

_STOP = "'a', 'an', 'and', 'as', 'at', 'be', 'by', 'do', 'for', 'from', 'how', 'in', 'is', 'it', 'its', 'of', 'on', 'or', 'that', 'the', 'this', 'to', 'vs', 'what', 'when', 'where', 'why', 'with', 'your'"
_R = f"WITH RECURSIVE {CHAPTERS}, {CONCEPTS}, {RELATIONS}"
_UNITS = "un AS (SELECT * FROM generated_unit WHERE unit_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY created_at DESC NULLS LAST) = 1)"
_PAIRS = "pa AS (SELECT DISTINCT least(concept_id_a, concept_id_b) AS a, greatest(concept_id_a, concept_id_b) AS b FROM concept_match WHERE concept_id_a <> concept_id_b)"
_KEYS = "kn AS (SELECT concept_id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key FROM co WHERE name IS NOT NULL)"



def _typed(at: str) -> str:
    forms = ("%Y-%m-%d", "%Y%m%d", "%m/%d/%Y", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y%m%d%H%M%S", "%Y%m%d%H%M")
    return "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN strftime({at}, '{x}')" for i, x in enumerate(forms)) + " END"


SQL = {
    "t_page_kinds": "SELECT source, CASE WHEN regexp_matches(lower(coalesce(title, '')), 'release notes|changelog|what''s new|whats new') THEN 'release_notes' WHEN regexp_matches(lower(coalesce(title, '')), 'error class|error condition|error code') THEN 'error_reference' WHEN source LIKE 'api:%' THEN 'api_reference' ELSE 'guide' END AS kind, count(*) AS n FROM documents GROUP BY 1, 2",
    "t_stems": f"WITH {CONCEPTS}, w AS (SELECT concept_id, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS w FROM co), s AS (SELECT DISTINCT concept_id, CASE WHEN w LIKE '%ing' AND length(w) >= 7 THEN left(w, -3) WHEN w LIKE '%ed' AND length(w) >= 6 THEN left(w, -2) WHEN w LIKE '%es' AND length(w) >= 6 THEN left(w, -2) WHEN w LIKE '%s' AND length(w) >= 5 THEN left(w, -1) ELSE w END AS stem FROM w WHERE length(w) >= 3 AND w NOT IN ({_STOP})) SELECT stem, count(*) AS n_concepts FROM s GROUP BY 1",
    "t_unit_categories": f"""WITH {_UNITS}, b AS (SELECT unit_id, lower(coalesce(name, '') || chr(10) || coalesce(substr(content_markdown, 1, 200), '')) AS b FROM un) SELECT unit_id, CASE WHEN regexp_matches(b, 'create|drop|delete|insert|update|select|alter|add column|rename') THEN 'CRUD'
WHEN regexp_matches(b, 'configure|config|set option|set flag|set parameter|settings|environment variable|enable|disable') THEN 'Configuration' WHEN regexp_matches(b, 'tune|optimize|performance|index|vacuum|compact|partition|cache|parallel') THEN 'Performance' WHEN regexp_matches(b, 'error|exception|fail|retry|rollback|recover|debug|troubleshoot') THEN 'Errors'
WHEN regexp_matches(b, 'connect|integrate|import|export|load from|write to|register|publish') THEN 'Integration' WHEN regexp_matches(b, 'install|setup|bootstrap|initialize') THEN 'Install' WHEN regexp_matches(b, 'start|stop|restart|deploy|monitor') THEN 'Operations' ELSE 'General' END AS category FROM b""",
    "t_subjects": rf"WITH {BOOKS}, s AS (SELECT book_id, unnest(subjects) AS subject, generate_subscripts(subjects, 1) AS pos FROM bk), p AS (SELECT book_id, pos, unnest(regexp_split_to_array(subject, '\s+/\s+')) AS part, generate_subscripts(regexp_split_to_array(subject, '\s+/\s+'), 1) AS nth FROM s), c AS (SELECT book_id, pos, nth, trim(part, ' ') AS part FROM p WHERE trim(part, ' ') <> '' AND length(trim(part, ' ')) <= 80 AND lower(trim(part, ' ')) <> 'general'), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY book_id, lower(part) ORDER BY pos, nth) = 1) SELECT part AS subject, count(*) AS n_books FROM f GROUP BY 1",
    "t_name_overlap": rf"WITH {CONCEPTS}, {_PAIRS}, w AS (SELECT concept_id, list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(name), '\(.*?\)|:.*$', '', 'g'), '[a-z0-9#+]+'), lambda x: x NOT IN ({_STOP}))) AS ws FROM co WHERE name IS NOT NULL) SELECT a, b, round(CASE WHEN len(x.ws) + len(y.ws) > 0 THEN len(list_intersect(x.ws, y.ws)) / len(list_distinct(list_concat(x.ws, y.ws))) ELSE 0 END, 6) AS overlap FROM pa JOIN w x ON x.concept_id = a JOIN w y ON y.concept_id = b",
    "i32_ordinals": f"WITH {CHAPTERS} SELECT chapter_id, parent_chapter_id, CAST(row_number() OVER (PARTITION BY book_id, parent_chapter_id ORDER BY chapter_num NULLS LAST, chapter_id) - 1 AS INTEGER) AS ordinal FROM ch",
    "g03_capped_neighborhoods": f"{_R}, s AS (SELECT DISTINCT concept_id AS src, other_id AS dst FROM be), u(query, node, depth) AS (SELECT concept_id, concept_id, 0 FROM co WHERE concept_id % 20 = 0 UNION SELECT query, dst, depth + 1 FROM u JOIN s ON src = node WHERE depth < 3) SELECT query, node AS concept_id, min(depth) AS depth FROM u GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY min(depth), node) <= 200",
    "g10_gated_neighbours": f"{_R}, v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL), n AS (SELECT DISTINCT concept_id AS query, other_id AS concept_id FROM be WHERE concept_id % 20 = 0), s AS (SELECT query, concept_id, round(list_cosine_similarity(q.e, w.e), 6) AS similarity FROM n LEFT JOIN v q ON q.vec_id = query LEFT JOIN v w ON w.vec_id = concept_id) SELECT *, similarity IS NULL OR similarity >= 0.25 AS kept FROM s",
    "g23_domain_dependencies": f"{_R} SELECT f.domain, t.domain AS needs, count(*) AS n FROM (SELECT DISTINCT from_id, to_id FROM rl WHERE relation_type = 'REQUIRES') JOIN co f ON f.concept_id = from_id JOIN co t ON t.concept_id = to_id WHERE f.domain <> t.domain GROUP BY 1, 2",
    "a19_packages": f"WITH {_UNITS} SELECT package_id, count(*) AS n_units, count(DISTINCT unit_type) AS n_types, count(*) FILTER (length(content_markdown) > 0) AS n_filled FROM un GROUP BY 1",
    "a21_relation_metrics": f"""WITH {_MV}, g AS (SELECT alignment_edge_id, CASE WHEN verdict = 'SUPERSEDED' THEN 'CONTRADICTS' ELSE verdict END AS gold FROM mv), r AS (SELECT DISTINCT alignment_edge_id, relation_type, gold FROM alignment_edge JOIN g USING (alignment_edge_id) WHERE gold IN ('CORROBORATES', 'CONTRADICTS', 'UNRELATED')),
e AS (SELECT relation_type AS relation FROM r UNION SELECT gold FROM r), c AS (SELECT relation, count(*) FILTER (relation_type = relation AND gold = relation) AS tp, count(*) FILTER (relation_type = relation) AS n_stored, count(*) FILTER (gold = relation) AS n_gold FROM e, r GROUP BY 1)
SELECT *, round(CASE WHEN n_stored > 0 THEN tp / n_stored ELSE 0 END, 6) AS precision, round(CASE WHEN n_gold > 0 THEN tp / n_gold ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / n_stored) * (tp / n_gold) / (tp / n_stored + tp / n_gold) ELSE 0 END, 6) AS f1 FROM c""",
    "a22_lookup_accuracy": f"WITH {CONCEPTS}, {_KEYS}, p AS (SELECT DISTINCT match_rule, least(concept_id_a, concept_id_b) AS a, greatest(concept_id_a, concept_id_b) AS b FROM concept_match WHERE concept_id_a <> concept_id_b) SELECT match_rule, count(*) AS n, round(avg(CASE WHEN x.key = y.key THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p JOIN kn x ON x.concept_id = a JOIN kn y ON y.concept_id = b GROUP BY 1",
    "r47_unknown_terms": f"WITH {CHAPTERS}, {CONCEPTS}, t AS (SELECT DISTINCT doc_id, lower(term) AS term FROM (SELECT doc_id, unnest(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9_.-]+')) AS term FROM documents) WHERE length(term) >= 3 AND regexp_matches(term, '[A-Z]|[0-9._-]') AND lower(term) NOT IN ({_STOP})), k AS (SELECT unnest(regexp_extract_all(lower(name), '[a-z][a-z0-9_.-]+')) AS term FROM co UNION SELECT unnest(regexp_extract_all(lower(title), '[a-z][a-z0-9_.-]+')) FROM ch) SELECT term, count(*) AS n_documents FROM t WHERE term NOT IN (SELECT term FROM k) GROUP BY 1",
    "h03_typed_dates": f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS d, CAST(('0x' || substr({_hmac("CAST(o_custkey AS VARCHAR)")}, 1, 16))::UBIGINT % 121 AS INTEGER) - 60 AS days FROM orders)
SELECT o_orderkey, {_typed("d")} AS typed, {_typed("d + to_days(days)")} AS moved FROM o""",
    "i07_author_positions": "WITH l AS (SELECT book_id, author_id, min(position) AS position FROM book_author WHERE book_id IS NOT NULL AND author_id IS NOT NULL GROUP BY 1, 2) SELECT book_id, author_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY position NULLS LAST, author_id) AS INTEGER) AS nth FROM l",
    "a03_stored_coverage": "WITH c AS (SELECT concept_id, count(DISTINCT to_chapter_id) AS n FROM alignment_edge WHERE concept_id IS NOT NULL AND to_chapter_id IN (SELECT chapter_id FROM chapter) GROUP BY 1), x AS (SELECT concept_id, from_doc_section_id AS d FROM alignment_edge UNION ALL SELECT concept_id, to_doc_section_id FROM alignment_edge), d AS (SELECT concept_id, count(DISTINCT d) AS n FROM x WHERE concept_id IS NOT NULL AND d IN (SELECT doc_id FROM documents) GROUP BY 1) SELECT concept_id, coalesce(c.n, 0) AS n_chapters, coalesce(d.n, 0) AS n_documents FROM c FULL JOIN d USING (concept_id)",
    "g24_layers": f"{_R}, e AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM rl WHERE relation_type IN ('REQUIRES', 'EXTENDS')), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), u(node, top, depth) AS (SELECT node, node, 0 FROM n UNION SELECT u.node, dst, depth + 1 FROM u JOIN e ON src = top WHERE depth < 60) SELECT node AS concept_id, CASE WHEN max(depth) >= 60 THEN -1 ELSE max(depth) END AS layer FROM u GROUP BY 1",
    "h10_audit_trail": "SELECT 'pseudonymise' AS action, count(*) AS n, count(DISTINCT c_custkey) AS n_subjects, count(DISTINCT coalesce(c_name, '')) AS n_contents FROM customer UNION ALL SELECT 'suppress', count(*), count(DISTINCT c_custkey), count(DISTINCT coalesce(c_mktsegment, '')) FROM customer WHERE c_acctbal < 0",
    "s_partitioned_sink": "SELECT doc_kind, lang, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE doc_kind IS NOT NULL GROUP BY 1, 2",
    "h04_years": "SELECT CAST(date_part('year', CAST(o_orderdate AS DATE)) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1",
}
