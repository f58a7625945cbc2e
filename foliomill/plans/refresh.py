"""Snapshots of document sources and versions of books: what changed, what carries over, what is due.

A snapshot is what a source held in a month of ``collected_at``; its sections are the lines of at least
``SECTION`` characters of its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.functions import text as X
from foliomill.operators.hierarchy import latest_links, resolve_forest
from foliomill.plans.common import BOOKS, CHAPTERS, CONCEPTS, books, chapters, concepts
from foliomill.plans.hierarchy import _LINKS, TREES
from foliomill.plans.relations import edges
from foliomill.runtime import cut, table

#: Days after which a source is due again, by how it is kept; rows of an extraction batch; corroborations below this confidence are looked at again.
SECTION = 20
TTL_DAYS = {"api": 7, "git": 14, "site": 30}
DEFAULT_TTL, BATCH, WEAK = 90, 20, 0.5


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, month, doc_id, digest) of the sections of dated documents; the digest ignores case and spacing."""
    rows = table(spark, sf_dir, "documents").where("collected_at is not null and text is not null and source is not null")
    lines = rows.select("source", F.date_format("collected_at", "yyyy-MM").alias("month"), "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    plain = F.lower(F.trim(F.regexp_replace("line", "[ \t\r\f]+", " ")))
    return lines.select("source", "month", "doc_id", plain.alias("plain")).where(F.length("plain") >= SECTION).select("source", "month", "doc_id", F.md5("plain").alias("digest"))


def _snapshots(rows: DataFrame) -> DataFrame:
    """(source, month, before): the snapshots of each source with the one before."""
    months = rows.select("source", "month").distinct()
    return months.withColumn("before", F.lag("month").over(Window.partitionBy("source").orderBy("month")))


def i61_snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each snapshot against the one before: first, unchanged or changed, by a sum of digests that no order affects."""
    rows = cut(_sections(spark, sf_dir).select("source", "month", "digest"))
    number = F.conv(F.substring("digest", 1, 15), 16, 10).cast("decimal(38,0)")
    sums = rows.groupBy("source", "month").agg(F.count("*").alias("n_sections"), F.sum(number).alias("sum"))
    order = Window.partitionBy("source").orderBy("month")
    before, n_before = F.lag("sum").over(order), F.lag("n_sections").over(order)
    state = F.when(before.isNull(), "first").when((before == F.col("sum")) & (n_before == F.col("n_sections")), "unchanged").otherwise("changed")
    return sums.select("source", "month", "n_sections", state.alias("state"))


def i63_carried_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that stood in the snapshot before too, with the smallest id they had there; derived rows can be pointed to the new one."""
    rows = cut(_sections(spark, sf_dir))
    old = rows.groupBy("source", F.col("month").alias("before"), "digest").agg(F.min("doc_id").alias("old_doc_id"))
    return rows.distinct().join(_snapshots(rows).where("before is not null"), ["source", "month"]).join(old, ["source", "before", "digest"]).select("source", "month", "doc_id", "digest", "old_doc_id")


def i62_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each snapshot that are new, carried over, and gone since the one before."""
    rows = cut(_sections(spark, sf_dir).select("source", "month", "digest").distinct())
    snapshots = cut(_snapshots(rows))
    now = rows.join(snapshots, ["source", "month"]).select("source", "month", "digest", F.lit(1).alias("now"), F.lit(0).alias("was"))
    was = rows.withColumnRenamed("month", "before").join(snapshots, ["source", "before"]).select("source", "month", "digest", F.lit(0).alias("now"), F.lit(1).alias("was"))
    each = now.unionByName(was).groupBy("source", "month", "digest").agg(F.max("now").alias("now"), F.max("was").alias("was"))
    return each.groupBy("source", "month").agg(F.count_if((F.col("now") == 1) & (F.col("was") == 0)).alias("n_new"), F.count_if((F.col("now") == 1) & (F.col("was") == 1)).alias("n_carried"), F.count_if((F.col("now") == 0) & (F.col("was") == 1)).alias("n_gone"))


def a15_section_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 - shared / all sections of consecutive snapshots."""
    counts = i62_ingest_counts(spark, sf_dir)
    first = Window.partitionBy("source").orderBy("month")
    rows = counts.withColumn("nth", F.row_number().over(first)).where("nth > 1")
    return rows.select("source", "month", F.round(1 - F.col("n_carried") / (F.col("n_new") + F.col("n_carried") + F.col("n_gone")), 6).alias("churn"))


def a16_source_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn of a source's consecutive snapshots, summed, times ln(snapshots + 1)."""
    sums = a15_section_churn(spark, sf_dir).groupBy("source").agg(F.sum("churn").alias("churn"), (F.count("*") + 1).alias("n_snapshots"))
    return sums.select("source", "n_snapshots", F.round(F.col("churn") * F.log(F.col("n_snapshots") + 1.0), 6).alias("volatility"))


def i66_page_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (titles of a source) by what happened between its last two snapshots: new, gone, changed or unchanged."""
    rows = table(spark, sf_dir, "documents").where("collected_at is not null and text is not null and source is not null and title is not null").select("source", F.date_format("collected_at", "yyyy-MM").alias("month"), "title", F.md5("text").alias("digest"))
    pages = cut(rows.groupBy("source", "month", "title").agg(F.max("digest").alias("digest")))
    last = pages.select("source", "month").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy(F.col("month").desc()))).where("nth <= 2")
    both = pages.join(last, ["source", "month"]).groupBy("source", "title").agg(F.max(F.when(F.col("nth") == 1, F.col("digest"))).alias("now"), F.max(F.when(F.col("nth") == 2, F.col("digest"))).alias("was"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("was"), "unchanged").otherwise("changed")
    return both.groupBy("source", state.alias("state")).agg(F.count("*").alias("n_pages"))


def _ttl(source: Column) -> Column:
    out = F.lit(DEFAULT_TTL)
    for kind, days in TTL_DAYS.items():
        out = F.when(source.startswith(f"{kind}:"), days).otherwise(out)
    return out


def i68_stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose last document is older than their time to live, counted from the last document of all."""
    seen = table(spark, sf_dir, "documents").where("collected_at is not null and source is not null").groupBy("source").agg(F.max("collected_at").alias("last"))
    today = seen.agg(F.max("last").alias("today"))
    rows = seen.join(F.broadcast(today)).select("source", F.datediff(F.col("today").cast("date"), F.col("last").cast("date")).alias("age"), _ttl(F.col("source")).alias("ttl"))
    return rows.where("age > ttl")


def i64_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes with the documents of archived sources: the edges from or to them and the votes on those, per source."""
    gone = table(spark, sf_dir, "documents").where(F.col("source").endswith("-archive")).select("doc_id", "source")
    stored = edges(spark, sf_dir).select("alignment_edge_id", "from_doc_section_id", "to_doc_section_id")
    ends = stored.select("alignment_edge_id", F.explode(F.array_distinct(F.array_compact(F.array("from_doc_section_id", "to_doc_section_id")))).alias("doc_id"))
    purged = cut(ends.join(gone, "doc_id").select("source", "alignment_edge_id").distinct())
    votes = table(spark, sf_dir, "alignment_vote").select("alignment_edge_id", "alignment_vote_id").distinct()
    n_votes = purged.join(votes, "alignment_edge_id").groupBy("source").agg(F.count("*").alias("n_votes"))
    counts = gone.groupBy("source").agg(F.count("*").alias("n_documents")).join(purged.groupBy("source").agg(F.count("*").alias("n_edges")), "source", "left").join(n_votes, "source", "left")
    return counts.select("source", "n_documents", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("n_votes", F.lit(0)).alias("n_votes"))


def i70_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that wait for extraction, book by book, in batches of BATCH."""
    rows = chapters(spark, sf_dir, "book_id", "chapter_num", "indexed_at", "extraction_attempted_at")
    waiting = rows.where(F.col("extraction_attempted_at").isNull() | (F.col("extraction_attempted_at") < F.col("indexed_at")))
    nth = F.row_number().over(Window.partitionBy("book_id").orderBy(F.col("chapter_num").asc_nulls_last(), "chapter_id"))
    return waiting.select("book_id", "chapter_id", F.floor((nth - 1) / BATCH).cast("int").alias("batch"))


def i71_twin_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of books that are no longer active, with the chapter of the same content in an active one."""
    rows = chapters(spark, sf_dir, "book_id", "content_hash").where("content_hash is not null").join(books(spark, sf_dir, "status"), "book_id")
    twins = rows.where("status = 'active'").groupBy("content_hash").agg(F.min("chapter_id").alias("twin_id"))
    return rows.where("status <> 'active'").join(twins, "content_hash", "left").select("chapter_id", "book_id", "twin_id")


def i76_edge_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with stored edges: relation, confidence, or an end that does not exist."""
    rows = edges(spark, sf_dir)
    known = [(table(spark, sf_dir, "documents").select("doc_id"), "from_doc_section_id", "no document"), (table(spark, sf_dir, "chapter").select("chapter_id"), "to_chapter_id", "no chapter"), (concepts(spark, sf_dir, "name").select("concept_id"), "concept_id", "no concept")]
    checks = [
        rows.where(~F.coalesce(F.col("relation_type").isin("CORROBORATES", "CONTRADICTS"), F.lit(False))).select("alignment_edge_id", F.lit("relation").alias("problem")),
        rows.where(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1)).select("alignment_edge_id", F.lit("confidence").alias("problem")),
        rows.where("to_chapter_id is null and to_doc_section_id is null").select("alignment_edge_id", F.lit("no target").alias("problem")),
        *[rows.where(F.col(c).isNotNull()).join(df.distinct().toDF(c), c, "left_anti").select("alignment_edge_id", F.lit(problem).alias("problem")) for df, c, problem in known],
    ]
    out = checks[0]
    for part in checks[1:]:
        out = out.unionByName(part)
    return out


def i78_pairs_to_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to look at again: all contradictions, and corroborations without much confidence."""
    weak = (F.col("relation_type") == "CORROBORATES") & (F.coalesce("confidence", F.lit(0.0)) < WEAK)
    return edges(spark, sf_dir).where((F.col("relation_type") == "CONTRADICTS") | weak).select("alignment_edge_id", "relation_type", "confidence", F.when(weak, "weak").otherwise("contradiction").alias("reason"))


def i42_derived_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings for documents without a title or with an address for one: the first heading of the text, else its first line of at most twelve words."""
    address = F.lower(F.trim("title")).rlike("^(https?://|www[.])")
    rows = table(spark, sf_dir, "documents").where(F.col("title").isNull() | address)
    lines = F.filter(F.transform(F.split("text", r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    marked = F.regexp_extract(F.get(F.filter(lines, lambda x: x.rlike("^#{1,6} .*[^ #]")), F.lit(0)), "^#{1,6} +(.*[^ #])", 1)
    short = F.get(F.filter(lines, lambda x: (F.size(F.split(x, " +")) <= 12) & ~x.rlike("^([`|~]|https?://)")), F.lit(0))
    return rows.select("doc_id", F.coalesce(F.nullif(marked, F.lit("")), short).alias("heading"))


def i41_heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from the root down to each chapter."""
    paths = cut(resolve_forest(latest_links(table(spark, sf_dir, "chapter"), *TREES["chapter"]), paths=True))
    steps = paths.select("node", F.posexplode("path").alias("at", "step"))
    titles = chapters(spark, sf_dir, "title").select(F.col("chapter_id").alias("step"), F.coalesce(F.trim("title"), F.lit("")).alias("title"))
    named = steps.join(titles, "step").where("title <> ''").groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "title"))), lambda x: x["title"]), " › ").alias("heading_path"))
    return named.select(F.col("node").alias("chapter_id"), "heading_path")


def i06_file_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles read from the names of book files: without the leading number, the ending and an ISBN."""
    name = F.regexp_replace(F.substring_index("source_path", "/", -1), r"\.[A-Za-z0-9]+$", "")
    words = F.regexp_replace(F.regexp_replace(name, r"^\d+-", ""), "[-_]+", " ")
    return books(spark, sf_dir, "source_path").where("source_path is not null").select("book_id", X.clean_title(words, "untitled").alias("file_title"))


QUERIES = {
    f.__name__: f
    for f in (
        i61_snapshot_changes, i62_ingest_counts, i63_carried_sections, a15_section_churn, a16_source_volatility, i66_page_changes, i68_stale_sources, i64_purge, i70_batches, i71_twin_chapters, i76_edge_checks, i78_pairs_to_review,
        i42_derived_headings, i41_heading_paths, i06_file_titles,
    )
}

_SEC = r"""sl AS (SELECT source, strftime(collected_at, '%Y-%m') AS month, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE collected_at IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL),
sp AS (SELECT source, month, doc_id, lower(trim(regexp_replace(line, '[ \t\r\f]+', ' ', 'g'), ' ')) AS p FROM sl), se AS (SELECT source, month, doc_id, md5(p) AS digest FROM sp WHERE length(p) >= 20)"""
_SNAP = "sn AS (SELECT source, month, lag(month) OVER (PARTITION BY source ORDER BY month) AS before FROM (SELECT DISTINCT source, month FROM se))"
_COUNTS = f"""{_SEC}, {_SNAP}, ds AS (SELECT DISTINCT source, month, digest FROM se), fl AS (SELECT source, month, digest, 1 AS now, 0 AS was FROM ds UNION ALL SELECT ds.source, sn.month, digest, 0, 1 FROM ds JOIN sn ON sn.source = ds.source AND sn.before = ds.month),
ea AS (SELECT source, month, digest, max(now) AS now, max(was) AS was FROM fl GROUP BY 1, 2, 3), ct AS (SELECT source, month, count(*) FILTER (now = 1 AND was = 0) AS n_new, count(*) FILTER (now = 1 AND was = 1) AS n_carried, count(*) FILTER (now = 0 AND was = 1) AS n_gone FROM ea GROUP BY 1, 2),
cr AS (SELECT source, month, round(1 - n_carried / (n_new + n_carried + n_gone), 6) AS churn FROM ct QUALIFY row_number() OVER (PARTITION BY source ORDER BY month) > 1)"""
_EDGE = "ed AS (SELECT * FROM alignment_edge QUALIFY row_number() OVER (PARTITION BY alignment_edge_id ORDER BY created_at DESC NULLS LAST, concept_id DESC NULLS LAST) = 1)"

SQL = {
    "i61_snapshot_changes": f"""WITH {_SEC}, s AS (SELECT source, month, count(*) AS n_sections, sum(CAST('0x' || substr(digest, 1, 15) AS BIGINT)) AS su FROM se GROUP BY 1, 2), l AS (SELECT *, lag(su) OVER w AS ps, lag(n_sections) OVER w AS pn FROM s WINDOW w AS (PARTITION BY source ORDER BY month))
SELECT source, month, n_sections, CASE WHEN ps IS NULL THEN 'first' WHEN ps = su AND pn = n_sections THEN 'unchanged' ELSE 'changed' END AS state FROM l""",
    "i63_carried_sections": f"WITH {_SEC}, {_SNAP}, o AS (SELECT source, month AS before, digest, min(doc_id) AS old_doc_id FROM se GROUP BY 1, 2, 3) SELECT DISTINCT se.source, se.month, doc_id, se.digest, old_doc_id FROM se JOIN sn ON sn.source = se.source AND sn.month = se.month JOIN o ON o.source = se.source AND o.before = sn.before AND o.digest = se.digest",
    "i62_ingest_counts": f"WITH {_COUNTS} SELECT * FROM ct",
    "a15_section_churn": f"WITH {_COUNTS} SELECT * FROM cr",
    "a16_source_volatility": f"WITH {_COUNTS} SELECT source, count(*) + 1 AS n_snapshots, round(sum(churn) * ln(count(*) + 2), 6) AS volatility FROM cr GROUP BY 1",
    "i66_page_changes": """WITH r AS (SELECT source, strftime(collected_at, '%Y-%m') AS month, title, max(md5(text)) AS digest FROM documents WHERE collected_at IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL AND title IS NOT NULL GROUP BY 1, 2, 3),
l AS (SELECT source, month, row_number() OVER (PARTITION BY source ORDER BY month DESC) AS nth FROM (SELECT DISTINCT source, month FROM r) QUALIFY nth <= 2), b AS (SELECT source, title, max(digest) FILTER (nth = 1) AS now, max(digest) FILTER (nth = 2) AS was FROM r JOIN l USING (source, month) GROUP BY 1, 2)
SELECT source, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'gone' WHEN now = was THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS n_pages FROM b GROUP BY 1, 2""",
    "i68_stale_sources": """WITH s AS (SELECT source, max(collected_at) AS last FROM documents WHERE collected_at IS NOT NULL AND source IS NOT NULL GROUP BY 1), a AS (SELECT source, CAST(date_diff('day', CAST(last AS DATE), CAST((SELECT max(last) FROM s) AS DATE)) AS INTEGER) AS age, CASE WHEN source LIKE 'api:%' THEN 7 WHEN source LIKE 'git:%' THEN 14 WHEN source LIKE 'site:%' THEN 30 ELSE 90 END AS ttl FROM s) SELECT * FROM a WHERE age > ttl""",
    "i64_purge": f"""WITH {_EDGE}, g AS (SELECT doc_id, source FROM documents WHERE source LIKE '%-archive'), p AS (SELECT DISTINCT source, alignment_edge_id FROM ed JOIN g ON doc_id = from_doc_section_id UNION SELECT source, alignment_edge_id FROM ed JOIN g ON doc_id = to_doc_section_id),
v AS (SELECT source, count(*) AS n FROM p JOIN (SELECT DISTINCT alignment_edge_id, alignment_vote_id FROM alignment_vote) USING (alignment_edge_id) GROUP BY 1), e AS (SELECT source, count(*) AS n FROM p GROUP BY 1)
SELECT source, count(*) AS n_documents, coalesce(any_value(e.n), 0) AS n_edges, coalesce(any_value(v.n), 0) AS n_votes FROM g LEFT JOIN e USING (source) LEFT JOIN v USING (source) GROUP BY source""",
    "i70_batches": f"WITH {CHAPTERS} SELECT book_id, chapter_id, CAST((row_number() OVER (PARTITION BY book_id ORDER BY chapter_num NULLS LAST, chapter_id) - 1) // 20 AS INTEGER) AS batch FROM ch WHERE extraction_attempted_at IS NULL OR extraction_attempted_at < indexed_at",
    "i71_twin_chapters": f"WITH {CHAPTERS}, {BOOKS}, r AS (SELECT chapter_id, book_id, ch.content_hash, status FROM ch JOIN bk USING (book_id) WHERE ch.content_hash IS NOT NULL), t AS (SELECT content_hash, min(chapter_id) AS twin_id FROM r WHERE status = 'active' GROUP BY 1) SELECT chapter_id, book_id, twin_id FROM r LEFT JOIN t USING (content_hash) WHERE status <> 'active'",
    "i76_edge_checks": f"""WITH {CONCEPTS}, {_EDGE} SELECT alignment_edge_id, 'relation' AS problem FROM ed WHERE NOT coalesce(relation_type IN ('CORROBORATES', 'CONTRADICTS'), false) UNION ALL SELECT alignment_edge_id, 'confidence' FROM ed WHERE confidence IS NULL OR NOT confidence BETWEEN 0 AND 1
UNION ALL SELECT alignment_edge_id, 'no target' FROM ed WHERE to_chapter_id IS NULL AND to_doc_section_id IS NULL UNION ALL SELECT alignment_edge_id, 'no document' FROM ed WHERE from_doc_section_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT alignment_edge_id, 'no chapter' FROM ed WHERE to_chapter_id NOT IN (SELECT chapter_id FROM chapter WHERE chapter_id IS NOT NULL) UNION ALL SELECT alignment_edge_id, 'no concept' FROM ed WHERE concept_id NOT IN (SELECT concept_id FROM co)""",
    "i78_pairs_to_review": f"WITH {_EDGE} SELECT alignment_edge_id, relation_type, confidence, CASE WHEN relation_type = 'CORROBORATES' THEN 'weak' ELSE 'contradiction' END AS reason FROM ed WHERE relation_type = 'CONTRADICTS' OR (relation_type = 'CORROBORATES' AND coalesce(confidence, 0) < 0.5)",
    "i42_derived_headings": r"""WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM documents WHERE title IS NULL OR regexp_matches(lower(trim(title)), '^(https?://|www[.])'))
SELECT doc_id, coalesce(nullif(regexp_extract(list_filter(ls, lambda x: regexp_matches(x, '^#{1,6} .*[^ #]'))[1], '^#{1,6} +(.*[^ #])', 1), ''), list_filter(ls, lambda x: len(regexp_split_to_array(x, ' +')) <= 12 AND NOT regexp_matches(x, '^([`|~]|https?://)'))[1]) AS heading FROM d""",
    "i41_heading_paths": f"""WITH RECURSIVE {_LINKS}, {CHAPTERS}, st AS (SELECT id AS chapter_id, unnest(string_split(path, '/')) AS step, generate_subscripts(string_split(path, '/'), 1) AS place FROM w WHERE tree = 'chapter')
SELECT st.chapter_id, string_agg(trim(title, ' '), ' › ' ORDER BY place) AS heading_path FROM st JOIN ch ON ch.chapter_id = CAST(step AS BIGINT) WHERE trim(coalesce(title, ''), ' ') <> '' GROUP BY 1""",
    "i06_file_titles": rf"WITH {BOOKS}, n AS (SELECT book_id, regexp_replace(regexp_replace(regexp_replace(string_split(source_path, '/')[-1], '\.[A-Za-z0-9]+$', ''), '^\d+-', ''), '[-_]+', ' ', 'g') AS t FROM bk WHERE source_path IS NOT NULL) SELECT book_id, coalesce(nullif(trim(regexp_replace(t, '-?\b(97[89])?\d{{9}}[\dX]$', ''), ' '), ''), 'untitled') AS file_title FROM n",
}
