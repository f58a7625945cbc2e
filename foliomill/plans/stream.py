"""Streaming and sectionizer queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.runtime import table
from foliomill.sources.markdown import parts, sectionize
from foliomill.streaming.events import drain, parsed_events, stream_table


def s_event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type, read as a stream."""
    rows = drain(parsed_events(stream_table(spark, sf_dir, "events")))
    return rows.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.sum("n_props").alias("n_props")).withColumn("day", F.col("day").cast("string"))


def i31_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown sections of the documents: one row per heading of level one or two."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sectionize(docs, "doc_id", "text").select("doc_id", "ordinal", "parent", "level", "heading", F.length("body").alias("body_chars"))


def i31_section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by level, fences left out by the sectionizer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sectionize(docs, "doc_id", "text", split_level=6).groupBy("level").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_documents"))


def i33_section_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections down to level four cut into parts of at most 4,000 characters, fenced blocks kept whole; named (part k/n) where there are several."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sectionize(docs, "doc_id", "text", split_level=4).select("doc_id", "ordinal", "heading", parts(F.col("body")).alias("parts"))
    each = rows.select("doc_id", "ordinal", "heading", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part"))
    named = F.when(F.col("n") > 1, F.concat("heading", F.lit(" (part "), (F.col("k") + 1).cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("heading"))
    return each.select("doc_id", "ordinal", named.alias("heading"), F.length("part").alias("n_chars"))


QUERIES = {f.__name__: f for f in (s_event_days, i31_sections, i31_section_counts, i33_section_parts)}

_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}\x{1C}-\x{1F}]"
# a fence is open behind an odd number of fence lines
_LINES = rf"""sp AS (SELECT doc_id, regexp_split_to_array(text, '\r\n?|\n') AS ls FROM documents WHERE text IS NOT NULL), ln AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM sp),
mk AS (SELECT *, regexp_matches(line, '^ {{0,3}}(```|~~~)') AS m, sum(CASE WHEN regexp_matches(line, '^ {{0,3}}(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS c FROM ln),
hd AS (SELECT *, CASE WHEN NOT m AND c % 2 = 0 AND regexp_matches(line, '^ {{0,3}}#{{1,6}}{_SPACE}') THEN length(regexp_extract(line, '^ {{0,3}}(#+)', 1)) END AS level FROM mk)"""

SQL = {
    "i31_section_counts": f"WITH {_LINES} SELECT CAST(level AS INTEGER) AS level, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM hd WHERE level IS NOT NULL GROUP BY 1",
    "i31_sections": rf"""WITH {_LINES}, se AS (SELECT *, CAST(sum(CASE WHEN level <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) - 1 AS INTEGER) AS ordinal FROM hd),
bo AS (SELECT doc_id, ordinal, min(CASE WHEN level <= 2 THEN level END) AS level, min(CASE WHEN level <= 2 THEN line END) AS head, string_agg(CASE WHEN level <= 2 THEN NULL ELSE line END, chr(10) ORDER BY no) AS body FROM se WHERE ordinal >= 0 GROUP BY 1, 2)
SELECT doc_id, ordinal, CAST(CASE WHEN level = 1 THEN -1 ELSE coalesce(max(CASE WHEN level = 1 THEN ordinal END) OVER (PARTITION BY doc_id ORDER BY ordinal), -1) END AS INTEGER) AS parent, CAST(level AS INTEGER) AS level, regexp_extract(head, '^ {{0,3}}#+{_SPACE}+(.*?){_SPACE}*#*{_SPACE}*$', 1) AS heading,
CAST(length(regexp_replace(regexp_replace(coalesce(body, ''), '^{_SPACE}+', ''), '{_SPACE}+$', '')) AS INTEGER) AS body_chars FROM bo""",
    "s_event_days": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, CAST(sum(coalesce(len(json_keys(props)), 0)) AS BIGINT) AS n_props FROM events GROUP BY 1, 2",
}
