"""Counting versions of the tables, shared by the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.runtime import table


def _latest(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """One row per key: the greatest (version, columns); partial aggregation, no window."""
    rows = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(version).alias("_version"), *columns)).alias("row"))
    return rows.select(key, *[F.col(f"row.{c}").alias(c) for c in columns])


def chapters(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _latest(table(spark, sf_dir, "chapter"), "chapter_id", "indexed_at", list(columns))


def books(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _latest(table(spark, sf_dir, "book"), "book_id", "updated_at", list(columns))


def concepts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _latest(table(spark, sf_dir, "concept"), "concept_id", "updated_at", list(columns))


#: The same in SQL, as CTEs.
CHAPTERS = "ch AS (SELECT * FROM chapter WHERE chapter_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chapter_id ORDER BY indexed_at DESC NULLS LAST) = 1)"
BOOKS = "bk AS (SELECT * FROM book WHERE book_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY updated_at DESC NULLS LAST) = 1)"
CONCEPTS = "co AS (SELECT * FROM concept WHERE concept_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY updated_at DESC NULLS LAST) = 1)"
