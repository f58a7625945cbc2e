"""Sinks: partitioned Parquet, JSON lines and an audit trail, all appendable and read back with a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT = "action string, subject string, digest string, at timestamp"


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "append") -> None:
    """Parquet, partitioned by ``by``; rows of one partition value are brought together first, in as many files as AQE finds fit."""
    rows = df.repartition(*[F.col(c) for c in by]) if by else df
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines; nulls are left out."""
    df.write.mode(mode).json(path)


def record(df: DataFrame, path: str, action: str, subject: Column, *content: Column) -> None:
    """Appends one audit row per row of ``df``: what was done, to whom, and a hash of the content, never the content."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in content]), 256)
    write_json(df.select(F.lit(action).alias("action"), subject.cast("string").alias("subject"), digest.alias("digest"), F.current_timestamp().alias("at")), path)


def summary(spark: SparkSession, path: str) -> DataFrame:
    """(action, n, n_subjects, n_contents) of an audit trail."""
    rows = spark.read.schema(AUDIT).json(path)
    return rows.groupBy("action").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("n_subjects"), F.countDistinct("digest").alias("n_contents"))
