"""Structured Streaming over files: de-duplicated event windows and the latest vote of each annotator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.runtime import checkpoint_dir


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its parquet files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream until its input is used up; the parquet it wrote, in the shared checkpoint folder."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def hourly_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Count and sum per event type and hour; rows later than the watermark are dropped by the engine."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def parsed_events(events: DataFrame) -> DataFrame:
    """Stateless part: day, type and the number of properties of each event."""
    return events.select("event_id", F.to_date("ts").alias("day"), "event_type", F.coalesce(F.size(F.expr("json_object_keys(props)")), F.lit(0)).alias("n_props"))
