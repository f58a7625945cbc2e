"""Session, table and materialisation helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "foliomill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (AQE, skew join, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table (file or directory) of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A local session that names none (as in tests) gets a temporary one; a cluster must name a folder
    that all its machines share. The folder of this run is deleted when the program ends with the
    session still open.
    """
    context = spark.sparkContext
    jvm_dir = context._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get()
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(named)
    folder = context._jsc.sc().getCheckpointDir().get()
    atexit.register(_delete_at_exit, spark, folder)
    return folder


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    with suppress(Exception):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read again.

    This cuts the lineage, survives the loss of executors and runs the plan once (a checkpoint
    runs its last stage twice); the sizes of the files guide later joins.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._cut_path = path
    return written


def release(df: DataFrame) -> None:
    """Deletes the table behind a result of ``cut`` that no later plan reads (older rounds of a loop)."""
    path = getattr(df, "_cut_path", None)
    if path:
        _delete(df.sparkSession, path)


def spread(df: DataFrame, *keys: str, rows_per_task: int = 20_000) -> DataFrame:
    """``df`` in as many partitions as its number of rows asks for, in front of a Python stage.

    The cost of such a stage goes by rows, while adaptive execution would size its tasks by bytes. All
    cores get a part, and no task more than about ``rows_per_task`` rows. Pass a table: its rows are counted.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows_per_task)), *keys)


def small_or_shuffled(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if ``df`` is proven to hold at most ``max_rows`` rows.

    The proof is a count of at most ``max_rows + 1`` rows; beyond the bound the plain
    DataFrame is returned and the join shuffles.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
