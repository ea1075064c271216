"""Session helpers shared by all operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("voxloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only where that is unset (tests, the bench) a temporary one is made."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="voxloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage; what is written outlives the executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of frames that are no longer referenced.

    Spark deletes them when the driver collects its garbage, which a small driver may not do for
    hours; a loop that leaves a shuffle behind each round would fill the disks meanwhile.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checked_broadcast(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df`` marked for a broadcast join if it has at most ``most`` rows, else ``df`` as it is.

    The rows are counted first, so call it on a durable or otherwise cheap table of narrow rows.
    Beyond the bound Spark shuffles both sides, splitting skewed partitions.
    """
    if df.limit(most + 1).count() <= most:
        return F.broadcast(df)
    return df


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder and read again: for tables that carry texts."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
