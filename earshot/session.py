"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "earshot", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small inputs still have text work to share among the cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext.getCheckpointDir() is None:
        # One machine: its own temporary folder is shared by definition.
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="earshot-"))
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and every executor see, as ``spark.checkpoint.dir`` names it.

    A session without that setting may name a folder with ``SparkContext.setCheckpointDir``.  There is no
    other stand-in: a machine-local folder would lose rows on a cluster, so its absence is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir (or call setCheckpointDir) to a folder that all executors share")
    return configured.rstrip("/")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Let ``checkpoint()`` write to the shared root, unless the cluster already set a folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def folder_at(spark: SparkSession, path: str):
    """A path and the file system that holds it, as Hadoop has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared root for one run of one job, removed when the application ends."""
    folder = f"{shared_root(spark)}/earshot/{purpose}-{uuid.uuid4().hex}"
    path, files = folder_at(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/rows"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result once to the shared root and go on from the files.

    What follows may read it several times, plans with its true size, and does not depend on
    executors that held it.
    """
    folder = work_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a work folder before the application ends."""
    path, files = folder_at(spark, folder)
    files.delete(path, True)


def written_for_now(df: DataFrame, purpose: str) -> tuple[DataFrame, Callable[[], None]]:
    """As ``written``, with a function that removes the files once nothing reads them any more."""
    folder = work_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), lambda: remove_folder(df.sparkSession, folder)
