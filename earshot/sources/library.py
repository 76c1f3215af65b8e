"""The external music library: one row per file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from earshot.session import folder_at

OPTIONAL = {"participants": "string", "has_cover_art": "boolean"}

LIBRARY_SCHEMA = """id string, title string, artist string, participants string, album string, album_id string, artist_id string,
 album_artist string, duration int, track_number int, size bigint, missing boolean, genre string, updated_at string,
 has_cover_art boolean"""


def with_optional_columns(library: DataFrame) -> DataFrame:
    for name, kind in OPTIONAL.items():
        if name not in library.columns:
            library = library.withColumn(name, F.lit(None).cast(kind))
    return library


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet snapshot of the library; columns some servers lack come as NULL, without a look at every footer."""
    return spark.read.schema(LIBRARY_SCHEMA).parquet(path)


def visible(library: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Files that are there: not flagged missing, not in the recently deleted ``id`` list."""
    shown = library.filter(F.col("missing").cast("boolean") == F.lit(False))
    return shown if deleted is None else shown.join(deleted.select("id").distinct(), "id", "left_anti")


# -- snapshots: <path>/version=<n>/... , each a whole library; the largest number is the present one ----------------


def library_version(spark: SparkSession, path: str) -> int:
    """The number of the newest snapshot; 0 for none.  A listing of one folder, so cheap enough for every micro-batch."""
    at, files = folder_at(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=0)


def publish_library(library: DataFrame, path: str) -> int:
    """Write a snapshot and give it the next number; readers see it whole or not at all."""
    spark = library.sparkSession
    version = library_version(spark, path) + 1
    staged = f"{path}/_new-{uuid.uuid4().hex}"
    with_optional_columns(library).write.parquet(staged)
    (source, files), (target, _) = folder_at(spark, staged), folder_at(spark, f"{path}/version={version}")
    if not files.rename(source, target):
        raise OSError(f"snapshot {version} could not be put in place")
    return version


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A snapshot, the newest by default; no files where there is none."""
    version = library_version(spark, path) if version is None else version
    return read_library(spark, f"{path}/version={version}") if version else spark.createDataFrame([], LIBRARY_SCHEMA)
