"""Listen payloads: nested JSON bodies to one row per listen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from earshot.functions.text import or_unknown

PAYLOAD_SCHEMA = """
listen_type string,
payload array<struct<track_metadata: struct<
  track_name: string, artist_name: string, release_name: string, additional_info: struct<duration_ms: double>>>>
"""


BODY_SCHEMA = "user_name string, received_at timestamp_ntz, body string"


def read_bodies(spark: SparkSession, path: str, stream: bool = False, files: int = 200) -> DataFrame:
    """Posted bodies as a receiver lands them: JSON lines with sender, receipt time and body.

    As a stream, a micro-batch takes at most ``files`` files.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files) if stream else spark.read
    return reader.schema(BODY_SCHEMA).json(path)


def parse_listen_payloads(bodies: DataFrame, body: str = "body") -> DataFrame:
    """One row per listen of each body; other columns (user_name, received_at, ...) are kept.

    An empty payload gives no rows, absent names become the stand-in name, and ``playing_now``
    is a view while any other type is a play.  Runs on batches and on streams.
    """
    kept = [c for c in bodies.columns if c != body]
    rows = bodies.withColumn("_doc", F.from_json(body, PAYLOAD_SCHEMA))
    rows = rows.select(*kept, F.col("_doc.listen_type").alias("_type"), F.explode("_doc.payload").alias("_listen"))
    track = F.col("_listen.track_metadata")
    view = F.coalesce(F.col("_type") == "playing_now", F.lit(False))
    if "user_name" in kept:
        rows = rows.withColumn("user_name", or_unknown(F.col("user_name")))
    return rows.select(
        *kept,
        or_unknown(track["track_name"]).alias("track_name"),
        or_unknown(track["artist_name"]).alias("artist_name"),
        or_unknown(track["release_name"]).alias("album_name"),
        track["additional_info"]["duration_ms"].alias("duration_ms"),
        F.when(view, F.lit("view")).otherwise(F.lit("play")).alias("event_type"),
    )
