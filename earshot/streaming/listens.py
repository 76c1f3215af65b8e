"""Listens as a stream: parse, enrich, append, and two results kept up to date.

Listens are stamped when received and duplicates count, so there is no watermark, no late-data
rule and no de-duplication here: none would leave the results equal to a batch over the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from earshot.functions.measures import plays, playtime, views
from earshot.functions.timecols import epoch_seconds, iso, local_date
from earshot.operators.enrich import Files, enrich_listens, keyed_files
from earshot.params import Clock, ntz
from earshot.session import written_for_now
from earshot.sources.library import library_version, read_snapshot
from earshot.sources.listens import LISTEN_COLUMNS, append_listens, numbered, top_id
from earshot.sources.payloads import parse_listen_payloads


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gives a query for the life of its checkpoint."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def _states(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _keep_state(path: str):
    """Write the whole state after each micro-batch, taking turns between two folders.

    States are numbered on from what is there, whichever query wrote it, so that after a restart with a new checkpoint the
    newest state still wins.  The older one stays valid while the other is replaced, and a
    long-lived stream leaves no more than these behind.
    """

    def write(state: DataFrame, epoch: int) -> None:
        before = _states(state.sparkSession, path)
        last = before.agg(F.max("written")).first()[0] if before is not None else None
        nth = 0 if last is None else last + 1
        state.withColumn("written", F.lit(nth).cast("bigint")).write.mode("overwrite").parquet(f"{path}/turn={nth % 2}")

    return write


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows that the micro-batches wrote."""
    return spark.read.parquet(path).drop("stream", "epoch")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The state after the last micro-batch."""
    states = spark.read.parquet(path)
    return states.filter(F.col("written") == states.agg(F.max("written")).scalar()).drop("written", "turn")


@dataclass(frozen=True)
class LiveLibrary:
    """The library as snapshots that ``publish_library`` adds to while a stream runs."""

    path: str


class _Keyed:
    """The library keyed for look-ups: once where it is a DataFrame, else once for each snapshot, whose tables replace the former's."""

    def __init__(self, library: DataFrame | LiveLibrary):
        self._library = library
        self._files: Files | None = None
        self._version = -1
        self._drops: list[Callable[[], None]] = []

    def files(self, spark: SparkSession) -> Files:
        live = isinstance(self._library, LiveLibrary)
        version = library_version(spark, self._library.path) if live else 0
        if self._files is None or version != self._version:
            old, self._drops = self._drops, []
            self._files = keyed_files(read_snapshot(spark, self._library.path, version) if live else self._library, self._keep)
            self._version = version
            for drop in old:
                drop()
        return self._files

    def _keep(self, df: DataFrame, purpose: str) -> DataFrame:
        kept, drop = written_for_now(df, purpose)
        self._drops.append(drop)
        return kept


def _enriching(library: DataFrame | LiveLibrary, checkpoint: str, then):
    """A micro-batch function: enrich, then ``then(rows, stream id, epoch)``.

    The library is keyed when the first micro-batch comes, and again whenever a snapshot was published since the last one, so each
    micro-batch is enriched from the library as it stood when it began.  The cascade reads the batch and its own steps several
    times; they are written to the shared folder for that, in as many files as their size asks for, and removed with the micro-batch.
    """
    keyed = _Keyed(library)

    def write(batch: DataFrame, epoch: int) -> None:
        files = keyed.files(batch.sparkSession)
        drops: list[Callable[[], None]] = []

        def hold(df: DataFrame, purpose: str) -> DataFrame:
            kept, drop = written_for_now(df, purpose)
            drops.append(drop)
            return kept

        try:
            then(enrich_listens(batch, files, keep=hold), _stream_id(batch.sparkSession, checkpoint), epoch)
        finally:
            for drop in drops:
                drop()

    return write


def stream_enrich(bodies: DataFrame, library: DataFrame | LiveLibrary, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Parse posted bodies and enrich each micro-batch with the batch operator.

    Pairs are resolved once per batch; the library is a static side, or a live one that is looked at before each micro-batch.  A folder per stream and micro-batch: one that is
    repeated after a failure replaces itself.
    """

    def then(rows: DataFrame, stream: str, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/stream={stream}/epoch={epoch}")

    return _start(parse_listen_payloads(bodies).writeStream.foreachBatch(_enriching(library, checkpoint, then)), checkpoint, available_now)


def stream_ingest(bodies: DataFrame, library: DataFrame | LiveLibrary, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Landed bodies to the stored fact: parse, enrich, number on from the store's largest id, append as a commit per micro-batch.

    A repeated micro-batch replaces its commit.  One writer at a time numbers a store.
    """

    def then(rows: DataFrame, stream: str, epoch: int) -> None:
        spark = rows.sparkSession
        append_listens(numbered(rows, top_id(spark, path)), path, f"{stream}-{epoch}")

    return _start(parse_listen_payloads(bodies).writeStream.foreachBatch(_enriching(library, checkpoint, then)), checkpoint, available_now)


def ingest_listens(bodies: DataFrame, library: DataFrame, path: str, commit: str | None = None) -> None:
    """The same for a batch of landed bodies."""
    rows = enrich_listens(parse_listen_payloads(bodies), library)
    append_listens(numbered(rows, top_id(bodies.sparkSession, path)), path, commit)


def stream_append(listens: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append listens to the stored fact: a commit per micro-batch, in the layout of every other append."""

    def write(batch: DataFrame, epoch: int) -> None:
        append_listens(batch, path, f"{_stream_id(batch.sparkSession, checkpoint)}-{epoch}")

    return _start(listens.select(*LISTEN_COLUMNS, "ts").writeStream.foreachBatch(write), checkpoint, available_now)


_PLAYING = ["id", "track_name", "artist_name", "album_name", "track_id", "album_id", "artist_id", "duration", "ts"]


def stream_now_playing(listens: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keep the last view by id: one row of state."""
    last = listens.filter(F.col("event_type") == "view").groupBy().agg(F.max_by(F.struct(*_PLAYING), "id").alias("last"))
    writer = last.select("last.*").writeStream.outputMode("complete").foreachBatch(_keep_state(path))
    return _start(writer, checkpoint, available_now)


def read_now_playing(spark: SparkSession, path: str, clock: Clock, ttl: int = 300) -> DataFrame:
    """The kept view, if it is fresh at reading time."""
    fresh = F.col("ts") >= ntz(clock.as_of.replace(microsecond=0)) - F.make_dt_interval(secs=F.lit(ttl))
    rows = read_latest(spark, path).filter(fresh)
    return rows.select(*[c for c in _PLAYING if c != "ts"], epoch_seconds(F.col("ts")).alias("timestamp"))


def stream_counters(listens: DataFrame, clock: Clock, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keep views, plays and playtime per local day: one row of state per day."""
    days = listens.groupBy(local_date(clock).alias("day")).agg(views(), plays(), playtime())
    writer = days.writeStream.outputMode("complete").foreachBatch(_keep_state(path))
    return _start(writer, checkpoint, available_now)


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    return read_latest(spark, path).withColumn("day", iso(F.col("day")))
