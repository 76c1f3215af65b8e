"""The listen fact: schema, reader, append, export and import."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from earshot.functions.measures import measures
from earshot.functions.text import blank
from earshot.functions.timecols import epoch_seconds, from_epoch_seconds
from earshot.operators.enrich import exact_files, filled_from
from earshot.operators.numbering import number_rows
from earshot.operators.skew import skew_safe_left_join
from earshot.session import folder_at, written

LISTEN_COLUMNS = [
    "id", "user_name", "track_name", "artist_name", "album_name", "track_id", "album_id", "artist_id",
    "duration", "genre", "event_type",
]

LISTEN_SCHEMA = T.StructType(
    [
        T.StructField(name, T.LongType() if name == "id" else T.IntegerType() if name == "duration" else T.StringType())
        for name in LISTEN_COLUMNS
    ]
    + [T.StructField("ts", T.TimestampNTZType()), T.StructField("listen_date", T.DateType())]
)

EXPORT_SCHEMA = T.StructType(
    [f for f in LISTEN_SCHEMA.fields if f.name in LISTEN_COLUMNS] + [T.StructField("timestamp", T.LongType())]
)


# -- the store ---------------------------------------------------------------------------------------
# <path>/commit=<name>/listen_date=<UTC day>/...         rows; a commit is what one append, micro-batch or import added
# <path>/_days/commit=<name>/listen_date=<UTC day>/...   what these rows add up to (DAY_SCHEMA)
# <path>/_merged/by=<name>/...                           commits and days that a compaction took over
# <path>/_pending/<name>/{rows,days,merged,gone}/...     a change that is being written; with _READY it counts
# Writing a commit again replaces it, so a repeated micro-batch leaves no second copy.
#
# A change is written aside first, with a mark for each folder that it replaces.  Once _READY stands beside it, it counts: readers look
# through it, and the writer, or the next one, removes the marked folders and moves the new ones in.  Each of these steps may be
# repeated, so a stop at any point ends in the same rows.  One writer at a time.

#: Half-hour slots, by genre: additive measures, the number of rows, and the bounds of their ids.
DAY_SCHEMA = T.StructType(
    [T.StructField("slot", T.TimestampNTZType()), T.StructField("genre", T.StringType())]
    + [T.StructField(name, T.LongType()) for name in ("views", "plays", "playtime", "n", "low", "top", "top_view")]
    + [T.StructField("commit", T.StringType()), T.StructField("listen_date", T.DateType())]
)
SLOT_SECONDS = 1800
_PLACE = ["commit", "listen_date"]


def _exists(spark: SparkSession, path: str) -> bool:
    at, files = folder_at(spark, path)
    return files.exists(at)


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in ``path``."""
    at, files = folder_at(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(at) if f.isDirectory()) if files.exists(at) else []


def _delete(spark: SparkSession, path: str) -> None:
    at, files = folder_at(spark, path)
    files.delete(at, True)


def _places(spark: SparkSession, path: str) -> list[str]:
    """commit=.../listen_date=... below ``path``."""
    return [f"{commit}/{day}" for commit in _folders(spark, path) if "=" in commit for day in _folders(spark, f"{path}/{commit}") if "=" in day]


def _ready(spark: SparkSession, path: str) -> list[str]:
    return [name for name in _folders(spark, f"{path}/_pending") if _exists(spark, f"{path}/_pending/{name}/_READY")]


def _move(spark: SparkSession, source: str, target: str) -> None:
    (old, files), (new, _) = folder_at(spark, source), folder_at(spark, target)
    files.mkdirs(new.getParent())
    if not files.rename(old, new):
        raise OSError(f"{source} could not be moved to {target}")


def settle(spark: SparkSession, path: str) -> None:
    """Finish changes that were ready when their writer stopped."""
    for name in _ready(spark, path):
        change = f"{path}/_pending/{name}"
        for place in _places(spark, f"{change}/gone"):
            _delete(spark, f"{path}/{place}")
            _delete(spark, f"{path}/_days/{place}")
            _delete(spark, f"{change}/gone/{place}")
        for part, home in (("rows", path), ("days", f"{path}/_days")):
            for place in _places(spark, f"{change}/{part}"):
                _move(spark, f"{change}/{part}/{place}", f"{home}/{place}")
        if _exists(spark, f"{change}/merged"):
            _move(spark, f"{change}/merged", f"{path}/_merged/by={name}")
        _delete(spark, change)


def day_partials(rows: DataFrame) -> DataFrame:
    """What rows (with commit and listen_date) add up to, as DAY_SCHEMA has it."""
    slot = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.floor(epoch_seconds(F.col("ts")) / SLOT_SECONDS) * SLOT_SECONDS)
    genre = F.coalesce("genre", F.lit("")).alias("genre")
    kind = F.col("event_type")
    made = rows.groupBy(*_PLACE, slot.alias("slot"), genre).agg(
        *measures(), F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("top"), F.max(F.when(kind == "view", F.col("id"))).alias("top_view")
    )
    return made.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DAY_SCHEMA.fields])


def prepare_change(rows: DataFrame, path: str, name: str, gone: DataFrame, merged: DataFrame | None = None) -> None:
    """Write a change aside: ``rows`` (with commit and listen_date) to come, and the folders ``gone`` (commit, listen_date) to go."""
    spark = rows.sparkSession
    settle(spark, path)
    change = f"{path}/_pending/{name}"
    _delete(spark, change)
    rows.hint("rebalance", *_PLACE).write.partitionBy(*_PLACE).parquet(f"{change}/rows")
    staged = spark.read.schema(_ROW_SCHEMA).parquet(f"{change}/rows")
    day_partials(staged).hint("rebalance", *_PLACE).write.partitionBy(*_PLACE).parquet(f"{change}/days")
    gone.select(*_PLACE).distinct().withColumn("x", F.lit(1)).write.partitionBy(*_PLACE).parquet(f"{change}/gone")
    if merged is not None:
        merged.write.parquet(f"{change}/merged")
    at, files = folder_at(spark, f"{change}/_READY")
    files.create(at, True).close()


def _change(rows: DataFrame, path: str, name: str, gone: DataFrame, merged: DataFrame | None = None) -> None:
    prepare_change(rows, path, name, gone, merged)
    settle(rows.sparkSession, path)


_ROW_SCHEMA = T.StructType([*LISTEN_SCHEMA.fields, T.StructField("commit", T.StringType())])


def _through_changes(spark: SparkSession, path: str, part: str, home: str, schema: T.StructType) -> DataFrame:
    """What lies at ``home``, as the changes that count leave it."""
    found = spark.read.schema(schema).parquet(home) if _exists(spark, home) else spark.createDataFrame([], schema)
    for name in _ready(spark, path):
        change = f"{path}/_pending/{name}"
        gone = spark.read.schema("commit string, listen_date date").parquet(f"{change}/gone").distinct()
        found = found.join(gone, _PLACE, "left_anti").select(*schema.names)
        found = found.unionByName(spark.read.schema(schema).parquet(f"{change}/{part}"))
    return found


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return _through_changes(spark, path, "rows", path, _ROW_SCHEMA).withColumn("genre", F.coalesce("genre", F.lit("")))


def read_listens(spark: SparkSession, path: str) -> DataFrame:
    """The stored fact, partitioned by UTC ``listen_date``; older files may lack ``genre``."""
    return _stored(spark, path).drop("commit")


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """What the stored fact adds up to, by commit, day, half-hour slot and genre; a small part of its size."""
    return _through_changes(spark, path, "days", f"{path}/_days", DAY_SCHEMA)


def _merged(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The days of a commit that compactions took over."""
    kind = "commit string, listen_date date"
    merged = spark.read.schema(kind).parquet(f"{path}/_merged") if _exists(spark, f"{path}/_merged") else spark.createDataFrame([], kind)
    return merged.filter(F.col("commit") == name).select("listen_date").distinct()


def append_listens(listens: DataFrame, path: str, commit: str | None = None) -> None:
    """Append rows as one commit, one directory per UTC day.

    Rebalancing by day lets Spark give a busy day several tasks, and files, of the advisory size, and a quiet day one.  Writing a
    commit again replaces it, but for days that a compaction has taken over: these hold the rows already.
    """
    spark, name = listens.sparkSession, commit or uuid.uuid4().hex
    settle(spark, path)
    rows = listens.select(*LISTEN_COLUMNS, "ts").withColumns({"commit": F.lit(name), "listen_date": F.to_date("ts")})
    if commit and _exists(spark, f"{path}/_merged"):
        rows = rows.join(F.broadcast(_merged(spark, path, name)), "listen_date", "left_anti")  # days of one commit
    _change(rows, path, name, read_days(spark, path).filter(F.col("commit") == name))


def top_id(spark: SparkSession, path: str) -> int:
    """The largest id of the store; 0 for none."""
    return read_days(spark, path).agg(F.coalesce(F.max("top"), F.lit(0))).first()[0]


def read_newest(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """Rows of the store among which are those with the ``limit`` largest ids, read from the days that hold them.

    Folders in the order of their smallest ids, largest first, hold ``limit`` rows after ``limit`` folders at most; so many are looked at. From
    the smallest id of the last one on nothing is left out, whatever order the ids came in.
    """
    folders = read_days(spark, path).groupBy(*_PLACE).agg(F.min("low").alias("low"), F.max("top").alias("top"), F.sum("n").alias("n"))
    held, least = 0, None
    for row in folders.orderBy(F.desc("low")).limit(limit).collect():
        held, least = held + row["n"], row["low"]
        if held >= limit:
            break
    days = [] if least is None else [r[0] for r in folders.filter(F.col("top") >= least).select("listen_date").distinct().collect()]
    return _days_of(read_listens(spark, path), days).filter(F.col("id") >= F.lit(0 if least is None else least))


def _days_of(rows: DataFrame, days: list) -> DataFrame:
    """``rows`` of some days, of which there are at most as many as the calendar has."""
    if len(days) > 1000:
        return rows.filter(F.col("listen_date").between(min(days), max(days)))
    return rows.filter(F.col("listen_date").isin(*days)) if days else rows.filter(F.lit(False))


def read_last_view(spark: SparkSession, path: str) -> DataFrame:
    """The view with the largest id, read from its day."""
    last = read_days(spark, path).filter("top_view is not null").groupBy("listen_date").agg(F.max("top_view").alias("id")).orderBy(F.desc("id")).first()
    rows = _days_of(read_listens(spark, path), [last["listen_date"]] if last else [])
    return rows.filter(F.col("id") == F.lit(last["id"] if last else None).cast("bigint"))


def compact(spark: SparkSession, path: str, before: date, name: str | None = None) -> None:
    """Put the commits of each day before ``before`` together, so that a day's files follow its size and not its number of commits.

    Days that one commit holds stay as they are.  What a day adds up to is kept; the commits that go are remembered, so that one that
    is repeated adds nothing for these days.
    """
    settle(spark, path)
    name = name or f"compact-{uuid.uuid4().hex}"
    places = read_days(spark, path).filter(F.col("listen_date") < F.lit(before)).select(*_PLACE).distinct()
    busy = places.groupBy("listen_date").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("listen_date")
    gone = written(places.join(busy, "listen_date", "left_semi").select(*_PLACE), "compacted-folders")
    if gone.isEmpty():
        return
    rows = _stored(spark, path).filter(F.col("listen_date") < F.lit(before)).join(gone.select("listen_date").distinct(), "listen_date", "left_semi")
    _change(rows.withColumn("commit", F.lit(name)).select(*LISTEN_COLUMNS, "ts", *_PLACE), path, name, gone, merged=gone)


def numbered(listens: DataFrame, top: int, time: str = "received_at") -> DataFrame:
    """Parsed and enriched listens as rows of the fact: ``ts`` from the time of receipt, ``id`` on from ``top`` in its order.

    The order is written out first, so that every attempt and every reader sees the same ids; rows of one moment keep the order
    of the remaining columns.  A task of the sort numbers its own rows without gaps, so only the tasks' counts, a row each, are added up.
    """
    rest = [F.col(c) for c in ("user_name", "track_name", "artist_name", "album_name", "event_type", "duration") if c in listens.columns]
    ordered = listens.orderBy(time, *rest).withColumn("_pos", F.monotonically_increasing_id())
    task, place = F.shiftright("_pos", 33).alias("_task"), F.col("_pos").bitwiseAND((1 << 33) - 1)
    rows = written(ordered, "ingest").select("*", task)
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_task").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select("_task", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    rows = rows.join(F.broadcast(starts), "_task")
    return rows.select((F.col("_start") + place + 1 + top).alias("id"), *LISTEN_COLUMNS[1:], F.col(time).cast("timestamp_ntz").alias("ts"))


def export_rows(listens: DataFrame) -> DataFrame:
    """Every row with all columns, time as epoch seconds."""
    return listens.select(*LISTEN_COLUMNS, epoch_seconds(F.col("ts")).alias("timestamp"))


def export_listens(listens: DataFrame, path: str) -> None:
    export_rows(listens).write.mode("errorifexists").json(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an export, ready for ``import_listens``."""
    return spark.read.schema(EXPORT_SCHEMA).json(path).withColumn("ts", from_epoch_seconds(F.col("timestamp")))


def _positioned(batch: DataFrame) -> DataFrame:
    """A batch without ``pos`` stands in the order in which it is read."""
    return batch if "pos" in batch.columns else batch.withColumn("pos", F.monotonically_increasing_id())


def import_listens(listens: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert a batch by ``id``; ``pos`` is the position of a row in the batch.

    A known id is replaced, an unknown one inserted, the later of two rows with one id wins, and
    rows without an id are numbered on from the largest id, in batch order.  The batch is read several times, so it is
    written once.
    """
    columns = [*LISTEN_COLUMNS, "ts"]
    named, fresh = _import_rows(written(_positioned(batch), "import-batch"), listens.select("id").agg(F.coalesce(F.max("id"), F.lit(0))).scalar())
    kept = listens.select(*columns).join(named.select("id"), "id", "left_anti")
    return kept.unionByName(named).unionByName(fresh)


def _import_rows(batch: DataFrame, known_top: Column | int) -> tuple[DataFrame, DataFrame]:
    """A batch's rows (with ``pos``) with an id, the last of each id; and those without, numbered on from the largest id of both sides."""
    columns = [*LISTEN_COLUMNS, "ts"]
    batch = batch.withColumn("genre", F.coalesce("genre", F.lit("")))
    row = F.struct(*[F.col(c) for c in columns if c != "id"])
    # Few rows share an id: dealt out first, they are sorted for the aggregate once and not before the shuffle as well.
    named = batch.filter(F.col("id").isNotNull()).repartition("id").groupBy("id").agg(F.max_by(row, "pos").alias("row"))
    named = named.select("id", "row.*").select(*columns)
    top = F.greatest(F.lit(known_top), batch.agg(F.coalesce(F.max("id"), F.lit(0))).scalar())
    fresh = number_rows(batch.filter(F.col("id").isNull()), "pos", out="_nth")
    fresh = fresh.withColumn("id", F.col("_nth") + top).select(*columns)
    return named, fresh


def _batch_name(batch: DataFrame) -> str:
    """A commit's name that follows from a batch's rows and their order."""
    row = F.xxhash64(*[F.col(c) for c in ("pos", *LISTEN_COLUMNS, "ts")]).cast("decimal(20,0)")
    found = batch.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row), F.lit(0)).alias("h")).first()
    return f"import-{found['n']}-{int(found['h']) % (1 << 64):016x}"


def import_into(batch: DataFrame, path: str, commit: str | None = None) -> None:
    """``import_listens`` on the store: only the days that hold a replaced id are written anew, in one change with the batch's own rows.

    A batch's commit is named after its rows, unless a name is given, so repeating an import, after a failure or not, ends in the same rows; to
    add a batch without ids twice, name the second.  Of a commit that a compaction took over only rows with an id are imported again.
    """
    spark = batch.sparkSession
    settle(spark, path)
    placed = written(_positioned(batch), "import-batch")
    placed = placed.withColumn("genre", F.coalesce("genre", F.lit("")))
    name = commit or _batch_name(placed)
    others = F.col("commit") != name
    top = read_days(spark, path).filter(others).agg(F.coalesce(F.max("top"), F.lit(0))).first()[0]
    named, fresh = _import_rows(placed, top)
    new = written(named if not _merged(spark, path, name).isEmpty() else named.unionByName(fresh), "import-rows")
    old = _stored(spark, path).filter(others)
    touched = written(old.join(new.select("id"), "id", "left_semi").select(*_PLACE).distinct(), "touched-days")
    kept = old.join(touched, _PLACE, "left_semi").join(new.select("id"), "id", "left_anti").select(*LISTEN_COLUMNS, "ts", *_PLACE)
    rows = new.withColumns({"commit": F.lit(name), "listen_date": F.to_date("ts")}).select(*LISTEN_COLUMNS, "ts", *_PLACE)
    own = read_days(spark, path).filter(F.col("commit") == name).select(*_PLACE)
    _change(rows.unionByName(kept), path, name, touched.unionByName(own))


def backfill_stored(spark: SparkSession, path: str, library: DataFrame) -> None:
    """``backfill_listens`` on the store: only the days with a row that a file helps are written anew, in one change.

    The library is joined once, to the distinct pairs that lack an album.
    """
    settle(spark, path)
    old = _stored(spark, path)
    lacking = old.filter(blank(F.col("album_id")))
    pair = ["track_name", "artist_name"]
    files = written(exact_files(library).join(lacking.select(*pair).distinct(), pair, "left_semi"), "backfill-files")
    helped = skew_safe_left_join(lacking.select(*pair, *_PLACE), files.withColumn("_hit", F.lit(True)).select(*pair, "_hit"), pair)
    touched = written(helped.filter("_hit").select(*_PLACE).distinct(), "touched-days")
    rows = filled_from(old.join(touched, _PLACE, "left_semi"), files)
    _change(rows.select(*LISTEN_COLUMNS, "ts", *_PLACE), path, f"backfill-{uuid.uuid4().hex}", touched)
