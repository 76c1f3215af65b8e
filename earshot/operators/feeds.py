"""Row-level views of the history: recent, paged, timeline, now playing; and the heard library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from earshot.functions.measures import add_up, all_events, largest, playtime, plays, rolled_up
from earshot.functions.text import contains_text
from earshot.functions.timecols import epoch_seconds, iso, local_date
from earshot.operators.credits import by_artist
from earshot.operators.paging import find_page, in_order, up, with_total
from earshot.operators.topstats import known
from earshot.params import Clock, clamp, ntz
from earshot.sources.listens import read_last_view, read_newest

_FEED = [
    "id", "user_name", "track_name", "artist_name", "album_name", "track_id", "album_id", "artist_id", "duration", "event_type",
]


def _feed(listens: DataFrame) -> DataFrame:
    return listens.select(*_FEED, epoch_seconds(F.col("ts")).alias("timestamp"))


def recent(listens: DataFrame, limit: int | None = 50) -> DataFrame:
    return _feed(listens).orderBy(F.desc("id")).limit(clamp(limit, 1, 200, 50))


def matching_listens(listens: DataFrame, query: str | None = None, event_type: str | None = None) -> DataFrame:
    """Substring search over track, artist and album; an unknown event type filters nothing."""
    if query:
        hit = [contains_text(F.col(c), query) for c in ("track_name", "artist_name", "album_name")]
        listens = listens.filter(hit[0] | hit[1] | hit[2])
    if event_type in ("play", "view"):
        listens = listens.filter(F.col("event_type") == event_type)
    return listens


def history_page(
    listens: DataFrame, query: str | None = None, event_type: str | None = None, page: int = 1, limit: int | None = 50, most: int = 100_000
) -> DataFrame:
    """A page of the history, newest id first, with the total and the number of pages; rows without an id are on no page.

    At most about ``most`` rows are read to cut the page out of them.
    """
    page, limit = max(1, page), clamp(limit, 1, 200, 50)
    found = find_page(matching_listens(listens, query, event_type), "id", (page - 1) * limit, limit, most)
    return with_total(_feed(found.rows(limit)), found.total, limit)


def timeline(listens: DataFrame, clock: Clock, page: int = 1, limit: int = 30, most: int = 100_000) -> DataFrame:
    """A page of the feed; ``new_day`` marks rows that open a local day on the page."""
    page, limit = max(1, page), clamp(limit, 1, 200, 30)
    rows = find_page(listens.select(*_FEED, "ts"), "id", (page - 1) * limit, limit, most).rows(limit)
    day = iso(local_date(clock))
    above = F.lag("local_day").over(Window.orderBy(F.desc("id")))
    rows = rows.withColumn("local_day", day).withColumn("new_day", ~F.col("local_day").eqNullSafe(above))
    return rows.select(*_FEED, epoch_seconds(F.col("ts")).alias("timestamp"), "local_day", "new_day").orderBy(F.desc("id"))


def now_playing(listens: DataFrame, clock: Clock, ttl: int = 300) -> DataFrame:
    """The last view by id, unless it is older than ``ttl`` seconds; then no row."""
    columns = [c for c in _FEED if c not in ("user_name", "event_type")]
    last = listens.filter(F.col("event_type") == "view").orderBy(F.desc("id")).limit(1)
    fresh = F.col("ts") >= ntz(clock.as_of.replace(microsecond=0)) - F.make_dt_interval(secs=F.lit(ttl))
    return last.filter(fresh).select(*columns, epoch_seconds(F.col("ts")).alias("timestamp"))


def stored_recent(spark: SparkSession, path: str, limit: int | None = 50) -> DataFrame:
    """``recent`` over the store, from the days that hold the newest ids."""
    return recent(read_newest(spark, path, clamp(limit, 1, 200, 50)), limit)


def stored_now_playing(spark: SparkSession, path: str, clock: Clock, ttl: int = 300) -> DataFrame:
    """``now_playing`` over the store, from the day of the last view."""
    return now_playing(read_last_view(spark, path), clock, ttl)


# -- the library as it was heard -----------------------------------------------------------------


def library_artists(
    listens: DataFrame, library: DataFrame | None = None, query: str | None = None, page: int = 1, limit: int | None = 100
) -> DataFrame:
    page, limit = max(1, page), clamp(limit, 1, 500, 100)
    per_credit = by_artist(listens, library, [plays(), playtime()]).filter(known("artist_name"))
    if query:
        per_credit = per_credit.filter(contains_text(F.col("artist_name"), query))
    artists = per_credit.groupBy("artist_id").agg(F.min("artist_name").alias("artist_name"), *add_up("plays", "playtime"))
    ordered = in_order(artists, [up("artist_name"), up("artist_id")])
    return with_total(ordered.page(page, limit).select("artist_name", "artist_id", "plays", "playtime"), ordered.total)


def library_albums(listens: DataFrame, query: str | None = None, page: int = 1, limit: int | None = 100) -> DataFrame:
    """Albums per artist; the total counts album names."""
    page, limit = max(1, page), clamp(limit, 1, 500, 100)
    rows = listens.filter(known("album_name"))
    if query:
        rows = rows.filter(contains_text(F.col("album_name"), query))
    albums = rolled_up(rows, ["album_name", "artist_name"], largest("album_id"), plays(), playtime())
    ordered = in_order(albums, [up("album_name"), up("artist_name")])
    names = ordered.rows.agg(F.countDistinct("album_name")).first()[0]
    return with_total(ordered.page(page, limit), names)


def library_tracks(listens: DataFrame, query: str | None = None, page: int = 1, limit: int | None = 100) -> DataFrame:
    """Tracks; ``total`` counts listens, as the paging contract has it, ``groups`` counts tracks."""
    page, limit = max(1, page), clamp(limit, 1, 500, 100)
    rows = listens if not query else listens.filter(contains_text(F.col("track_name"), query))
    keys = ["track_name", "artist_name", "album_name"]
    ids = largest("track_id", "album_id", "artist_id")
    tracks = rolled_up(rows, keys, ids, plays(), playtime(), all_events("_rows"))
    ordered = in_order(tracks, [up(c) for c in keys])
    heard = ordered.rows.agg(F.sum("_rows")).first()[0] or 0
    return with_total(ordered.page(page, limit).drop("_rows"), heard).withColumn("groups", F.lit(ordered.total).cast("bigint"))
