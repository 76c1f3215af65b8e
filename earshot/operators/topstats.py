"""Totals, top lists and the artist, album and search views.

``library`` is optional everywhere: it only contributes structured artist tags to credits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from earshot.functions import constants as k
from earshot.functions.measures import (
    add_up, all_events, largest, measures, playtime, plays, ranking, relative_bar, rolled_up, views,
)
from earshot.functions.text import artist_id, blank, contains_text, credit_key
from earshot.functions.timecols import iso, local_date
from earshot.operators.credits import by_artist, credited_rows
from earshot.params import Clock, time_filter

_MEASURES = ("views", "plays", "playtime")


def known(column: str):
    """Not the stand-in for absent values; NULL is not known either."""
    return F.col(column) != k.UNKNOWN


def summary(listens: DataFrame, clock: Clock, filter: str | None = None) -> DataFrame:
    """One row; the sums are NULL when nothing was heard."""
    return time_filter(listens, clock, filter).agg(*measures())


def top_tracks(listens: DataFrame, clock: Clock, filter: str | None = None, limit: int = 50) -> DataFrame:
    keys = ["track_name", "artist_name", "album_name"]
    rows = time_filter(listens, clock, filter)
    tracks = rolled_up(rows, keys, largest("track_id", "album_id"), *measures())
    return tracks.orderBy(*ranking(*keys)).limit(limit)


def ranked_tracks(listens: DataFrame, clock: Clock, filter: str | None = None, limit: int = 50) -> DataFrame:
    """``top_tracks`` with rank and the length of its bar, as a chart shows it."""
    top = top_tracks(listens, clock, filter, limit)
    place = F.row_number().over(Window.orderBy(*ranking("track_name", "artist_name", "album_name")))
    leader = F.max("playtime").over(Window.partitionBy())
    return top.withColumn("rank", place).withColumn("bar", relative_bar(F.col("playtime"), leader))


def top_albums(listens: DataFrame, clock: Clock, filter: str | None = None, limit: int = 50) -> DataFrame:
    keys = ["album_name", "artist_name"]
    rows = time_filter(listens, clock, filter).filter(known("album_name"))
    return rolled_up(rows, keys, largest("album_id"), *measures()).orderBy(*ranking(*keys)).limit(limit)


def _artist_totals(listens: DataFrame, library: DataFrame | None) -> DataFrame:
    per_credit = by_artist(listens, library, measures())
    return per_credit.groupBy("artist_id").agg(F.min("artist_name").alias("artist_name"), *add_up(*_MEASURES))


def top_artists(
    listens: DataFrame, clock: Clock, library: DataFrame | None = None, filter: str | None = None, limit: int = 50
) -> DataFrame:
    totals = _artist_totals(time_filter(listens, clock, filter), library)
    return totals.orderBy(*ranking("artist_id")).limit(limit).select("artist_name", "artist_id", *_MEASURES)


def _or_zero() -> list[Column]:
    """Measures of at most one row; 0 without one."""
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _MEASURES]


def artist_summary(
    listens: DataFrame, clock: Clock, artist: str, library: DataFrame | None = None, filter: str | None = None
) -> DataFrame:
    rows = credited_rows(time_filter(listens, clock, filter), artist, library)
    totals = _artist_totals(rows, library).withColumn("_wanted", credit_key(F.lit(artist)))
    mine = totals.filter(F.col("artist_id") == artist_id(F.col("_wanted")))
    return mine.agg(
        F.coalesce(F.max("artist_name"), F.lit(artist)).alias("artist_name"), F.max("artist_id").alias("artist_id"), *_or_zero()
    )


def artist_top_tracks(
    listens: DataFrame, clock: Clock, artist: str, library: DataFrame | None = None, filter: str | None = None, limit: int = 10
) -> DataFrame:
    rows = credited_rows(time_filter(listens, clock, filter), artist, library)
    tracks = rolled_up(rows, ["track_name"], largest("track_id", "album_id"), *measures())
    return tracks.orderBy(*ranking("track_name")).limit(limit)


def artist_top_albums(
    listens: DataFrame, clock: Clock, artist: str, library: DataFrame | None = None, filter: str | None = None, limit: int = 10
) -> DataFrame:
    rows = credited_rows(time_filter(listens, clock, filter).filter(known("album_name")), artist, library)
    albums = rolled_up(rows, ["album_name"], largest("album_id"), *measures())
    return albums.orderBy(*ranking("album_name")).limit(limit)


def _album_texts() -> dict[str, Column]:
    """The largest album id, and the artist on its row."""
    return {"artist_name": F.max_by("artist_name", F.struct("album_id", "artist_name")), **largest("album_id")}


def album_summary(listens: DataFrame, clock: Clock, album: str, filter: str | None = None) -> DataFrame:
    rows = time_filter(listens, clock, filter).filter((F.col("album_name") == album) & known("album_name"))
    found = rolled_up(rows, ["album_name"], _album_texts(), *measures())
    return found.agg(
        F.coalesce(F.max("album_name"), F.lit(album)).alias("album_name"),
        F.coalesce(F.max("artist_name"), F.lit("")).alias("artist_name"),
        F.max("album_id").alias("album_id"),
        *_or_zero(),
    )


def album_tracks(listens: DataFrame, clock: Clock, album: str, filter: str | None = None) -> DataFrame:
    """Every track of the album; where artists differ, the first by name is shown."""
    rows = time_filter(listens, clock, filter).filter(F.col("album_name") == album)
    texts = {"artist_name": F.min("artist_name"), **largest("track_id")}
    return rolled_up(rows, ["track_name"], texts, *measures()).orderBy(*ranking("track_name"))


def album_daily(listens: DataFrame, clock: Clock, album: str) -> DataFrame:
    """Days on which the album was met, over the whole history."""
    rows = listens.filter((F.col("album_name") == album) & known("album_name"))
    days = rows.groupBy(local_date(clock).alias("day")).agg(views(), plays())
    return days.orderBy("day").withColumn("day", iso(F.col("day")))


def search_tracks(listens: DataFrame, clock: Clock, query: str, filter: str | None = None, limit: int = 5) -> DataFrame:
    rows = time_filter(listens, clock, filter).filter(contains_text(F.col("track_name"), query))
    texts = {"artist_name": F.min("artist_name"), **largest("track_id", "album_id")}
    return rolled_up(rows, ["track_name"], texts, *measures()).orderBy(*ranking("track_name")).limit(limit)


def search_albums(listens: DataFrame, clock: Clock, query: str, filter: str | None = None, limit: int = 5) -> DataFrame:
    rows = time_filter(listens, clock, filter).filter(contains_text(F.col("album_name"), query) & known("album_name"))
    found = rolled_up(rows, ["album_name"], _album_texts(), *measures())
    return found.orderBy(*ranking("album_name")).limit(limit)


def search_artists(
    listens: DataFrame, clock: Clock, query: str, library: DataFrame | None = None, filter: str | None = None, limit: int = 5
) -> DataFrame:
    """Artists whose own spelling in a credit contains the query."""
    per_credit = by_artist(time_filter(listens, clock, filter), library, measures())
    found = per_credit.filter(contains_text(F.col("artist_name"), query)).groupBy("artist_id")
    totals = found.agg(F.min("artist_name").alias("artist_name"), *add_up(*_MEASURES))
    return totals.orderBy(*ranking("artist_id")).limit(limit).select("artist_name", "artist_id", *_MEASURES)


def unique_counts(listens: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """Exact counts of known artists, albums and tracks, and of all rows."""
    artists = by_artist(listens, library, [all_events("n")]).filter(known("artist_name"))
    counted = artists.agg(F.lit("artists").alias("type"), F.countDistinct("artist_id").alias("count"))
    rest = listens.agg(
        F.countDistinct(F.when(known("album_name"), F.col("album_name"))).alias("albums"),
        F.countDistinct(F.when(known("track_name"), F.col("track_name"))).alias("tracks"),
        F.count(F.lit(1)).alias("total"),
    )
    return counted.unionByName(rest.unpivot([], ["albums", "tracks", "total"], "type", "count"))


def top_genres(listens: DataFrame, clock: Clock, filter: str | None = None, limit: int = 20) -> DataFrame:
    """``plays`` counts every event here, ``playtime`` only plays."""
    rows = time_filter(listens, clock, filter).filter(~blank(F.col("genre")))
    genres = rows.groupBy("genre").agg(all_events(), playtime())
    return genres.orderBy(*ranking("genre", by=("playtime",))).limit(limit)
