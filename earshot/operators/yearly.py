"""The year in review.

The year is bounded in UTC and bucketed in local time, so with an eastern offset the last hours
of 31 December belong to January.  "plays" in the top lists and months counts every event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from earshot.functions.measures import add_up, all_events, largest, playtime, plays, ranking, rolled_up
from earshot.functions.timecols import iso, local_date, local_month
from earshot.operators.credits import by_artist
from earshot.operators.topstats import known
from earshot.params import Clock, year_range


def year_summary(listens: DataFrame, clock: Clock, year: int, library: DataFrame | None = None) -> DataFrame:
    rows = year_range(listens, year)
    artists = by_artist(rows, library, [all_events("n")]).agg(F.countDistinct("artist_id"))
    totals = rows.agg(
        playtime().alias("total_playtime"),
        plays().alias("total_plays"),
        F.countDistinct("track_name").alias("unique_tracks"),
        F.countDistinct("album_name").alias("unique_albums"),
        F.countDistinct(local_date(clock)).alias("active_days"),
    )
    return totals.select(
        "total_playtime", "total_plays", "unique_tracks", artists.scalar().alias("unique_artists"), "unique_albums", "active_days"
    )


def year_top_artists(listens: DataFrame, year: int, library: DataFrame | None = None, limit: int = 5) -> DataFrame:
    per_credit = by_artist(year_range(listens, year), library, [playtime(), all_events()]).filter(known("artist_name"))
    totals = per_credit.groupBy("artist_id").agg(F.min("artist_name").alias("artist_name"), *add_up("playtime", "plays"))
    top = totals.orderBy(*ranking("artist_id", by=("playtime",))).limit(limit)
    return top.select("artist_name", "artist_id", "playtime", "plays")


def year_top_tracks(listens: DataFrame, year: int, limit: int = 5) -> DataFrame:
    keys = ["track_name", "artist_name"]
    tracks = rolled_up(year_range(listens, year), keys, largest("track_id", "album_id"), playtime(), all_events())
    return tracks.orderBy(*ranking(*keys, by=("playtime",))).limit(limit)


def year_top_albums(listens: DataFrame, year: int, limit: int = 5) -> DataFrame:
    keys = ["album_name", "artist_name"]
    rows = year_range(listens, year).filter(known("album_name"))
    albums = rolled_up(rows, keys, largest("album_id"), playtime(), all_events())
    return albums.orderBy(*ranking(*keys, by=("playtime",))).limit(limit)


def year_monthly(listens: DataFrame, clock: Clock, year: int) -> DataFrame:
    months = year_range(listens, year).groupBy(local_month(clock).alias("month"))
    return months.agg(playtime(), all_events()).orderBy("month")


def year_peak_month(listens: DataFrame, clock: Clock, year: int) -> DataFrame:
    """The first of the busiest months; blank and 0 in a year without listens."""
    months = year_range(listens, year).groupBy(local_month(clock).alias("month")).agg(playtime(), all_events())
    peak = months.agg(F.min(F.struct((-F.col("plays")).alias("plays"), "month", "playtime")).alias("p"))
    return peak.select(
        F.coalesce("p.month", F.lit("")).alias("month"),
        F.coalesce(-F.col("p.plays"), F.lit(0)).alias("plays"),
        F.coalesce("p.playtime", F.lit(0)).alias("playtime"),
    )


def year_peak_day(listens: DataFrame, clock: Clock, year: int) -> DataFrame:
    """The day with most plays proper, the earliest if tied; no row without plays."""
    rows = year_range(listens, year).filter(F.col("event_type") == "play")
    days = rows.groupBy(local_date(clock).alias("day")).agg(all_events())
    return days.orderBy(F.desc("plays"), "day").limit(1).select(iso(F.col("day")).alias("day"), "plays")


def year_in_review(listens: DataFrame, clock: Clock, year: int, library: DataFrame | None = None) -> dict[str, DataFrame]:
    """All parts of the review, each a plan of its own over the year's partitions."""
    return {
        "summary": year_summary(listens, clock, year, library),
        "top_artists": year_top_artists(listens, year, library),
        "top_tracks": year_top_tracks(listens, year),
        "top_albums": year_top_albums(listens, year),
        "monthly": year_monthly(listens, clock, year),
        "peak_month": year_peak_month(listens, clock, year),
        "peak_day": year_peak_day(listens, clock, year),
    }
