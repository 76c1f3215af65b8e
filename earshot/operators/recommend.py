"""Recommendations from history and library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from earshot.functions.measures import all_events, largest, ranking, rolled_up
from earshot.functions.text import blank
from earshot.functions.timecols import local_hour
from earshot.functions.credits import with_artists
from earshot.operators.containment import texts_containing
from earshot.operators.credits import by_artist
from earshot.operators.skew import skew_safe_left_join
from earshot.params import Clock


def for_you(listens: DataFrame, library: DataFrame | None = None, genres: int = 5, limit: int = 10) -> DataFrame:
    """The most heard artists within the five most frequent genres.

    ``genre`` is the artist's most frequent one among these.
    """
    rows = listens.filter(~blank(F.col("genre")))
    top = rows.groupBy("genre").agg(all_events("n")).orderBy(F.desc("n"), "genre").limit(genres).select("genre")
    # At most ``genres`` rows are broadcast.
    chosen = rows.join(F.broadcast(top), "genre", "left_semi")
    per_genre = by_artist(chosen, library, [all_events("n")], ["genre"]).groupBy("artist_id", "genre")
    per_genre = per_genre.agg(F.sum("n").alias("n"), F.min("artist_name").alias("artist_name"))
    main = F.min(F.struct((-F.col("n")).alias("n"), "genre"))
    artists = per_genre.groupBy("artist_id").agg(
        F.sum("n").alias("n"), F.min("artist_name").alias("artist_name"), main["genre"].alias("genre")
    )
    best = artists.orderBy(F.desc("n"), "artist_id").limit(limit)
    return best.select("artist_name", "artist_id", "genre", F.concat(F.lit("Genre: "), F.col("genre")).alias("reason"))


def unheard(library: DataFrame, listens: DataFrame) -> DataFrame:
    """Files whose (title, artist) was never listened to."""
    heard = listens.select(F.col("track_name").alias("title"), F.col("artist_name").alias("artist")).distinct()
    marked = skew_safe_left_join(library, heard.withColumn("_heard", F.lit(True)), ["title", "artist"])
    return marked.filter(F.col("_heard").isNull()).select(*library.columns)


def discover_unheard(
    listens: DataFrame, library: DataFrame, seed: int = 42, credits: int = 50, per_credit: int = 5, limit: int = 15
) -> DataFrame:
    """Unheard files of recently heard credits, most recent credit first.

    Files are drawn first and heard ones dropped afterwards, so fewer than ``limit`` may remain.
    The draw orders files by a hash of seed and id, which repeats where randomness would not.
    """
    latest = listens.groupBy("artist_name").agg(F.max("id").alias("last_id"))
    latest = latest.orderBy(F.desc("last_id")).limit(credits)
    recent = latest.withColumnRenamed("artist_name", "artist")
    drawn = F.md5(F.concat(F.lit(f"{seed}|"), F.col("id")))
    # At most ``credits`` rows are broadcast; the rank is cut per task before the shuffle.
    files = library.join(F.broadcast(recent), "artist").withColumn("_draw", drawn)
    place = F.row_number().over(Window.partitionBy("artist").orderBy("_draw", "id"))
    files = files.withColumn("_place", place).filter(F.col("_place") <= per_credit)
    # Drawn files are few (credits x per_credit), so only their pairs are looked for in the history.
    pairs = files.select(F.col("title").alias("track_name"), F.col("artist").alias("artist_name")).distinct()
    heard = listens.join(F.broadcast(pairs), ["track_name", "artist_name"], "left_semi")
    heard = heard.select(F.col("track_name").alias("title"), F.col("artist_name").alias("artist")).distinct()
    fresh = files.join(heard, ["title", "artist"], "left_anti")
    once = F.row_number().over(Window.partitionBy("title", "artist").orderBy("_place"))
    fresh = fresh.withColumn("_once", once).filter("_once = 1")
    return fresh.orderBy(F.desc("last_id"), "_place").limit(limit).select(
        F.col("id").alias("track_id"), F.col("title").alias("track_name"), F.col("artist").alias("artist_name"),
        F.col("album").alias("album_name"), "album_id", "artist_id", "duration",
    )


def similar_artists(library: DataFrame, artist: str, limit: int = 8) -> DataFrame:
    """Artists with most files in genres that contain one of the artist's genres.

    Genres are compared among distinct values only, and by an equi join on their substrings;
    credits are split after the cut to ``limit``.
    """
    genres = library.filter(~blank(F.col("genre"))).select("genre").distinct()
    seeds = library.filter((F.col("artist") == artist) & ~blank(F.col("genre")))
    needles = seeds.select(F.lower("genre").alias("needle"))
    texts = genres.select(F.lower("genre").alias("text"), "genre")
    matched = texts_containing(needles, texts).select("genre").distinct()
    others = library.filter(F.col("artist") != artist).join(matched, "genre", "left_semi").groupBy("artist")
    counted = others.agg(all_events("n"), F.min("genre").alias("genre"))
    top = with_artists(counted.orderBy(F.desc("n"), "artist").limit(limit), "artist")
    person = F.posexplode("artists").alias("pos", "a")
    people = top.select("n", "artist", "genre", person).filter(F.lower("a.name") != F.lower(F.lit(artist)))
    # A person met twice keeps the first place and the last details.
    order = [F.desc("n"), F.asc("artist"), F.asc("pos")]
    people = people.withColumn("_at", F.row_number().over(Window.orderBy(*order)))
    people = people.groupBy(F.col("a.id").alias("artist_id")).agg(
        F.min("_at").alias("_at"), F.max_by(F.col("a.name"), "_at").alias("artist_name"), F.max_by("genre", "_at").alias("genre")
    )
    return people.orderBy("_at").limit(limit).select("artist_name", "artist_id", "genre")


def at_this_hour(listens: DataFrame, clock: Clock, limit: int = 10) -> DataFrame:
    """What is mostly played in the current local hour."""
    hour = clock.local_now.hour
    rows = listens.filter((F.col("event_type") == "play") & (local_hour(clock) == hour))
    texts = {"album_name": F.min("album_name"), **largest("track_id", "album_id")}
    tracks = rolled_up(rows, ["track_name", "artist_name"], texts, all_events("play_count"))
    top = tracks.orderBy(*ranking("track_name", "artist_name", by=("play_count",))).limit(limit)
    return top.select(F.lit(hour).alias("hour"), *tracks.columns)
