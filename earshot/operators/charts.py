"""Discovery feeds from landed catalog entries.

Entries carry their place in the provider's list as ``pos``.  Cuts per country, artist or query
are rank filters, which Spark applies per task before it shuffles a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from earshot.functions import constants as k
from earshot.functions.credits import ARTISTS_TYPE
from earshot.operators.skew import skew_safe_left_join
from earshot.sources.catalog import normalize_albums, normalize_artists, normalize_songs


def first_per(rows: DataFrame, keys: list[str], order: list[Column], limit: int, out: str = "place") -> DataFrame:
    """The first ``limit`` rows of each key, numbered from 1."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(out, place).filter(F.col(out) <= limit)


def pick_chart(playlists: DataFrame) -> DataFrame:
    """Per country the chart playlist of the best kind, the first in order within a kind."""
    title = F.lower("title")
    kind = F.lit(None).cast("int")
    for rank, words in reversed(list(enumerate(k.CHART_TITLES))):
        kind = F.when(title.contains(words), F.lit(rank)).otherwise(kind)
    ranked = playlists.withColumn("_kind", kind).filter(F.col("_kind").isNotNull())
    best = F.min_by(F.struct("playlist_id", "title"), F.struct("_kind", "pos")).alias("p")
    chosen = ranked.groupBy("country").agg(best).select("country", "p.playlist_id", "p.title")
    return chosen.withColumn("chart_url", F.concat(F.lit(k.CHART_URL), "playlist_id"))


def chart_artists(entries: DataFrame, limit: int = 30) -> DataFrame:
    """The first artists of each country's chart."""
    top = first_per(entries, ["country"], [F.asc("pos")], limit)
    return normalize_artists(top.drop("pos"), kept=["country", "place"])


def chart_songs(playlists: DataFrame, tracks: DataFrame, limit: int = 40) -> DataFrame:
    """The first available tracks of each country's chart playlist."""
    chosen = pick_chart(playlists).select("country", "playlist_id")
    songs = normalize_songs(tracks.join(chosen, "playlist_id"), kept=["country", "pos"])
    return first_per(songs, ["country"], [F.asc("pos"), F.asc("id")], limit).drop("pos")


def recent_releases(
    chart: DataFrame, details: DataFrame, artists: int = 5, per_section: int = 5, limit: int = 30
) -> DataFrame:
    """Releases of each country's leading chart artists, newest year first.

    ``details`` has artist_id, section (albums or singles), pos, payload.  An album met twice keeps
    its first place and its last details.
    """
    people = chart_artists(chart, artists).select(
        "country", F.col("place").alias("_person"), F.col("id").alias("artist_id"), F.col("title").alias("_name")
    )
    listed = details.join(people, "artist_id")
    listed = first_per(listed, ["country", "artist_id", "section"], [F.asc("pos")], per_section, "_nth")
    fallback = F.array(F.struct(F.col("_name").alias("name"), F.col("artist_id").alias("id"))).cast(ARTISTS_TYPE)
    listed = listed.withColumn("_fallback", fallback)
    # "albums" come before "singles" in text order as well.
    listed = listed.withColumn("_at", F.struct("_person", "section", "_nth"))
    cards = normalize_albums(listed, kept=["country", "_at"], fallback="_fallback").filter("id <> ''")
    details_of = [c for c in cards.columns if c not in ("country", "_at", "id")]
    once = cards.groupBy("country", "id").agg(
        F.min("_at").alias("_first"), F.max_by(F.struct(*details_of), "_at").alias("_last")
    )
    once = once.select("country", "id", "_first", "_last.*")
    return first_per(once, ["country"], [F.desc("year"), F.asc("_first")], limit).drop("_first")


def search_bundle(results: DataFrame, songs: int = 30, artists: int = 8, albums: int = 12) -> DataFrame:
    """Per query the first songs, artists and albums, as rows (query, kind, place, id, title, artist).

    ``results`` has query, kind (songs, artists, albums), pos, payload.
    """
    kept = ["query", "pos"]

    def of(kind: str) -> DataFrame:
        return results.filter(F.col("kind") == kind).drop("kind")

    def cut(rows: DataFrame, limit: int) -> DataFrame:
        return first_per(rows, ["query"], [F.asc("pos"), F.asc("id")], limit).select(
            "query", "kind", "place", "id", "title", "artist"
        )

    # Songs are dropped for availability before the cut; the other kinds have nothing to drop.
    people = normalize_artists(of("artists"), kept=kept).withColumn("artist", F.col("title"))
    return (
        cut(normalize_songs(of("songs"), kept=kept), songs)
        .unionByName(cut(people, artists))
        .unionByName(cut(normalize_albums(of("albums"), kept=kept), albums))
    )


def artist_page(heads: DataFrame, entries: DataFrame, songs: int = 30, related: int = 12) -> DataFrame:
    """An artist's songs, albums with singles, and related artists.

    ``heads`` has page_id and title; ``entries`` page_id, section (songs, playlist, albums, singles, related),
    pos, payload.  Entries without artists inherit the page's.  Where there is a playlist of the artist's songs, it stands in for
    the page's shorter list.
    """
    people = F.array(F.struct(F.col("title").alias("name"), F.col("page_id").alias("id"))).cast(ARTISTS_TYPE)
    rows = skew_safe_left_join(entries, heads.select("page_id", people.alias("_people")), ["page_id"])
    rows = rows.filter(F.col("_people").isNotNull())
    kept = ["page_id", "section", "pos"]

    def of(*sections: str) -> DataFrame:
        return rows.filter(F.col("section").isin(*sections))

    def first(df: DataFrame, limit: int) -> DataFrame:
        return first_per(df, ["page_id"], [F.asc("pos"), F.asc("id")], limit)

    fuller = of("playlist").withColumn("section", F.lit("songs"))
    listed = of("songs").join(fuller.select("page_id").distinct(), "page_id", "left_anti").unionByName(fuller)
    shown = ["page_id", "section", "pos", "kind", "id", "title", "artist"]
    other = normalize_artists(of("related"), kept=kept).withColumn("artist", F.col("title"))
    records = normalize_albums(of("albums", "singles"), kept=kept, fallback="_people")
    return (
        first(normalize_songs(listed, kept=kept, fallback="_people"), songs).select(*shown)
        .unionByName(records.select(*shown))
        .unionByName(first(other, related).select(*shown))
    )


def album_page(heads: DataFrame, tracks: DataFrame) -> DataFrame:
    """An album's available tracks; artists, art and album come from the page where missing.

    ``heads`` has page_id, title, image, artists (array of name, id); ``tracks`` page_id, pos, payload.
    """
    lent = heads.select(
        "page_id", F.col("title").alias("_title"), F.col("image").alias("_image"),
        F.col("artists").cast(ARTISTS_TYPE).alias("_people"),
    )
    rows = skew_safe_left_join(tracks, lent.withColumn("_album_id", F.col("page_id")), ["page_id"])
    rows = rows.filter(F.col("_album_id").isNotNull())
    return normalize_songs(
        rows, kept=["page_id", "pos"], fallback="_people", artwork="_image", page_album=("_title", "_album_id")
    )
