"""The library by size: roll-ups, filtered pages and breakdowns.

Artists come from each file's own credit and tags, so a shared song counts for every artist
while the totals count each file once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from earshot.functions.credits import with_artists
from earshot.functions.measures import share_percent
from earshot.functions.text import artist_id, contains_text, credit_key
from earshot.operators.paging import By, down, in_order, up, with_total
from earshot.params import clamp
from earshot.sources.library import visible, with_optional_columns

_SEARCHED = {"artists": ["artist"], "albums": ["album", "artist"], "tracks": ["title", "artist", "album"]}


@dataclass(frozen=True)
class Selection:
    """What part of the library is looked at."""

    artist: str | None = None
    album_id: str | None = None
    query: str | None = None


EVERYTHING = Selection()


def _credit_groups(files: DataFrame) -> DataFrame:
    """Files per distinct (credit, tags), with the artists of each such pair."""
    per_credit = files.groupBy("artist", "participants").agg(
        F.count(F.lit(1)).alias("tracks"),
        F.sum("size").alias("bytes"),
        F.min("album_id").alias("album_id"),
        F.max("updated_at").alias("updated_at"),
    )
    return with_artists(per_credit, "artist", "participants")


def credited_to(files: DataFrame, artist: str) -> DataFrame:
    """Files whose credit or tags include exactly this artist.

    The distinct (credit, tags) pairs that include the artist are the small side of a semi join, which Spark broadcasts when it
    has measured them to be small.
    """
    pairs = with_artists(files.select("artist", "participants").distinct(), "artist", "participants")
    pairs = pairs.withColumn("_key", credit_key(F.lit(artist))).withColumn("_wanted", artist_id(F.col("_key")))
    pairs = pairs.filter(F.exists("artists", lambda a: a["id"] == F.col("_wanted")))
    pairs = pairs.select(F.col("artist").alias("_a"), F.col("participants").alias("_p"))
    same = files["artist"].eqNullSafe(pairs["_a"]) & files["participants"].eqNullSafe(pairs["_p"])
    return files.join(pairs, same, "left_semi")


def selected_files(
    library: DataFrame, group: str = "tracks", selection: Selection = EVERYTHING, deleted: DataFrame | None = None
) -> DataFrame:
    """Visible files under the artist, album and search filters of a group's view."""
    files = visible(with_optional_columns(library), deleted)
    if selection.album_id:
        files = files.filter(F.col("album_id") == selection.album_id)
    if selection.query:
        hit = F.lit(False)
        for column in _SEARCHED[group]:
            hit = hit | contains_text(F.col(column), selection.query)
        files = files.filter(hit)
    return credited_to(files, selection.artist) if selection.artist else files


def _artist_rows(files: DataFrame) -> DataFrame:
    each = _credit_groups(files).withColumn("a", F.explode("artists")).drop("artists")
    rolled = each.groupBy(F.col("a.id").alias("id")).agg(
        F.min("a.name").alias("name"),
        F.sum("tracks").alias("tracks"),
        F.sum("bytes").alias("bytes"),
        F.min("album_id").alias("album_id"),
        F.max("updated_at").alias("updated_at"),
    )
    return rolled.select(
        "name", F.col("name").alias("artist"), F.lit("").alias("album"), "tracks", "bytes", "id", "album_id", "updated_at"
    )


def storage_artists(
    library: DataFrame, selection: Selection = EVERYTHING, deleted: DataFrame | None = None
) -> DataFrame:
    rows = _artist_rows(selected_files(library, "artists", selection, deleted))
    if selection.query:
        rows = rows.filter(contains_text(F.col("name"), selection.query))
    if selection.artist:
        rows = rows.withColumn("_key", credit_key(F.lit(selection.artist)))
        rows = rows.filter(F.col("id") == artist_id(F.col("_key"))).drop("_key")
    return rows


def storage_albums(
    library: DataFrame, selection: Selection = EVERYTHING, deleted: DataFrame | None = None
) -> DataFrame:
    files = selected_files(library, "albums", selection, deleted)
    rows = files.groupBy("album_id", "album", "album_artist").agg(
        F.count(F.lit(1)).alias("tracks"), F.sum("size").alias("bytes"), F.max("updated_at").alias("updated_at")
    )
    return rows.select(
        F.col("album").alias("name"), F.col("album_artist").alias("artist"), "album", "tracks", "bytes",
        F.col("album_id").alias("id"), "album_id", "updated_at",
    )


def storage_tracks(
    library: DataFrame, selection: Selection = EVERYTHING, deleted: DataFrame | None = None
) -> DataFrame:
    files = selected_files(library, "tracks", selection, deleted)
    return files.select(
        F.col("title").alias("name"), "artist", "album", "album_id", "duration", "track_number",
        F.col("size").alias("bytes"), "id", "updated_at",
    )


def with_split_artists(rows: DataFrame) -> DataFrame:
    """Add the artists of the shown credit, tags aside, to a page of rows."""
    return with_artists(rows, "artist")


def storage_order(group: str, sort: str | None) -> list[By]:
    """Names compare without case; ids break ties."""
    name, ties = up(F.lower("name")), [up("name"), up("id")]
    if group == "albums":
        ties = [*ties, up("artist")]
    if sort == "name":
        return [name, *ties]
    if sort == "artist":
        return [up(F.lower("artist")), name, *ties]
    if sort == "recent":
        return [down("updated_at"), name, *ties]
    if sort == "track" and group == "tracks":
        return [up("track_number"), name, *ties]
    return [down("bytes"), name, *ties]


def storage_page(
    library: DataFrame,
    group: str = "tracks",
    selection: Selection = EVERYTHING,
    sort: str | None = "size",
    page: int = 1,
    limit: int | None = 30,
    deleted: DataFrame | None = None,
    last_page: int | None = 10_000,
) -> DataFrame:
    """One page of a group's rows with the total number of rows.

    A request gets no page beyond ``last_page``, as the reference has it; without one every page can be read.
    """
    build = {"artists": storage_artists, "albums": storage_albums}.get(group, storage_tracks)
    rows = build(library, selection, deleted)
    page, limit = max(1, page) if last_page is None else clamp(page, 1, last_page, 1), clamp(limit, 1, 100, 30)
    ordered = in_order(rows, storage_order(group, sort))
    return with_total(ordered.page(page, limit), ordered.total)


def storage_summary(library: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Tracks, bytes (each file once), artists after splitting credits, albums."""
    files = visible(with_optional_columns(library), deleted)
    pairs = with_artists(files.select("artist", "participants").distinct(), "artist", "participants")
    artists = pairs.select(F.explode("artists").alias("a")).agg(F.countDistinct("a.id"))
    return files.agg(
        F.count(F.lit(1)).alias("tracks"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.countDistinct("album_id").alias("albums"),
    ).select("tracks", "bytes", artists.scalar().alias("artists"), "albums")


def storage_selection(
    library: DataFrame, group: str = "tracks", selection: Selection = EVERYTHING, deleted: DataFrame | None = None
) -> DataFrame:
    files = selected_files(library, group, selection, deleted)
    return files.agg(F.count(F.lit(1)).alias("tracks"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def _largest(rows: DataFrame, library: DataFrame, limit: int, *ties: str) -> DataFrame:
    # Shared songs make artist sizes overlap, so the whole is taken from the files.
    whole = visible(library).agg(F.sum("size")).scalar()
    top = rows.orderBy(F.desc("bytes"), *ties).limit(limit)
    return top.withColumn("share", share_percent(F.col("bytes"), whole))


def largest_artists(library: DataFrame, limit: int = 8) -> DataFrame:
    rows = storage_artists(library).select("name", "id", "tracks", "bytes")
    return _largest(rows, library, limit, "id")


def largest_albums(library: DataFrame, limit: int = 8) -> DataFrame:
    rows = storage_albums(library).select("name", "artist", "id", "tracks", "bytes")
    return _largest(rows, library, limit, "id", "name", "artist")


def album_tracklist(library: DataFrame, album_id: str) -> DataFrame:
    """All files of an album by track number, missing ones included."""
    rows = library.filter(F.col("album_id") == album_id)
    return rows.orderBy("track_number", "id").select(
        F.col("id").alias("track_id"), F.col("title").alias("track_name"), F.col("artist").alias("artist_name"),
        F.col("album").alias("album_name"), "track_number", "duration", "album_id", "artist_id",
    )


def artist_tracks(library: DataFrame, artist: str | None = None, artist_key: str | None = None, limit: int = 50) -> DataFrame:
    """Visible files of a credited artist, or of a plain library artist id, by title."""
    files = visible(with_optional_columns(library))
    files = credited_to(files, artist) if artist is not None else files.filter(F.col("artist_id") == artist_key)
    return files.orderBy("title", "id").limit(limit).select(
        F.col("id").alias("track_id"), F.col("title").alias("track_name"), F.col("artist").alias("artist_name"),
        F.col("album").alias("album_name"), "album_id", "artist_id", "duration",
    )
