"""Matching catalog entries, recordings and artists to each other by normalised names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earshot.functions.credits import with_artists
from earshot.functions.text import (
    blank, casefold, catalog_key, clean_recording_title, match_key, nfkc, title_prefix, title_rest,
)
from earshot.operators.skew import skew_safe_left_join
from earshot.sources.library import visible

_APART = "\uffff"


def mark_owned(catalog: DataFrame, library: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Catalog rows (kind, title, artist, artists) with the id and album id of the file they match.

    Songs match on artist and title, albums on artist and album; where several files share a key,
    the last id is taken.  Only the matched ids travel with the keys.
    """
    by = F.col("artist")
    if "artists" in catalog.columns:
        by = F.coalesce(F.nullif(by, F.lit("")), F.get("artists", F.lit(0))["name"])
    rows = catalog.withColumn("_kind", F.when(F.col("kind") == "album", F.lit("album")).otherwise(F.lit("song")))
    rows = rows.withColumn("_artist", match_key(by)).withColumn("_title", match_key(F.col("title")))
    files = visible(library, deleted)
    keyed = files.select(
        "id", "album_id", match_key(F.col("artist")).alias("_artist"),
        match_key(F.col("title")).alias("song"), match_key(F.col("album")).alias("album"),
    )
    keyed = keyed.select(
        "id", "album_id", "_artist",
        F.explode(F.create_map(F.lit("song"), F.col("song"), F.lit("album"), F.col("album"))).alias("_kind", "_title"),
    )
    last = F.max(F.struct("id", "album_id"))
    owned = keyed.groupBy("_kind", "_artist", "_title").agg(last["id"].alias("local_id"), last["album_id"].alias("local_album_id"))
    return skew_safe_left_join(rows, owned, ["_kind", "_artist", "_title"]).drop("_kind", "_artist", "_title")


def with_legacy_keys(rows: DataFrame, title: str = "track_name") -> DataFrame:
    """Add ``_person`` and ``_title``, the keys of both halves of an "Artist - Title" text.

    Other texts get keys that match nothing but differ from each other, so that they spread over
    the tasks of a join instead of meeting in the one for NULL.
    """
    c = F.col(title)
    old = F.instr(c, " - ") > 0
    none = F.concat(F.lit(_APART), F.coalesce(c, F.lit("")))
    rows = rows.withColumn("_person", match_key(title_prefix(c)))
    # A key takes its text several times, so what is cleaned gets a projection of its own.
    rows = rows.withColumn("_title", clean_recording_title(title_rest(c)))
    rows = rows.withColumn("_title", match_key(F.col("_title")))
    return rows.withColumns({"_person": F.when(old, F.col("_person")).otherwise(none)})


def legacy_files(library: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """One visible file (smallest id) per credited artist and cleaned title, for the ``_title`` keys asked for, if any are."""
    files = visible(library).withColumn("_title", clean_recording_title(F.col("title")))
    files = files.withColumn("_title", match_key(F.col("_title")))
    if titles is not None:
        files = files.join(titles, "_title", "left_semi")
    first = F.min(F.struct("id", "title", "artist", "album_id")).alias("legacy")
    # One file per credit and title first, so credits are split on the reduced rows.
    files = with_artists(files.groupBy("artist", "_title").agg(first), "artist")
    people = files.select("_title", "legacy", F.explode("artists.name").alias("_name"))
    people = people.withColumn("_person", match_key(F.col("_name")))
    return people.groupBy("_person", "_title").agg(F.min("legacy").alias("legacy"))


def match_legacy_titles(titles: DataFrame, library: DataFrame) -> DataFrame:
    """Old titles of the form "Artist - Title" with the visible file they name.

    ``titles`` has track_name.  A file fits when one of its credited artists equals the prefix and the
    cleaned titles are equal.
    """
    old = titles.select("track_name").filter(F.instr("track_name", " - ") > 0).distinct()
    old = with_legacy_keys(old)
    found = old.join(legacy_files(library, old.select("_title").distinct()), ["_person", "_title"])
    return found.select(
        "track_name", F.col("legacy.id").alias("file_id"), F.col("legacy.title").alias("title"),
        F.col("legacy.artist").alias("artist"), F.col("legacy.album_id").alias("album_id"),
    )


def _with_name_keys(df: DataFrame, names: str, out: str) -> DataFrame:
    """The catalog keys of an array of names."""
    joined = casefold(nfkc(F.array_join(F.transform(names, lambda n: F.coalesce(n, F.lit(""))), _APART)))
    keys = F.transform(F.split("_joined", _APART), lambda n: F.regexp_replace(n, r"[^\p{L}\p{N}_]", ""))
    some = F.when(F.coalesce(F.size(names), F.lit(0)) > 0, F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))
    return df.withColumn("_joined", joined).withColumn(out, some).drop("_joined")


def _clean_key(title: Column) -> Column:
    return catalog_key(clean_recording_title(title, catalog=True))


def match_catalog(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """The first candidate for each wanted recording: equal clean titles and a common artist.

    ``wanted`` has wanted_id, title, artists; ``candidates`` source (songs or videos), pos, id, title,
    artists, and perhaps image, which is returned too.  Songs come before videos.  An "Artist - " prefix is dropped from a title when it
    names a wanted artist, so a candidate is offered under both readings of its title.  It is
    reduced to the first one per (title, prefix, artist) before the join: no pairs of wanted and
    candidates that share a common title are formed.
    """
    wanted = _with_name_keys(wanted, "artists", "_artists")
    wanted = wanted.withColumn("_prefix", catalog_key(title_prefix(F.col("title"))))
    own = (F.instr("title", " - ") > 0) & F.array_contains("_artists", F.col("_prefix"))
    wanted = wanted.withColumn("_title", _clean_key(F.when(own, title_rest(F.col("title"))).otherwise(F.col("title"))))
    wanted = wanted.select("wanted_id", "_title", "_artists").withColumn("_artist", F.explode("_artists"))

    pool = _with_name_keys(candidates, "artists", "_artists")
    pool = pool.withColumn("_artist", F.explode("_artists")).drop("_artists")
    has_prefix = F.instr("title", " - ") > 0
    pool = pool.withColumn("_p", catalog_key(title_prefix(F.col("title"))))
    pool = pool.withColumn("_whole", _clean_key(F.col("title"))).withColumn("_rest", _clean_key(title_rest(F.col("title"))))
    pool = pool.withColumn("_prefix", F.when(has_prefix, F.col("_p")))
    image = ["image"] if "image" in candidates.columns else []
    order = F.struct((F.col("source") != "songs").alias("later"), "pos", "id", "source", *image)
    whole = pool.groupBy(F.col("_whole").alias("_title"), "_artist", "_prefix").agg(F.min(order).alias("hit"))
    rest = pool.filter(has_prefix).groupBy(F.col("_rest").alias("_title"), "_artist", "_prefix")
    rest = rest.agg(F.min(order).alias("hit"))

    other = F.col("_prefix").isNull() | ~F.array_contains("_artists", F.col("_prefix"))
    by_whole = wanted.join(whole, ["_title", "_artist"]).filter(other).select("wanted_id", "hit")
    named = wanted.withColumn("_prefix", F.explode("_artists"))
    by_rest = named.join(rest, ["_title", "_artist", "_prefix"]).select("wanted_id", "hit")
    best = by_whole.union(by_rest).groupBy("wanted_id").agg(F.min("hit").alias("hit"))
    return best.select("wanted_id", *[F.col(f"hit.{c}").alias(c) for c in ("id", "source", *image)])


def match_artist_exact(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The first candidate artist whose normalised name equals the query's.

    ``queries`` has name; ``candidates`` pos, id, title and perhaps artist, which goes before title, and image, which is returned.
    """
    title = F.col("title")
    if "artist" in candidates.columns:
        title = F.when(blank(F.col("artist")), title).otherwise(F.col("artist"))
    pool = candidates.withColumn("_key", catalog_key(title))
    image = ["image"] if "image" in candidates.columns else []
    pool = pool.groupBy("_key").agg(F.min(F.struct("pos", "id", *image)).alias("hit"))
    wanted = queries.select("name").distinct().withColumn("_key", catalog_key(F.col("name")))
    return wanted.join(pool, "_key").select("name", *[F.col(f"hit.{c}").alias(c) for c in ("id", *image)])
