"""Which covers are wanted, and what each cover id stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earshot.functions import constants as k
from earshot.functions.credits import with_artists
from earshot.functions.measures import largest
from earshot.functions.text import artist_name_from_id, blank, cover_key, from_base64url
from earshot.operators.credits import credit_dimension, credit_dimension_rows
from earshot.operators.matching import legacy_files, with_legacy_keys
from earshot.session import written
from earshot.sources.library import visible, with_optional_columns

_COLUMNS = ["cover_id", "kind", "name", "artist", "key", "native_id", "has_art"]


def with_cover_id(rows: DataFrame) -> DataFrame:
    """Add ``cover_id`` where a named track or album of an artist has neither album nor track id."""
    lacking = {c: F.lit("") for c in ("track_name", "album_name", "track_id", "album_id") if c not in rows.columns}
    full = {c: lacking.get(c, F.col(c)) for c in ("track_name", "album_name", "artist_name", "track_id", "album_id")}
    named = ~blank(full["artist_name"]) & ~(blank(full["track_name"]) & blank(full["album_name"]))
    nameless_ids = blank(full["album_id"]) & blank(full["track_id"])
    return rows.withColumn("cover_id", F.when(named & nameless_ids, cover_key(**full)))


def _files_by_id(library: DataFrame) -> DataFrame:
    """The first file behind each file id and each album id."""
    files = with_optional_columns(library).withColumn("file", F.struct("id", "title", "artist", "album_id", "has_cover_art"))
    keyed = files.select(F.explode(F.array_distinct(F.array("id", "album_id"))).alias("cover_id"), "file")
    return keyed.groupBy("cover_id").agg(F.min("file").alias("file"))


def _listens_by_id(listens: DataFrame) -> DataFrame:
    """The first listen behind each album, track and artist id."""
    fields = ["track_name", "artist_name", "album_id", "track_id", "artist_id"]
    # One row per combination of names and ids, before it is listed under each of its ids.
    heard = listens.groupBy(*fields).agg(F.min("id").alias("id"))
    each = F.explode(F.array_distinct(F.array("album_id", "track_id", "artist_id")))
    heard = heard.withColumn("cover_id", each).filter(~blank(F.col("cover_id")))
    return heard.groupBy("cover_id").agg(F.min(F.struct("id", *fields)).alias("listen"))


def describe_covers(
    ids: DataFrame, library: DataFrame, listens: DataFrame, artists: DataFrame | None = None
) -> DataFrame:
    """What each distinct ``cover_id`` stands for; ids nothing is known of are left out.

    In order: an encoded description, an encoded artist, a row of the optional ``artists`` table, a
    library file by file or album id, a listen by any of its ids.  A listen titled "Artist - Title"
    is traced to its file where there is one.  Every id passes once through the left joins, and the
    first source that knows it is chosen at the end.
    """
    cover_id = F.col("cover_id")
    rows = ids.select("cover_id").distinct()
    rows = rows.join(_files_by_id(library), "cover_id", "left").join(_listens_by_id(listens), "cover_id", "left")
    # Only these credits have to be split.
    credit = F.when(F.col("file").isNull() & (F.col("listen.artist_id") == cover_id), F.col("listen.artist_name"))
    known_artist = F.lit(False)
    if artists is not None:
        people = artists.select(F.col("id").alias("cover_id"), F.col("name").alias("_listed"))
        rows = rows.join(people, "cover_id", "left")
        known_artist = F.col("_listed").isNotNull()
        credit = F.coalesce(F.col("_listed"), credit)
    rows = rows.withColumn("_old", F.when(F.col("file").isNull(), F.col("listen.track_name"))).withColumn("_credit", credit)
    rows = with_legacy_keys(rows.withColumn("_old", F.coalesce("_old", cover_id)), "_old")
    rows = rows.join(legacy_files(library), ["_person", "_title"], "left")
    rows = with_artists(rows, "_credit", out="_people").withColumn("_person", F.get("_people", F.lit(0))["name"])

    described = F.from_json(from_base64url(F.substring(cover_id, 7, 1 << 30)), "kind string, name string, artist string")
    rows = rows.withColumn("_said", F.when(cover_id.startswith("cover-"), described))
    rows = rows.withColumn("_coded", F.nullif(artist_name_from_id(cover_id), F.lit("")))
    said, file, listen, legacy = (F.col(c) for c in ("_said", "file", "listen", "legacy"))
    well_formed = said["kind"].isin("song", "album") & (F.length(said["name"]) <= 300) & (F.length(said["artist"]) <= 300)

    cover = F.concat(F.lit("cover:"), cover_id)
    song, artist = F.lit("song"), F.lit("artist")
    no_text, no_flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    person = F.col("_person")

    def description(kind, name, by, key, native, shown):
        values = dict(kind=kind, name=name, artist=by, key=key, native_id=native, has_art=shown)
        return F.struct(*[value.alias(field) for field, value in values.items()])

    by_person = description(artist, person, no_text, F.concat(F.lit("artist:"), F.lower(person)), no_text, no_flag)
    sources = [
        (cover_id.startswith("cover-") & ~F.coalesce(well_formed, F.lit(False)), F.lit(None)),
        (cover_id.startswith("cover-"), description(said["kind"], said["name"], said["artist"], cover, no_text, F.lit(False))),
        (
            F.col("_coded").isNotNull(),
            description(artist, F.col("_coded"), no_text, F.concat(F.lit("artist:"), F.col("_coded")), no_text, no_flag),
        ),
        (known_artist, by_person),
        (
            file.isNotNull(),
            description(
                song, file["title"], file["artist"], cover, F.coalesce(F.nullif(file["album_id"], F.lit("")), file["id"]),
                F.coalesce(file["has_cover_art"].cast("boolean"), F.lit(True)),
            ),
        ),
        (
            listen.isNotNull() & legacy.isNotNull(),
            description(
                song, legacy["title"], legacy["artist"], cover,
                F.coalesce(F.nullif(legacy["album_id"], F.lit("")), legacy["id"]), F.lit(True),
            ),
        ),
        (listen["artist_id"] == cover_id, by_person),
        (listen.isNotNull(), description(song, listen["track_name"], listen["artist_name"], cover, cover_id, F.lit(True))),
    ]
    chosen = None
    for known, value in sources:
        chosen = F.when(known, value) if chosen is None else chosen.when(known, value)
    # A filter on the choice itself would work it out, and every text in it, again and again for each row.
    rows = written(rows.select("cover_id", chosen.alias("d")), "covers").filter(F.col("d").isNotNull())
    return rows.select("cover_id", *[F.col(f"d.{c}").alias(c) for c in _COLUMNS if c != "cover_id"])


def heard_covers(listens: DataFrame) -> DataFrame:
    """The distinct cover ids of the history, one per (track, artist, album)."""
    keys = ["track_name", "artist_name", "album_name"]
    ids = largest("track_id", "album_id")
    pairs = listens.select(*keys, "track_id", "album_id").distinct().groupBy(*keys)
    pairs = pairs.agg(*[agg.alias(c) for c, agg in ids.items()])
    key = cover_key(*[F.col(c) for c in ("track_name", "album_name", "artist_name", "track_id", "album_id")])
    return pairs.select(key.alias("cover_id")).distinct()


def artwork_worklist(listens: DataFrame, library: DataFrame, artists: DataFrame | None = None) -> DataFrame:
    """Every artwork that may have to be fetched, one row per key.

    Credited artists come first, then visible files known to lack a cover, then the history's covers.
    """
    def target(source: int, name: Column, by: Column, key: Column, native: Column, kind: str, shown: Column) -> list[Column]:
        texts = dict(kind=F.lit(kind), name=name, artist=by, key=key, native_id=native)
        columns = [value.cast("string").alias(field) for field, value in texts.items()]
        return [*columns, shown.cast("boolean").alias("has_art"), F.lit(source).alias("_from")]

    none = F.lit(None)
    people = credit_dimension_rows(credit_dimension(listens, library)).filter(F.col("artist_name") != k.UNKNOWN)
    people = people.groupBy("artist_id").agg(F.min("artist_name").alias("name"))
    person_key = F.concat(F.lit("artist:"), F.lower("name"))
    targets = people.select(*target(0, F.col("name"), none, person_key, none, "artist", none))

    files = visible(with_optional_columns(library)).filter(F.col("has_cover_art").cast("boolean") == F.lit(False))
    first = files.groupBy("album_id").agg(F.min(F.struct("id", "title", "artist")).alias("f"))
    album_key = F.concat(F.lit("cover:"), F.col("album_id"))
    targets = targets.unionByName(
        first.select(*target(1, F.col("f.title"), F.col("f.artist"), album_key, F.col("album_id"), "song", F.lit(False)))
    )

    described = describe_covers(heard_covers(listens), library, listens, artists).drop("cover_id")
    targets = targets.unionByName(described.withColumn("_from", F.lit(2)))
    fields = [c for c in _COLUMNS if c not in ("key", "cover_id")]
    best = targets.groupBy("key").agg(F.min(F.struct("_from", *fields)).alias("t"))
    return best.select("key", *[F.col(f"t.{c}").alias(c) for c in fields])
