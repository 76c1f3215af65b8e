"""Landed catalog documents (one JSON text per entry) to uniform song, album and artist rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from earshot.functions import constants as k
from earshot.functions.credits import ARTISTS_TYPE
from earshot.functions.text import allowed_image, valid_catalog_id

_PEOPLE = "artists array<struct<name:string,id:string,browseId:string>>"
_IMAGES = "thumbnails array<struct<url:string>>"

SONG = f"""videoId string, title string, {_PEOPLE}, album string, isAvailable boolean, {_IMAGES}, duration string,
duration_seconds bigint, isExplicit boolean, views string"""
ALBUM = f"browseId string, title string, {_PEOPLE}, {_IMAGES}, year string, type string"
ARTIST = f"browseId string, id string, title string, artist string, name string, {_IMAGES}, subscribers string, rank string, trend string"

_IMAGE_LIST = "images:array<struct<url:string>>"
_LINKS = "external_urls:struct<spotify:string>"
_TRACK = f"""id:string, name:string, artists:array<struct<name:string>>, preview_url:string, popularity:int, {_LINKS},
album:struct<name:string, {_IMAGE_LIST}, {_LINKS}, release_date:string>"""


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _first_text(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def _image(doc: Column) -> Column:
    """The last, largest thumbnail."""
    return _text(F.try_element_at(doc["thumbnails"], F.lit(-1))["url"])


def _people(doc: Column, fallback: Column | None) -> Column:
    named = F.filter(doc["artists"], lambda a: _text(a["name"]) != "")
    own = F.transform(
        named, lambda a: F.struct(a["name"].alias("name"), _text(_first_text(a["id"], a["browseId"])).alias("id"))
    )
    nobody = F.array().cast(ARTISTS_TYPE)
    inherited = nobody if fallback is None else F.coalesce(fallback, nobody)
    return F.when(F.coalesce(F.size(doc["artists"]), F.lit(0)) > 0, own).otherwise(
        F.filter(inherited, lambda a: _text(a["name"]) != "")
    )


def names(people: Column) -> Column:
    return F.array_join(F.transform(people, lambda a: a["name"]), ", ")


def _parsed(entries: DataFrame, payload: str, schema: str, kept: list[str] | None) -> tuple[DataFrame, list[str]]:
    """Add the parsed ``_doc``.

    It comes out of a one-element explode, because a filter on a plain column would be pushed below
    the projection together with a second copy of the parsing.
    """
    kept = [c for c in entries.columns if c != payload] if kept is None else kept
    return entries.withColumn("_doc", F.explode(F.array(F.from_json(payload, schema)))), kept


def normalize_songs(
    entries: DataFrame,
    payload: str = "payload",
    kept: list[str] | None = None,
    fallback: str | None = None,
    artwork: str | None = None,
    page_album: tuple[str, str] | None = None,
) -> DataFrame:
    """Song rows of the available entries.

    ``fallback``, ``artwork`` and ``page_album`` name columns with what a page lends to entries
    that lack artists, an image or an album of their own.
    """
    rows, kept = _parsed(entries, payload, SONG, kept)
    doc = F.col("_doc")
    rows = rows.filter((_text(doc["videoId"]) != "") & F.coalesce(doc["isAvailable"], F.lit(True)))
    rows = rows.withColumn("_people", _people(doc, F.col(fallback) if fallback else None))
    # An album is an object with name and id, a plain text, or absent.
    is_object = doc["album"].startswith("{")
    album = F.from_json(doc["album"], "name string, id string")
    lent_name, lent_id = (F.col(c) for c in page_album) if page_album else (_text(doc["album"]), F.lit(""))
    image = _first_text(_image(doc), F.col(artwork)) if artwork else _image(doc)
    return rows.select(
        *kept,
        doc["videoId"].alias("id"),
        F.lit("song").alias("kind"),
        F.coalesce(doc["title"], F.lit("Untitled")).alias("title"),
        F.col("_people").alias("artists"),
        names(F.col("_people")).alias("artist"),
        _text(F.when(is_object, album["name"]).otherwise(lent_name)).alias("album"),
        _text(F.when(is_object, album["id"]).otherwise(lent_id)).alias("album_id"),
        _text(image).alias("image"),
        _text(doc["duration"]).alias("duration"),
        F.coalesce(doc["duration_seconds"], F.lit(0)).alias("duration_seconds"),
        F.coalesce(doc["isExplicit"], F.lit(False)).alias("explicit"),
        doc["views"].alias("views"),
        F.concat(F.lit(k.WATCH_URL), doc["videoId"]).alias("url"),
        F.concat(F.lit(k.EMBED_URL), doc["videoId"]).alias("embed_url"),
        F.lit(k.CATALOG_PROVIDER).alias("provider"),
    )


def normalize_albums(
    entries: DataFrame, payload: str = "payload", kept: list[str] | None = None, fallback: str | None = None
) -> DataFrame:
    rows, kept = _parsed(entries, payload, ALBUM, kept)
    doc = F.col("_doc")
    rows = rows.withColumn("_people", _people(doc, F.col(fallback) if fallback else None))
    return rows.select(
        *kept,
        _text(doc["browseId"]).alias("id"),
        F.lit("album").alias("kind"),
        F.coalesce(doc["title"], F.lit("Untitled")).alias("title"),
        F.col("_people").alias("artists"),
        names(F.col("_people")).alias("artist"),
        _image(doc).alias("image"),
        _text(doc["year"]).alias("year"),
        F.coalesce(F.nullif(doc["type"], F.lit("")), F.lit("Album")).alias("type"),
        F.lit(k.CATALOG_PROVIDER).alias("provider"),
    )


def normalize_artists(entries: DataFrame, payload: str = "payload", kept: list[str] | None = None) -> DataFrame:
    rows, kept = _parsed(entries, payload, ARTIST, kept)
    doc = F.col("_doc")
    title = F.coalesce(_first_text(doc["title"], doc["artist"]), doc["name"], F.lit("Unknown artist"))
    return rows.select(
        *kept,
        _text(_first_text(doc["browseId"], doc["id"])).alias("id"),
        F.lit("artist").alias("kind"),
        title.alias("title"),
        _image(doc).alias("image"),
        _text(doc["subscribers"]).alias("subscribers"),
        doc["rank"].alias("rank"),
        doc["trend"].alias("trend"),
        F.lit(k.CATALOG_PROVIDER).alias("provider"),
    )


def normalize_second_provider(entries: DataFrame, payload: str = "payload", kept: list[str] | None = None) -> DataFrame:
    """Tracks of the second provider, bare or wrapped as a playlist's ``item`` or ``track``."""
    rows, kept = _parsed(entries, payload, f"struct<{_TRACK}, item:struct<{_TRACK}>, track:struct<{_TRACK}>>", kept)
    fields = ["id", "name", "artists", "preview_url", "popularity", "external_urls", "album"]

    def track(source: Column) -> Column:
        return F.when(source.isNotNull(), F.struct(*[source[f].alias(f) for f in fields]))

    doc = F.col("_doc")
    rows = rows.withColumn("_t", F.coalesce(track(doc["item"]), track(doc["track"]), track(doc)))
    t, album = F.col("_t"), F.col("_t.album")
    images = album["images"]
    artist = F.nullif(F.array_join(F.transform(t["artists"], lambda a: a["name"]), ", "), F.lit(""))
    return rows.select(
        *kept,
        t["id"].alias("id"),
        F.coalesce(_first_text(t["name"], album["name"]), F.lit("Untitled")).alias("title"),
        F.coalesce(artist, F.lit(k.SECOND_PROVIDER)).alias("artist"),
        _text(album["name"]).alias("album"),
        _text(_first_text(F.get(images, F.lit(1))["url"], F.get(images, F.lit(0))["url"])).alias("image"),
        _text(t["preview_url"]).alias("preview_url"),
        F.coalesce(
            _first_text(t["external_urls"]["spotify"], album["external_urls"]["spotify"]), F.lit(k.SECOND_PROVIDER_URL)
        ).alias("url"),
        _text(album["release_date"]).alias("published_at"),
        F.coalesce(t["popularity"], F.lit(0)).alias("popularity"),
        F.lit(k.SECOND_PROVIDER).alias("provider"),
    )


def normalize_page_heads(pages: DataFrame, kind: str, payload: str = "payload", kept: list[str] | None = None) -> DataFrame:
    """What heads an artist or album page; the page's id is among the kept columns."""
    schema = f"name string, title string, {_PEOPLE}, {_IMAGES}, description string, subscribers string, year string"
    rows, kept = _parsed(pages, payload, schema, kept)
    doc = F.col("_doc")
    shared = [*kept, F.lit(kind).alias("kind"), _image(doc).alias("image"), _text(doc["description"]).alias("description")]
    if kind == "artist":
        title = F.coalesce(doc["name"], F.lit("Artist")).alias("title")
        return rows.select(*shared, title, _text(doc["subscribers"]).alias("subscribers"))
    rows = rows.withColumn("_people", _people(doc, None))
    return rows.select(
        *shared,
        F.coalesce(doc["title"], F.lit("Album")).alias("title"),
        F.col("_people").alias("artists"),
        names(F.col("_people")).alias("artist"),
        _text(doc["year"]).alias("year"),
    )


def page_entries(pages: DataFrame, sections: list[str], payload: str = "payload") -> DataFrame:
    """Entries of whole pages, ``{section: {"results": [...]}}``, one row each.

    Adds section, pos and payload (the entry's own JSON) to the other columns of ``pages``.
    """
    kept = [c for c in pages.columns if c != payload]
    schema = ", ".join(f"{s} struct<results:array<string>>" for s in sections)
    rows = pages.withColumn("_doc", F.from_json(payload, schema))
    results = F.array(*[F.struct(F.lit(s).alias("section"), F.col(f"_doc.{s}.results").alias("results")) for s in sections])
    rows = rows.select(*kept, F.explode(results).alias("_s"))
    return rows.select(*kept, F.col("_s.section").alias("section"), F.posexplode("_s.results").alias("pos", "payload"))


def valid_catalog_rows(rows: DataFrame, country: str = "country", id: str = "id", image: str = "image") -> DataFrame:
    """Rows for a supported country, with a well-formed id and an image from an allowed host."""
    return rows.filter(F.upper(country).isin(k.COUNTRIES) & valid_catalog_id(F.col(id)) & allowed_image(F.col(image)))


def supported_countries(spark: SparkSession) -> DataFrame:
    """The countries a chart may be asked for: worldwide first, the rest by English name."""
    codes = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in k.COUNTRIES])).alias("code"))
    name = F.java_method(
        F.lit("com.ibm.icu.util.ULocale"), F.lit("getDisplayCountry"), F.concat(F.lit("und-"), F.col("code")), F.lit("en")
    )
    named = codes.withColumn("name", name)
    named = named.withColumn("name", F.when(F.col("code") == "ZZ", F.lit("Worldwide")).otherwise(F.col("name")))
    return named.orderBy(F.col("code") != "ZZ", "name")
