"""A listening history derived from the given tables, as FIXTURES.md lays it down.

parts are library files, suppliers artists, events listens with intraday time, line items a
longer history.  Nothing is sampled: each view covers its whole base tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from earshot.functions.constants import COUNTRIES
from earshot.functions.credits import with_artists
from earshot.params import Clock
from earshot.sources.catalog import normalize_page_heads, normalize_songs
from earshot.sources.listens import LISTEN_COLUMNS

AS_OF = Clock(datetime(2024, 1, 30, 23, 59, 59))
AS_OF_LONG = Clock(datetime(2001, 11, 4, 23, 59, 59))


# Footers and counts are read once per session; the sessions are kept, so their ids stay theirs.
_TABLES: dict[tuple[int, str, str], tuple[SparkSession, DataFrame]] = {}
_COUNTS: dict[tuple[int, str, str], int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = (id(spark), sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = (spark, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return _TABLES[key][1]


def row_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """A table's row count, which Parquet footers hold."""
    key = (id(spark), sf_dir, name)
    if key not in _COUNTS:
        _COUNTS[key] = table(spark, sf_dir, name).count()
    return _COUNTS[key]


def _text(c: Column) -> Column:
    return c.cast("string")


def media_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    n = F.lit(row_count(spark, sf_dir, "supplier"))
    key = F.col("p_partkey")
    first = supplier.select(F.col("s_suppkey").alias("k1"), F.col("s_name").alias("n1"))
    second = supplier.select(F.col("s_suppkey").alias("k2"), F.col("s_name").alias("n2"))
    files = part.withColumn("k1", key % n).withColumn("k2", (key * 7 + 3) % n).join(first, "k1").join(second, "k2")
    n1, n2 = F.col("n1"), F.col("n2")
    artist = (
        F.when(key % 11 == 0, F.lit("Unknown"))
        .when(key % 5 == 0, F.concat(n1, F.lit(", "), n2))
        .when(key % 7 == 0, F.concat(n1, F.lit(" feat. "), n2))
        .when(key % 13 == 0, F.concat(n1, F.lit("; "), F.upper(n1)))
        .otherwise(n1)
    )
    tags = F.concat(F.lit('{"artist":[{"name":"'), n1, F.lit('"},{"name":"'), n2, F.lit('"}]}'))
    month = F.lpad(_text(key % 12 + 1), 2, "0")
    return files.select(
        F.concat(F.lit("t"), _text(key)).alias("id"),
        F.col("p_name").alias("title"),
        artist.alias("artist"),
        F.when(key % 17 == 0, tags).alias("participants"),
        F.when(key % 11 == 0, F.lit("Unknown")).otherwise(F.col("p_brand")).alias("album"),
        F.concat(F.lit("al-"), F.col("p_brand")).alias("album_id"),
        F.concat(F.lit("ar-"), _text(F.col("k1"))).alias("artist_id"),
        n1.alias("album_artist"),
        (F.col("p_size") * 10).alias("duration"),
        (key % 20 + 1).cast("int").alias("track_number"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").alias("size"),
        (key % 19 == 0).alias("missing"),
        F.when(key % 9 == 0, F.lit("")).otherwise(F.col("p_type")).alias("genre"),
        F.concat(F.lit("2024-"), month, F.lit("-01 00:00:00")).alias("updated_at"),
        (key % 6 != 0).alias("has_cover_art"),
        key.alias("file_key"),
    )


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_file(spark, sf_dir).drop("file_key")


def _heard(files: DataFrame) -> DataFrame:
    return files.select(
        "file_key", F.col("title").alias("track_name"), F.col("artist").alias("artist_name"),
        F.col("album").alias("album_name"), F.col("id").alias("track_id"), "album_id", "artist_id", "genre",
    )


def _as_listens(events: DataFrame, files: DataFrame) -> DataFrame:
    """Works for a batch and for a stream of events alike."""
    rows = events.join(_heard(files), "file_key")
    return rows.select(*[c for c in LISTEN_COLUMNS if c in rows.columns], "ts")


def listen_events(events: DataFrame, parts: int) -> DataFrame:
    heard = F.lit(int(parts * 0.6))
    e = F.col("event_id") % heard
    # Reduced before squaring: the same remainder, without overflow for large ids.
    key = (e * e % heard * 31 + F.col("user_id") * 17) % heard
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), _text(F.col("user_id"))).alias("user_name"),
        F.floor("value").cast("int").alias("duration"),
        F.when(F.col("event_type").isin("view", "click"), F.lit("view")).otherwise(F.lit("play")).alias("event_type"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        key.alias("file_key"),
    )


def listens(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = listen_events(table(spark, sf_dir, "events"), row_count(spark, sf_dir, "part"))
    return _as_listens(events, media_file(spark, sf_dir))


def stream_of_listens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same listens as a stream: files of events joined to the static library."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return _as_listens(listen_events(events, row_count(spark, sf_dir, "part")), media_file(spark, sf_dir))


def listens_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six calendar years without ids."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    events = lines.select(
        F.concat(F.lit("u"), _text(F.col("o_custkey"))).alias("user_name"),
        (F.col("l_quantity") * 10).cast("int").alias("duration"),
        F.when(F.col("l_returnflag") == "R", F.lit("view")).otherwise(F.lit("play")).alias("event_type"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.col("l_partkey").alias("file_key"),
    )
    return _as_listens(events, media_file(spark, sf_dir))


def as_submissions(rows: DataFrame) -> DataFrame:
    """Listens as a player would submit them: titles decorated, cut or foreign, names partly absent."""
    how = F.col("id") % 4
    title = (
        F.when(how == 0, F.col("track_name"))
        .when(how == 1, F.concat(F.col("track_name"), F.lit(" (Remaster) [HD]")))
        .when(how == 2, F.substring("track_name", 2, 40))
        .otherwise(F.concat(F.lit("zz "), F.col("track_name")))
    )
    return rows.select(
        F.col("id").alias("event_id"),
        "user_name",
        F.col("ts").alias("received_at"),
        F.when(F.col("event_type") == "view", F.lit("playing_now")).otherwise(F.lit("single")).alias("listen_type"),
        title.alias("track_name"),
        F.nullif("artist_name", F.lit("Unknown")).alias("artist_name"),
        F.nullif("album_name", F.lit("Unknown")).alias("release_name"),
        F.when(F.col("id") % 3 != 0, F.col("duration") * 1000 + 500).alias("duration_ms"),
    )


def raw_listens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_submissions(listens(spark, sf_dir))


def as_payloads(submissions: DataFrame) -> DataFrame:
    """Wrap each submission into the nested JSON body a client posts."""
    info = F.struct(F.col("duration_ms"))
    track = F.struct("track_name", "artist_name", "release_name", info.alias("additional_info"))
    body = F.to_json(F.struct("listen_type", F.array(F.struct(track.alias("track_metadata"))).alias("payload")))
    return submissions.select("event_id", "user_name", "received_at", body.alias("body"))


def listen_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_payloads(raw_listens(spark, sf_dir))


def listens_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listens of which a third lost their ids, genre and duration."""
    lost = F.col("id") % 3 == 0
    rows = listens(spark, sf_dir)
    emptied = {c: F.when(lost, F.lit("")).otherwise(F.col(c)) for c in ("album_id", "track_id", "artist_id", "genre")}
    return rows.withColumns({**emptied, "duration": F.when(lost, F.lit(0)).otherwise(F.col("duration"))})


def import_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch as large as the history: its upper half replaces rows, the rest is new, views come
    twice with different durations, and sign-ups have no id."""
    half = row_count(spark, sf_dir, "events") // 2
    events = table(spark, sf_dir, "events")
    signups = events.select(F.col("event_id").alias("id"), F.col("event_type") == "signup").toDF("id", "signup")
    # Joined before the files, while the rows are narrow.
    marked = listen_events(events, row_count(spark, sf_dir, "part")).join(signups, "id")
    rows = marked.join(_heard(media_file(spark, sf_dir)), "file_key").select(*LISTEN_COLUMNS, "ts", "signup")
    n = row_count(spark, sf_dir, "events")
    once = rows.withColumn("pos", F.col("id")).withColumn("duration", F.col("duration") + 1)
    again = rows.filter((F.col("event_type") == "view")).withColumn("pos", F.col("id") + n)
    again = again.withColumn("duration", F.col("duration") + 2)
    batch = once.unionByName(again)
    return batch.withColumn("id", F.when(~F.col("signup"), F.col("id") + half)).drop("signup")


def legacy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listens that name the artist in the title and an uploader as artist, without library ids."""
    title = F.concat("artist_name", F.lit(" - "), "track_name", F.lit(" (Audio)"))
    return listens(spark, sf_dir).select(
        "id", title.alias("track_name"), F.lit("Uploads").alias("artist_name"), "album_name",
        F.concat(F.lit("old-"), "track_id").alias("track_id"), F.lit("").alias("album_id"), F.lit("").alias("artist_id"), "ts",
    )


def track_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_listens(spark, sf_dir)
    artist = F.coalesce("artist_name", F.lit("Unknown"))
    return raw.select(F.col("track_name").alias("track"), artist.alias("artist")).distinct()


# -- landed catalog entries ---------------------------------------------------------------------


def _country(nation: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in COUNTRIES]), nation)


def _brand_number(c: Column) -> Column:
    return F.regexp_extract(c, r"#(\d+)", 1).cast("int")


def song_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every library file as a catalog song: some without id, artists or album object, some gone."""
    f = media_file(spark, sf_dir)
    people = F.array(F.struct(F.col("album_artist").alias("name"), F.col("artist_id").alias("id")))
    url = (
        F.when(F.col("genre") == "LARGE", F.lit("http://i.ytimg.com/a.jpg"))
        .when(F.col("genre") == "SMALL", F.lit("https://notytimg.com/a.jpg"))
        .otherwise(F.concat(F.lit("https://i.ytimg.com/"), "id"))
    )
    common = [
        F.when(F.col("genre") != "", F.concat(F.lit("v"), F.lpad(_text(F.col("file_key")), 9, "0"))).alias("videoId"),
        "title",
        F.when(F.col("artist") != "Unknown", people).alias("artists"),
        (~F.col("missing")).alias("isAvailable"),
        F.array(F.struct(F.lit("small").alias("url")), F.struct(url.alias("url"))).alias("thumbnails"),
        _text(F.col("duration")).alias("duration"),
        F.col("duration").alias("duration_seconds"),
        (F.col("track_number") > 15).alias("isExplicit"),
    ]
    record = F.struct(F.col("album").alias("name"), F.col("album_id").alias("id"))
    as_object = F.to_json(F.struct(*common, record.alias("album")))
    as_text = F.to_json(F.struct(*common, F.col("album")))
    return f.select(
        "artist_id", "album_id", "genre", F.col("file_key").alias("pos"),
        F.when(F.col("has_cover_art"), as_object).otherwise(as_text).alias("payload"),
    )


def release_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a release of its customer; releases of one day share an id."""
    orders = table(spark, sf_dir, "orders")
    single = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    doc = F.struct(
        F.concat(F.lit("r"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("browseId"),
        F.concat(F.lit("Release "), _text(F.col("o_orderkey"))).alias("title"),
        _text(F.year("o_orderdate")).alias("year"),
        F.when(single, F.lit("Single")).alias("type"),
    )
    return orders.select(
        F.concat(F.lit("c"), _text(F.col("o_custkey"))).alias("artist_id"),
        F.when(single, F.lit("singles")).otherwise(F.lit("albums")).alias("section"),
        F.col("o_orderkey").alias("pos"),
        F.to_json(doc).alias("payload"),
    )


def chart_artist_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as an artist in the chart of its nation."""
    c = table(spark, sf_dir, "customer")
    doc = F.struct(
        F.concat(F.lit("c"), _text(F.col("c_custkey"))).alias("browseId"), F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("subscribers"), _text(F.col("c_custkey")).alias("rank"),
    )
    return c.select(_country(F.col("c_nationkey")).alias("country"), F.col("c_custkey").alias("pos"), F.to_json(doc).alias("payload"))


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as a playlist of its nation, of a kind that depends on its balance."""
    s = table(spark, sf_dir, "supplier")
    kind = (
        F.when(F.col("s_acctbal") > 8000, F.lit("DAILY TOP MUSIC videos "))
        .when(F.col("s_acctbal") > 5000, F.lit("Top 100 Music videos "))
        .when(F.col("s_acctbal") > 2000, F.lit("Trending "))
        .otherwise(F.lit("Mix "))
    )
    return s.select(
        _country(F.col("s_nationkey")).alias("country"), F.col("s_suppkey").alias("pos"),
        F.concat(F.lit("ar-"), _text(F.col("s_suppkey"))).alias("playlist_id"), F.concat(kind, "s_name").alias("title"),
    )


def playlist_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return song_entries(spark, sf_dir).select(F.col("artist_id").alias("playlist_id"), "pos", "payload")


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search per genre: its songs, and the artists and albums they belong to."""
    f = media_file(spark, sf_dir).filter("genre <> ''")
    songs = song_entries(spark, sf_dir).filter("genre <> ''")
    songs = songs.select(F.col("genre").alias("query"), F.lit("songs").alias("kind"), "pos", "payload")
    people = f.select("genre", "artist_id", "album_artist").distinct()
    doc = F.to_json(F.struct(F.col("artist_id").alias("browseId"), F.col("album_artist").alias("artist")))
    number = F.substring("artist_id", 4, 20).cast("bigint")
    people = people.select(F.col("genre").alias("query"), F.lit("artists").alias("kind"), number.alias("pos"), doc.alias("payload"))
    albums = f.select("genre", "album_id").distinct()
    doc = F.to_json(F.struct(F.col("album_id").alias("browseId"), F.concat(F.lit("Album "), "album_id").alias("title")))
    number = _brand_number(F.col("album_id")).cast("bigint")
    albums = albums.select(F.col("genre").alias("query"), F.lit("albums").alias("kind"), number.alias("pos"), doc.alias("payload"))
    return songs.unionByName(people).unionByName(albums)


def artist_page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    doc = F.struct(F.col("s_name").alias("name"), _text(F.col("s_nationkey")).alias("subscribers"))
    return s.select(F.concat(F.lit("ar-"), _text(F.col("s_suppkey"))).alias("page_id"), F.to_json(doc).alias("payload"))


def artist_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_page_heads(artist_page_documents(spark, sf_dir), "artist")


def artist_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs, records and related artists of every artist page, and a fuller song playlist of some."""
    f = media_file(spark, sf_dir)
    songs = song_entries(spark, sf_dir).select(F.col("artist_id").alias("page_id"), F.lit("songs").alias("section"), "pos", "payload")
    number = _brand_number(F.col("album_id"))
    records = f.select("artist_id", "album_id").distinct()
    doc = F.to_json(F.struct(F.col("album_id").alias("browseId"), F.concat(F.lit("Album "), "album_id").alias("title")))
    records = records.select(
        F.col("artist_id").alias("page_id"), F.when(number > 20, F.lit("singles")).otherwise(F.lit("albums")).alias("section"),
        number.cast("bigint").alias("pos"), doc.alias("payload"),
    )
    n = F.lit(row_count(spark, sf_dir, "supplier"))
    other = f.select("artist_id", ((F.col("file_key") * 7 + 3) % n).alias("s_suppkey")).distinct()
    other = other.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    doc = F.to_json(F.struct(F.concat(F.lit("ar-"), _text(F.col("s_suppkey"))).alias("id"), F.col("s_name").alias("name")))
    other = other.select(
        F.col("artist_id").alias("page_id"), F.lit("related").alias("section"), F.col("s_suppkey").alias("pos"), doc.alias("payload")
    )
    fuller = songs.filter(F.substring("page_id", 4, 20).cast("bigint") % 3 == 0)
    fuller = fuller.withColumn("section", F.lit("playlist")).withColumn("pos", 1_000_000 - F.col("pos"))
    return songs.unionByName(records).unionByName(other).unionByName(fuller)


def album_page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    albums = media_file(spark, sf_dir).groupBy("album_id").agg(F.min("updated_at").alias("year"))
    various = F.struct(F.lit("Various").alias("name"), F.lit("va").alias("browseId"))
    people = F.array(various, F.struct(F.lit("Guest").alias("name"), F.lit("g").alias("browseId")))
    doc = F.struct(
        F.concat(F.lit("Album "), "album_id").alias("title"), people.alias("artists"), F.substring("year", 1, 7).alias("year"),
        F.array(F.struct(F.lit("https://yt3.ggpht.com/cover").alias("url"))).alias("thumbnails"),
    )
    return albums.select(F.col("album_id").alias("page_id"), F.to_json(doc).alias("payload"))


def album_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_page_heads(album_page_documents(spark, sf_dir), "album")


def album_page_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return song_entries(spark, sf_dir).select(F.col("album_id").alias("page_id"), "pos", "payload")


def second_provider_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every library file as a track of the second provider; some wrapped, some bare or blank."""
    f = media_file(spark, sf_dir)
    link = F.when(F.col("track_number") > 5, F.struct(F.concat(F.lit("https://x/"), "id").alias("spotify")))
    images = F.when(
        F.col("track_number") > 10, F.array(F.struct(F.lit("i0").alias("url")), F.struct(F.lit("i1").alias("url")))
    ).otherwise(F.array(F.struct(F.lit("i0").alias("url"))))
    record = F.struct(
        F.col("album").alias("name"), F.when(F.col("has_cover_art"), images).alias("images"), F.col("updated_at").alias("release_date")
    )
    people = F.array(F.struct(F.col("album_artist").alias("name")), F.struct(F.lit("Guest").alias("name")))
    track = F.struct(
        "id", F.when(F.col("genre") != "", F.col("title")).alias("name"),
        F.when(F.col("artist") != "Unknown", people).alias("artists"), F.col("duration").alias("popularity"),
        link.alias("external_urls"), record.alias("album"),
    )
    wrapped = F.to_json(F.struct(track.alias("track")))
    return f.select(F.when(F.col("missing"), wrapped).otherwise(F.to_json(track)).alias("payload"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs and albums as a discovery feed shows them."""
    shown = ["id", "kind", "title", "artist"]
    songs = normalize_songs(song_entries(spark, sf_dir), kept=[]).select(*shown)
    albums = media_file(spark, sf_dir).select("album_id", "album", "artist").distinct()
    albums = albums.select(
        F.concat(F.lit("rec-"), "album_id").alias("id"), F.lit("album").alias("kind"), F.upper("album").alias("title"), "artist"
    )
    return songs.unionByName(albums)


def wanted_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was heard, as recordings to look up; views carry the artist in the title."""
    rows = listens(spark, sf_dir).select("track_name", "artist_name", "event_type").distinct()
    prefixed = F.concat("artist_name", F.lit(" - "), "track_name", F.lit(" [Lyrics] feat. Someone"))
    title = F.when(F.col("event_type") == "view", prefixed).otherwise(F.col("track_name"))
    rows = with_artists(rows.withColumn("title", title), "artist_name")
    return rows.select(
        F.concat_ws("|", "event_type", "track_name", "artist_name").alias("wanted_id"), "title",
        F.col("artists.name").alias("artists"),
    )


def recording_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every library file as a search hit: files with a cover as songs, the rest as videos."""
    f = media_file(spark, sf_dir)
    video = F.concat("album_artist", F.lit(" - "), "title", F.lit(" (Official Video)"))
    return f.select(
        F.when(F.col("has_cover_art"), F.lit("songs")).otherwise(F.lit("videos")).alias("source"),
        F.col("file_key").alias("pos"), "id", F.when(F.col("has_cover_art"), F.col("title")).otherwise(video).alias("title"),
        F.array("album_artist").alias("artists"), F.concat(F.lit("https://i.ytimg.com/"), "id").alias("image"),
    )


def artist_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer and supplier as an artist found by search."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("ar-").alias("kind"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("cu-").alias("kind"))
    id_ = F.concat("kind", _text(F.col("key")))
    pos = F.col("key") + F.when(F.col("kind") == "cu-", F.lit(1_000_000_000)).otherwise(0)
    return s.unionByName(c).select(
        pos.alias("pos"), id_.alias("id"), F.upper("name").alias("title"), F.concat(F.lit("https://i.ytimg.com/"), id_).alias("image")
    )


def artist_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The artists of the library and every customer, as names to look up."""
    customers = table(spark, sf_dir, "customer").select(F.lower("c_name").alias("name"))
    return library(spark, sf_dir).select(F.col("artist").alias("name")).unionByName(customers)


def song_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog songs with the country of their artist, in lower case; some countries have no charts."""
    s = table(spark, sf_dir, "supplier")
    country = F.when(F.col("s_nationkey") % 5 == 0, F.lit("xx")).otherwise(F.lower(_country(F.col("s_nationkey"))))
    of = s.select(F.concat(F.lit("ar-"), _text(F.col("s_suppkey"))).alias("artist_id"), country.alias("country"))
    return song_entries(spark, sf_dir).join(of, "artist_id")
