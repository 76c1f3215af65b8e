"""Small hand-made histories and libraries."""

from datetime import datetime

from earshot.params import Clock

NOW = datetime(2024, 3, 13, 12, 0, 0)  # a Wednesday
CLOCK = Clock(NOW, 0.0)

LISTEN = """id long, user_name string, track_name string, artist_name string, album_name string, track_id string, album_id string,
artist_id string, duration int, genre string, event_type string, ts timestamp_ntz"""
FILE = """id string, title string, artist string, participants string, album string, album_id string, artist_id string,
album_artist string, duration int, track_number int, size long, missing boolean, genre string, updated_at string,
has_cover_art boolean"""


def listen(id, ts=NOW, track="T", artist="A", album="B", duration=100, kind="play", genre=None, **ids):
    return (
        id, "u", track, artist, album, ids.get("track_id"), ids.get("album_id"), ids.get("artist_id"), duration, genre, kind, ts,
    )


def listens(spark, *rows):
    return spark.createDataFrame(list(rows), LISTEN)


def file(id, title="T", artist="A", participants=None, album="B", album_id="b", size=1, missing=False, **more):
    return (
        id, title, artist, participants, album, album_id, more.get("artist_id", "x"), more.get("album_artist", artist),
        more.get("duration", 215), more.get("track_number", 1), size, missing, more.get("genre", ""),
        more.get("updated_at", "2024-01-01"), more.get("has_cover_art", True),
    )


def library(spark, *rows):
    return spark.createDataFrame(list(rows), FILE)


def rows(df):
    return [tuple(r) for r in df.collect()]
