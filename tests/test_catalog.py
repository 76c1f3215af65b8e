import json

import pytest
from history import CLOCK, file, library, listen, listens, rows
from pyspark.sql import functions as F

from earshot.functions import constants as k
from earshot.functions.text import allowed_image, clean_recording_title, cover_key
from earshot.operators import artwork, charts, matching, recommend, storage
from earshot.operators.storage import Selection
from earshot.sources import catalog


def entries(spark, *docs, **more):
    data = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(data, "pos long, payload string")
    return df.withColumns({name: F.lit(value) for name, value in more.items()})


def test_song_forms(spark):
    docs = [
        {"videoId": "a", "title": "Text album", "album": "Own", "artists": [{"name": "P", "id": "p"}, {"name": "Q", "browseId": "q"}, {"name": ""}]},
        {"videoId": "b", "title": "Object album", "album": {"name": "Rec", "id": "r"}, "thumbnails": [{"url": "s"}, {"url": "l"}]},
        {"videoId": "c", "isAvailable": True, "isExplicit": True, "duration_seconds": 61, "views": "5M"},
        {"title": "no id"},
        {"videoId": "d", "isAvailable": False},
    ]
    df = entries(spark, *docs, name="Page", page="pg", art="cover")
    df = df.withColumn("people", F.array(F.struct(F.lit("Host").alias("name"), F.lit("h").alias("id"))))
    out = catalog.normalize_songs(df, kept=["pos"], fallback="people", artwork="art", page_album=("name", "page"))
    got = [(r.id, r.title, r.artist, r.album, r.album_id, r.image) for r in out.orderBy("pos").collect()]
    assert got == [
        ("a", "Text album", "P, Q", "Page", "pg", "cover"),
        ("b", "Object album", "Host", "Rec", "r", "l"),
        ("c", "Untitled", "Host", "Page", "pg", "cover"),
    ]
    [a, b, c] = catalog.normalize_songs(entries(spark, *docs), kept=["pos"]).orderBy("pos").collect()
    assert (a.album, a.album_id, b.album, c.album, c.artist) == ("Own", "", "Rec", "", "")
    assert (c.explicit, c.duration_seconds, c.views, a.url) == (True, 61, "5M", k.WATCH_URL + "a")
    assert [(p.name, p.id) for p in a.artists] == [("P", "p"), ("Q", "q")]


def test_second_provider(spark):
    album = {"name": "Rec", "images": [{"url": "big"}], "external_urls": {"spotify": "al"}, "release_date": "2020"}
    docs = [
        {"id": "1", "name": "N", "artists": [{"name": "A"}, {"name": "B"}], "album": album},
        {"item": {"id": "2", "album": {**album, "images": [{"url": "big"}, {"url": "mid"}]}, "external_urls": {"spotify": "me"}, "popularity": 7}},
        {"track": {"id": "3"}},
    ]
    out = catalog.normalize_second_provider(entries(spark, *docs)).orderBy("pos").collect()
    assert [(r.id, r.title, r.artist, r.image, r.url, r.popularity) for r in out] == [
        ("1", "N", "A, B", "big", "al", 0),
        ("2", "Rec", k.SECOND_PROVIDER, "mid", "me", 7),
        ("3", "Untitled", k.SECOND_PROVIDER, "", k.SECOND_PROVIDER_URL, 0),
    ]


def test_page_entries(spark):
    doc = {"songs": {"results": [{"videoId": "a"}, {"videoId": "b"}]}, "albums": {"results": [{"browseId": "x"}]}}
    pages = spark.createDataFrame([("p", json.dumps(doc))], "page_id string, payload string")
    out = catalog.page_entries(pages, ["songs", "albums", "singles"])
    assert [(r.section, r.pos, json.loads(r.payload)) for r in out.orderBy("section", "pos").collect()] == [
        ("albums", 0, {"browseId": "x"}), ("songs", 0, {"videoId": "a"}), ("songs", 1, {"videoId": "b"}),
    ]


def test_image_hosts(spark):
    urls = {
        "https://lh3.googleusercontent.com/x": True, "https://ytimg.com/x": True, "HTTPS://I.YTIMG.COM/x": True,
        "http://i.ytimg.com/x": False, "https://notytimg.com/x": False, "https://ytimg.com.evil.org/x": False, "nonsense": False,
        "": False,
    }
    df = spark.createDataFrame([(u,) for u in urls] + [(None,)], "u string").withColumn("ok", allowed_image(F.col("u")))
    assert {r.u: r.ok for r in df.collect()} == {**urls, None: False}


def test_countries(spark):
    out = catalog.supported_countries(spark).collect()
    assert out[0].code == "ZZ" and out[0].name == "Worldwide" and len(out) == len(k.COUNTRIES)
    assert {r.code: r.name for r in out}["JP"] == "Japan"
    assert [r.name for r in out[1:]] == sorted(r.name for r in out[1:])


@pytest.mark.parametrize(
    "title, clean",
    [
        ("Song (Official Video)", "Song "), ("Song [Lyrics]", "Song "), ("Song (Live)", "Song (Live)"), ("Song (feat. B)", "Song"),
        ("Song ft. B", "Song"), ("Soft. Rock", "Soft. Rock"), ("Song (Audio Only) x", "Song  x"),
    ],
)
def test_recording_titles(spark, title, clean):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(clean_recording_title(F.col("t"))).first()[0] == clean


def test_words_of_other_scripts_before_the_tail(spark):
    df = spark.createDataFrame([("\u00e9feat. B",)], "t string")
    both = df.select(clean_recording_title(F.col("t")), clean_recording_title(F.col("t"), catalog=True)).first()
    assert tuple(both) == ("\u00e9", "\u00e9feat. B")


def recordings(spark, wanted, candidates):
    w = spark.createDataFrame(wanted, "wanted_id string, title string, artists array<string>")
    c = spark.createDataFrame(candidates, "source string, pos long, id string, title string, artists array<string>")
    return {r.wanted_id: r.id for r in matching.match_catalog(w, c).collect()}


def test_recording_match(spark):
    candidates = [
        ("videos", 0, "v", "Anna - Song (Official Video) [4K Remaster]", ["Uploader", "ANNA"]),
        ("songs", 1, "s", "Song feat. Other", ["Anna"]),
        ("songs", 0, "live", "Song (Live)", ["Anna"]),
        ("songs", 0, "x", "Song", ["Somebody"]),
        ("videos", 0, "only", "Anna - Clip", ["anna"]),
        ("songs", 2, "odd", "Anna - Tune", ["Ben"]),
        ("songs", 3, "straße", "STRASSE", ["Anna"]),
        ("songs", 4, "under", "a_b", ["Anna"]),
    ]
    wanted = [
        ("1", "Song", ["Anna"]), ("2", "Anna - Song", ["Anna", "Ben"]), ("3", "Song", ["Nobody"]), ("4", "clip", ["Anna"]),
        ("5", "Tune", ["Anna"]), ("6", "AnnaTune", ["Ben"]), ("7", "Straße", ["Anna"]), ("8", "ab", ["Anna"]), ("9", "Song", []),
    ]
    assert recordings(spark, wanted, candidates) == {"1": "s", "2": "s", "4": "only", "6": "odd", "7": "straße"}


def test_recording_match_against_brute_force(spark):
    import random
    import re

    rng = random.Random(11)
    people = ["Anna", "Ben", "Cid"]
    titles = ["Hit", "Hit (Audio)", "Anna - Hit", "Ben - Hit", "Other", "AnnaHit"]
    norm = lambda t: re.sub(r"[^\w]", "", t.casefold())
    cleaned = lambda t: norm(re.sub(r"\(audio\)", "", t, flags=re.I))

    def reading(title, artists):
        head, _, tail = title.partition(" - ")
        return cleaned(tail if tail and norm(head) in {norm(a) for a in artists} else title)

    candidates = [(rng.choice(["songs", "videos"]), i, f"c{i}", rng.choice(titles), rng.sample(people, rng.randint(1, 2))) for i in range(60)]
    wanted = [(f"w{i}", rng.choice(titles), rng.sample(people, rng.randint(1, 3))) for i in range(60)]
    expected = {}
    for wid, title, artists in wanted:
        hits = [
            (c[0] != "songs", c[1], c[2]) for c in candidates
            if reading(c[3], artists) == reading(title, artists) and set(artists) & set(c[4])
        ]
        if hits:
            expected[wid] = min(hits)[2]
    assert recordings(spark, wanted, candidates) == expected


def test_mark_owned(spark):
    lib = library(
        spark, file("1", "My Song!", "Anna", album="Rec", album_id="r1"), file("2", "my song", "ANNA", album="Rec", album_id="r2"),
        file("3", "Gone", "Anna", missing=True),
    )
    cat = spark.createDataFrame(
        [("s", "song", "My-Song", "anna"), ("a", "album", "REC", "Anna"), ("g", "song", "Gone", "Anna")],
        "id string, kind string, title string, artist string",
    )
    out = {r.id: (r.local_id, r.local_album_id) for r in matching.mark_owned(cat, lib).collect()}
    assert out == {"s": ("2", "r2"), "a": ("2", "r2"), "g": (None, None)}


def test_storage(spark):
    lib = library(
        spark, file("1", artist="Anna, Ben", size=100), file("2", artist="Anna", size=300, album_id="c"),
        file("3", artist="Annabel", size=50, missing=True), file("4", artist="Deleted", size=7),
    )
    deleted = spark.createDataFrame([("4",)], "id string")
    by = {r.name: (r.tracks, r.bytes) for r in storage.storage_artists(lib, deleted=deleted).collect()}
    assert by == {"Anna": (2, 400), "Ben": (1, 100)}
    assert rows(storage.storage_summary(lib, deleted)) == [(2, 400, 2, 2)]
    assert rows(storage.storage_selection(lib, selection=Selection(artist="ann"))) == [(0, 0)]
    assert rows(storage.storage_selection(lib, selection=Selection(artist="BEN"))) == [(1, 100)]
    assert [r.name for r in storage.storage_artists(lib, Selection(artist="Ben")).collect()] == ["Ben"]
    assert [r.id for r in storage.credited_to(lib, "BEN").collect()] == ["1"]
    top = storage.largest_artists(lib).collect()
    assert [(r.name, r.share) for r in top] == [("Anna", 98.3), ("Ben", 24.6), ("Deleted", 1.7)]
    page = storage.with_split_artists(storage.storage_page(lib, sort="name", limit=1, page=2))
    assert [(r.id, r.total, [a.name for a in r.artists]) for r in page.collect()] == [("2", 3, ["Anna"])]


def test_covers(spark):
    import base64

    lib = library(
        spark, file("f1", "Hit", "Anna, Ben", album_id="al", has_cover_art=False), file("f2", "Solo", "Ben", album_id="", missing=False),
    )
    h = listens(
        spark,
        listen(1, track="Anna - Hit (Official Video)", artist="Uploader", track_id="t1"),
        listen(2, track="Anna - Unknown one", artist="Uploader", track_id="t2", artist_id="ar"),
        listen(3, track="X", artist="Cid, Dee", artist_id="ar3"),
    )
    said = "cover-" + base64.urlsafe_b64encode(json.dumps({"kind": "album", "name": "N", "artist": "Ä"}).encode()).decode().rstrip("=")
    bad = "cover-" + base64.urlsafe_b64encode(b'{"kind":"song","name":"only"}').decode().rstrip("=")
    coded = "artist-" + base64.urlsafe_b64encode("zoë".encode()).decode().rstrip("=")
    ids = ["f1", "al", "f2", "t1", "t2", "ar", "ar3", said, bad, "cover-!", coded, "nothing", "listed"]
    people = spark.createDataFrame([("listed", "Eve ft. Abe")], "id string, name string")
    out = artwork.describe_covers(spark.createDataFrame([(i,) for i in ids], "cover_id string"), lib, h, people).collect()
    assert {r.cover_id: (r.kind, r.name, r.artist, r.key, r.native_id, r.has_art) for r in out} == {
        "f1": ("song", "Hit", "Anna, Ben", "cover:f1", "al", False),
        "al": ("song", "Hit", "Anna, Ben", "cover:al", "al", False),
        "f2": ("song", "Solo", "Ben", "cover:f2", "f2", True),
        "t1": ("song", "Hit", "Anna, Ben", "cover:t1", "al", True),
        "t2": ("song", "Anna - Unknown one", "Uploader", "cover:t2", "t2", True),
        "ar": ("artist", "Uploader", None, "artist:uploader", None, None),
        "ar3": ("artist", "Cid", None, "artist:cid", None, None),
        said: ("album", "N", "Ä", "cover:" + said, None, False),
        coded: ("artist", "zoë", None, "artist:zoë", None, None),
        "listed": ("artist", "Eve", None, "artist:eve", None, None),
    }


def test_texts_of_covers_are_worked_out_once(spark):
    lib, h = library(spark, file("f1", "Hit", "Anna")), listens(spark, listen(1, track="Anna - Hit", track_id="t1"))

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    # What is not known is left out by a filter on what was written, not by one that chooses anew.
    covers = artwork.describe_covers(spark.createDataFrame([("f1",)], "cover_id string"), lib, h)
    assert "from_json" not in plan(covers) and "regexp_replace" not in plan(covers)
    # Once with and once without a guest's tail; a row goes through one of them.
    assert plan(matching.with_legacy_keys(h)).count("visualizer") == 2
    assert plan(matching.legacy_files(lib)).count("visualizer") == 2


def test_cover_key_text(spark):
    import base64

    df = spark.createDataFrame([("", 'A "b"', None, "", None), ("t", "a", "x", "id", "")], "t string, al string, ar string, ti string, ai string")
    got = [r[0] for r in df.select(cover_key(*[F.col(c) for c in ("t", "al", "ar", "ti", "ai")])).collect()]
    text = json.dumps({"kind": "album", "name": 'A "b"', "artist": None}, separators=(",", ":"))
    assert got == ["cover-" + base64.urlsafe_b64encode(text.encode()).decode().rstrip("="), "id"]


def test_chart_choice(spark):
    lists = spark.createDataFrame(
        [("AA", 0, "t", "Trending 20"), ("AA", 1, "d1", "Daily TOP Music videos"), ("AA", 2, "d2", "daily top music"), ("BB", 0, "m", "Mix")],
        "country string, pos long, playlist_id string, title string",
    )
    assert rows(charts.pick_chart(lists)) == [("AA", "d1", "Daily TOP Music videos", k.CHART_URL + "d1")]


def test_page_heads(spark):
    docs = [{"name": "Anna", "subscribers": "5"}, {"title": "Rec", "artists": [{"name": "A"}, {"name": "B", "id": "b"}], "year": "1999"}, {}]
    df = entries(spark, *docs)
    people = catalog.normalize_page_heads(df, "artist").orderBy("pos").collect()
    assert [(r.title, r.subscribers) for r in people] == [("Anna", "5"), ("Artist", ""), ("Artist", "")]
    albums = catalog.normalize_page_heads(df, "album").orderBy("pos").collect()
    assert [(r.title, r.artist, r.year) for r in albums] == [("Album", "", ""), ("Rec", "A, B", "1999"), ("Album", "", "")]


def test_recommendations(spark):
    lib = library(
        spark, file("1", "Heard", "Anna", genre="rock"), file("2", "New", "Anna", genre="indie rock"), file("3", "Other", "Ben; Anna", genre="Rock"),
        file("4", "X", "Cid", genre="ROCK and roll"), file("5", "Y", "Dee", genre="pop"),
    )
    h = listens(spark, listen(1, track="Heard", artist="Anna", genre="rock"), listen(2, artist="Dee", genre="pop", track="Z"))
    assert [r.track_id for r in recommend.discover_unheard(h, lib).collect()] == ["5", "2"]
    assert sorted(r.id for r in recommend.unheard(lib, h).collect()) == ["2", "3", "4", "5"]
    assert [(r.artist_name, r.genre) for r in recommend.similar_artists(lib, "Anna").collect()] == [("Ben", "Rock"), ("Cid", "ROCK and roll")]
    assert [r.artist_name for r in recommend.for_you(h).collect()] == ["Anna", "Dee"]
    assert [(r.hour, r.play_count) for r in recommend.at_this_hour(h, CLOCK).collect()] == [(12, 1), (12, 1)]


def test_pages_beyond_the_bound_of_a_request(spark):
    shape = library(spark, file("0"))
    lib = spark.range(10_003).select(F.format_string("f%06d", "id").alias("id"), *[F.lit(1).cast("bigint").alias(c) if c == "size" else F.lit(v).alias(c) for c, v in zip(shape.columns[1:], shape.first()[1:], strict=True)])

    def page(nth, **bound):
        return [(r.id, r.total) for r in storage.storage_page(lib, sort="artist", page=nth, limit=1, **bound).collect()]

    assert page(10_002) == [("f009999", 10_003)]
    assert page(10_002, last_page=None) == [("f010001", 10_003)] and page(10_004, last_page=None) == []
