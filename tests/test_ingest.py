import json
import random
from datetime import datetime

import pytest
from history import LISTEN, NOW, file, library, listen, listens, rows

from earshot.functions.text import clean_listen_title
from earshot.operators.containment import smallest_containing, texts_containing
from earshot.operators.enrich import backfill_listens, backfill_report, enrich_listens, fuzzy_files, resolve_tracks
from earshot.operators.numbering import number_rows
from earshot.operators.paging import down, find_page, in_order, page_by_number, page_rows, up
from earshot.operators.skew import skew_safe_left_join
from earshot.sources.listens import export_listens, import_listens, numbered, read_export
from earshot.sources.payloads import parse_listen_payloads, read_bodies
from pyspark.sql import functions as F


def bodies(spark, *docs):
    data = [(i, "me", NOW, json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(data, "event_id long, user_name string, received_at timestamp_ntz, body string")


def track(name=None, artist=None, release=None, ms=None):
    meta = {"track_name": name, "artist_name": artist, "release_name": release}
    if ms is not None:
        meta["additional_info"] = {"duration_ms": ms}
    return {"track_metadata": {k: v for k, v in meta.items() if v is not None}}


def test_payload_forms(spark):
    docs = [
        {"listen_type": "single", "payload": [track("T", "A", "B", 240000)]},
        {"listen_type": "playing_now", "payload": [track("T")]},
        {"listen_type": "import", "payload": [track("", "A"), track("X", "A", ms=1500)]},
        {"listen_type": "single", "payload": []},
        {"listen_type": "single"},
    ]
    parsed = parse_listen_payloads(bodies(spark, *docs)).orderBy("event_id", "track_name")
    assert rows(parsed.select("event_id", "track_name", "artist_name", "album_name", "duration_ms", "event_type")) == [
        (0, "T", "A", "B", 240000.0, "play"),
        (1, "T", "Unknown", "Unknown", None, "view"),
        (2, "Unknown", "A", "Unknown", None, "play"),
        (2, "X", "A", "Unknown", 1500.0, "play"),
    ]


@pytest.mark.parametrize(
    "title, clean",
    [
        ("Song (Live) [HD] feat. Other", "Song"),
        ("Song (a) more", "Songmore"),
        ("Defeat. the rest", "De"),
        ("Song Feat Other", "Song Feat Other"),
        ("A feat. B\nline feat. C", "A\nline feat. C"),
        ("( unclosed", "( unclosed"),
    ],
)
def test_clean_listen_title(spark, title, clean):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(clean_listen_title(F.col("t"))).first()[0] == clean


def test_tiers_and_durations(spark):
    lib = library(
        spark,
        file("9", "Song", "A", duration=215, genre="rock"),
        file("10", "Song", "A", duration=1),  # smaller as text
        file("3", "Very Long Song Name", "A", duration=0, missing=True),
        file("4", "100% Pure_Gold", "A"),
    )
    docs = [
        track("Song", "A", ms=5), track("Song (Live)", "A"), track("LONG song", "A", ms=2500), track("% pure_", "A"),
        track("Song", "B", ms=240400), track("Other", "A"),
    ]
    parsed = parse_listen_payloads(bodies(spark, {"listen_type": "x", "payload": docs}))
    found = {r.track_name + "/" + r.artist_name: (r.tier, r.track_id, r.duration) for r in enrich_listens(parsed, lib).collect()}
    assert found == {
        "Song/A": ("exact", "10", 1),
        "Song (Live)/A": ("clean", "10", 1),
        "LONG song/A": ("fuzzy", "3", 3),
        "% pure_/A": ("fuzzy", "4", 215),
        "Song/B": ("none", "", 240),
        "Other/A": ("none", "", 0),
    }


def test_enrichment_keeps_duplicates_and_count(spark):
    docs = [track("Song", "A")] * 7 + [track("Zz", None)] * 3
    parsed = parse_listen_payloads(bodies(spark, {"listen_type": "x", "payload": docs}, {"listen_type": "x", "payload": docs}))
    out = enrich_listens(parsed, library(spark, file("1", "Song", "A")))
    assert out.count() == 20 and out.filter("tier = 'exact'").count() == 14


def words(rng, n):
    return "".join(rng.choice("aAbB cé") for _ in range(n))


def test_fuzzy_against_brute_force_with_one_hot_artist(spark):
    rng = random.Random(7)
    artists = ["hot"] * 5 + ["b", "c"]
    files = [(f"{i:04d}", words(rng, rng.randint(1, 60)), rng.choice(artists)) for i in range(400)]
    pairs = {(words(rng, rng.randint(1, 4)), rng.choice(artists)) for _ in range(60)}
    pairs |= {(t[3:] + "tail", a) for _, t, a in files[:40] if len(t) > 53} | {("", "hot")}
    lib = library(spark, *[file(i, t, a) for i, t, a in files])
    wanted = spark.createDataFrame(sorted(pairs), "track_name string, artist_name string")
    expected = {}
    for title, artist in pairs:
        needle = title[:50].lower()
        ids = [i for i, t, a in files if a == artist and needle in t.lower()]
        if ids and needle:
            expected[title, artist] = min(ids)
    found = {(r.track_name, r.artist_name): r.file.track_id for r in fuzzy_files(wanted.filter("track_name <> ''"), lib).collect()}
    assert found == expected and len(found) > 30


def test_containment_helpers(spark):
    needles = spark.createDataFrame([("g", "ab"), ("g", "zz"), ("h", "a")], "g string, needle string")
    texts = spark.createDataFrame([("g", "cab", 2), ("g", "abab", 1), ("h", "b", 3), ("x", "ab", 4)], "g string, text string, id int")
    assert rows(smallest_containing(needles, texts, "g", "id")) == [("g", "ab", 1)]
    assert sorted({r.id for r in texts_containing(needles, texts, "g").collect()}) == [1, 2]


def test_containment_equals_brute_force(spark):
    rng = random.Random(9)
    def word(most):
        return "".join(rng.choice("ab é") for _ in range(rng.randrange(most)))

    texts = [(rng.choice("gh"), word(30), i) for i in range(150)]
    needles = [(rng.choice("ghx"), word(14)) for _ in range(150)] + [("g", ""), ("h", None), ("g", texts[0][1])]
    found = smallest_containing(spark.createDataFrame(needles, "g string, needle string"), spark.createDataFrame(texts, "g string, text string, id int"), "g", "id")
    expected = {}
    for g, needle in set(needles):
        ids = [i for h, text, i in texts if h == g and needle is not None and needle in text]
        if ids:
            expected[g, needle] = min(ids)
    assert {(r.g, r.needle): r.id for r in found.collect()} == expected


def test_needles_are_looked_up_by_their_rarest_gram(spark, monkeypatch):
    """100,000 titles of one artist: few of them are listed, and the longest list that is joined is split."""
    from earshot.operators import containment

    texts = spark.range(100_000).select(F.lit("A").alias("g"), F.concat(F.lit("symphony in d number "), "id").alias("text"), "id")
    needles = spark.createDataFrame([("A", "symphony in d number 4711"), ("A", "number 99998"), ("A", "symphony in d minor")], "g string, needle string")
    found = {r.needle: r.id for r in smallest_containing(needles, texts, "g", "id").collect()}
    assert found == {"symphony in d number 4711": 4711, "number 99998": 99998}
    held = containment.listed(containment._needles(needles, ["g"]), texts, ["g"])
    assert held.count() / 100_000 < 20  # grams of a title that a needle holds; it has 25 or more
    joined = containment._matches(needles, texts, ["g"])
    assert joined.count() <= 111 + 1
    monkeypatch.setattr(containment, "LIST", 1000)
    wide = spark.createDataFrame([("A", "symphony")], "g string, needle string")
    assert smallest_containing(wide, texts, "g", "id").first().id == 0


@pytest.mark.parametrize("min_rows", [1, 50, 10**6])
def test_skew_safe_join_equals_plain_join(spark, min_rows):
    rng = random.Random(3)
    keys = ["hot"] * 300 + [None] * 200 + [f"k{rng.randint(0, 40)}" for _ in range(300)]
    facts = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("none", 4), (None, 5)], "key string, v int")
    got = skew_safe_left_join(facts, dim, ["key"], shares=20, min_rows=min_rows)
    assert sorted(rows(got.select("id", "v")), key=repr) == sorted(rows(facts.join(dim, "key", "left").select("id", "v")), key=repr)


def test_hot_key_is_spread(spark):
    facts = spark.range(0, 30_000, 1, 8).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"))
    dim = spark.range(0, 30_000, 3).select(F.col("id").alias("key"), F.lit(1).alias("v"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        def largest(joined):
            return joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

        assert largest(facts.join(dim, "key", "left")) > 10_000
        assert largest(skew_safe_left_join(facts, dim, ["key"], shares=100, min_rows=100)) < 4_500
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_bodies_are_read_from_files(spark, tmp_path):
    bodies(spark, {"listen_type": "single", "payload": [track("T", "A")]}).drop("event_id").write.json(str(tmp_path / "b"))
    [row] = parse_listen_payloads(read_bodies(spark, str(tmp_path / "b"))).collect()
    assert (row.user_name, row.received_at, row.track_name) == ("me", NOW, "T")
    assert read_bodies(spark, str(tmp_path / "b"), stream=True).isStreaming


def test_pages_at_any_depth(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("id"), F.lit("x").alias("x"))
    for page, limit in ((1, 10), (4, 333), (21, 50)):
        expected = [(i, "x") for i in range(999, -1, -1)][(page - 1) * limit : page * limit]
        assert rows(page_by_number(df, "id", page, limit, width=64)) == expected
        for bounds in (1, 20):
            assert rows(page_rows(df, [up("x"), down("id")], page, limit, bounds)) == expected
    names = spark.createDataFrame([(None if i % 9 == 0 else f"n{i % 13}", i) for i in range(200)], "name string, id int")
    for by, order in (([down("name"), up("id")], [F.desc("name"), F.asc("id")]), ([up("name"), down("id")], [F.asc("name"), F.desc("id")])):
        assert rows(page_rows(names, by, 3, 31, bounds=6)) == rows(names.orderBy(*order).offset(62).limit(31))


def test_a_page_reads_its_input_once_and_only_its_own_range(spark, tmp_path):
    rng = random.Random(4)
    data = [(rng.choice([None, f"n{rng.randrange(40)}"]), i) for i in range(5000)]
    df = spark.createDataFrame(data, "name string, id int")
    ordered = in_order(df, [down("name"), up("id")], 16)
    expected = sorted(data, key=lambda r: (r[0] is not None, r[0] or ""), reverse=True)  # stable, so ids still ascend
    assert ordered.total == 5000 and len(ordered.sizes) > 8
    assert rows(ordered.numbered("n").orderBy("n")) == [(*r, i + 1) for i, r in enumerate(expected)]
    middle = ordered.between(2500, 40)
    assert rows(middle) == expected[2500:2540]
    scan = middle._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1]
    assert "_range" in scan.split("]")[0]
    page = ordered.page(63, 40)
    assert rows(page) == expected[62 * 40 : 63 * 40] and "FileScan" not in page._jdf.queryExecution().executedPlan().toString()
    assert rows(page_rows(df.limit(0), [up("id")], 1, 10)) == [] and rows(page_rows(df, [up("id")], 501, 10)) == []


def test_a_page_by_number_is_read_between_two_numbers(spark, tmp_path):
    ids = random.Random(5).sample(range(10**12), 3000)
    spark.createDataFrame([(i,) for i in ids], "id long").repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for offset in (0, 1490, 2990, 3000, 5000):
        found = find_page(df, "id", offset, 20, most=50, ways=16)
        assert rows(found.rows(20)) == [(i,) for i in sorted(ids, reverse=True)[offset : offset + 20]] and found.total == 3000
        if offset < 3000:
            assert df.filter(F.col("id").between(found.low, found.high)).count() <= 50
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual" in found.rows(20)._jdf.queryExecution().executedPlan().toString()
    assert find_page(df.limit(0), "id", 0, 10).total == 0


def test_numbering_is_dense_in_order(spark):
    df = spark.range(0, 1000, 1, 5).select((F.col("id") * F.col("id")).alias("p"))
    got = rows(number_rows(df, "p", width=1000).orderBy("p").select("n"))
    assert got == [(i,) for i in range(1, 1001)]


def test_import(spark):
    base = listens(spark, listen(1, track="old"), listen(2, track="kept"))
    batch = [(*listen(1, track="first"), 0), (*listen(1, track="last"), 1), (*listen(None, track="n1"), 2), (*listen(7, track="new"), 3), (*listen(None, track="n2"), 4)]
    out = import_listens(base, spark.createDataFrame(batch, LISTEN + ", pos long"))
    assert sorted((r.id, r.track_name, r.genre) for r in out.collect()) == [
        (1, "last", ""), (2, "kept", None), (7, "new", ""), (8, "n1", ""), (9, "n2", ""),
    ]


def test_export_round_trip(spark, tmp_path):
    base = listens(spark, listen(1, datetime(1999, 12, 31, 23, 59, 58), genre="é"), listen(2, track=None))
    export_listens(base, str(tmp_path / "x"))
    back = read_export(spark, str(tmp_path / "x"))
    assert sorted(rows(back.select(*base.columns))) == sorted(rows(base))
    assert sorted(r.timestamp for r in back.collect())[0] == 946684798


def test_backfill(spark):
    lib = library(spark, file("1", "T", "A", album_id="b", duration=None))
    h = listens(
        spark, listen(1, album_id="kept"), listen(2, album_id=""), listen(3, duration=5), listen(4, track="other", duration=7)
    )
    out = {r.id: (r.album_id, r.track_id, r.duration, r.backfilled) for r in backfill_listens(h, lib).collect()}
    assert out == {1: ("kept", None, 100, False), 2: ("b", "1", 0, True), 3: ("b", "1", 0, True), 4: (None, None, 7, False)}
    assert rows(backfill_report(h, lib)) == [(2, 1, 3)]


def test_resolve_tracks(spark):
    h = listens(spark, listen(1, track_id="x", album_id="m"), listen(5, track_id="y"), listen(6, track_id=""))
    lib = library(spark, file("f", "T", "A"), file("g", "U", "A", genre="pop"))
    wanted = spark.createDataFrame([("T", "A"), ("U", "A"), ("V", "A"), ("T", "A")], "track string, artist string")
    out = {r.track: (r.track_id, r.genre) for r in resolve_tracks(wanted, h, lib).collect()}
    assert out == {"T": ("y", ""), "U": ("g", "pop"), "V": ("", "")}


def test_listens_are_parsed_once(spark):
    parsed = parse_listen_payloads(bodies(spark, {"listen_type": "x", "payload": [track("Song (Live)", "A"), track("Song", "A")]}))
    out = enrich_listens(parsed, library(spark, file("1", "Song", "A")))
    # What is read again, by a sort as well, are rows that were written.
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.track_name, r.tier, r.track_id) for r in out.collect()) == [("Song", "exact", "1"), ("Song (Live)", "clean", "1")]


def test_ids_need_no_second_sort(spark):
    enriched = spark.range(1000).select(
        F.timestamp_seconds(F.col("id") * 7919 % 1000).cast("timestamp_ntz").alias("received_at"), F.lit("u").alias("user_name"),
        *[F.lit("x").alias(c) for c in ("track_name", "artist_name", "album_name", "track_id", "album_id", "artist_id", "genre", "event_type")], F.lit(1).alias("duration"),
    )
    out = numbered(enriched.repartition(7), 50)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and plan.count("Window") == 1  # over a row for each task of the sort
    assert [(r.id, r.s) for r in out.select("id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")).orderBy("id").collect()] == [(51 + i, i) for i in range(1000)]


def test_an_import_reads_its_batch_once(spark):
    made = spark.range(40).select(F.when(F.col("id") % 4 != 0, F.col("id") % 15).alias("id"), F.col("id").alias("pos"))
    lacking = [F.lit("x").alias(c) for c in ("user_name", "track_name", "artist_name", "album_name", "track_id", "album_id", "artist_id", "genre", "event_type")]
    batch = made.select("id", *lacking, F.col("pos").cast("int").alias("duration"), F.lit(NOW).cast("timestamp_ntz").alias("ts"), "pos")
    out = import_listens(listens(spark, listen(3), listen(100)), batch)
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    last = {r.id: r.pos for r in made.filter("id is not null").orderBy("pos").collect()}
    got = {r.id: r.duration for r in out.collect()}
    assert got == {**last, 100: 100, **{101 + i: 4 * i for i in range(10)}}
