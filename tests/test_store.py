"""The store under streams, batches, imports and restarts; spread of equal rows; plans that matter."""

import json
import random
from datetime import timedelta

import pytest
from history import CLOCK, NOW, file, library, listen, listens, rows
from pyspark.sql import functions as F

from earshot.operators.credits import artist_listens
from earshot.operators.enrich import enrich_listens, fuzzy_files
from earshot.operators.recommend import similar_artists
from earshot.operators.skew import skew_safe_left_join
from earshot.session import shared_root
from earshot.sources import listens as store
from earshot.sources.payloads import parse_listen_payloads, read_bodies
from earshot.streaming import listens as streaming


def some(spark, a, b, **kw):
    return listens(spark, *[listen(i, NOW - timedelta(hours=7 * i), track=f"t{i % 5}", **kw) for i in range(a, b)])


def ids(df):
    return sorted(r.id for r in df.collect())


def test_streams_and_batches_share_the_store(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "rows")
    some(spark, 0, 20).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(some(spark, 0, 1).schema).parquet
    streaming.stream_append(stream(source), path, str(tmp_path / "s1"), True).awaitTermination()
    store.append_listens(some(spark, 20, 50), path)
    assert ids(store.read_listens(spark, path)) == list(range(50))
    store.append_listens(some(spark, 50, 60), path, "again")
    store.append_listens(some(spark, 50, 60), path, "again")  # a repeated commit replaces itself
    assert ids(store.read_listens(spark, path)) == list(range(60))
    assert store.top_id(spark, path) == 59 and store.top_id(spark, str(tmp_path / "none")) == 0


def test_import_rewrites_touched_days_only(spark, tmp_path):
    path = str(tmp_path / "rows")
    store.append_listens(some(spark, 0, 30), path)
    before = {r[0] for r in store.read_listens(spark, path).select(F.input_file_name()).distinct().collect()}
    batch = some(spark, 3, 5, kind="view").unionByName(listens(spark, listen(None, NOW, track="new"), listen(None, NOW, track="newer")))
    store.import_into(batch, path, "one")
    store.import_into(batch, path, "one")
    got = {r.id: r for r in store.read_listens(spark, path).collect()}
    assert sorted(got) == list(range(32)) and got[3].event_type == got[4].event_type == "view" and got[2].event_type == "play"
    assert {got[30].track_name, got[31].track_name} == {"new", "newer"}
    after = {r[0] for r in store.read_listens(spark, path).select(F.input_file_name()).distinct().collect()}
    assert len(before & after) >= len(before) - 2
    # A day all of whose rows are replaced leaves nothing behind.
    store.import_into(some(spark, 0, 30), path)
    assert ids(store.read_listens(spark, path)) == list(range(32))


class Stopped(Exception):
    pass


def stopping(monkeypatch, function, after):
    """Let ``store.<function>`` fail once it was called ``after`` times."""
    real, calls = getattr(store, function), []

    def counted(*args):
        calls.append(args)
        if len(calls) > after:
            raise Stopped
        return real(*args)

    monkeypatch.setattr(store, function, counted)


@pytest.mark.parametrize(("function", "after"), [("_delete", 1), ("_delete", 2), ("_delete", 4), ("_delete", 6), ("_move", 0), ("_move", 1), ("_move", 3)])
def test_a_stopped_import_counts_once_it_is_ready(spark, tmp_path, monkeypatch, function, after):
    path = str(tmp_path / "rows")
    store.append_listens(some(spark, 0, 12), path)
    batch = some(spark, 3, 7, kind="view").unionByName(listens(spark, listen(None, NOW, track="new")))
    with monkeypatch.context() as patch:
        stopping(patch, function, after)
        with pytest.raises(Stopped):
            store.import_into(batch, path)

    def check():
        got = {r.id: r for r in store.read_listens(spark, path).collect()}
        assert len(got) == store.read_listens(spark, path).count() == 13
        assert {i for i, r in got.items() if r.event_type == "view"} == {3, 4, 5, 6} and got[12].track_name == "new"
        days = store.read_days(spark, path).agg(F.sum("n"), F.sum("views"), F.max("top")).first()
        assert tuple(days) == (13, 4, 12)

    check()  # a reader looks through the change
    store.append_listens(some(spark, 20, 20), path)  # the next writer completes it
    check()
    assert not (tmp_path / "rows" / "_pending").exists() or not any((tmp_path / "rows" / "_pending").iterdir())
    store.import_into(batch, path)  # repeating it changes nothing, rows without an id included
    check()


def test_an_import_that_stops_before_it_is_ready_does_not_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    store.append_listens(some(spark, 0, 5), path)
    with monkeypatch.context() as patch:
        stopping(patch, "day_partials", 0)
        with pytest.raises(Stopped):
            store.import_into(some(spark, 3, 9), path)
    assert ids(store.read_listens(spark, path)) == list(range(5))
    store.import_into(some(spark, 3, 9), path)
    assert ids(store.read_listens(spark, path)) == list(range(9))


def test_compaction(spark, tmp_path):
    path = str(tmp_path / "rows")
    for i in range(12):  # three days and a bit, four commits a day
        store.append_listens(some(spark, i, i + 1), path, f"c{i}")
    store.append_listens(some(spark, 12, 14), path, "c12")
    before = sorted(rows(store.read_listens(spark, path)), key=repr)
    sums = sorted(rows(store.read_days(spark, path).drop("commit")), key=repr)

    def places():
        return {(r.commit, r.listen_date) for r in store.read_days(spark, path).select("commit", "listen_date").distinct().collect()}

    days = {day for _, day in places()}
    store.compact(spark, path, max(days))  # all but the last day are closed
    assert sorted(rows(store.read_listens(spark, path)), key=repr) == before
    assert sorted(rows(store.read_days(spark, path).drop("commit")), key=repr) == sums
    closed = [day for _, day in places() if day < max(days)]
    assert len(closed) == len(set(closed)) == len(days) - 1
    store.append_listens(some(spark, 11, 12), path, "c11")  # a commit that was taken over is repeated
    assert sorted(rows(store.read_listens(spark, path)), key=repr) == before
    store.append_listens(some(spark, 30, 33), path, "late")
    store.compact(spark, path, max(days))
    assert ids(store.read_listens(spark, path)) == [*range(14), 30, 31, 32]
    store.compact(spark, path, min(days))  # nothing to do
    assert ids(store.read_listens(spark, path)) == [*range(14), 30, 31, 32]


def test_newest_rows_are_read_from_their_days(spark, tmp_path):
    from earshot.operators.feeds import now_playing, recent, stored_now_playing, stored_recent

    path = str(tmp_path / "rows")
    # Ids grow with time, but for one late commit of old ids and new days.
    store.append_listens(listens(spark, *[listen(i, NOW - timedelta(hours=6 * (200 - i)), kind="view" if i < 150 else "play") for i in range(200)]), path)
    store.append_listens(listens(spark, *[listen(-i, NOW + timedelta(days=i)) for i in range(1, 5)]), path)
    fact = store.read_listens(spark, path)
    for limit in (1, 7, 200):
        got = stored_recent(spark, path, limit)
        assert rows(got) == rows(recent(fact, limit))
        read = store.read_newest(spark, path, limit).select("listen_date").distinct().collect()
        assert len(read) <= limit // 4 + 2
    for ttl in (300, 10**7):
        assert rows(stored_now_playing(spark, path, CLOCK, ttl)) == rows(now_playing(fact, CLOCK, ttl))
    scan = executed(store.read_newest(spark, path, 7)).split("PartitionFilters: [")[1].split("]")[0]
    assert "listen_date" in scan and scan.count("2024-") <= 4
    assert "(listen_date#" in executed(store.read_last_view(spark, path)).split("PartitionFilters: [")[1].split("]")[0]
    empty = str(tmp_path / "none")
    store.append_listens(some(spark, 0, 0), empty)
    assert rows(stored_recent(spark, empty)) == [] and rows(stored_now_playing(spark, empty, CLOCK)) == []


def test_reports_from_what_commits_add_up_to(spark, tmp_path):
    from earshot.operators import rollups, timeseries, topstats
    from earshot.params import Clock

    path = str(tmp_path / "rows")
    rng = random.Random(3)
    data = [
        listen(i, NOW - timedelta(seconds=rng.randrange(40 * 86400)), kind=rng.choice(["play", "view", "other"]), duration=rng.choice([None, 5, 100]), genre=rng.choice(["", None, "a", "b"]))
        for i in range(600)
    ]
    store.append_listens(listens(spark, *data[:300]), path)
    store.append_listens(listens(spark, *data[300:]), path)
    store.import_into(listens(spark, *[(*r[:1], *r[1:10], "view", r[11]) for r in data[100:140]]), path)
    fact = store.read_listens(spark, path)
    for clock in (Clock(NOW, 5.5), Clock(NOW + timedelta(minutes=17, seconds=3), -3.0)):
        for filter_ in (None, "today", "week", "7d", "1m"):
            assert rows(rollups.stored_summary(spark, path, clock, filter_)) == rows(topstats.summary(fact, clock, filter_)), filter_
        assert rows(rollups.stored_daily(spark, path, clock, 7)) == rows(timeseries.daily_chart(fact, clock, 7))
        assert rows(rollups.stored_growth(spark, path, clock)) == rows(timeseries.growth(fact, clock))
        assert rows(rollups.stored_moods(spark, path, clock, 30)) == rows(timeseries.mood_calendar(fact, clock, 30))
    plan = executed(rollups.stored_summary(spark, path, Clock(NOW, 5.5), "week"))
    assert "event_type" not in plan and plan.count("FileScan") == 1
    with pytest.raises(ValueError, match="half hour"):
        rollups.stored_growth(spark, path, Clock(NOW, 5.75))


def test_ingest_numbers_on(spark, tmp_path):
    path, landed = str(tmp_path / "rows"), str(tmp_path / "landed")
    lib = library(spark, file("f1", "t1", "A"))

    def body(names, ms=None):
        info = {} if ms is None else {"additional_info": {"duration_ms": ms}}
        return json.dumps({"listen_type": "single", "payload": [{"track_metadata": {"track_name": n, "artist_name": "A", **info}} for n in names]})

    def land(*bodies):
        data = [("me", NOW + timedelta(seconds=i), b) for i, b in enumerate(bodies)]
        spark.createDataFrame(data, "user_name string, received_at timestamp_ntz, body string").coalesce(1).write.mode("append").json(landed)

    land(body(["t1", "x"]), body(["y"], 1e13), body(["z"], -5e300))  # absurd durations stop nothing
    streaming.ingest_listens(read_bodies(spark, landed), lib, path)
    first = store.read_listens(spark, path).orderBy("id").collect()
    assert [r.id for r in first] == [1, 2, 3, 4] and first[0].track_id == "f1" and first[2].duration == 0

    def run():
        streaming.stream_ingest(read_bodies(spark, landed, stream=True), lib, path, str(tmp_path / "s"), True).awaitTermination()

    run()
    land(body(["later"]))
    run()
    got = store.read_listens(spark, path).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 10)) and got[-1].track_name == "later"


def test_a_new_checkpoint_does_not_bring_an_old_state_back(spark, tmp_path):
    source, days = str(tmp_path / "in"), str(tmp_path / "days")
    stream = spark.readStream.schema(some(spark, 0, 1).schema).parquet
    some(spark, 0, 10).coalesce(1).write.parquet(source)
    for _ in range(3):
        streaming.stream_counters(stream(source), CLOCK, days, str(tmp_path / "s1"), True).awaitTermination()
        some(spark, 0, 10).coalesce(1).write.mode("append").parquet(source)
    streaming.stream_counters(stream(source), CLOCK, days, str(tmp_path / "s2"), True).awaitTermination()
    assert streaming.read_counters(spark, days).agg(F.sum("plays")).first()[0] == 40


def test_equal_rows_of_a_hot_key_are_spread(spark):
    facts = spark.range(30_000, numPartitions=3).select(F.lit("hot").alias("k"))
    dim = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew_safe_left_join(facts, dim, ["k"], shares=100, min_rows=1000)
        assert joined.filter("v = 1").count() == 30_000
        most = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert most < 15_000


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    lib = library(spark, *[file(str(i), f"title {i}", "A", genre="rock") for i in range(5)])
    h = some(spark, 0, 10)
    assert "NestedLoop" not in executed(similar_artists(lib, "A")) and "Cartesian" not in executed(similar_artists(lib, "A"))
    assert "Exchange" not in executed(artist_listens(h))
    pairs = h.select("track_name", "artist_name").distinct()
    plan = executed(fuzzy_files(pairs, lib))
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_missing_work_folder_is_said(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        def getCheckpointDir(self):
            return None

    class Bare:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(Bare())
    assert shared_root(spark)


def test_enrichment_of_nothing(spark):
    none = spark.createDataFrame([], "user_name string, received_at timestamp_ntz, body string")
    assert rows(enrich_listens(parse_listen_payloads(none), library(spark, file("1", "t", "A")))) == []
