"""Streams over several files, with a stop between them, end equal to the batch."""

from datetime import timedelta
from pathlib import Path

from history import CLOCK, NOW, file, library, listen, listens, rows

from earshot.functions.timecols import iso, local_date
from earshot.functions.measures import measures
from earshot.operators.enrich import enrich_listens
from earshot.operators.feeds import now_playing
from earshot.session import shared_root
from earshot.sources.fixtures import as_payloads, as_submissions
from earshot.sources.library import library_version, publish_library, read_snapshot
from earshot.sources.listens import LISTEN_COLUMNS, read_listens
from earshot.sources.payloads import parse_listen_payloads
from earshot.streaming import listens as streaming


def parts(spark):
    rows_ = [
        listen(i, NOW - timedelta(hours=5 * (30 - i)), track=f"t{i % 7}", kind="view" if i % 3 == 0 else "play", duration=i)
        for i in range(30)
    ]
    return [listens(spark, *rows_[a : a + 10]) for a in (0, 10, 20)]


def run_in_steps(frames, source, start):
    """Feed one file at a time, each to a query of its own that resumes from the checkpoint."""
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(source)
        query = start()
        query.awaitTermination()
        assert query.exception() is None


def test_enrich(spark, tmp_path):
    frames = [as_payloads(as_submissions(p)) for p in parts(spark)]
    lib = library(spark, *[file(f"f{i}", f"t{i}") for i in range(5)])
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    stream = spark.readStream.schema(frames[0].schema).parquet
    run_in_steps(frames, source, lambda: streaming.stream_enrich(stream(source), lib, out, state, True))
    batch = enrich_listens(parse_listen_payloads(spark.read.parquet(source)), lib)
    got = streaming.read_batches(spark, out).select(*batch.columns)
    assert sorted(rows(got), key=repr) == sorted(rows(batch), key=repr) and got.count() == 30


def test_append_and_counters_and_now_playing(spark, tmp_path):
    frames = parts(spark)
    source = str(tmp_path / "in")
    stream = spark.readStream.schema(frames[0].schema).parquet

    def folder(name):
        return str(tmp_path / name)

    def all_three():
        streaming.stream_append(stream(source), folder("table"), folder("s1"), True).awaitTermination()
        streaming.stream_counters(stream(source), CLOCK, folder("days"), folder("s2"), True).awaitTermination()
        return streaming.stream_now_playing(stream(source), folder("now"), folder("s3"), True)

    run_in_steps(frames, source, all_three)
    whole = spark.read.parquet(source)
    stored = read_listens(spark, folder("table")).select(*LISTEN_COLUMNS, "ts")
    assert sorted(r.id for r in stored.collect()) == list(range(30))
    days = whole.groupBy(iso(local_date(CLOCK)).alias("day")).agg(*measures())
    kept = streaming.read_counters(spark, folder("days")).select(*days.columns)
    assert sorted(rows(kept)) == sorted(rows(days))
    for ttl in (300, 10**6):
        expected = rows(now_playing(whole, CLOCK, ttl))
        assert rows(streaming.read_now_playing(spark, folder("now"), CLOCK, ttl)) == expected
    assert expected


def test_a_running_stream_sees_a_library_that_changes(spark, tmp_path):
    frames = [as_payloads(as_submissions(p)).coalesce(1) for p in parts(spark)]
    source, out, state, live = (str(tmp_path / n) for n in ("in", "out", "state", "library"))
    assert library_version(spark, live) == 0 and read_snapshot(spark, live).count() == 0
    frames[0].write.parquet(source)
    stream = spark.readStream.schema(frames[0].schema).parquet(source)
    query = streaming.stream_enrich(stream, streaming.LiveLibrary(live), out, state)
    try:
        query.processAllAvailable()  # without any snapshot
        assert publish_library(library(spark, *[file(f"f{i}", f"t{i}") for i in range(3)]), live) == 1
        frames[1].write.mode("append").parquet(source)
        query.processAllAvailable()
        publish_library(library(spark, *[file(f"g{i}", f"t{i}") for i in range(5)]), live)
        frames[2].write.mode("append").parquet(source)
        query.processAllAvailable()
    finally:
        query.stop()
    got = {r.event_id: r.track_id for r in streaming.read_batches(spark, out).collect()}
    assert len(got) == 30 and {got[i] for i in range(10)} == {""}
    for frame, (prefix, most) in zip(frames[1:], (("f", 3), ("g", 5))):
        batch = enrich_listens(parse_listen_payloads(frame), library(spark, *[file(f"{prefix}{i}", f"t{i}") for i in range(most)]))
        assert all(got[r.event_id] == r.track_id for r in batch.collect()) and batch.filter("tier = 'exact'").count() > 0


def test_a_micro_batch_is_held_in_files_that_go_with_it(spark, tmp_path):
    frame = as_payloads(as_submissions(parts(spark)[0]))
    seen, held = [], lambda: set(Path(shared_root(spark)).glob("earshot/parsed-listens-*/rows"))
    before = held()

    def then(rows_, stream, epoch):
        plan = rows_._jdf.queryExecution().optimizedPlan().toString()
        seen.append(("InMemoryRelation" in plan, "from_json" in plan, rows_.count(), len(held() - before)))

    state = tmp_path / "state"
    state.mkdir()
    (state / "metadata").write_text('{"id": "s"}')
    streaming._enriching(library(spark, file("1", "t1")), str(state), then)(parse_listen_payloads(frame), 0)
    assert seen == [(False, False, 10, 1)]
    assert held() == before


def test_bodies_of_a_live_stream_come_in_as_many_files_as_tasks(spark, monkeypatch):
    import earshot.plans.rest as plans

    written = []
    rows_ = as_payloads(as_submissions(listens(spark, *[listen(i) for i in range(60)]))).repartition(3)
    monkeypatch.setattr(plans.fx, "listen_payloads", lambda s, sf: rows_)
    monkeypatch.setattr(plans.fx, "library", lambda s, sf: library(s, file("1", "T")))
    kept = plans.work_folder
    monkeypatch.setattr(plans, "work_folder", lambda s, purpose: written.append(kept(s, purpose)) or written[-1])
    assert plans._stream_live_library(spark, "").count() == 60
    assert len(list(Path(f"{written[0]}/bodies").glob("*.parquet"))) == 6
