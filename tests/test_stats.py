from datetime import datetime, timedelta

from history import CLOCK, NOW, listen, listens, rows

from earshot.operators import feeds, timeseries, topstats, yearly
from earshot.params import Clock


def ago(**kw):
    return NOW - timedelta(**kw)


def filtered(spark):
    return listens(
        spark,
        listen(1, duration=100),
        listen(2, ago(days=8), duration=200),
        listen(3, ago(days=35), duration=300),
        listen(4, duration=150, kind="view"),
    )


def test_time_filters(spark):
    h = filtered(spark)
    assert rows(topstats.summary(h, CLOCK)) == [(1, 3, 600)]
    assert rows(topstats.summary(h, CLOCK, "7d")) == [(1, 1, 100)]
    assert rows(topstats.summary(h, CLOCK, "1m")) == [(1, 2, 300)]
    assert rows(topstats.summary(h, CLOCK, "no such filter")) == [(1, 3, 600)]


def test_bounds_are_inclusive_and_open_above(spark):
    h = listens(spark, listen(1, ago(days=7)), listen(2, ago(days=7, seconds=1)), listen(3, NOW + timedelta(days=3)))
    assert topstats.summary(h, CLOCK, "7d").first().plays == 2


def test_empty_history(spark):
    h = listens(spark)
    assert rows(topstats.summary(h, CLOCK)) == [(None, None, None)]
    assert rows(timeseries.this_week_summary(h, CLOCK)) == [(0, 0, 0, 0, 0)]
    assert rows(timeseries.this_week_delta(h, CLOCK)) == [("none", None)]
    assert rows(timeseries.streaks(h, CLOCK)) == [(0, 0, 0)]
    assert rows(yearly.year_peak_month(h, CLOCK, 2024)) == [("", 0, 0)]
    assert rows(yearly.year_peak_day(h, CLOCK, 2024)) == []
    assert [r.plays for r in timeseries.hourly(h, CLOCK).collect()] == [0] * 24
    assert rows(topstats.artist_summary(h, CLOCK, "Nobody")) == [("Nobody", None, 0, 0, 0)]
    assert rows(topstats.album_summary(h, CLOCK, "None")) == [("None", "", None, 0, 0, 0)]
    assert rows(feeds.now_playing(h, CLOCK)) == []


def test_week(spark):
    h = filtered(spark)
    assert timeseries.this_week_summary(h, CLOCK).first().plays == 1
    daily = timeseries.this_week_daily(h, CLOCK).collect()
    assert [d.label for d in daily] == ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    assert [d.plays for d in daily] == [0, 0, 1, 0, 0, 0, 0]
    assert timeseries.this_week_prev(h, CLOCK).first().plays == 1
    assert rows(timeseries.this_week_delta(h, CLOCK)) == [("pct", 0)]
    assert rows(timeseries.this_week_range(spark, CLOCK)) == [("2024-03-11", "2024-03-17", "Mar 11 – Mar 17")]


def test_halves_round_up_below_zero_too(spark):
    week, before = NOW, ago(days=7)
    many = [listen(i, before) for i in range(200)] + [listen(1000 + i, week) for i in range(199)]
    assert rows(timeseries.this_week_delta(listens(spark, *many), CLOCK)) == [("pct", 0)]


def test_offsets_move_days(spark):
    h = listens(spark, listen(1, datetime(2024, 2, 28, 23, 0)))
    for hours, day in ((0, "2024-02-28"), (5.5, "2024-02-29"), (-3.5, "2024-02-28"), (14, "2024-02-29")):
        clock = Clock(datetime(2024, 3, 1), hours)
        assert timeseries.heatmap(h, clock).first().day == day
    clock = Clock(datetime(2024, 3, 10, 20, 0), 5.5)  # already Monday there
    assert clock.week_start == datetime(2024, 3, 10, 18, 30)


def test_year_is_utc_but_months_are_local(spark):
    h = listens(spark, listen(1, datetime(2023, 12, 31, 20, 0)), listen(2, datetime(2023, 6, 1)))
    clock = Clock(NOW, 5.5)
    assert [r.month for r in yearly.year_monthly(h, clock, 2023).collect()] == ["2023-06", "2024-01"]
    assert yearly.year_summary(h, clock, 2023).first().total_plays == 2
    assert yearly.year_summary(h, clock, 2024).first().total_plays is None


def test_streaks(spark):
    def days(*back):
        return listens(spark, *[listen(i, ago(days=b)) for i, b in enumerate(back)])

    assert rows(timeseries.streaks(days(0, 1, 2, 5, 6, 7, 8), CLOCK)) == [(3, 4, 7)]
    assert rows(timeseries.streaks(days(1, 2, 9), CLOCK)) == [(2, 2, 3)]
    assert rows(timeseries.streaks(days(2, 3), CLOCK)) == [(0, 2, 2)]
    assert rows(timeseries.streaks(days(-2, 0), CLOCK)) == [(0, 1, 2)]
    views = listens(spark, listen(1, kind="view"))
    assert rows(timeseries.streaks(views, CLOCK)) == [(0, 0, 0)]


def test_heatmap_levels(spark):
    h = listens(spark, *[listen(i, ago(days=1)) for i in range(8)], listen(50), listen(51, ago(days=2)), listen(52, ago(days=2)), listen(53, ago(days=2)))
    levels = {r.day: (r.plays, r.level) for r in timeseries.heatmap_levels(h, CLOCK).collect()}
    assert levels["2024-03-12"] == (8, 4) and levels["2024-03-13"] == (1, 1) and levels["2024-03-11"] == (3, 2)
    assert levels["2024-03-10"] == (0, 0)
    assert min(levels) == "2023-03-12" and datetime.fromisoformat(min(levels)).weekday() == 6
    assert all(level == 0 for _, level in levels.values() if _ == 0)


def test_plays_count_views_where_the_report_does(spark):
    h = listens(spark, listen(1, genre="rock"), listen(2, kind="view", genre="rock"), listen(3, genre=None), listen(4, genre=""))
    assert rows(topstats.top_genres(h, CLOCK)) == [("rock", 2, 100)]
    assert rows(timeseries.mood_calendar(h, CLOCK)) == [("2024-03-13", "rock", 2)]


def test_ties_are_broken_by_name(spark):
    h = listens(spark, *[listen(i, track=t) for i, t in enumerate("cab")])
    assert [r.track_name for r in topstats.top_tracks(h, CLOCK, limit=2).collect()] == ["a", "b"]


def test_artist_of_an_album_comes_from_the_row_with_the_largest_id(spark):
    h = listens(spark, listen(1, artist="Z", album_id="a"), listen(2, artist="Y", album_id="b"), listen(3, artist="X"))
    found = topstats.album_summary(h, CLOCK, "B").first()
    assert (found.artist_name, found.album_id, found.plays) == ("Y", "b", 3)


def test_search_wildcards_and_backslashes(spark):
    h = listens(spark, listen(1, track="100% pure"), listen(2, track="a\\b"), listen(3, track="ABC"))
    def found(q):
        return sorted(r.track_name for r in topstats.search_tracks(h, CLOCK, q).collect())
    assert found("abc") == ["ABC"]
    assert found("a_c") == ["ABC"]
    assert found("\\") == ["a\\b"]


def test_now_playing_looks_at_the_last_view_only(spark):
    fresh, stale = listen(1, ago(seconds=300), kind="view"), listen(2, ago(seconds=301), kind="view")
    assert [r.id for r in feeds.now_playing(listens(spark, fresh), CLOCK).collect()] == [1]
    assert feeds.now_playing(listens(spark, fresh, stale), CLOCK).collect() == []


def test_limits_are_clamped(spark):
    h = listens(spark, *[listen(i) for i in range(5)])
    assert feeds.recent(h, -1).count() == 1
    page = feeds.history_page(h, page=0, limit=2).collect()
    assert [(r.id, r.total, r.total_pages) for r in page] == [(4, 5, 3), (3, 5, 3)]


def test_timeline_marks_days(spark):
    h = listens(spark, listen(1, ago(days=1)), listen(2, ago(days=1)), listen(3), listen(4))
    assert [(r.id, r.new_day) for r in feeds.timeline(h, CLOCK).collect()] == [(4, True), (3, False), (2, True), (1, False)]


def test_stored_partitions_are_pruned(spark, tmp_path):
    from earshot.sources.listens import append_listens, read_listens

    append_listens(filtered(spark), str(tmp_path / "t"))
    append_listens(listens(spark, listen(9, duration=1)), str(tmp_path / "t"))
    stored = read_listens(spark, str(tmp_path / "t"))
    assert rows(topstats.summary(stored, CLOCK, "7d")) == [(1, 2, 101)]
    plan = topstats.summary(stored, CLOCK, "7d")._jdf.queryExecution().executedPlan().toString()
    assert "listen_date" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(ts" in plan
    assert "track_name" not in plan


def test_session_time_zone_does_not_matter(spark):
    gap, before = datetime(2024, 3, 10, 2, 30, 0, 500_000), datetime(1969, 12, 31, 23, 59, 59, 500_000)
    h = listens(spark, listen(2, gap), listen(1, before))
    clock = Clock(datetime(2024, 3, 10, 12, 0), 0.0)
    zone = spark.conf.get("spark.sql.session.timeZone")
    seen = []
    try:
        for name in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            stamps = [r.timestamp for r in feeds.recent(h).collect()]
            hours = [r.hour for r in timeseries.hourly(h, clock).filter("plays > 0").collect()]
            days = [r.day for r in timeseries.heatmap(h, clock).collect()]
            months = [r.month for r in timeseries.growth(h, clock).collect()]
            seen.append((stamps, hours, days, months, topstats.summary(h, clock, "today").first().plays))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert seen == [([1710037800, -1], [2, 23], ["2024-03-10"], ["1969-12", "2024-03"], 1)] * 3
