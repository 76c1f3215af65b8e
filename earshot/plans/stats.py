"""Listening statistics: each entry is (query over the derived tables, SQL counterpart)."""

from __future__ import annotations

from earshot.operators import credits, feeds, timeseries, topstats, yearly
from earshot.params import ROLLING_DAYS
from earshot.plans.views import DAY, MEASURES, PLAYS, PLAYTIME, VIEW_COUNT
from earshot.sources import fixtures as fx

ARTIST = "Supplier#000000001"
ARTIST_ID = "artist-c3VwcGxpZXIjMDAwMDAwMDAx"
ALBUM = "Brand#7"
YEAR = 1998
YEAR_SQL = f"ts >= timestamp '{YEAR}-01-01' and ts < timestamp '{YEAR + 1}-01-01'"
NOW = "timestamp '2024-01-30 23:59:59'"
# local Monday 2024-01-29 and local midnight 2024-01-31, both at +5.5 h
WEEK = "ts >= timestamp '2024-01-28 18:30:00'"
TODAY = "ts >= timestamp '2024-01-30 18:30:00'"
RANK = "playtime desc, plays desc, views desc"
EVENTS = "count(*) as plays"

clock, long_clock = fx.AS_OF, fx.AS_OF_LONG


CREDITS_SQL = """select c.credit, cast(row_number() over (partition by c.credit order by c.pos) - 1 as int) as position,
 c.artist_name, c.artist_id from credits c
where c.credit in (select artist_name from listens union select artist from media_file where not missing)"""


def _listens(op, *args, **kw):
    return lambda spark, sf: op(fx.listens(spark, sf), *args, **kw)


def _long(op, *args, **kw):
    return lambda spark, sf: op(fx.listens_long(spark, sf), *args, **kw)


def _credited(op, *args, **kw):
    return lambda spark, sf: op(fx.listens(spark, sf), *args, library=fx.library(spark, sf), **kw)


def _credited_long(op, *args, **kw):
    return lambda spark, sf: op(fx.listens_long(spark, sf), *args, library=fx.library(spark, sf), **kw)


def _middle_page(listens, op, *args, limit: int, **kw):
    """The page in the middle of the history."""
    return op(listens, *args, page=listens.count() // (2 * limit) + 1, limit=limit, **kw)


def _since(days: int) -> str:
    return f"ts >= {NOW} - interval {days} day"


QUERIES = {
    "summary": (_listens(topstats.summary, clock), f"select {MEASURES} from listens"),
    "summary_today": (_listens(topstats.summary, clock, "today"), f"select {MEASURES} from listens where {TODAY}"),
    "summary_week": (_listens(topstats.summary, clock, "week"), f"select {MEASURES} from listens where {WEEK}"),
    **{
        f"summary_{name}": (
            _listens(topstats.summary, clock, name), f"select {MEASURES} from listens where {_since(days)}"
        )
        for name, days in ROLLING_DAYS.items()
    },
    "top_tracks": (
        _listens(topstats.top_tracks, clock),
        f"""select track_name, artist_name, album_name, max(track_id) as track_id, max(album_id) as album_id, {MEASURES}
        from listens group by all order by {RANK}, track_name, artist_name, album_name limit 50""",
    ),
    "top_tracks_long": (
        _long(topstats.top_tracks, long_clock),
        f"""select track_name, artist_name, album_name, max(track_id) as track_id, max(album_id) as album_id, {MEASURES}
        from listens_long group by all order by {RANK}, track_name, artist_name, album_name limit 50""",
    ),
    "ranked_tracks": (
        _listens(topstats.ranked_tracks, clock, "7d"),
        f"""with t as (select track_name, artist_name, album_name, max(track_id) as track_id, max(album_id) as album_id,
          {MEASURES} from listens where {_since(7)} group by track_name, artist_name, album_name
          order by {RANK}, track_name, artist_name, album_name limit 50)
        select *, cast(row_number() over (order by {RANK}, track_name, artist_name, album_name) as int) as rank,
         cast(case when max(playtime) over () > 0 then greatest(3,
           floor(cast(playtime as double) / max(playtime) over () * 100 + 0.5)) else 0 end as int) as bar from t""",
    ),
    "top_albums": (
        _listens(topstats.top_albums, clock),
        f"""select album_name, artist_name, max(album_id) as album_id, {MEASURES} from listens
        where album_name <> 'Unknown' group by all order by {RANK}, album_name, artist_name limit 50""",
    ),
    "top_artists": (
        _credited(topstats.top_artists, clock),
        f"""select min(artist_name) as artist_name, artist_id, {MEASURES} from artist_listens
        group by artist_id order by {RANK}, artist_id limit 50""",
    ),
    "top_artists_long": (
        _credited_long(topstats.top_artists, long_clock),
        f"""select min(artist_name) as artist_name, artist_id, {MEASURES} from artist_listens_long
        group by artist_id order by {RANK}, artist_id limit 50""",
    ),
    "artist_summary": (
        _credited(topstats.artist_summary, clock, ARTIST),
        f"""select min(artist_name) as artist_name, artist_id, {MEASURES} from artist_listens
        where artist_id = '{ARTIST_ID}' group by artist_id""",
    ),
    "artist_top_tracks": (
        _credited(topstats.artist_top_tracks, clock, ARTIST),
        f"""select track_name, max(track_id) as track_id, max(album_id) as album_id, {MEASURES} from artist_listens
        where artist_id = '{ARTIST_ID}' group by track_name order by {RANK}, track_name limit 10""",
    ),
    "artist_top_albums": (
        _credited(topstats.artist_top_albums, clock, ARTIST),
        f"""select album_name, max(album_id) as album_id, {MEASURES} from artist_listens
        where artist_id = '{ARTIST_ID}' and album_name <> 'Unknown'
        group by album_name order by {RANK}, album_name limit 10""",
    ),
    "album_summary": (
        _listens(topstats.album_summary, clock, ALBUM),
        f"""select album_name, arg_max(artist_name, row(album_id, artist_name)) as artist_name,
         max(album_id) as album_id, {MEASURES}
        from listens where album_name = '{ALBUM}' group by album_name""",
    ),
    "album_tracks": (
        _listens(topstats.album_tracks, clock, ALBUM),
        f"""select track_name, min(artist_name) as artist_name, max(track_id) as track_id, {MEASURES}
        from listens where album_name = '{ALBUM}' group by track_name""",
    ),
    "album_daily": (
        _listens(topstats.album_daily, clock, ALBUM),
        f"select {DAY} as day, {VIEW_COUNT}, {PLAYS} from listens where album_name = '{ALBUM}' group by 1",
    ),
    "daily_chart": (
        _listens(timeseries.daily_chart, clock),
        f"select {DAY} as day, {VIEW_COUNT}, {PLAYS} from listens where {_since(7)} group by 1",
    ),
    "this_week_summary": (
        _listens(timeseries.this_week_summary, clock),
        f"""select coalesce(sum(case when event_type = 'play' then 1 else 0 end), 0)::bigint as plays,
        coalesce(sum(case when event_type = 'play' then duration else 0 end), 0)::bigint as playtime,
        coalesce(sum(case when event_type = 'view' then 1 else 0 end), 0)::bigint as views,
        count(distinct track_name) as unique_tracks, count(distinct {DAY}) as active_days from listens where {WEEK}""",
    ),
    "this_week_daily": (
        _listens(timeseries.this_week_daily, clock),
        f"""with d as (select cast(lts as date) as day, {PLAYS}, {PLAYTIME} from listens where {WEEK} group by 1)
        select cast(i as int) as day_index, strftime(date '2024-01-29' + cast(i as int), '%a') as label,
         strftime(date '2024-01-29' + cast(i as int), '%Y-%m-%d') as date,
         coalesce(plays, 0) as plays, coalesce(playtime, 0) as playtime
        from range(7) r(i) left join d on d.day = date '2024-01-29' + cast(i as int)""",
    ),
    "this_week_top_track": (
        _listens(timeseries.this_week_top_track, clock),
        f"""select track_name, artist_name, album_name, max(track_id) as track_id, max(album_id) as album_id,
        {PLAYTIME}, {PLAYS} from listens where {WEEK} group by track_name, artist_name, album_name
        order by playtime desc, plays desc, track_name, artist_name, album_name limit 1""",
    ),
    "this_week_prev": (
        _listens(timeseries.this_week_prev, clock),
        f"""select coalesce(sum(case when event_type = 'play' then 1 else 0 end), 0)::bigint as plays,
        coalesce(sum(case when event_type = 'play' then duration else 0 end), 0)::bigint as playtime
        from listens where ts >= timestamp '2024-01-21 18:30:00' and ts < timestamp '2024-01-28 18:30:00'""",
    ),
    "this_week_delta": (
        _listens(timeseries.this_week_delta, clock),
        f"""with s as (select count(*) filter (where {WEEK}) as cur, count(*) filter (where not ({WEEK})) as prev
          from listens where event_type = 'play' and ts >= timestamp '2024-01-21 18:30:00')
        select case when prev > 0 then 'pct' when cur > 0 then 'New' else 'none' end as state,
         cast(case when prev > 0 then floor((cur - prev) / cast(prev as double) * 100 + 0.5) end as bigint) as pct from s""",
    ),
    "search_tracks": (
        _listens(topstats.search_tracks, clock, "RING"),
        f"""select track_name, min(artist_name) as artist_name, max(track_id) as track_id, max(album_id) as album_id,
        {MEASURES} from listens where track_name ilike '%RING%' group by track_name
        order by {RANK}, track_name limit 5""",
    ),
    "search_albums": (
        _listens(topstats.search_albums, clock, "brand#1"),
        f"""select album_name, arg_max(artist_name, row(album_id, artist_name)) as artist_name,
        max(album_id) as album_id, {MEASURES}
        from listens where album_name ilike '%brand#1%' and album_name <> 'Unknown' group by album_name
        order by {RANK}, album_name limit 5""",
    ),
    "search_artists": (
        _credited(topstats.search_artists, clock, "00003"),
        f"""select min(artist_name) as artist_name, artist_id, {MEASURES} from artist_listens
        where artist_name ilike '%00003%' group by artist_id order by {RANK}, artist_id limit 5""",
    ),
    "heatmap": (
        _listens(timeseries.heatmap, clock),
        f"select {DAY} as day, {PLAYS}, {VIEW_COUNT} from listens where {_since(365)} group by 1",
    ),
    "heatmap_levels": (
        _listens(timeseries.heatmap_levels, clock),
        f"""with d as (select cast(lts as date) as day, {PLAYS} from listens where {_since(365)} group by 1),
        f as (select cast(g.day as date) as day, coalesce(d.plays, 0) as plays
          from generate_series(timestamp '2023-01-29', timestamp '2024-01-31', interval 1 day) g(day)
          left join d on d.day = cast(g.day as date))
        select strftime(day, '%Y-%m-%d') as day, plays, cast(case when plays = 0 then 0 else
          ceil(plays / cast((select max(plays) from d) as double) * 4) end as int) as level from f""",
    ),
    "hourly": (
        _listens(timeseries.hourly, clock),
        f"""select cast(h as int) as hour, coalesce(plays, 0) as plays, coalesce(views, 0) as views from range(24) r(h)
        left join (select hour(lts) as hour, {PLAYS}, {VIEW_COUNT} from listens group by 1) d on d.hour = h""",
    ),
    "day_of_week": (
        _listens(timeseries.day_of_week, clock),
        f"""select cast(i as int) as day, ['Sun','Mon','Tue','Wed','Thu','Fri','Sat'][i + 1] as day_name,
        coalesce(plays, 0) as plays from range(7) r(i)
        left join (select dayofweek(lts) as day, {PLAYS} from listens group by 1) d on d.day = i""",
    ),
    "unique_counts": (
        _credited(topstats.unique_counts),
        """select 'artists' as type, count(distinct artist_id) as count from artist_listens where artist_name <> 'Unknown'
        union all select 'albums', count(distinct album_name) from listens where album_name <> 'Unknown'
        union all select 'tracks', count(distinct track_name) from listens where track_name <> 'Unknown'
        union all select 'total', count(*) from listens""",
    ),
    "growth": (
        _long(timeseries.growth, long_clock),
        f"""with m as (select strftime(lts, '%Y-%m') as month, {PLAYS} from listens_long group by 1)
        select month, plays, cast(sum(plays) over (order by month) as bigint) as cumulative from m""",
    ),
    "top_genres": (
        _listens(topstats.top_genres, clock),
        f"""select genre, {EVENTS}, {PLAYTIME} from listens where coalesce(genre, '') <> '' group by genre
        order by playtime desc, genre limit 20""",
    ),
    "library_artists": (
        lambda spark, sf: feeds.library_artists(fx.listens(spark, sf), fx.library(spark, sf), page=2, limit=4),
        f"""with a as (select min(artist_name) as artist_name, artist_id, {PLAYS}, {PLAYTIME} from artist_listens
          where artist_name <> 'Unknown' group by artist_id)
        select *, (select count(*) from a) as total from a order by artist_name, artist_id limit 4 offset 4""",
    ),
    "library_albums": (
        _listens(feeds.library_albums, query="Brand", page=2, limit=40),
        f"""with r as (select * from listens where album_name <> 'Unknown' and album_name ilike '%Brand%'),
        a as (select album_name, artist_name, max(album_id) as album_id, {PLAYS}, {PLAYTIME} from r group by 1, 2)
        select *, (select count(distinct album_name) from r) as total from a
        order by album_name, artist_name limit 40 offset 40""",
    ),
    "library_tracks": (
        _listens(feeds.library_tracks, page=3, limit=30),
        f"""with t as (select track_name, artist_name, album_name, max(track_id) as track_id, max(album_id) as album_id,
          max(artist_id) as artist_id, {PLAYS}, {PLAYTIME} from listens group by 1, 2, 3)
        select *, (select count(*) from listens) as total, (select count(*) from t) as groups from t
        order by track_name, artist_name, album_name limit 30 offset 60""",
    ),
    "years": (_long(timeseries.years, long_clock), "select distinct cast(year(lts) as int) as year from listens_long"),
    "year_summary": (
        _credited_long(yearly.year_summary, long_clock, YEAR),
        f"""select cast(sum(case when event_type = 'play' then duration else 0 end) as bigint) as total_playtime,
        cast(sum(case when event_type = 'play' then 1 else 0 end) as bigint) as total_plays,
        count(distinct track_name) as unique_tracks,
        (select count(distinct artist_id) from artist_listens_long where {YEAR_SQL}) as unique_artists,
        count(distinct album_name) as unique_albums, count(distinct {DAY}) as active_days
        from listens_long where {YEAR_SQL}""",
    ),
    "year_top_artists": (
        _credited_long(yearly.year_top_artists, YEAR),
        f"""select min(artist_name) as artist_name, artist_id, {PLAYTIME}, {EVENTS} from artist_listens_long
        where {YEAR_SQL} and artist_name <> 'Unknown' group by artist_id order by playtime desc, artist_id limit 5""",
    ),
    "year_top_tracks": (
        _long(yearly.year_top_tracks, YEAR),
        f"""select track_name, artist_name, max(track_id) as track_id, max(album_id) as album_id, {PLAYTIME}, {EVENTS}
        from listens_long where {YEAR_SQL} group by 1, 2 order by playtime desc, track_name, artist_name limit 5""",
    ),
    "year_top_albums": (
        _long(yearly.year_top_albums, YEAR),
        f"""select album_name, artist_name, max(album_id) as album_id, {PLAYTIME}, {EVENTS} from listens_long
        where {YEAR_SQL} and album_name <> 'Unknown' group by 1, 2
        order by playtime desc, album_name, artist_name limit 5""",
    ),
    "year_monthly": (
        _long(yearly.year_monthly, long_clock, YEAR),
        f"select strftime(lts, '%Y-%m') as month, {PLAYTIME}, {EVENTS} from listens_long where {YEAR_SQL} group by 1",
    ),
    "year_peak_month": (
        _long(yearly.year_peak_month, long_clock, YEAR),
        f"""select strftime(lts, '%Y-%m') as month, {EVENTS}, {PLAYTIME} from listens_long where {YEAR_SQL}
        group by 1 order by plays desc, month limit 1""",
    ),
    "year_peak_day": (
        _long(yearly.year_peak_day, long_clock, YEAR),
        f"""select {DAY} as day, {EVENTS} from listens_long where {YEAR_SQL} and event_type = 'play'
        group by 1 order by plays desc, day limit 1""",
    ),
    "mood_calendar": (
        _listens(timeseries.mood_calendar, clock),
        f"""with c as (select {DAY} as day, genre, count(*) as plays from listens
          where {_since(90)} and coalesce(genre, '') <> '' group by 1, 2)
        select day, genre, plays from c qualify row_number() over (partition by day order by plays desc, genre) = 1""",
    ),
    "streaks_with_gaps": (
        lambda spark, sf: timeseries.streaks(fx.listens(spark, sf).filter("day(ts) % 7 > 1"), clock),
        f"""with d as (select distinct cast(lts as date) as day from listens where event_type = 'play' and day(ts) % 7 > 1),
        r as (select day, day - cast(row_number() over (order by day) as int) as run from d),
        g as (select max(day) as last, count(*) as length from r group by run)
        select coalesce((select length from g where last = (select max(last) from g)
           and last in (date '2024-01-31', date '2024-01-30')), 0) as current,
         coalesce(max(length), 0) as longest, cast(coalesce(sum(length), 0) as bigint) as total_active_days from g""",
    ),
    "streaks": (
        _listens(timeseries.streaks, clock),
        f"""with d as (select distinct cast(lts as date) as day from listens where event_type = 'play'),
        r as (select day, day - cast(row_number() over (order by day) as int) as run from d),
        g as (select max(day) as last, count(*) as length from r group by run)
        select coalesce((select length from g where last = (select max(last) from g)
           and last in (date '2024-01-31', date '2024-01-30')), 0) as current,
         coalesce(max(length), 0) as longest, cast(coalesce(sum(length), 0) as bigint) as total_active_days from g""",
    ),
    "streaks_long": (
        _long(timeseries.streaks, long_clock),
        f"""with d as (select distinct cast(lts as date) as day from listens_long where event_type = 'play'),
        r as (select day, day - cast(row_number() over (order by day) as int) as run from d),
        g as (select max(day) as last, count(*) as length from r group by run)
        select coalesce((select length from g where last = (select max(last) from g)
           and last in (date '2001-11-05', date '2001-11-04')), 0) as current,
         coalesce(max(length), 0) as longest, cast(coalesce(sum(length), 0) as bigint) as total_active_days from g""",
    ),
    "recent": (
        _listens(feeds.recent, 200),
        """select id, user_name, track_name, artist_name, album_name, track_id, album_id, artist_id, duration, event_type,
        timestamp from listens order by id desc limit 200""",
    ),
    "history_page": (
        _listens(feeds.history_page, query="ring", event_type="play", page=2, limit=5),
        """with r as (select id, user_name, track_name, artist_name, album_name, track_id, album_id, artist_id, duration,
          event_type, timestamp from listens where event_type = 'play'
          and (track_name ilike '%ring%' or artist_name ilike '%ring%' or album_name ilike '%ring%'))
        select *, (select count(*) from r) as total, cast(ceil((select count(*) from r) / 5.0) as bigint) as total_pages
        from r order by id desc limit 5 offset 5""",
    ),
    "history_page_deep": (
        _listens(_middle_page, feeds.history_page, limit=50, most=64),
        """with r as (select id, user_name, track_name, artist_name, album_name, track_id, album_id, artist_id, duration,
          event_type, timestamp, row_number() over (order by id desc) as nth, count(*) over () as total from listens)
        select * exclude (nth), cast(ceil(total / 50.0) as bigint) as total_pages from r
        where nth > total // 100 * 50 and nth <= total // 100 * 50 + 50""",
    ),
    "timeline": (
        _listens(_middle_page, feeds.timeline, clock, limit=100, most=256),
        f"""with a as (select id, user_name, track_name, artist_name, album_name, track_id, album_id, artist_id, duration,
          event_type, timestamp, {DAY} as local_day, row_number() over (order by id desc) as nth, count(*) over () as total from listens),
        p as (select * exclude (nth, total) from a where nth > total // 200 * 100 and nth <= total // 200 * 100 + 100)
        select *, local_day is distinct from lag(local_day) over (order by id desc) as new_day from p""",
    ),
    "now_playing": (
        _listens(feeds.now_playing, clock, ttl=100_000),
        f"""select * from (select id, track_name, artist_name, album_name, track_id, album_id, artist_id, duration, timestamp
          from listens where event_type = 'view' order by id desc limit 1)
        where timestamp >= epoch({NOW}) - 100000""",
    ),
    "credit_dimension": (
        lambda spark, sf: credits.credit_dimension_rows(
            credits.credit_dimension(fx.listens(spark, sf), fx.library(spark, sf))
        ),
        CREDITS_SQL,
    ),
    "artist_listens": (
        lambda spark, sf: credits.artist_listens(fx.listens(spark, sf), fx.library(spark, sf)),
        """select id, user_name, track_name, album_name, track_id, album_id, duration, genre, event_type, ts,
        original_artist_name, artist_name, artist_id from artist_listens""",
    ),
}
