"""Storage, ingest, matching, recommendation, catalog and streaming queries with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from earshot.functions.measures import add_up
from earshot.functions.text import cover_key
from earshot.operators import artwork, charts, distincts, enrich, feeds, matching, recommend, rollups, storage
from earshot.operators.credits import credit_dimension, credit_dimension_rows, read_credits, refresh_credits
from earshot.operators.storage import Selection
from earshot.plans.stats import ARTIST, ARTIST_ID, CREDITS_SQL, NOW, QUERIES as STATS, YEAR
from earshot.plans.views import DAY, MEASURES, PLAYS, VIEW_COUNT
from earshot.session import work_folder, written
from earshot.sources import catalog, fixtures as fx, listens as store, payloads
from earshot.sources.library import publish_library, read_snapshot
from earshot.streaming import listens as streaming

SEPARATOR = r"'(?i)\s*(?:;|,\s+|\s+(?:feat\.?|ft\.?|featuring)\s+)\s*'"


def _deleted(spark, sf):
    """The recently deleted list: the files of one album."""
    return fx.library(spark, sf).filter(F.col("album_id") == "al-Brand#13").select("id")


def _library(op, *args, **kw):
    return lambda spark, sf: op(fx.library(spark, sf), *args, **kw)


def _middle_of_library(spark, sf):
    """The page in the middle of the tracks by artist."""
    files = fx.library(spark, sf)
    tracks = storage.storage_tracks(files).count()
    return storage.storage_page(files, "tracks", sort="artist", page=tracks // 20 + 1, limit=10, last_page=None)


def _match_key(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]', '', 'g')"


def _catalog_key(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]', '', 'g')"


def _clean_recording(x: str, extra: str = "") -> str:
    markers = rf"[\[(](?:official(?: music)?(?: video| audio)?|lyrics?|audio|visualizer{extra})[^\])]*[\])]"
    tail = r"\s*[\[(]?\s*\b(?:feat\.?|ft\.?|featuring)\s+.*$"
    return f"regexp_replace(regexp_replace({x}, '{markers}', '', 'gi'), '{tail}', '', 'i')"


CREDITED = f"""id in (select id from file_artists where artist_id = '{ARTIST_ID}')"""
ARTIST_FILES = """select min(a.name) as name, min(a.name) as artist, '' as album, count(*) as tracks,
 cast(sum(m.size) as bigint) as bytes, a.artist_id as id, min(m.album_id) as album_id, max(m.updated_at) as updated_at
 from media_file m join file_artists a on a.id = m.id where not m.missing"""
ALBUM_FILES = """select album as name, album_artist as artist, album, count(*) as tracks, cast(sum(size) as bigint) as bytes,
 album_id as id, album_id, max(updated_at) as updated_at from media_file where not missing"""
TRACK_FILES = """select title as name, artist, album, album_id, duration, track_number, size as bytes, id, updated_at
 from media_file where not missing"""
SHARE = "floor(cast(bytes as double) * 1000 / cast((select sum(size) from media_file where not missing) as double) + 0.5) / 10"
ENRICHED_COLUMNS = """event_id, user_name, received_at, track_name, artist_name, album_name, event_type, track_id, album_id,
 artist_id, duration, genre, tier"""

STORAGE = {
    "storage_artists": (_library(storage.storage_artists), f"{ARTIST_FILES} group by a.artist_id"),
    "storage_artists_search": (
        _library(storage.storage_artists, Selection(query="0007")),
        f"""select * from ({ARTIST_FILES} and m.artist ilike '%0007%' group by a.artist_id)
        where name ilike '%0007%'""",
    ),
    "storage_albums": (_library(storage.storage_albums), f"{ALBUM_FILES} group by album_id, album, album_artist"),
    "storage_tracks": (
        _library(storage.storage_tracks, Selection(artist=ARTIST)), f"{TRACK_FILES} and {CREDITED}",
    ),
    "storage_summary": (
        _library(storage.storage_summary),
        """select count(*) as tracks, cast(coalesce(sum(size), 0) as bigint) as bytes,
        (select count(distinct a.artist_id) from file_artists a join media_file m on m.id = a.id where not m.missing) as artists,
        count(distinct album_id) as albums from media_file where not missing""",
    ),
    "storage_selection": (
        _library(storage.storage_selection, "tracks", Selection(query="ring", album_id="al-Brand#7")),
        """select count(*) as tracks, cast(coalesce(sum(size), 0) as bigint) as bytes from media_file
        where not missing and album_id = 'al-Brand#7'
        and (title ilike '%ring%' or artist ilike '%ring%' or album ilike '%ring%')""",
    ),
    "storage_page": (
        _library(storage.storage_page, "tracks", sort="recent", page=2, limit=25),
        f"""select *, (select count(*) from media_file where not missing) as total from ({TRACK_FILES})
        order by updated_at desc, lower(name), name, id limit 25 offset 25""",
    ),
    "storage_page_deep": (
        _middle_of_library,
        f"""with a as (select *, row_number() over (order by lower(artist), lower(name), name, id) as nth, count(*) over () as total from ({TRACK_FILES}))
        select * exclude (nth) from a where nth > total // 20 * 10 and nth <= total // 20 * 10 + 10""",
    ),
    "storage_artists_deleted": (
        lambda spark, sf: storage.storage_artists(fx.library(spark, sf), deleted=_deleted(spark, sf)),
        f"{ARTIST_FILES} and m.album_id <> 'al-Brand#13' group by a.artist_id",
    ),
    "storage_page_artists": (
        _library(storage.storage_page, "artists", sort="name", page=2, limit=4),
        f"""with a as ({ARTIST_FILES} group by a.artist_id) select *, (select count(*) from a) as total from a
        order by lower(name), name, id limit 4 offset 4""",
    ),
    "storage_page_albums": (
        _library(storage.storage_page, "albums", sort="size", page=1, limit=30),
        f"""with a as ({ALBUM_FILES} group by album_id, album, album_artist) select *, (select count(*) from a) as total
        from a order by bytes desc, lower(name), name, id, artist limit 30""",
    ),
    "largest_artists": (
        _library(storage.largest_artists),
        f"""with a as ({ARTIST_FILES} group by a.artist_id) select name, id, tracks, bytes, {SHARE} as share from a
        order by bytes desc, id limit 8""",
    ),
    "largest_albums": (
        _library(storage.largest_albums),
        f"""with a as ({ALBUM_FILES} group by album_id, album, album_artist)
        select name, artist, id, tracks, bytes, {SHARE} as share from a order by bytes desc, id, name, artist limit 8""",
    ),
    "album_tracklists": (
        _library(storage.album_tracklist, "al-Brand#7"),
        """select id as track_id, title as track_name, artist as artist_name, album as album_name, track_number, duration,
        album_id, artist_id from media_file where album_id = 'al-Brand#7'""",
    ),
    "artist_tracks": (
        _library(storage.artist_tracks, ARTIST),
        f"""select id as track_id, title as track_name, artist as artist_name, album as album_name, album_id, artist_id, duration
        from media_file where not missing and {CREDITED} order by title, id limit 50""",
    ),
}


def _parsed(spark, sf):
    return payloads.parse_listen_payloads(fx.listen_payloads(spark, sf))


def _exported(spark, sf):
    folder = work_folder(spark, "export")
    store.export_listens(fx.listens(spark, sf), folder)
    return store.read_export(spark, folder).drop("ts")


def _appended(spark, sf):
    folder = work_folder(spark, "append")
    store.append_listens(fx.listens(spark, sf), folder)
    return store.read_listens(spark, folder)


def _round_trip(spark, sf):
    """Store, export, and import the export into the same store."""
    folder = work_folder(spark, "round-trip")
    store.append_listens(fx.listens(spark, sf), f"{folder}/rows")
    store.export_listens(store.read_listens(spark, f"{folder}/rows"), f"{folder}/export")
    store.import_into(store.read_export(spark, f"{folder}/export"), f"{folder}/rows")
    return store.read_listens(spark, f"{folder}/rows")


def _imported(spark, sf):
    folder = work_folder(spark, "import")
    store.append_listens(fx.listens(spark, sf), folder)
    store.import_into(fx.import_batch(spark, sf), folder)
    return store.read_listens(spark, folder).drop("listen_date")


def _backfilled(spark, sf):
    folder = work_folder(spark, "backfill")
    store.append_listens(fx.listens_blank(spark, sf), folder)
    store.backfill_stored(spark, folder, fx.library(spark, sf))
    return store.read_listens(spark, folder).drop("listen_date")


def _ingested(spark, sf):
    folder = work_folder(spark, "ingest")
    streaming.ingest_listens(fx.listen_payloads(spark, sf), fx.library(spark, sf), folder)
    return store.read_listens(spark, folder)


STORED_SQL = """select id, user_name, track_name, artist_name, album_name, track_id, album_id, artist_id, duration, genre, event_type,
 ts, cast(ts as date) as listen_date from listens"""
INGESTED_SQL = """select row_number() over (order by received_at, user_name, track_name, artist_name, album_name, event_type, duration) as id,
 user_name, track_name, artist_name, album_name, track_id, album_id, artist_id, duration, genre, event_type, received_at as ts,
 cast(received_at as date) as listen_date from enriched"""

INGEST = {
    "ingest_listens": (_ingested, INGESTED_SQL),
    # An export has whole seconds.
    "import_export_round_trip": (_round_trip, STORED_SQL.replace(" ts,", " date_trunc('second', ts) as ts,")),
    "parse_listen_payloads": (
        _parsed,
        """select event_id, user_name, received_at, track_name, artist_name, album_name,
        cast(duration_ms as double) as duration_ms, event_type from parsed""",
    ),
    "enrich_listens": (
        lambda spark, sf: enrich.enrich_listens(_parsed(spark, sf), fx.library(spark, sf)),
        f"select {ENRICHED_COLUMNS} from enriched",
    ),
    "enrich_exact": (
        lambda spark, sf: enrich.enrich_exact(_parsed(spark, sf), fx.library(spark, sf)),
        f"select {ENRICHED_COLUMNS} from enriched where tier = 'exact'",
    ),
    "enrich_clean": (
        lambda spark, sf: enrich.enrich_tier(_parsed(spark, sf), fx.library(spark, sf), "clean"),
        f"select {ENRICHED_COLUMNS} from enriched where tier = 'clean'",
    ),
    "enrich_fuzzy": (
        lambda spark, sf: enrich.enrich_tier(_parsed(spark, sf), fx.library(spark, sf), "fuzzy"),
        f"select {ENRICHED_COLUMNS} from enriched where tier = 'fuzzy'",
    ),
    "backfill_listens": (
        lambda spark, sf: enrich.backfill_listens(fx.listens_blank(spark, sf), fx.library(spark, sf)),
        """select b.id, b.user_name, b.track_name, b.artist_name, b.album_name,
        case when b.album_id = '' and m.id is not null then m.id else b.track_id end as track_id,
        case when b.album_id = '' and m.id is not null then m.album_id else b.album_id end as album_id,
        case when b.album_id = '' and m.id is not null then m.artist_id else b.artist_id end as artist_id,
        case when b.album_id = '' and m.id is not null then m.duration else b.duration end as duration,
        case when b.album_id = '' and m.id is not null then m.genre else b.genre end as genre,
        b.event_type, b.ts, b.album_id = '' and m.id is not null as backfilled
        from blanked b left join exact_files e on e.title = b.track_name and e.artist = b.artist_name
        left join media_file m on m.id = e.id""",
    ),
    "backfill_report": (
        lambda spark, sf: enrich.backfill_report(fx.listens_blank(spark, sf), fx.library(spark, sf)),
        """select count(e.id) as backfilled, count(*) - count(e.id) as failed, count(*) as total
        from blanked b left join exact_files e on e.title = b.track_name and e.artist = b.artist_name
        where b.album_id = ''""",
    ),
    "resolve_tracks": (
        lambda spark, sf: enrich.resolve_tracks(
            fx.track_requests(spark, sf), fx.listens(spark, sf), fx.library(spark, sf)
        ),
        """with r as (select distinct track_name as track, artist_name as artist from parsed),
        h as (select track_name, artist_name, arg_max(row(track_id, album_id, artist_id, duration, genre), id) as v
          from listens where coalesce(track_id, '') <> '' group by track_name, artist_name)
        select r.track, r.artist, coalesce(v[1], m.id, '') as track_id, coalesce(v[2], m.album_id, '') as album_id,
         coalesce(v[3], m.artist_id, '') as artist_id, coalesce(v[4], m.duration, 0) as duration,
         coalesce(v[5], m.genre, '') as genre
        from r left join h on h.track_name = r.track and h.artist_name = r.artist
        left join exact_files e on e.title = r.track and e.artist = r.artist left join media_file m on m.id = e.id""",
    ),
    "import_listens": (
        lambda spark, sf: store.import_listens(fx.listens(spark, sf), fx.import_batch(spark, sf)),
        """with n as (select count(*) as n from events),
        b as (select l.* replace (l.duration + 1 as duration), l.id as pos from listens l
          union all select l.* replace (l.duration + 2 as duration), l.id + n.n as pos from listens l, n where event_type = 'view'),
        k as (select b.* replace (case when raw_type <> 'signup' then id + n.n // 2 end as id) from b, n),
        named as (select * from k where id is not null qualify row_number() over (partition by id order by pos desc) = 1),
        top as (select max(id) as top from (select id from listens union all select id from k)),
        fresh as (select k.* replace (top.top + row_number() over (order by pos) as id) from k, top where k.id is null)
        select id, user_name, track_name, artist_name, album_name, track_id, album_id, artist_id, duration, genre, event_type, ts
        from (select l.* from listens l anti join named on named.id = l.id
          union all select * exclude (pos) from named union all select * exclude (pos) from fresh)""",
    ),
    "export_listens": (
        _exported,
        """select id, user_name, track_name, artist_name, album_name, track_id, album_id, artist_id, duration, genre, event_type,
        timestamp from listens""",
    ),
    "append_listens": (
        _appended,
        """select id, user_name, track_name, artist_name, album_name, track_id, album_id, artist_id, duration, genre, event_type,
        ts, cast(ts as date) as listen_date from listens""",
    ),
}

MATCHING = {
    "mark_owned": (
        lambda spark, sf: matching.mark_owned(fx.catalog(spark, sf), fx.library(spark, sf)),
        f"""with c as (select id, 'song' as kind, title, coalesce(own_artist, '') as artist from songs
          union all select distinct concat('rec-', album_id), 'album', upper(album), artist from media_file),
        f as (select 'song' as kind, {_match_key('artist')} as a, {_match_key('title')} as t, id, album_id
            from media_file where not missing
          union all select 'album', {_match_key('artist')}, {_match_key('album')}, id, album_id from media_file where not missing),
        o as (select kind, a, t, max(id) as local_id, arg_max(album_id, id) as local_album_id from f group by 1, 2, 3)
        select c.*, o.local_id, o.local_album_id from c
        left join o on o.kind = c.kind and o.a = {_match_key('c.artist')} and o.t = {_match_key('c.title')}""",
    ),
    "match_legacy_titles": (
        lambda spark, sf: matching.match_legacy_titles(fx.legacy_titles(spark, sf), fx.library(spark, sf)),
        f"""with t as (select distinct track_name, person, title from legacy),
        n as (select m.*, unnest(string_split_regex(m.artist, {SEPARATOR})) as name from media_file m where not missing),
        k as (select {_match_key('name')} as a, {_match_key('title')} as t, min(id) as id from n group by 1, 2)
        select t.track_name, k.id as file_id, m.title, m.artist, m.album_id
        from t join k on k.a = {_match_key('t.person')} and k.t = {_match_key('t.title')} join media_file m on m.id = k.id""",
    ),
    "match_catalog": (
        lambda spark, sf: matching.match_catalog(fx.wanted_recordings(spark, sf), fx.recording_candidates(spark, sf)),
        f"""with w as (select distinct concat(event_type, '|', track_name, '|', artist_name) as wanted_id, track_name,
           artist_name, event_type from listens),
        p as (select credit, list_transform(names, lambda n: {_catalog_key('n')}) as keys from credit_names),
        r as (select w.wanted_id, p.keys, case when event_type = 'view' and not list_contains(keys, {_catalog_key('artist_name')})
             then concat(artist_name, ' - ', track_name) else track_name end as title
          from w join p on p.credit = w.artist_name),
        c as (select id, has_cover_art as song, file_key, {_catalog_key('album_artist')} as a, {_catalog_key('title')} as t,
           {_catalog_key("concat(album_artist, ' - ', title)")} as whole from media_file)
        select r.wanted_id, arg_min(c.id, row(not c.song, c.file_key)) as id,
         case when arg_min(c.song, row(not c.song, c.file_key)) then 'songs' else 'videos' end as source,
         concat('https://i.ytimg.com/', arg_min(c.id, row(not c.song, c.file_key))) as image
        from r join c on list_contains(r.keys, c.a) and c.t = {_catalog_key('r.title')} group by r.wanted_id""",
    ),
    "match_artist_exact": (
        lambda spark, sf: matching.match_artist_exact(
            fx.artist_names(spark, sf), fx.artist_candidates(spark, sf)
        ),
        f"""with q as (select artist as name from media_file union select lower(c_name) from customer),
        a as (select s_suppkey as pos, concat('ar-', cast(s_suppkey as varchar)) as id, s_name as name from supplier
          union all select c_custkey + 1000000000, concat('cu-', cast(c_custkey as varchar)), c_name from customer),
        c as (select {_catalog_key('name')} as k, arg_min(id, pos) as id from a group by 1)
        select q.name, c.id, concat('https://i.ytimg.com/', c.id) as image from q join c on c.k = {_catalog_key('q.name')}""",
    ),
    "unheard": (
        lambda spark, sf: recommend.unheard(fx.library(spark, sf), fx.listens(spark, sf)).select("id", "title", "artist"),
        """select id, title, artist from media_file m
        where not exists (select 1 from listens l where l.track_name = m.title and l.artist_name = m.artist)""",
    ),
    "describe_covers": (
        lambda spark, sf: artwork.describe_covers(_cover_ids(spark, sf), fx.library(spark, sf), _old_listens(spark, sf)),
        f"""with n as (select m.*, unnest(string_split_regex(m.artist, {SEPARATOR})) as name from media_file m where not missing),
        k as (select {_match_key('name')} as a, {_match_key('title')} as t, min(id) as id from n group by 1, 2),
        h as (select track_id, arg_min(row(track_name, person, title), id) as l from legacy group by track_id),
        byid as (select cover_id, min(id) as id from (select id as cover_id, id from media_file
          union all select album_id, id from media_file) group by cover_id)
        select byid.cover_id, 'song' as kind, m.title as name, m.artist, concat('cover:', byid.cover_id) as key,
         m.album_id as native_id, m.has_cover_art as has_art from byid join media_file m on m.id = byid.id
        union all
        select h.track_id, 'song', coalesce(m.title, h.l[1]), coalesce(m.artist, 'Uploads'), concat('cover:', h.track_id),
         coalesce(m.album_id, h.track_id), true
        from h left join k on k.a = {_match_key('h.l[2]')} and k.t = {_match_key('h.l[3]')} left join media_file m on m.id = k.id
        union all
        select distinct artist_id, 'artist', lower(artist_name), null, concat('artist:', lower(artist_name)), null,
         cast(null as boolean) from credits where credit in (select artist from media_file)
        union all
        select distinct concat('cover-', rtrim(translate(to_base64(encode(concat('{{"kind":"song","name":"', title,
          '","artist":"', artist, '"}}'))), '+/', '-_'), '=')), 'song', title, artist,
         concat('cover:cover-', rtrim(translate(to_base64(encode(concat('{{"kind":"song","name":"', title,
          '","artist":"', artist, '"}}'))), '+/', '-_'), '=')), null, false from media_file""",
    ),
    "cover_ids": (
        lambda spark, sf: artwork.with_cover_id(
            fx.listens_blank(spark, sf).select("id", "track_name", "artist_name", "album_name", "track_id", "album_id")
        ),
        """select id, track_name, artist_name, album_name, track_id, album_id, case when album_id = '' and track_id = '' then
        concat('cover-', rtrim(translate(to_base64(encode(concat('{"kind":"song","name":"', track_name,
            '","artist":"', artist_name, '"}'))), '+/', '-_'), '=')) end as cover_id from blanked""",
    ),
    "artwork_worklist": (
        lambda spark, sf: artwork.artwork_worklist(fx.listens_blank(spark, sf), fx.library(spark, sf)),
        """with people as (select artist_id, min(artist_name) as name from credits
           where artist_name <> 'Unknown' and credit in (select artist_name from listens
             union select artist from media_file where not missing) group by artist_id),
        bare as (select album_id, min(row(id, title, artist)) as f from media_file where not missing and not has_cover_art group by album_id),
        g as (select track_name, artist_name, album_name, max(track_id) as track_id, max(album_id) as album_id
          from blanked group by track_name, artist_name, album_name),
        byid as (select cover_id, min(id) as id from (select id as cover_id, id from media_file
          union all select album_id, id from media_file) group by cover_id),
        heard as (select distinct byid.cover_id, byid.id from g join byid on byid.cover_id = coalesce(nullif(g.album_id, ''), nullif(g.track_id, ''))),
        lost as (select distinct concat('cover-', rtrim(translate(to_base64(encode(concat('{"kind":"song","name":"', track_name,
            '","artist":"', artist_name, '"}'))), '+/', '-_'), '=')) as cover_id, track_name, artist_name
          from g where album_id = '' and track_id = '')
        select concat('artist:', lower(name)) as key, 'artist' as kind, name, null as artist, null as native_id,
          cast(null as boolean) as has_art from people
        union all select concat('cover:', album_id), 'song', f[2], f[3], album_id, false from bare
        union all select concat('cover:', h.cover_id), 'song', m.title, m.artist, m.album_id, m.has_cover_art
          from heard h join media_file m on m.id = h.id where h.cover_id not in (select album_id from bare)
        union all select concat('cover:', cover_id), 'song', track_name, artist_name, null, false from lost""",
    ),
    "for_you": (
        lambda spark, sf: recommend.for_you(fx.listens(spark, sf), fx.library(spark, sf)),
        """with g as (select genre from listens where coalesce(genre, '') <> '' group by genre order by count(*) desc, genre limit 5),
        a as (select artist_id, genre, count(*) as n, min(artist_name) as artist_name from artist_listens
          where genre in (select genre from g) group by 1, 2)
        select min(artist_name) as artist_name, artist_id, arg_min(genre, row(-n, genre)) as genre,
         concat('Genre: ', arg_min(genre, row(-n, genre))) as reason
        from a group by artist_id order by sum(n) desc, artist_id limit 10""",
    ),
    "discover_unheard": (
        lambda spark, sf: recommend.discover_unheard(fx.listens(spark, sf), fx.library(spark, sf)),
        """with r as (select artist_name, max(id) as last_id from listens group by 1 order by last_id desc limit 50),
        d as (select m.*, r.last_id, row_number() over (partition by m.artist order by md5(concat('42|', m.id)), m.id) as place
          from media_file m join r on r.artist_name = m.artist),
        f as (select * from d where place <= 5 and not exists (select 1 from listens l
            where l.track_name = d.title and l.artist_name = d.artist)
          qualify row_number() over (partition by title, artist order by place) = 1)
        select id as track_id, title as track_name, artist as artist_name, album as album_name, album_id, artist_id, duration
        from f order by last_id desc, place limit 15""",
    ),
    "similar_artists": (
        _library(recommend.similar_artists, ARTIST),
        f"""with s as (select distinct lower(genre) as g from media_file where artist = '{ARTIST}' and genre <> ''),
        o as (select artist, count(*) as n, min(genre) as genre from media_file m where artist <> '{ARTIST}' and genre <> ''
          and exists (select 1 from s where contains(lower(m.genre), s.g)) group by artist order by n desc, artist limit 8),
        p as (select n, artist, genre, string_split_regex(artist, {SEPARATOR}) as names from o),
        q as (select n, artist, genre, unnest(names) as name, unnest(range(len(names))) as pos from p),
        d as (select n, artist, genre, arg_max(name, pos) as name, min(pos) as pos from q where name <> ''
          group by n, artist, genre, lower(name)),
        t as (select *, row_number() over (order by n desc, artist, pos) as nth from d where lower(name) <> lower('{ARTIST}'))
        select arg_max(name, nth) as artist_name,
         concat('artist-', rtrim(translate(to_base64(encode(lower(name))), '+/', '-_'), '=')) as artist_id,
         arg_max(genre, nth) as genre from t group by lower(name) order by min(nth) limit 8""",
    ),
    "at_this_hour": (
        lambda spark, sf: recommend.at_this_hour(fx.listens(spark, sf), fx.AS_OF),
        """select cast(5 as int) as hour, track_name, artist_name, min(album_name) as album_name, max(track_id) as track_id,
        max(album_id) as album_id, count(*) as play_count from listens where event_type = 'play' and hour(lts) = 5
        group by track_name, artist_name order by play_count desc, track_name, artist_name limit 10""",
    ),
}


def _cover_ids(spark, sf):
    """File, album, artist and old track ids, and encoded descriptions."""
    files = fx.library(spark, sf)
    nothing = F.lit("")
    encoded = cover_key(F.col("title"), nothing, F.col("artist"), nothing, nothing)
    everyone = files.select(F.col("artist").alias("artist_name"))
    people = credit_dimension_rows(credit_dimension(everyone, files)).select("artist_id")
    ids = files.select("id").union(files.select("album_id")).union(files.select(encoded)).union(people)
    return ids.union(fx.legacy_titles(spark, sf).select("track_id")).toDF("cover_id")


def _old_listens(spark, sf):
    return fx.legacy_titles(spark, sf)


CATALOG = {
    "normalize_catalog_songs": (
        lambda spark, sf: catalog.normalize_songs(fx.song_entries(spark, sf), kept=[]).drop("artists"),
        """select id, 'song' as kind, title, coalesce(own_artist, '') as artist, album, coalesce(own_album_id, '') as album_id,
        image, cast(duration as varchar) as duration, cast(duration as bigint) as duration_seconds, explicit,
        cast(null as varchar) as views, concat('https://www.youtube.com/watch?v=', id) as url,
        concat('https://www.youtube-nocookie.com/embed/', id) as embed_url, 'YouTube Music' as provider from songs""",
    ),
    "normalize_catalog_albums": (
        lambda spark, sf: catalog.normalize_albums(fx.release_entries(spark, sf), kept=[]).drop("artists"),
        """select strftime(o_orderdate, 'r%Y-%m-%d') as id, 'album' as kind, concat('Release ', cast(o_orderkey as varchar)) as title,
        '' as artist, '' as image, strftime(o_orderdate, '%Y') as year,
        case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'Single' else 'Album' end as type, 'YouTube Music' as provider
        from orders""",
    ),
    "normalize_catalog_artists": (
        lambda spark, sf: catalog.normalize_artists(fx.chart_artist_entries(spark, sf), kept=["country"]),
        """select country, id, 'artist' as kind, title, '' as image, subscribers, rank, cast(null as varchar) as trend,
        'YouTube Music' as provider from chart_people""",
    ),
    "normalize_spotify_tracks": (
        lambda spark, sf: catalog.normalize_second_provider(fx.second_provider_entries(spark, sf)),
        """select id, case when genre <> '' then title else album end as title,
        case when artist <> 'Unknown' then concat(album_artist, ', Guest') else 'Spotify' end as artist, album,
        case when not has_cover_art then '' when track_number > 10 then 'i1' else 'i0' end as image, '' as preview_url,
        case when track_number > 5 then concat('https://x/', id) else 'https://open.spotify.com/' end as url,
        updated_at as published_at, duration as popularity, 'Spotify' as provider from media_file""",
    ),
    "valid_catalog_rows": (
        lambda spark, sf: catalog.valid_catalog_rows(
            catalog.normalize_songs(fx.song_countries(spark, sf), kept=["country"])
        ).select("country", "id", "image"),
        """select lower(n.country) as country, s.id, s.image from songs s
        join supplier p on concat('ar-', cast(p.s_suppkey as varchar)) = s.page_artist join nation_codes n on n.nation = p.s_nationkey
        where p.s_nationkey % 5 <> 0 and s.image like 'https://i.ytimg.com/%'""",
    ),
    "pick_chart": (
        lambda spark, sf: charts.pick_chart(fx.playlists(spark, sf)), """select country, playlist_id, title,
        concat('https://music.youtube.com/playlist?list=', playlist_id) as chart_url from picked""",
    ),
    "chart_artists": (
        lambda spark, sf: charts.chart_artists(fx.chart_artist_entries(spark, sf)).drop("kind", "image", "trend", "provider"),
        "select country, place, id, title, subscribers, rank from chart_people where place <= 30",
    ),
    "chart_songs": (
        lambda spark, sf: charts.chart_songs(fx.playlists(spark, sf), fx.playlist_tracks(spark, sf)).select(
            "country", "place", "id", "title", "artist"
        ),
        """select * from (select p.country, cast(row_number() over (partition by p.country order by s.pos, s.id) as int) as place,
          s.id, s.title, coalesce(s.own_artist, '') as artist from songs s join picked p on p.playlist_id = s.page_artist)
        where place <= 40""",
    ),
    "recent_releases": (
        lambda spark, sf: charts.recent_releases(fx.chart_artist_entries(spark, sf), fx.release_entries(spark, sf)).select(
            "country", "place", "id", "title", "artist", "year", "type"
        ),
        """with e as (select p.country, p.place as person, p.title as artist,
           case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'singles' else 'albums' end as section, o.*
          from orders o join chart_people p on p.id = concat('c', cast(o.o_custkey as varchar)) where p.place <= 5),
        n as (select *, row_number() over (partition by country, person, section order by o_orderkey) as nth from e),
        f as (select *, strftime(o_orderdate, 'r%Y-%m-%d') as id, row_number() over (partition by country
            order by person, section, nth) as listed from n where nth <= 5),
        d as (select country, id, min(listed) as first, arg_max(row(concat('Release ', cast(o_orderkey as varchar)), artist,
            strftime(o_orderdate, '%Y'), case when section = 'singles' then 'Single' else 'Album' end), listed) as v
          from f group by country, id),
        r as (select country, cast(row_number() over (partition by country order by v[3] desc, first) as int) as place, id,
           v[1] as title, v[2] as artist, v[3] as year, v[4] as type from d)
        select * from r where place <= 30""",
    ),
    "search_bundle": (
        lambda spark, sf: charts.search_bundle(fx.search_results(spark, sf)),
        """with a as (
          select genre as query, 'song' as kind, pos, id, title, coalesce(own_artist, '') as artist, 30 as most from songs
          union all select distinct genre, 'artist', cast(substring(artist_id, 4) as bigint), artist_id, album_artist, album_artist, 8
            from media_file where genre <> ''
          union all select distinct genre, 'album', cast(regexp_extract(album_id, '#(\\d+)', 1) as bigint), album_id,
            concat('Album ', album_id), '', 12 from media_file where genre <> ''),
        p as (select *, cast(row_number() over (partition by query, kind order by pos, id) as int) as place from a)
        select query, kind, place, id, title, artist from p where place <= most""".replace("\\\\", "\\"),
    ),
    "artist_page": (
        lambda spark, sf: charts.artist_page(fx.artist_heads(spark, sf), fx.artist_entries(spark, sf)),
        r"""with n as (select count(*) as n from supplier),
        a as (select page_artist as page_id, 'songs' as section,
            case when cast(substring(page_artist, 4) as bigint) % 3 = 0 then 1000000 - pos else pos end as pos, 'song' as kind, id, title,
            coalesce(own_artist, album_artist) as artist, 30 as most from songs
          union all select distinct m.artist_id, 'related', s.s_suppkey, 'artist', concat('ar-', cast(s.s_suppkey as varchar)),
            s.s_name, s.s_name, 12 from media_file m, n, supplier s where s.s_suppkey = (m.file_key * 7 + 3) % n.n),
        p as (select *, row_number() over (partition by page_id, section order by pos, id) as place from a)
        select page_id, section, pos, kind, id, title, artist from p where place <= most
        union all select distinct artist_id, case when cast(regexp_extract(album_id, '#(\d+)', 1) as int) > 20
            then 'singles' else 'albums' end, cast(regexp_extract(album_id, '#(\d+)', 1) as bigint), 'album', album_id,
          concat('Album ', album_id), album_artist from media_file""",
    ),
    "artist_page_heads": (
        lambda spark, sf: fx.artist_heads(spark, sf),
        """select concat('ar-', cast(s_suppkey as varchar)) as page_id, 'artist' as kind, '' as image, '' as description,
        s_name as title, cast(s_nationkey as varchar) as subscribers from supplier""",
    ),
    "album_page_heads": (
        lambda spark, sf: fx.album_heads(spark, sf).drop("artists"),
        """select album_id as page_id, 'album' as kind, 'https://yt3.ggpht.com/cover' as image, '' as description,
        concat('Album ', album_id) as title, 'Various, Guest' as artist, substring(min(updated_at), 1, 7) as year
        from media_file group by album_id""",
    ),
    "album_page": (
        lambda spark, sf: charts.album_page(fx.album_heads(spark, sf), fx.album_page_tracks(spark, sf)).select(
            "page_id", "pos", "id", "title", "artist", "album", "album_id", "image"
        ),
        """select page_album as page_id, pos, id, title, coalesce(own_artist, 'Various, Guest') as artist,
        case when own_album_id is not null then album else concat('Album ', page_album) end as album, page_album as album_id, image
        from songs""",
    ),
}


def _stored_in_parts(spark, sf):
    """The listens as two commits of one store."""
    folder = work_folder(spark, "parts")
    for part in (0, 1):
        store.append_listens(fx.listens(spark, sf).filter(F.col("id") % 2 == part), folder, f"part-{part}")
    return folder


def _over_store(op, *args, **kw):
    return lambda spark, sf: op(spark, _stored_in_parts(spark, sf), *args, **kw)


def _compacted(spark, sf):
    """Half of the listens as a stream, half as a batch, into one store whose closed days are then put together."""
    folder = work_folder(spark, "compacted")
    streamed = fx.stream_of_listens(spark, sf).filter(F.col("id") % 2 == 0)
    _run(streaming.stream_append(streamed, f"{folder}/rows", f"{folder}/state", True))
    store.append_listens(fx.listens(spark, sf).filter(F.col("id") % 2 == 1), f"{folder}/rows")
    store.compact(spark, f"{folder}/rows", date(2024, 1, 25))
    return store.read_listens(spark, f"{folder}/rows")


def _day_sums(spark, folder):
    """Rows and measures of a store by day and genre, from what its commits add up to."""
    return store.read_days(spark, folder).groupBy("listen_date", "genre").agg(*add_up("views", "plays", "playtime", "n"))


def _sums_after_import(spark, sf):
    folder = _stored_in_parts(spark, sf)
    store.import_into(fx.import_batch(spark, sf), folder)
    return _day_sums(spark, folder)


def _sums_after_backfill(spark, sf):
    folder = work_folder(spark, "changed")
    store.append_listens(fx.listens_blank(spark, sf), folder)
    store.backfill_stored(spark, folder, fx.library(spark, sf))
    return _day_sums(spark, folder)


IMPORT_SQL, BACKFILL_SQL = INGEST["import_listens"][1], INGEST["backfill_listens"][1]
WRITTEN = {
    "import_written": (_imported, IMPORT_SQL),
    "backfill_written": (_backfilled, f"select * exclude (backfilled) from ({BACKFILL_SQL})"),
}


def _run(query):
    query.awaitTermination()


def _stream_enriched(spark, sf):
    folder = work_folder(spark, "stream-enrich")
    bodies = fx.as_payloads(fx.as_submissions(fx.stream_of_listens(spark, sf)))
    _run(streaming.stream_enrich(bodies, fx.library(spark, sf), f"{folder}/rows", f"{folder}/state", True))
    return streaming.read_batches(spark, f"{folder}/rows")


def _stream_appended(spark, sf):
    folder = work_folder(spark, "stream-append")
    _run(streaming.stream_append(fx.stream_of_listens(spark, sf), f"{folder}/rows", f"{folder}/state", True))
    return store.read_listens(spark, f"{folder}/rows")


def _stream_ingested(spark, sf):
    folder = work_folder(spark, "stream-ingest")
    bodies = fx.as_payloads(fx.as_submissions(fx.stream_of_listens(spark, sf)))
    _run(streaming.stream_ingest(bodies, fx.library(spark, sf), f"{folder}/rows", f"{folder}/state", True))
    return store.read_listens(spark, f"{folder}/rows")


def _mixed_appends(spark, sf):
    """Half of the listens as a stream, half as a batch, into one store."""
    folder = work_folder(spark, "mixed-appends")
    streamed = fx.stream_of_listens(spark, sf).filter(F.col("id") % 2 == 0)
    _run(streaming.stream_append(streamed, f"{folder}/rows", f"{folder}/state", True))
    store.append_listens(fx.listens(spark, sf).filter(F.col("id") % 2 == 1), f"{folder}/rows")
    return store.read_listens(spark, f"{folder}/rows")


def _landed(spark, sf):
    """Posted bodies as files, and the folder of a job over them."""
    folder = work_folder(spark, "landed")
    fx.listen_payloads(spark, sf).select("user_name", "received_at", "body").write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{folder}/bodies")
    return folder


def _stream_landed(spark, sf):
    """The store after a stream over landed files."""
    folder = _landed(spark, sf)
    bodies = payloads.read_bodies(spark, f"{folder}/bodies", stream=True)
    _run(streaming.stream_ingest(bodies, fx.library(spark, sf), f"{folder}/rows", f"{folder}/state", True))
    return store.read_listens(spark, f"{folder}/rows")


def _stream_live_library(spark, sf):
    """One stream: bodies of even listens come while the library is empty, those of odd ones after it was published."""
    folder = work_folder(spark, "live-library")
    payload_rows = fx.listen_payloads(spark, sf)
    payload_rows.filter("event_id % 2 = 0").write.parquet(f"{folder}/bodies")
    publish_library(fx.library(spark, sf).limit(0), f"{folder}/library")
    bodies = spark.readStream.schema(payload_rows.schema).parquet(f"{folder}/bodies")
    query = streaming.stream_enrich(bodies, streaming.LiveLibrary(f"{folder}/library"), f"{folder}/rows", f"{folder}/state")
    try:
        query.processAllAvailable()
        publish_library(fx.library(spark, sf), f"{folder}/library")
        payload_rows.filter("event_id % 2 = 1").write.mode("append").parquet(f"{folder}/bodies")
        query.processAllAvailable()
    finally:
        query.stop()
    return streaming.read_batches(spark, f"{folder}/rows")


def _snapshot(spark, sf):
    folder = work_folder(spark, "library")
    publish_library(fx.library(spark, sf).limit(0), folder)
    publish_library(fx.library(spark, sf), folder)
    return read_snapshot(spark, folder).select(*SNAPSHOT)


def _refreshed_credits(spark, sf):
    """The stored dimension after a refresh from the library and half of the history, and one from all of both."""
    folder = work_folder(spark, "credits")
    files, listens = fx.library(spark, sf), fx.listens(spark, sf)
    refresh_credits(spark, folder, listens.filter("id % 2 = 0"), files)
    refresh_credits(spark, folder, listens, files)
    return credit_dimension_rows(read_credits(spark, folder))


def _page_with_artists(spark, sf):
    """A page of tracks with the artists of each row."""
    page = storage.with_split_artists(storage.storage_page(fx.library(spark, sf), "tracks", sort="name", page=2, limit=40))
    return page.select("id", "name", "artist", F.array_join(F.transform("artists", lambda a: a["name"]), " | ").alias("artists"))


def _bitmaps(heard):
    return distincts.day_bitmaps(heard, distincts.number_names(heard))


def _unique_counts_of_days(spark, sf):
    rows = fx.listens(spark, sf)
    heard = written(distincts.heard_names(rows, fx.library(spark, sf)), "heard-names")
    return distincts.unique_counts(_bitmaps(heard), rows.agg(F.count(F.lit(1))))


def _year_summary_of_days(spark, sf):
    rows = fx.listens_long(spark, sf)
    heard = written(distincts.heard_names(rows, fx.library(spark, sf)), "heard-names")
    return distincts.year_summary(rows, _bitmaps(heard), fx.AS_OF_LONG, YEAR)


def _stream_now_playing(spark, sf):
    folder = work_folder(spark, "stream-now-playing")
    _run(streaming.stream_now_playing(fx.stream_of_listens(spark, sf), f"{folder}/rows", f"{folder}/state", True))
    return streaming.read_now_playing(spark, f"{folder}/rows", fx.AS_OF, ttl=100_000)


def _stream_counters(spark, sf):
    folder = work_folder(spark, "stream-counters")
    _run(streaming.stream_counters(fx.stream_of_listens(spark, sf), fx.AS_OF, f"{folder}/rows", f"{folder}/state", True))
    return streaming.read_counters(spark, f"{folder}/rows")


SNAPSHOT = ["id", "title", "artist", "album", "album_id", "artist_id", "album_artist", "duration", "track_number", "size", "missing", "genre", "updated_at", "has_cover_art"]
UNKNOWN_YET = """select event_id, user_name, received_at, track_name, artist_name, album_name, event_type, '' as track_id, '' as album_id,
 '' as artist_id, cast(coalesce(floor(duration_ms / 1000 + 0.5), 0) as int) as duration, '' as genre, 'none' as tier from parsed where event_id % 2 = 0"""
STREAMING = {
    "stream_landed_bodies": (_stream_landed, INGESTED_SQL),
    "stream_live_library": (_stream_live_library, f"select {ENRICHED_COLUMNS} from enriched where event_id % 2 = 1 union all {UNKNOWN_YET}"),
    "stream_enrich": (_stream_enriched, f"select {ENRICHED_COLUMNS} from enriched"),
    "stream_append": (
        _stream_appended,
        """select id, user_name, track_name, artist_name, album_name, track_id, album_id, artist_id, duration, genre, event_type,
        ts, cast(ts as date) as listen_date from listens""",
    ),
    "stream_ingest": (_stream_ingested, INGESTED_SQL),
    "mixed_appends": (_mixed_appends, STORED_SQL),
    "stream_now_playing": (
        _stream_now_playing,
        f"""select * from (select id, track_name, artist_name, album_name, track_id, album_id, artist_id, duration, timestamp
          from listens where event_type = 'view' order by id desc limit 1)
        where timestamp >= epoch({NOW}) - 100000""",
    ),
    "stream_counters": (_stream_counters, f"select {DAY} as day, {MEASURES} from listens group by 1"),
}

FEED = """id, user_name, track_name, artist_name, album_name, track_id, album_id, artist_id, duration, event_type, timestamp"""
STORED = {
    "stored_recent": (_over_store(feeds.stored_recent, 120), f"select {FEED} from listens order by id desc limit 120"),
    "stored_now_playing": (_over_store(feeds.stored_now_playing, fx.AS_OF, ttl=100_000), STREAMING["stream_now_playing"][1]),
    "stored_summary_7d": (_over_store(rollups.stored_summary, fx.AS_OF, "7d"), f"select {MEASURES} from listens where ts >= {NOW} - interval 7 day"),
    "stored_summary_week": (_over_store(rollups.stored_summary, fx.AS_OF, "week"), f"select {MEASURES} from listens where ts >= timestamp '2024-01-28 18:30:00'"),
    "stored_daily": (
        _over_store(rollups.stored_daily, fx.AS_OF, 7),
        f"select {DAY} as day, {VIEW_COUNT}, {PLAYS} from listens where ts >= {NOW} - interval 7 day group by 1",
    ),
    "stored_heatmap": (
        _over_store(rollups.stored_daily, fx.AS_OF, 365),
        f"select {DAY} as day, {VIEW_COUNT}, {PLAYS} from listens where ts >= {NOW} - interval 365 day group by 1",
    ),
    "stored_growth": (
        _over_store(rollups.stored_growth, fx.AS_OF),
        f"""with m as (select strftime(lts, '%Y-%m') as month, {PLAYS} from listens group by 1)
        select month, plays, cast(sum(plays) over (order by month) as bigint) as cumulative from m""",
    ),
    "stored_moods": (
        _over_store(rollups.stored_moods, fx.AS_OF),
        f"""with c as (select {DAY} as day, genre, count(*) as plays from listens
          where ts >= {NOW} - interval 90 day and coalesce(genre, '') <> '' group by 1, 2)
        select day, genre, plays from c qualify row_number() over (partition by day order by plays desc, genre) = 1""",
    ),
    "stored_compacted": (_compacted, STORED_SQL),
    "unique_counts_of_days": (_unique_counts_of_days, STATS["unique_counts"][1]),
    "year_summary_of_days": (_year_summary_of_days, STATS["year_summary"][1]),
    "library_snapshot": (_snapshot, f"select {', '.join(SNAPSHOT)} from media_file"),
    "refreshed_credits": (_refreshed_credits, CREDITS_SQL),
    "storage_page_artists_of_rows": (
        _page_with_artists,
        f"""with p as ({TRACK_FILES} order by lower(name), name, id limit 40 offset 40),
        s as (select id, unnest(parts) as x, generate_subscripts(parts, 1) as pos from (select id, string_split_regex(artist, {SEPARATOR}) as parts from p)),
        d as (select id, arg_max(x, pos) as x, min(pos) as first from s where x <> '' group by id, lower(x))
        select p.id, p.name, p.artist, string_agg(x, ' | ' order by first) as artists from p join d using (id) group by all""",
    ),
    "stored_sums_after_import": (
        _sums_after_import, f"select cast(ts as date) as listen_date, genre, {MEASURES}, count(*) as n from ({IMPORT_SQL}) group by 1, 2",
    ),
    "stored_sums_after_backfill": (
        _sums_after_backfill, f"select cast(ts as date) as listen_date, genre, {MEASURES}, count(*) as n from ({BACKFILL_SQL}) group by 1, 2",
    ),
}

QUERIES = {**STORED, **STORAGE, **INGEST, **WRITTEN, **MATCHING, **CATALOG, **STREAMING}
