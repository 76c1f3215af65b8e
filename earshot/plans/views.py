"""The derived tables in SQL, as common table expressions for the cross-check engine."""

from __future__ import annotations

VIEWS = {
    "media_file": """
select concat('t', cast(p.p_partkey as varchar)) as id, p.p_name as title,
 case when p.p_partkey % 11 = 0 then 'Unknown'
      when p.p_partkey % 5 = 0 then concat(s1.s_name, ', ', s2.s_name)
      when p.p_partkey % 7 = 0 then concat(s1.s_name, ' feat. ', s2.s_name)
      when p.p_partkey % 13 = 0 then concat(s1.s_name, '; ', upper(s1.s_name))
      else s1.s_name end as artist,
 case when p.p_partkey % 17 = 0
      then concat('{"artist":[{"name":"', s1.s_name, '"},{"name":"', s2.s_name, '"}]}') end as participants,
 case when p.p_partkey % 11 = 0 then 'Unknown' else p.p_brand end as album,
 concat('al-', p.p_brand) as album_id, concat('ar-', cast(s1.s_suppkey as varchar)) as artist_id,
 s1.s_name as album_artist, p.p_size * 10 as duration, cast(p.p_partkey % 20 + 1 as int) as track_number,
 cast(round(p.p_retailprice * 100) as bigint) as size, p.p_partkey % 19 = 0 as missing,
 case when p.p_partkey % 9 = 0 then '' else p.p_type end as genre,
 concat('2024-', lpad(cast(p.p_partkey % 12 + 1 as varchar), 2, '0'), '-01 00:00:00') as updated_at,
 p.p_partkey % 6 <> 0 as has_cover_art, p.p_partkey as file_key
from part p
cross join (select count(*) as n from supplier) c
join supplier s1 on s1.s_suppkey = p.p_partkey % c.n
join supplier s2 on s2.s_suppkey = (p.p_partkey * 7 + 3) % c.n""",
    "listens": """
select e.event_id as id, concat('u', cast(e.user_id as varchar)) as user_name, m.title as track_name,
 m.artist as artist_name, m.album as album_name, m.id as track_id, m.album_id, m.artist_id,
 cast(floor(e.value) as int) as duration, m.genre,
 case when e.event_type in ('view', 'click') then 'view' else 'play' end as event_type, e.ts,
 e.ts + interval 19800 second as lts, cast(floor(epoch(e.ts)) as bigint) as timestamp, e.event_type as raw_type
from events e
cross join (select count(*) as n from part) c
join media_file m on m.id = concat('t', cast((e.event_id * e.event_id * 31 + e.user_id * 17)
   % cast(floor(c.n * 0.6) as bigint) as varchar))""",
    "listens_long": """
select concat('u', cast(o.o_custkey as varchar)) as user_name, m.title as track_name, m.artist as artist_name,
 m.album as album_name, m.id as track_id, m.album_id, m.artist_id, cast(l.l_quantity * 10 as int) as duration, m.genre,
 case when l.l_returnflag = 'R' then 'view' else 'play' end as event_type, l.l_shipdate as ts,
 l.l_shipdate + interval 19800 second as lts
from lineitem l join orders o on o.o_orderkey = l.l_orderkey
join media_file m on m.id = concat('t', cast(l.l_partkey as varchar))""",
    # one row per credit and artist; participants first, then separators; last spelling, first position
    "credit_names": r"""
select credit, string_split_regex(credit, '(?i)\s*(?:;|,\s+|\s+(?:feat\.?|ft\.?|featuring)\s+)\s*') as names
from (select artist as credit from media_file union select artist_name from listens)""",
    "tags": """
select artist as credit, min(participants) as tag from media_file
where not missing and participants is not null group by artist""",
    "credit_pieces": """
select c.credit, unnest(case when t.tag is not null
   then [json_extract_string(t.tag, '$.artist[0].name'), json_extract_string(t.tag, '$.artist[1].name')]
   else c.names end) as name,
 unnest(range(case when t.tag is not null then 2 else len(c.names) end)) as pos
from credit_names c left join tags t on t.credit = c.credit""",
    "credits": """
select credit, arg_max(name, pos) as artist_name, min(pos) as pos,
 concat('artist-', rtrim(translate(to_base64(encode(lower(name))), '+/', '-_'), '=')) as artist_id
from credit_pieces where name <> '' group by credit, lower(name)""",
    "artist_listens": """
select l.* exclude (artist_name, artist_id), l.artist_name as original_artist_name, c.artist_name, c.artist_id
from listens l join credits c on c.credit = l.artist_name""",
    "artist_listens_long": """
select l.* exclude (artist_name, artist_id), l.artist_name as original_artist_name, c.artist_name, c.artist_id
from listens_long l join credits c on c.credit = l.artist_name""",
    # storage splits the row's own tags
    "file_artists": r"""
select id, arg_max(name, pos) as name,
 concat('artist-', rtrim(translate(to_base64(encode(lower(name))), '+/', '-_'), '=')) as artist_id, min(pos) as pos
from (select id, unnest(names) as name, unnest(range(len(names))) as pos from (
   select id, case when participants is not null
     then [json_extract_string(participants, '$.artist[0].name'), json_extract_string(participants, '$.artist[1].name')]
     else string_split_regex(artist, '(?i)\s*(?:;|,\s+|\s+(?:feat\.?|ft\.?|featuring)\s+)\s*') end as names
   from media_file))
where name <> '' group by id, lower(name)""",
    "raw_listens": """
select l.id as event_id, l.user_name, l.ts as received_at,
 case when l.event_type = 'view' then 'playing_now' else 'single' end as listen_type,
 case l.id % 4 when 0 then l.track_name when 1 then concat(l.track_name, ' (Remaster) [HD]')
   when 2 then substring(l.track_name, 2, 40) else concat('zz ', l.track_name) end as track_name,
 nullif(l.artist_name, 'Unknown') as artist_name, nullif(l.album_name, 'Unknown') as release_name,
 case when l.id % 3 = 0 then null else l.duration * 1000 + 500 end as duration_ms, l.timestamp
from listens l""",
    # parsed payloads
    "parsed": """
select event_id, user_name, received_at, track_name, coalesce(artist_name, 'Unknown') as artist_name,
 coalesce(release_name, 'Unknown') as album_name, duration_ms,
 case when listen_type = 'playing_now' then 'view' else 'play' end as event_type from raw_listens""",
    "exact_files": """
select title, artist, min(id) as id from media_file group by title, artist""",
    "resolved": r"""
select p.track_name, p.artist_name, e.id as exact_id, c.id as clean_id,
 case when e.id is null and c.id is null then (select min(f.id) from media_file f where f.artist = p.artist_name
   and contains(lower(f.title), lower(substring(p.track_name, 1, 50)))) end as fuzzy_id
from (select distinct track_name, artist_name,
   trim(regexp_replace(regexp_replace(regexp_replace(track_name, '\s*\(.*?\)\s*', '', 'g'), '\s*\[.*?\]\s*', '', 'g'),
     '\s*feat\..*', '', 'i')) as cleaned from parsed) p
left join exact_files e on e.title = p.track_name and e.artist = p.artist_name
left join exact_files c on c.title = p.cleaned and c.artist = p.artist_name and p.cleaned <> p.track_name""",
    "enriched": """
select p.event_id, p.user_name, p.received_at, p.track_name, p.artist_name, p.album_name, p.event_type,
 coalesce(m.id, '') as track_id, coalesce(m.album_id, '') as album_id, coalesce(m.artist_id, '') as artist_id,
 cast(coalesce(nullif(m.duration, 0), cast(floor(p.duration_ms / 1000 + 0.5) as int), 0) as int) as duration,
 coalesce(m.genre, '') as genre,
 case when r.exact_id is not null then 'exact' when r.clean_id is not null then 'clean'
      when r.fuzzy_id is not null then 'fuzzy' else 'none' end as tier
from parsed p join resolved r on r.track_name = p.track_name and r.artist_name = p.artist_name
left join media_file m on m.id = coalesce(r.exact_id, r.clean_id, r.fuzzy_id)""",
    "blanked": """
select id, user_name, track_name, artist_name, album_name, case when id % 3 = 0 then '' else track_id end as track_id,
 case when id % 3 = 0 then '' else album_id end as album_id, case when id % 3 = 0 then '' else artist_id end as artist_id,
 cast(case when id % 3 = 0 then 0 else duration end as int) as duration,
 case when id % 3 = 0 then '' else genre end as genre, event_type, ts from listens""",
    "legacy": """
select id, concat(artist_name, ' - ', track_name, ' (Audio)') as track_name, artist_name as person, track_name as title,
 concat('old-', track_id) as track_id from listens""",
    # catalog songs after normalisation
    "songs": """
select concat('v', lpad(cast(file_key as varchar), 9, '0')) as id, title,
 case when artist <> 'Unknown' then album_artist end as own_artist, album, case when has_cover_art then album_id end as own_album_id,
 album_id as page_album, artist_id as page_artist, album_artist, genre, file_key as pos, duration, track_number > 15 as explicit,
 case genre when 'LARGE' then 'http://i.ytimg.com/a.jpg' when 'SMALL' then 'https://notytimg.com/a.jpg'
   else concat('https://i.ytimg.com/t', cast(file_key as varchar)) end as image
from media_file where genre <> '' and not missing""",
    "nation_codes": """
select cast(i as int) as nation, ['ZZ','AR','AU','AT','BE','BO','BR','CA','CL','CO','CR','CZ','DK','DO','EC','EG','SV','EE',
 'FI','FR','DE','GT','HN','HK','HU'][i + 1] as country from range(25) r(i)""",
    "lists": """
select n.country, s.s_suppkey as pos, concat('ar-', cast(s.s_suppkey as varchar)) as playlist_id,
 concat(case when s_acctbal > 8000 then 'DAILY TOP MUSIC videos ' when s_acctbal > 5000 then 'Top 100 Music videos '
   when s_acctbal > 2000 then 'Trending ' else 'Mix ' end, s.s_name) as title,
 case when s_acctbal > 8000 then 0 when s_acctbal > 5000 then 1 when s_acctbal > 2000 then 2 end as kind
from supplier s join nation_codes n on n.nation = s.s_nationkey""",
    "picked": """
select country, playlist_id, title from lists where kind is not null
qualify row_number() over (partition by country order by kind, pos) = 1""",
    "chart_people": """
select n.country, cast(row_number() over (partition by n.country order by c.c_custkey) as int) as place,
 concat('c', cast(c.c_custkey as varchar)) as id, c.c_name as title, c.c_mktsegment as subscribers,
 cast(c.c_custkey as varchar) as rank
from customer c join nation_codes n on n.nation = c.c_nationkey""",
}

MEASURES = """cast(sum(case when event_type = 'view' then 1 else 0 end) as bigint) as views,
 cast(sum(case when event_type = 'play' then 1 else 0 end) as bigint) as plays,
 cast(sum(case when event_type = 'play' then duration else 0 end) as bigint) as playtime"""
PLAYS = "cast(sum(case when event_type = 'play' then 1 else 0 end) as bigint) as plays"
VIEW_COUNT = "cast(sum(case when event_type = 'view' then 1 else 0 end) as bigint) as views"
PLAYTIME = "cast(sum(case when event_type = 'play' then duration else 0 end) as bigint) as playtime"
DAY = "strftime(lts, '%Y-%m-%d')"


def _needed(text: str) -> list[str]:
    """Names of derived tables a statement reaches, in definition order."""
    import re

    wanted: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in VIEWS:
            if name in words and name not in wanted:
                wanted.add(name)
                todo.append(VIEWS[name])
    return [name for name in VIEWS if name in wanted]


def with_views(statement: str) -> str:
    """Prefix a statement with the derived tables it uses."""
    views = ",\n".join(f"{name} as ({VIEWS[name]})" for name in _needed(statement))
    statement = statement.strip()
    if not views:
        return statement
    if statement.lower().startswith("with "):
        return f"with {views},\n{statement[5:]}"
    return f"with {views}\n{statement}"
