"""Exact distinct counts that add up: names are numbered once, and each day keeps a bitmap of the numbers it heard.

Bitmaps of days, commits or tables are united by ``or``, so a count over any range of days reads bitmaps alone, and new days never touch old ones.
A bitmap row covers 32,768 numbers in 4 KB, whatever the number of listens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earshot.functions.measures import all_events, playtime, plays
from earshot.functions.text import blank
from earshot.functions.timecols import local_date
from earshot.operators.credits import by_artist
from earshot.operators.numbering import number_rows
from earshot.operators.topstats import known
from earshot.params import Clock, year_range
from earshot.session import written

#: What is counted: names as they are, and names that are known.
KINDS = ["track", "album", "artist", "known_track", "known_album", "known_artist"]


def heard_names(listens: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """day (UTC), kind and name, once each; artists by their ids, from split credits.

    The listens are read once, for the names of each day; a credit is split once, whatever the number of days that heard it.
    """
    text = F.lit(None).cast("string")
    raw_id = F.when(blank(F.col("artist_name")), F.col("artist_id"))
    listed = [("track", F.col("track_name"), text), ("album", F.col("album_name"), text), ("credit", F.col("artist_name"), raw_id)]
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), name.alias("name"), raw.alias("raw")) for kind, name, raw in listed])
    heard = listens.select(F.to_date("ts").alias("day"), F.explode(each).alias("x")).select("day", "x.*").distinct()
    heard = written(heard, "heard-by-day")

    def kinds(kind: Column, spelling: str) -> Column:
        """``kind``, and its known names' kind where ``spelling`` is one of them."""
        return F.explode(F.filter(F.array(kind, F.when(known(spelling), F.concat(F.lit("known_"), kind))), lambda x: x.isNotNull())).alias("kind")

    titles = heard.filter("kind <> 'credit'").select("day", kinds(F.col("kind"), "name"), "name")
    credits = heard.filter("kind = 'credit'").select("day", F.col("name").alias("credit"), "raw")
    split = credits.select("credit", "raw").distinct().withColumns({"artist_name": F.col("credit"), "artist_id": F.col("raw")})
    people = by_artist(split, library, [all_events("n")], extra=["credit", "raw"])
    people = people.select("credit", "raw", kinds(F.lit("artist"), "artist_name"), F.col("artist_id").alias("name")).distinct()
    same = credits["credit"].eqNullSafe(people["credit"]) & credits["raw"].eqNullSafe(people["raw"])
    artists = credits.join(people, same).select("day", "kind", "name").distinct()
    return titles.unionByName(artists).filter("name is not null")


def number_names(names: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """kind, name, number for every (kind, name) of ``names`` and of ``numbered``, whose numbers stay; new names are numbered on from 1."""
    new = names.select("kind", "name").distinct()
    top = 0
    if numbered is not None:
        new = new.join(numbered.select("kind", "name"), ["kind", "name"], "left_anti")
        top = numbered.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    # Written first, so that every reader sees one numbering.
    new = written(new.withColumn("_pos", F.monotonically_increasing_id()), "new-names")
    new = number_rows(new, "_pos", out="_nth").select("kind", "name", (F.col("_nth") + top).alias("number"))
    return new if numbered is None else numbered.select("kind", "name", "number").unionByName(new)


def day_bitmaps(heard: DataFrame, numbered: DataFrame) -> DataFrame:
    """day, kind, part and bits (the names of a part that the day heard) from ``heard_names`` and their numbers."""
    rows = heard.join(numbered, ["kind", "name"])
    part, bit = F.bitmap_bucket_number("number"), F.bitmap_bit_position("number")
    return rows.groupBy("day", "kind", part.alias("part")).agg(F.bitmap_construct_agg(bit).alias("bits"))


def distinct_counts(bitmaps: DataFrame) -> DataFrame:
    """kind and count over all days of ``bitmaps``."""
    united = bitmaps.groupBy("kind", "part").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    return united.groupBy("kind").agg(F.sum("n").alias("count"))


def _by_kind(bitmaps: DataFrame, kinds: dict[str, str]) -> list[Column]:
    """One scalar column for each of ``kinds``, 0 where nothing was heard."""
    counts = distinct_counts(bitmaps.filter(F.col("kind").isin(*kinds)))
    row = counts.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("count"))), F.lit(0)).alias(name) for kind, name in kinds.items()])
    return [row.select(name).scalar().alias(name) for name in kinds.values()]


def unique_counts(bitmaps: DataFrame, total: DataFrame) -> DataFrame:
    """``topstats.unique_counts``; ``total`` has one row and column, the number of listens."""
    kinds = {"known_artist": "artists", "known_album": "albums", "known_track": "tracks"}
    row = total.toDF("total").select(*_by_kind(bitmaps, kinds), "total")
    each = F.array(*[F.struct(F.lit(name).alias("type"), F.col(name).alias("count")) for name in row.columns])
    return row.select(F.explode(each).alias("x")).select("x.*")


def year_summary(listens: DataFrame, bitmaps: DataFrame, clock: Clock, year: int) -> DataFrame:
    """``yearly.year_summary``; the measures are added up by local day, which counts the days as well."""
    days = year_range(listens, year).groupBy(local_date(clock).alias("day")).agg(playtime(), plays())
    totals = days.agg(F.sum("playtime").alias("total_playtime"), F.sum("plays").alias("total_plays"), F.count("day").alias("active_days"))
    kinds = {"track": "unique_tracks", "artist": "unique_artists", "album": "unique_albums"}
    of_year = bitmaps.filter(F.year("day") == year)
    return totals.select("total_playtime", "total_plays", *_by_kind(of_year, kinds), "active_days")
