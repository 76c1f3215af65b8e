"""Finding the library file behind a listen.

The match depends only on (title, artist), so distinct pairs are resolved once, through three
tiers, and the listens join the outcome.  Where several files fit, the smallest id is taken.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from earshot.functions import constants as k
from earshot.functions.measures import round_half_up
from earshot.functions.text import blank, clean_listen_title
from earshot.operators.containment import smallest_containing
from earshot.operators.skew import skew_safe_left_join
from earshot.session import written

_PAIR = ["track_name", "artist_name"]

Keep = Callable[[DataFrame, str], DataFrame]


def _file() -> Column:
    return F.struct(F.col("id").alias("track_id"), "album_id", "artist_id", "duration", "genre")


@dataclass(frozen=True)
class Files:
    """The library as the cascade looks it up."""

    exact: DataFrame  # track_name, artist_name, file: one file per (title, artist)
    titles: DataFrame  # artist_name, text, id, file: one file per artist and lower-cased title


def exact_files(library: DataFrame) -> DataFrame:
    """One file per (title, artist)."""
    return library.groupBy(F.col("title").alias("track_name"), F.col("artist").alias("artist_name")).agg(
        F.min_by(_file(), "id").alias("file")
    )


def _same(df: DataFrame, purpose: str) -> DataFrame:
    return df


def keyed_files(library: DataFrame, keep: Keep = _same) -> Files:
    """Reduce the library to its keys; a caller that looks up again and again keeps the outcome."""
    exact = keep(exact_files(library), "exact-files")
    titles = exact.groupBy("artist_name", F.lower("track_name").alias("text")).agg(F.min_by("file", "file.track_id").alias("file"))
    return Files(exact, keep(titles.select("artist_name", "text", F.col("file.track_id").alias("id"), "file"), "title-files"))


def fuzzy_files(pairs: DataFrame, library: DataFrame | Files) -> DataFrame:
    """Files by the same artist whose title contains the start of the listen's title, any case."""
    files = library if isinstance(library, Files) else keyed_files(library)
    wanted = pairs.withColumn("needle", F.lower(F.substring("track_name", 1, k.FUZZY_PREFIX)))
    # Only the artists that are asked for.
    titles = files.titles.join(wanted.select("artist_name").distinct(), "artist_name", "left_semi")
    found = smallest_containing(wanted, titles.select("artist_name", "text", "id"), "artist_name", "id")
    file = titles.select("artist_name", "id", "file")
    return wanted.join(found, ["artist_name", "needle"]).join(file, ["artist_name", "id"]).select(*_PAIR, "file")


def resolve_pairs(pairs: DataFrame, library: DataFrame | Files, keep: Keep = written) -> DataFrame:
    """Distinct pairs with ``file`` and ``tier``: exact, clean, fuzzy or none.

    The outcome of the first two tiers is kept: the third tier and the final answer both start from
    it, and so do the row counts that may travel with the pairs.
    """
    keyed = library if isinstance(library, Files) else keyed_files(library)
    files = keyed.exact
    cleaned = clean_listen_title(F.col("track_name"))
    # Pairs the first tier settled, and titles that are clean already, get a key that no title has.
    no_title = F.concat(F.lit("\uffff"), F.col("track_name"))
    clean = F.when(F.col("_exact_file").isNull() & (cleaned != F.col("track_name")), cleaned).otherwise(no_title)
    by_clean = files.select(F.col("track_name").alias("_clean"), "artist_name", F.col("file").alias("_clean_file"))
    tried = pairs.join(files.withColumnRenamed("file", "_exact_file"), _PAIR, "left").withColumn("_clean", clean)
    tried = tried.join(by_clean, ["_clean", "artist_name"], "left").drop("_clean")
    tried = keep(tried, "resolved-pairs")
    open_pairs = tried.filter(F.col("_exact_file").isNull() & F.col("_clean_file").isNull()).select(*_PAIR)
    tried = tried.join(fuzzy_files(open_pairs, keyed).withColumnRenamed("file", "_fuzzy_file"), _PAIR, "left")
    tier = (
        F.when(F.col("_exact_file").isNotNull(), F.lit("exact"))
        .when(F.col("_clean_file").isNotNull(), F.lit("clean"))
        .when(F.col("_fuzzy_file").isNotNull(), F.lit("fuzzy"))
        .otherwise(F.lit("none"))
    )
    file = F.coalesce("_exact_file", "_clean_file", "_fuzzy_file")
    return tried.select(*pairs.columns, file.alias("file"), tier.alias("tier"))


def _with_file(listens: DataFrame, tier: Column) -> DataFrame:
    """Fill ids, genre and duration from ``file``; the submitted duration is the fallback."""
    known = F.nullif(F.col("file.duration"), F.lit(0))
    # What no file could last is as good as unknown.
    submitted = round_half_up(F.col("duration_ms") / 1000).try_cast("int")
    kept = [c for c in listens.columns if c not in ("file", "tier", "duration_ms")]
    return listens.select(
        *kept,
        *[F.coalesce(F.col(f"file.{c}"), F.lit("")).alias(c) for c in ("track_id", "album_id", "artist_id")],
        F.coalesce(known, submitted, F.lit(0)).cast("int").alias("duration"),
        F.coalesce("file.genre", F.lit("")).alias("genre"),
        tier.alias("tier"),
    )


def pair_counts(listens: DataFrame) -> DataFrame:
    return listens.groupBy(*_PAIR).agg(F.count(F.lit(1)).alias("n"))


def enrich_listens(listens: DataFrame, library: DataFrame | Files, keep: Keep = written) -> DataFrame:
    """The full cascade over parsed listens (``duration_ms`` from the payload).

    The listens are read several times: to count their distinct pairs, to take the files found, and by
    whoever sorts the outcome.  So they are parsed once and written to the shared folder, and so is what was found; a
    caller may ``keep`` them some other way.
    """
    listens = keep(listens, "parsed-listens")
    resolved = keep(resolve_pairs(pair_counts(listens), library, keep), "resolved-files")
    counts = resolved.select(*_PAIR, "n")
    return _with_file(skew_safe_left_join(listens, resolved.drop("n"), _PAIR, counts), F.col("tier"))


def enrich_exact(listens: DataFrame, library: DataFrame) -> DataFrame:
    """Listens the first tier settles, with their files."""
    found = skew_safe_left_join(listens, exact_files(library), _PAIR).filter(F.col("file").isNotNull())
    return _with_file(found, F.lit("exact"))


def enrich_tier(listens: DataFrame, library: DataFrame, tier: str) -> DataFrame:
    """Listens that a given tier of the cascade settles."""
    return enrich_listens(listens, library).filter(F.col("tier") == tier)


def backfill_listens(listens: DataFrame, library: DataFrame) -> DataFrame:
    """Give rows without album id the ids, duration and genre of an exact match."""
    return filled_from(listens, exact_files(library))


def filled_from(listens: DataFrame, files: DataFrame) -> DataFrame:
    """The same from files by (title, artist), as ``exact_files`` gives them."""
    lacking = blank(F.col("album_id"))
    open_rows = skew_safe_left_join(listens.filter(lacking), files, _PAIR)
    hit = F.col("file").isNotNull()
    filled = {
        c: F.when(hit, F.coalesce(F.col(f"file.{c}"), F.lit(0 if c == "duration" else ""))).otherwise(F.col(c))
        for c in ("track_id", "album_id", "artist_id", "duration", "genre")
    }
    open_rows = open_rows.withColumn("backfilled", hit).withColumns(filled).select(*listens.columns, "backfilled")
    return listens.filter(~lacking).withColumn("backfilled", F.lit(False)).unionByName(open_rows)


def backfill_report(listens: DataFrame, library: DataFrame) -> DataFrame:
    """How many rows lacked an album id, and how many of them an exact match helps.

    Rows are counted per pair before the lookup, so the fact itself is not joined.
    """
    lacking = pair_counts(listens.filter(blank(F.col("album_id"))))
    looked_up = lacking.join(exact_files(library), _PAIR, "left")
    found = F.when(F.col("file").isNotNull(), F.col("n")).otherwise(0)
    return looked_up.agg(
        F.coalesce(F.sum(found), F.lit(0)).alias("backfilled"),
        F.coalesce(F.sum(F.col("n") - found), F.lit(0)).alias("failed"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    )


def resolve_tracks(requests: DataFrame, listens: DataFrame, library: DataFrame) -> DataFrame:
    """(track, artist) requests: the latest listen with a track id, else an exact file, else blanks."""
    columns = ["track_id", "album_id", "artist_id", "duration", "genre"]
    pairs = requests.select("track", "artist").distinct()
    # A track that a third of all listens name is spread over many tasks.
    wanted = pairs.toDF(*_PAIR).withColumn("_wanted", F.lit(True))
    listens = skew_safe_left_join(listens.filter(~blank(F.col("track_id"))), wanted, _PAIR).filter("_wanted")
    track, by = F.col("track_name").alias("track"), F.col("artist_name").alias("artist")
    # Two passes: the first only keeps a number per group and therefore hashes instead of sorting.
    heard = listens.groupBy(track, by, *columns).agg(F.max("id").alias("id"))
    heard = heard.groupBy("track", "artist").agg(F.max_by(F.struct(*columns), "id").alias("_heard"))
    files = exact_files(library).select(
        F.col("track_name").alias("track"), F.col("artist_name").alias("artist"), F.col("file").alias("_file")
    )
    pairs = pairs.join(heard, ["track", "artist"], "left")
    pairs = pairs.join(files, ["track", "artist"], "left").withColumn("_hit", F.coalesce("_heard", "_file"))
    shown = [F.coalesce(F.col(f"_hit.{c}"), F.lit(0 if c == "duration" else "")).alias(c) for c in columns]
    return pairs.select("track", "artist", *shown)
