"""Credits as a relation: the dimension, the exploded listens, and pre-aggregated explosion.

Additive reports group by the raw credit first and split afterwards, so the text work and the
explosion run once per distinct credit instead of once per listen, and a dominant artist is
already reduced by map-side aggregation before anything is shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from earshot.functions import constants as k
from earshot.functions.credits import ARTISTS_TYPE, structured_names, with_artists
from earshot.functions.text import blank, credit_key, artist_id
from earshot.session import folder_at, written
from earshot.sources.library import visible, with_optional_columns


def library_participants(library: DataFrame) -> DataFrame:
    """One structured tag per credit of the visible library: most names, then smallest text."""
    tagged = (
        visible(with_optional_columns(library))
        .filter(F.col("participants").isNotNull())
        .select(F.col("artist").alias("credit"), "participants")
        .distinct()
        .withColumn("n", F.size(structured_names(F.col("participants"))))
        .filter("n > 1")
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), "participants"))
    return tagged.groupBy("credit").agg(best["participants"].alias("participants"))


def _split(rows: DataFrame, credit: str, library: DataFrame | None) -> DataFrame:
    if library is None:
        return with_artists(rows, credit)
    tags = library_participants(library).withColumnRenamed("credit", "_credit")
    return with_artists(rows.join(tags, rows[credit] == tags["_credit"], "left"), credit, "participants").drop(
        "_credit", "participants"
    )


def _credits(listens: DataFrame, library: DataFrame | None) -> DataFrame:
    """Every raw credit of the history and of the visible library."""
    credits = listens.select(F.col("artist_name").alias("credit"))
    if library is not None:
        credits = credits.union(visible(library).select(F.col("artist").alias("credit")))
    return credits.select(F.coalesce(F.nullif("credit", F.lit("")), F.lit(k.UNKNOWN)).alias("credit")).distinct()


def credit_dimension(listens: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """Every raw credit of the history and of the visible library, with its artists."""
    return _split(_credits(listens, library), "credit", library)


def credit_dimension_rows(dimension: DataFrame) -> DataFrame:
    """The dimension in first normal form: credit, position, artist_name, artist_id."""
    rows = dimension.select("credit", F.posexplode("artists").alias("position", "a"))
    return rows.select("credit", "position", F.col("a.name").alias("artist_name"), F.col("a.id").alias("artist_id"))


def _or_raw(artists: Column) -> Column:
    raw = F.array(F.struct(F.col("artist_name").alias("name"), F.col("artist_id").alias("id")))
    return F.when(blank(F.col("artist_name")), raw).otherwise(artists)


def artist_listens(listens: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """One row per listen and credited artist, with the credit kept as ``original_artist_name``.

    Credits without a name keep their raw name and id; a credit that splits to nothing vanishes.  Credits are split where they lie, so the
    history isn't shuffled: structured tags of a library, one row a credit, are the only thing to join.
    """
    rows = _split(listens, "artist_name", library)
    rows = rows.withColumn("a", F.explode(_or_raw(F.col("artists"))))
    replaced = {"artist_name": F.col("a.name"), "artist_id": F.col("a.id")}
    columns = [replaced[c].alias(c) if c in replaced else F.col(c) for c in listens.columns]
    return rows.select(*columns, F.col("artist_name").alias("original_artist_name"))


# -- the dimension as a stored table: <path>/generation=<n>/... , a credit's newest row counts -------------------------


def _credits_kept(spark: SparkSession, path: str) -> DataFrame:
    """credit, participants (the tag that decided) and artists, as last split."""
    rows = spark.read.schema(f"credit string, participants string, artists {ARTISTS_TYPE}, generation int").parquet(path)
    newest = F.max_by(F.struct("participants", "artists"), "generation").alias("row")
    return rows.groupBy("credit").agg(newest).select("credit", "row.participants", "row.artists")


def refresh_credits(spark: SparkSession, path: str, listens: DataFrame, library: DataFrame | None = None) -> int:
    """Bring the stored dimension up to ``credit_dimension(listens, library)`` and return its generation.

    Only credits that are not there yet, or whose structured tag has changed, are split and written, as the next generation; without any, nothing is
    written.  A generation is put in place whole, so a refresh that stopped may be repeated.
    """
    at, files = folder_at(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    last = max((int(n.removeprefix("generation=")) for n in names if n.startswith("generation=")), default=0)
    seen = _credits(listens, library).withColumn("participants", F.lit(None).cast("string"))
    if library is not None:
        seen = seen.drop("participants").join(library_participants(library), "credit", "left")
    if last:
        known = _credits_kept(spark, path).select(F.col("credit").alias("_credit"), F.col("participants").alias("_tag"))
        seen = seen.join(known, (F.col("credit") == F.col("_credit")) & F.col("participants").eqNullSafe(F.col("_tag")), "left_anti")
    seen = written(seen, "new-credits")
    if seen.isEmpty():
        return last
    staged = f"{path}/_new-{uuid.uuid4().hex}"
    with_artists(seen, "credit", "participants").select("credit", "participants", "artists").write.parquet(staged)
    source, target = folder_at(spark, staged)[0], folder_at(spark, f"{path}/generation={last + 1}")[0]
    if not files.rename(source, target):
        raise OSError(f"generation {last + 1} could not be put in place")
    return last + 1


def read_credits(spark: SparkSession, path: str) -> DataFrame:
    """The stored dimension: credit, artists.  It keeps credits that were seen once."""
    return _credits_kept(spark, path).drop("participants")


def by_artist(listens: DataFrame, library: DataFrame | None, aggs: list[Column], extra: list[str] | None = None) -> DataFrame:
    """Aggregate per raw credit (and ``extra`` keys), then one row per credited artist."""
    extra = extra or []
    raw_id = F.when(blank(F.col("artist_name")), F.col("artist_id")).alias("artist_id")
    per_credit = listens.groupBy("artist_name", raw_id, *extra).agg(*aggs)
    measures = [c for c in per_credit.columns if c not in ("artist_name", "artist_id", *extra)]
    split = _split(per_credit, "artist_name", library).withColumn("a", F.explode(_or_raw(F.col("artists"))))
    return split.select(F.col("a.name").alias("artist_name"), F.col("a.id").alias("artist_id"), *extra, *measures)


def distinct_artists(listens: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """Distinct (artist_id, smallest spelling) over all credits."""
    per_credit = by_artist(listens, library, [F.count(F.lit(1)).alias("n")])
    return per_credit.groupBy("artist_id").agg(F.min("artist_name").alias("artist_name"))


def credited_rows(listens: DataFrame, artist: str, library: DataFrame | None = None) -> DataFrame:
    """Listens whose credit includes exactly this artist.

    Credits are split once per distinct credit; those that include the artist are the small side of a semi join, which Spark
    broadcasts when it has measured them to be small.
    """
    credits = _split(listens.select("artist_name").filter(~blank(F.col("artist_name"))).distinct(), "artist_name", library)
    # The wanted id is itself a column, so that both sides go through one normalisation.
    credits = credits.withColumn("_wanted", credit_key(F.lit(artist))).withColumn("_wanted", artist_id(F.col("_wanted")))
    wanted = credits.filter(F.exists("artists", lambda a: a["id"] == F.col("_wanted"))).select("artist_name")
    return listens.join(wanted, "artist_name", "left_semi")
