"""Splitting a collaboration credit into its artists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earshot.functions import constants as k
from earshot.functions.text import artist_id, credit_key, nfkc, squeeze

ARTISTS_TYPE = "array<struct<name:string,id:string>>"

# A code point that is never a character keeps the names apart while they are normalised together.
_APART = "\uffff"


def structured_names(participants: Column) -> Column:
    """Names from multi-value tags, ``{"artist": [{"name": ...}, ...]}``; NULL where unusable."""
    parsed = F.from_json(participants, "artist array<struct<name:string>>")
    return F.transform(parsed["artist"], lambda a: a["name"])


def with_artists(df: DataFrame, credit: str, participants: str | None = None, out: str = "artists") -> DataFrame:
    """Add the artists of a credit as an array of (name, id).

    More than one structured name wins; protected names stay whole; anything else is split.
    Names with one key are one artist: it keeps the first position and the last spelling.
    """
    raw = F.col(credit)
    text = F.coalesce(F.nullif(raw, F.lit("")), F.lit(k.UNKNOWN))
    protected = F.array(*[F.lower(F.lit(n)) for n in k.PROTECTED_CREDITS])
    split = F.when(F.array_contains(protected, F.col("_credit_key")), F.array(raw)).otherwise(
        F.split(text, k.CREDIT_SEPARATOR)
    )
    if participants is not None:
        names = structured_names(F.col(participants))
        split = F.when(F.size(names) > 1, names).otherwise(split)
    pieces = F.filter(split, lambda n: F.coalesce(n, F.lit("")) != "")
    df = df.withColumn("_credit_key", credit_key(raw)).withColumn("_pieces", pieces)
    df = df.withColumn("_joined", nfkc(F.array_join("_pieces", _APART)))
    names = F.transform(F.split("_joined", _APART), lambda n: squeeze(n))
    df = df.withColumn("_names", F.when(F.size("_pieces") > 0, names).otherwise(F.array().cast("array<string>")))
    keys = F.array_distinct(F.transform("_names", lambda n: F.lower(n)))
    artists = F.transform(
        keys,
        lambda key: F.struct(
            F.element_at(F.filter("_names", lambda n: F.lower(n) == key), -1).alias("name"),
            artist_id(key).alias("id"),
        ),
    )
    return df.withColumn(out, artists).drop("_credit_key", "_pieces", "_joined", "_names")
