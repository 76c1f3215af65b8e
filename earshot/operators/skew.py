"""Joining a fact to a dimension when one key may hold a large part of the fact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def skew_safe_left_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    counts: DataFrame | None = None,
    shares: int = 10_000,
    min_rows: int = 10_000,
) -> DataFrame:
    """``facts`` left join ``dim`` (unique on ``keys``), with hot keys spread over many tasks.

    A key is hot when it holds at least 1/``shares`` of all rows, so there are at most ``shares``
    hot keys whatever the data size: that list, and only it, is broadcast.  A hot key gets as
    many salts as it has shares; its fact rows pick one by row hash, its dimension row is
    copied to each, which adds fewer than 2 x ``shares`` rows.  NULL keys, which match nothing,
    are spread the same way.  ``counts`` (keys + ``n``) saves the counting pass where known.
    """
    if counts is None:
        counts = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    hot = counts.filter((F.col("n") >= min_rows) & (F.col("n") * shares >= total)).select(
        *[F.col(key).alias(f"_hot_{key}") for key in keys],
        F.ceil(F.col("n") * shares / total).cast("int").alias("_salts"),
    )
    hot = F.broadcast(hot)

    def with_salts(df: DataFrame) -> DataFrame:
        same = reduce(lambda a, b: a & b, [df[key].eqNullSafe(hot[f"_hot_{key}"]) for key in keys])
        return df.join(hot, same, "left").drop(*[f"_hot_{key}" for key in keys])

    # The row's place in its task is part of the salt, so that equal rows are spread as well.
    salted = facts.withColumn("_row", F.xxhash64(*[F.col(c) for c in facts.columns], F.monotonically_increasing_id()))
    left = with_salts(salted).withColumn("_salt", F.coalesce(F.pmod("_row", "_salts").cast("int"), F.lit(0))).drop("_row")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    right = with_salts(dim).withColumn("_salt", copies)
    return left.drop("_salts").join(right.drop("_salts"), [*keys, "_salt"], "left").drop("_salt")
