"""Numbering rows 1..n in a global order without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def number_rows(df: DataFrame, position: str, out: str = "n", width: int = 1_000_000) -> DataFrame:
    """Number rows by a unique long ``position``.

    Rows are numbered inside blocks of ``width`` positions, each at most ``width`` rows, and a
    running total over the block sizes (one row per block) gives every block its start.
    """
    blocks = df.withColumn("_block", F.floor(F.col(position) / width))
    sizes = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(position))
    numbered = blocks.withColumn("_inside", inside).join(starts, "_block")
    return numbered.withColumn(out, F.col("_start") + F.col("_inside")).drop("_block", "_inside", "_start")
