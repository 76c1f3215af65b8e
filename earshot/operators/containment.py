"""Which texts contain a given text, as an equi join.

An inverted index of grams: a text is listed under each of its grams, a needle is looked up by the gram of its own that the fewest texts
of its group have.  Only grams that some needle holds are listed at all, and lists are counted before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earshot.operators.skew import skew_safe_left_join

#: Characters of a gram; a shorter needle is one gram.
GRAM = 8
#: Rows of a list that meet in one task; longer lists are split.
LIST = 10_000


def _grams(text: Column, length: Column) -> Column:
    """The distinct grams of ``length``, none where the text is shorter; of length 0 the empty one."""
    starts = F.when(length > F.length(text), F.array().cast("array<int>")).when(length == 0, F.array(F.lit(1)))
    starts = starts.otherwise(F.sequence(F.lit(1), F.greatest(F.length(text) - F.greatest(length, F.lit(1)) + 1, F.lit(1))))
    return F.array_distinct(F.transform(starts, lambda at: F.substring(text, at, length)))


def _needles(needles: DataFrame, group: list[str]) -> DataFrame:
    """group, needle, _grams (how many distinct ones), _gram: a row for each gram of each distinct needle."""
    rows = needles.select(*group, "needle").distinct().filter(F.col("needle").isNotNull())
    rows = rows.withColumn("_all", _grams(F.col("needle"), F.least(F.length("needle"), F.lit(GRAM))))
    return rows.select(*group, "needle", F.size("_all").alias("_grams"), F.explode("_all").alias("_gram"))


def listed(needles: DataFrame, texts: DataFrame, group: list[str]) -> DataFrame:
    """``texts`` under each of their grams that a needle of their group holds: the columns of ``texts`` and ``_gram``.

    Linear in the length of a text, for each of the few lengths in use.
    """
    wanted = needles.select(*group, "_gram").distinct()
    if group:
        lengths = wanted.groupBy(*group).agg(F.collect_set(F.length("_gram")).alias("_lengths"))
        sized = skew_safe_left_join(texts, lengths, group).filter(F.col("_lengths").isNotNull())
    else:
        sized = texts.withColumn("_lengths", F.sequence(F.lit(0), F.lit(GRAM)))
    sized = sized.withColumn("_length", F.explode("_lengths")).drop("_lengths")
    each = sized.withColumn("_gram", F.explode(_grams(F.col("text"), F.col("_length")))).drop("_length")
    return each.join(wanted, [*group, "_gram"], "left_semi")


def _matches(needles: DataFrame, texts: DataFrame, group: list[str]) -> DataFrame:
    """Texts beside each needle of their group that they contain.

    Comparing all needles with all texts of a group would grow with their product, and one group may be a third of both sides.
    """
    asked = _needles(needles, group)
    lists = listed(asked, texts, group)
    sizes = lists.groupBy(*group, "_gram").agg(F.count(F.lit(1)).alias("_texts"))
    # A needle one of whose grams no text has is contained in none.
    rarest = asked.join(sizes, [*group, "_gram"]).groupBy(*group, "needle", "_grams").agg(
        F.count(F.lit(1)).alias("_found"), F.min(F.struct("_texts", "_gram")).alias("_rarest")
    )
    parts = F.ceil(F.col("_rarest._texts") / LIST).cast("int")
    chosen = rarest.filter("_found = _grams").select(*group, "needle", F.col("_rarest._gram").alias("_gram"), parts.alias("_parts"))
    kept = chosen.select(*group, "_gram", "_parts").distinct()
    short = lists.join(kept, [*group, "_gram"]).withColumn("_part", F.pmod(F.xxhash64("text"), F.col("_parts")).cast("int")).drop("_parts")
    chosen = chosen.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return short.join(chosen, [*group, "_gram", "_part"]).filter(F.contains("text", "needle")).drop("_gram", "_part")


def smallest_containing(needles: DataFrame, texts: DataFrame, group: str, of: str) -> DataFrame:
    """For each distinct (``group``, ``needle``), the smallest ``of`` among texts that contain it."""
    found = _matches(needles, texts, [group])
    return found.groupBy(group, "needle").agg(F.min(of).alias(of))


def texts_containing(needles: DataFrame, texts: DataFrame, group: str | None = None) -> DataFrame:
    """The texts that contain at least one needle (of their group, where there are groups); a text may come repeatedly."""
    return _matches(needles, texts, [group] if group else [])
