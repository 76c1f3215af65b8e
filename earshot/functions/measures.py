"""The three listening measures, display ratios and the common ranking order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _when_event(kind: str, value: Column | int) -> Column:
    return F.when(F.col("event_type") == kind, value).otherwise(0)


def views() -> Column:
    return F.sum(_when_event("view", 1)).alias("views")


def plays() -> Column:
    return F.sum(_when_event("play", 1)).alias("plays")


def playtime() -> Column:
    return F.sum(_when_event("play", F.col("duration"))).alias("playtime")


def all_events(name: str = "plays") -> Column:
    """Counts every event; some reports call that "plays" although views are in it."""
    return F.count(F.lit(1)).alias(name)


def measures() -> list[Column]:
    return [views(), plays(), playtime()]


def add_up(*names: str) -> list[Column]:
    """Second-stage sums of measures that were pre-aggregated."""
    return [F.sum(n).alias(n) for n in names]


def largest(*names: str) -> dict[str, Column]:
    return {name: F.max(name) for name in names}


def rolled_up(rows: DataFrame, keys: list[str], texts: dict[str, Column], *sums: Column) -> DataFrame:
    """Group by ``keys`` with aggregates over text columns and additive measures.

    A text aggregate in the first pass would make Spark sort every row before its map-side step.
    So the first pass groups by the text columns as well and only adds up, which hashes; the
    second pass reduces the texts over what is left, about one row per group.
    """
    fine = [c for c in texts if c not in keys]
    first = rows.groupBy(*keys, *fine).agg(*sums)
    names = [c for c in first.columns if c not in (*keys, *fine)]
    second = first.groupBy(*keys).agg(*[agg.alias(c) for c, agg in texts.items()], *add_up(*names))
    return second.select(*keys, *texts, *names)


def ranking(*keys: str, by: tuple[str, ...] = ("playtime", "plays", "views")) -> list[Column]:
    """Measures descending; group keys break ties, so that a limit is repeatable."""
    return [F.desc(m) for m in by] + [F.asc(key) for key in keys]


def round_half_up(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + F.lit(0.5))


def pct_change(current: Column, previous: Column) -> Column:
    change = (current - previous) / previous.cast("double") * 100
    return F.when(previous > 0, round_half_up(change).cast("bigint"))


def change_state(current: Column, previous: Column) -> Column:
    return (
        F.when(previous > 0, F.lit("pct")).when(current > 0, F.lit("New")).otherwise(F.lit("none"))
    )


def intensity_level(plays_: Column, top: Column) -> Column:
    """0 without plays, else which quarter of the busiest day is reached."""
    return F.when(plays_ == 0, F.lit(0)).otherwise(F.ceil(plays_ / top.cast("double") * 4)).cast("int")


def relative_bar(value: Column, top: Column) -> Column:
    """Bar length in percent of the leader, at least 3."""
    share = round_half_up(value.cast("double") / top * 100)
    return F.when(top > 0, F.greatest(F.lit(3), share)).otherwise(F.lit(0)).cast("int")


def share_percent(part: Column, total: Column) -> Column:
    """Percent of a total to one decimal."""
    scaled = part.cast("double") * 1000 / total.cast("double")
    return F.when(total > 0, round_half_up(scaled) / 10).otherwise(F.lit(0.0)).cast("double")
