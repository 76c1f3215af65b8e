"""Calendar profiles in local time, and the sequences read off them."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from earshot.functions import constants as k
from earshot.functions.measures import (
    change_state, intensity_level, largest, pct_change, playtime, plays, rolled_up, views,
)
from earshot.functions.text import blank
from earshot.functions.timecols import iso, local_date, local_hour, local_month, local_weekday, local_year
from earshot.params import Clock, between, ntz, rolling_days, time_filter


def spine(spark: SparkSession, name: str, low: Column, high: Column) -> DataFrame:
    """One row per value of a fixed range: hours, weekdays or the days of a window."""
    return spark.range(1).select(F.explode(F.sequence(low, high)).alias(name))


def fill_gaps(dense: DataFrame, sparse: DataFrame, key: str) -> DataFrame:
    """Every spine row with its measures, 0 where nothing happened."""
    filled = dense.join(sparse, key, "left")
    return filled.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in sparse.columns if c != key])


def _days(listens: DataFrame, clock: Clock, *aggs: Column) -> DataFrame:
    return listens.groupBy(local_date(clock).alias("day")).agg(*aggs)


def daily_chart(listens: DataFrame, clock: Clock, days: int = 7) -> DataFrame:
    rows = _days(rolling_days(listens, clock, days), clock, views(), plays())
    return rows.orderBy("day").withColumn("day", iso(F.col("day")))


def heatmap(listens: DataFrame, clock: Clock, days: int = 365) -> DataFrame:
    rows = _days(rolling_days(listens, clock, days), clock, plays(), views())
    return rows.orderBy("day").withColumn("day", iso(F.col("day")))


def heatmap_levels(listens: DataFrame, clock: Clock, days: int = 365) -> DataFrame:
    """The dense calendar, from the Sunday on or before the first day, with four intensities."""
    sparse = _days(rolling_days(listens, clock, days), clock, plays())
    first = clock.local_today - timedelta(days=days - 1)
    first -= timedelta(days=(first.weekday() + 1) % 7)
    dense = spine(listens.sparkSession, "day", F.lit(first.date()), F.lit(clock.local_today.date()))
    # The busiest day is looked up among the window's rows, one per day.
    busiest = sparse.agg(F.max("plays")).scalar()
    filled = fill_gaps(dense, sparse, "day").withColumn("level", intensity_level(F.col("plays"), busiest))
    return filled.orderBy("day").select(iso(F.col("day")).alias("day"), "plays", "level")


def hourly(listens: DataFrame, clock: Clock, filter: str | None = None) -> DataFrame:
    hours = time_filter(listens, clock, filter).groupBy(local_hour(clock).alias("hour")).agg(plays(), views())
    return fill_gaps(spine(listens.sparkSession, "hour", F.lit(0), F.lit(23)), hours, "hour").orderBy("hour")


def day_of_week(listens: DataFrame, clock: Clock, filter: str | None = None) -> DataFrame:
    days = time_filter(listens, clock, filter).groupBy(local_weekday(clock).alias("day")).agg(plays())
    filled = fill_gaps(spine(listens.sparkSession, "day", F.lit(0), F.lit(6)), days, "day")
    names = F.array(*[F.lit(n) for n in k.DAY_NAMES])
    return filled.select("day", F.get(names, F.col("day")).alias("day_name"), "plays").orderBy("day")


def growth(listens: DataFrame, clock: Clock) -> DataFrame:
    """Plays per local month and their running total; the window runs over months only."""
    months = listens.groupBy(local_month(clock).alias("month")).agg(plays())
    so_far = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return months.withColumn("cumulative", F.sum("plays").over(so_far)).orderBy("month")


def years(listens: DataFrame, clock: Clock) -> DataFrame:
    return listens.select(local_year(clock).alias("year")).distinct().orderBy(F.desc("year"))


def mood_calendar(listens: DataFrame, clock: Clock, days: int = 90) -> DataFrame:
    """Per local day the most frequent genre and its count; the first by name wins a tie."""
    rows = rolling_days(listens, clock, days).filter(~blank(F.col("genre")))
    counts = rows.groupBy(local_date(clock).alias("day"), "genre").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("day").agg(F.min(F.struct((-F.col("n")).alias("n"), "genre")).alias("best"))
    return best.orderBy("day").select(
        iso(F.col("day")).alias("day"), F.col("best.genre").alias("genre"), (-F.col("best.n")).alias("plays")
    )


def streaks(listens: DataFrame, clock: Clock) -> DataFrame:
    """Runs of consecutive local days with plays.

    Days are distinct before any ordering, so the window sees one row per day.  Within a run,
    day minus row number is constant.  The current run must end today or yesterday.
    """
    days = listens.filter(F.col("event_type") == "play").select(local_date(clock).alias("day")).distinct()
    nth = F.row_number().over(Window.orderBy("day"))
    runs = days.withColumn("run", F.date_sub("day", nth)).groupBy("run").agg(
        F.max("day").alias("last"), F.count(F.lit(1)).alias("length")
    )
    newest = runs.agg(
        F.max(F.struct("last", "length")).alias("newest"),
        F.max("length").alias("longest"),
        F.sum("length").alias("total"),
    )
    today = clock.local_today.date()
    live = F.col("newest.last").isin(F.lit(today), F.lit(today - timedelta(days=1)))
    return newest.select(
        F.when(live, F.col("newest.length")).otherwise(0).cast("bigint").alias("current"),
        F.coalesce("longest", F.lit(0)).cast("bigint").alias("longest"),
        F.coalesce("total", F.lit(0)).cast("bigint").alias("total_active_days"),
    )


# -- this week ---------------------------------------------------------------------------------


def _this_week(listens: DataFrame, clock: Clock) -> DataFrame:
    return between(listens, clock.week_start)


def this_week_summary(listens: DataFrame, clock: Clock) -> DataFrame:
    totals = _this_week(listens, clock).agg(
        plays(),
        playtime(),
        views(),
        F.countDistinct("track_name").alias("unique_tracks"),
        F.countDistinct(local_date(clock)).alias("active_days"),
    )
    return totals.select(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in totals.columns])


def this_week_daily(listens: DataFrame, clock: Clock) -> DataFrame:
    """Monday to Sunday of the current local week."""
    monday = clock.local_monday.date()
    dense = spine(listens.sparkSession, "day", F.lit(monday), F.lit(monday + timedelta(days=6)))
    filled = fill_gaps(dense, _days(_this_week(listens, clock), clock, plays(), playtime()), "day")
    return filled.orderBy("day").select(
        F.date_diff("day", F.lit(monday)).alias("day_index"),
        F.date_format("day", "EEE").alias("label"),
        iso(F.col("day")).alias("date"),
        F.col("plays"),
        F.col("playtime"),
    )


def this_week_range(spark: SparkSession, clock: Clock) -> DataFrame:
    """First and last day of the week, and its label, as in "Jan 29 – Feb 4"."""
    monday = F.lit(clock.local_monday.date())
    sunday = F.date_add(monday, 6)
    label = F.concat(F.date_format(monday, "MMM d"), F.lit(" – "), F.date_format(sunday, "MMM d"))
    return spark.range(1).select(iso(monday).alias("start"), iso(sunday).alias("end"), label.alias("label"))


def this_week_top_track(listens: DataFrame, clock: Clock) -> DataFrame:
    keys = ["track_name", "artist_name", "album_name"]
    tracks = rolled_up(_this_week(listens, clock), keys, largest("track_id", "album_id"), playtime(), plays())
    top = tracks.orderBy(F.desc("playtime"), F.desc("plays"), *keys).limit(1)
    return top.filter(~blank(F.col("track_name")))


def this_week_prev(listens: DataFrame, clock: Clock) -> DataFrame:
    before = between(listens, clock.week_start - timedelta(days=7), clock.week_start).agg(plays(), playtime())
    return before.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in before.columns])


def this_week_delta(listens: DataFrame, clock: Clock) -> DataFrame:
    """Change of plays against the week before, from one scan of both weeks."""
    both = between(listens, clock.week_start - timedelta(days=7)).withColumn(
        "_now", F.col("ts") >= ntz(clock.week_start)
    )
    played = F.col("event_type") == "play"
    sums = both.agg(
        F.count_if(played & F.col("_now")).alias("current"), F.count_if(played & ~F.col("_now")).alias("previous")
    )
    return sums.select(
        change_state(F.col("current"), F.col("previous")).alias("state"),
        pct_change(F.col("current"), F.col("previous")).alias("pct"),
    )
