"""Calendar reports over the stored fact, from what its commits add up to.

``days`` is ``sources.listens.read_days``: half-hour slots by genre.  Local days and months are made of whole slots where the listener's offset is
a multiple of half an hour; other offsets raise.  A filter that begins within a slot takes that slot's rows from the fact, whose day alone is read.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from earshot.functions.measures import add_up
from earshot.functions.text import blank
from earshot.functions.timecols import iso
from earshot.params import Clock, between, ntz
from earshot.sources.listens import SLOT_SECONDS, day_partials, read_days, read_listens

_MEASURES = ["views", "plays", "playtime"]


def _since(spark, path: str, low: datetime | None) -> DataFrame:
    """Slots from ``low`` on; of the slot that it divides, what the fact has from ``low`` on."""
    days = read_days(spark, path).select("slot", "genre", *_MEASURES, "n", "listen_date")
    if low is None:
        return days
    into = (low - datetime(1970, 1, 1)).total_seconds() % SLOT_SECONDS
    whole = low + timedelta(seconds=SLOT_SECONDS - into) if into else low
    later = days.filter((F.col("slot") >= ntz(whole)) & (F.col("listen_date") >= F.lit(whole.date())))
    if not into:
        return later
    rows = between(read_listens(spark, path), low, whole).withColumn("commit", F.lit(""))
    return later.unionByName(day_partials(rows).select(*later.columns))


def _local(clock: Clock):
    if clock.offset_seconds % SLOT_SECONDS:
        raise ValueError("days are kept by half hours: the offset must be a multiple of one")
    return F.col("slot") + F.make_dt_interval(secs=F.lit(clock.offset_seconds))


def stored_summary(spark, path: str, clock: Clock, filter: str | None = None) -> DataFrame:
    """``topstats.summary``."""
    return _since(spark, path, clock.lower_bound(filter)).agg(*add_up(*_MEASURES))


def stored_daily(spark, path: str, clock: Clock, days: int = 7) -> DataFrame:
    """``timeseries.daily_chart``, and with 365 days ``timeseries.heatmap``."""
    rows = _since(spark, path, clock.days_back(days)).groupBy(F.to_date(_local(clock)).alias("day"))
    return rows.agg(*add_up("views", "plays")).orderBy("day").withColumn("day", iso(F.col("day")))


def stored_growth(spark, path: str, clock: Clock) -> DataFrame:
    """``timeseries.growth``."""
    months = _since(spark, path, None).groupBy(F.date_format(F.to_date(_local(clock)), "yyyy-MM").alias("month")).agg(*add_up("plays"))
    so_far = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return months.withColumn("cumulative", F.sum("plays").over(so_far)).orderBy("month")


def stored_moods(spark, path: str, clock: Clock, days: int = 90) -> DataFrame:
    """``timeseries.mood_calendar``."""
    rows = _since(spark, path, clock.days_back(days)).filter(~blank(F.col("genre")))
    counts = rows.groupBy(F.to_date(_local(clock)).alias("day"), "genre").agg(*add_up("n"))
    best = counts.groupBy("day").agg(F.min(F.struct((-F.col("n")).alias("n"), "genre")).alias("best"))
    return best.orderBy("day").select(iso(F.col("day")).alias("day"), F.col("best.genre").alias("genre"), (-F.col("best.n")).alias("plays"))
