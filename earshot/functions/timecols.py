"""Local-time columns: shift the stored UTC wall time by the listener's offset, then bucket."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from earshot.params import Clock


def epoch_seconds(ts: Column) -> Column:
    """Whole epoch seconds of a zone-less UTC time, whatever the session zone is."""
    since = ts - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    return F.floor(since.cast("interval second").cast("decimal(20,6)")).cast("bigint")


def from_epoch_seconds(seconds: Column) -> Column:
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)


def local(clock: Clock, ts: Column | None = None) -> Column:
    ts = F.col("ts") if ts is None else ts
    return ts + F.make_dt_interval(secs=F.lit(clock.offset_seconds))


def local_date(clock: Clock) -> Column:
    return F.to_date(local(clock))


def iso(day: Column) -> Column:
    return day.cast("string")


def local_hour(clock: Clock) -> Column:
    return F.hour(local(clock))


def local_weekday(clock: Clock) -> Column:
    """0 is Sunday."""
    return F.dayofweek(local(clock)) - 1


def local_month(clock: Clock) -> Column:
    return F.date_format(local_date(clock), "yyyy-MM")


def local_year(clock: Clock) -> Column:
    return F.year(local(clock))
