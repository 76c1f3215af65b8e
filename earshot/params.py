"""Job parameters: the reporting clock and the time filters derived from it.

Every query takes its notion of "now" as a parameter, so a run can be repeated.  Bounds are
computed once on the driver and reach the plan as literals, where the Parquet reader can use
them to skip row groups and, through ``listen_date``, whole partitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

# Length in days of each rolling filter.
ROLLING_DAYS = {"7d": 7, "14d": 14, "1m": 30, "3m": 90, "6m": 180, "1y": 365}


@dataclass(frozen=True)
class Clock:
    """``as_of`` is a naive UTC instant; the offset turns it into the listener's local time."""

    as_of: datetime
    utc_offset_hours: float = 5.5

    @property
    def offset_seconds(self) -> int:
        return math.floor(self.utc_offset_hours * 3600 + 0.5)

    @property
    def offset(self) -> timedelta:
        return timedelta(seconds=self.offset_seconds)

    @property
    def local_now(self) -> datetime:
        return self.as_of + self.offset

    @property
    def local_today(self) -> datetime:
        return self.local_now.replace(hour=0, minute=0, second=0, microsecond=0)

    @property
    def local_monday(self) -> datetime:
        return self.local_today - timedelta(days=self.local_today.weekday())

    @property
    def today_start(self) -> datetime:
        """UTC instant of local midnight."""
        return self.local_today - self.offset

    @property
    def week_start(self) -> datetime:
        """UTC instant of local Monday 00:00."""
        return self.local_monday - self.offset

    def days_back(self, days: int) -> datetime:
        return self.as_of.replace(microsecond=0) - timedelta(days=days)

    def lower_bound(self, name: str | None) -> datetime | None:
        """The inclusive lower bound of a named filter; an unknown name means no bound."""
        if name == "today":
            return self.today_start
        if name == "week":
            return self.week_start
        if name in ROLLING_DAYS:
            return self.days_back(ROLLING_DAYS[name])
        return None


def ntz(instant: datetime) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{instant.isoformat(sep=' ')}'")


def between(df: DataFrame, low: datetime | None = None, high: datetime | None = None) -> DataFrame:
    """Rows with ``low <= ts < high``; a stored ``listen_date`` partition is bounded as well."""
    partitioned = "listen_date" in df.columns
    if low is not None:
        df = df.filter(F.col("ts") >= ntz(low))
        if partitioned:
            df = df.filter(F.col("listen_date") >= F.lit(low.date()))
    if high is not None:
        df = df.filter(F.col("ts") < ntz(high))
        if partitioned:
            df = df.filter(F.col("listen_date") <= F.lit(high.date()))
    return df


def time_filter(df: DataFrame, clock: Clock, name: str | None) -> DataFrame:
    return between(df, clock.lower_bound(name))


def rolling_days(df: DataFrame, clock: Clock, days: int) -> DataFrame:
    """The last ``days`` x 24 hours; the first local day is therefore partial."""
    return between(df, clock.days_back(days))


def year_range(df: DataFrame, year: int) -> DataFrame:
    """A UTC calendar year, although buckets inside it are local."""
    return between(df, datetime(year, 1, 1), datetime(year + 1, 1, 1))


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    return min(high, max(low, default if value is None else int(value)))
