"""Days of runs and reports are days of UTC, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_time(stamp: Column) -> Column:
    """The time as clocks in UTC show it."""
    return F.to_utc_timestamp(stamp, F.current_timezone())


def utc_day(stamp: Column) -> Column:
    return F.to_date(utc_time(stamp))
