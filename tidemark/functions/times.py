"""UTC days and their labels; times are without zone and mean UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_start(ts: Column) -> Column:
    """Midnight of the UTC day, as a time without zone."""
    return F.date_trunc("DAY", ts).cast("timestamp_ntz")


def day_end(ts: Column) -> Column:
    """24 hours after the start of the day; not part of it."""
    return day_start(ts) + F.expr("INTERVAL 24 HOURS")


def day_label(ts: Column) -> Column:
    """yyyy-MM-dd of the UTC day."""
    return F.date_format(ts, "yyyy-MM-dd")


def in_day(ts: Column, day: Column) -> Column:
    """Whether a time lies in the half-open day of another."""
    return (ts >= day_start(day)) & (ts < day_end(day))


def display_date(ts: Column, zone: str = "UTC") -> Column:
    """yyyy. MM. dd. in a display zone, which may be another day than the UTC one."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)
    return F.date_format(local, "yyyy. MM. dd.")


def milliseconds(ts: Column) -> Column:
    """The time cut to milliseconds, as it is stored."""
    return F.date_trunc("MILLISECOND", ts).cast("timestamp_ntz")
