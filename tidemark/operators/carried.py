"""What one run of requests leaves to the next: the last accepted times of each user, and the draws of the day.

Both are small tables beside the entries.  A run that is given them reads no entries at all; one that is given the
entries reads only what may still count.  Either way the work of a run follows from the run, not from the history.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import day_start
from tidemark.operators.admission import micros
from tidemark.sources.entries import entry_object
from tidemark.sources.schemas import DREAM, ENTRY, TAROT

#: State of the quota, and of draws.
QUOTA = "userId string, times array<bigint>"
DRAWS = "userId string, day timestamp_ntz, at long, own string, entry string"


@dataclass(frozen=True)
class Span:
    """The first and the last time of a run's requests, None if it has none, and how many it has."""

    first: datetime | None
    last: datetime | None
    size: int = 0


def span(requests: DataFrame, time_col: str) -> Span:
    row = requests.agg(F.min(time_col).alias("a"), F.max(time_col).alias("b"), F.count("*").alias("n")).first()
    return Span(row["a"], row["b"], row["n"])


def since(entries: DataFrame, kind: str, first: datetime | None, users: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Entries of a kind from a time on, of users who ask: the time is told to the scan, the users are met by a semi join."""
    recent = entries.filter(F.col("type") == kind)
    recent = recent.filter(F.col("createdAt") >= F.lit(first).cast("timestamp_ntz")) if first is not None else recent.filter("false")
    who = users.select(F.col(user_col).cast("string").alias("userId")).distinct()
    return recent.withColumn("userId", F.col("userId").cast("string")).join(who, "userId", "left_semi")


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def quota_before(valid: DataFrame, when: Span, stored: DataFrame | None, state: DataFrame | None, hours: int, limit: int) -> DataFrame:
    """(user_id, held): accepted times before a run; a user may have several rows."""
    kind = valid.schema["user_id"].dataType
    out = _empty(valid, QUOTA) if state is None else state.select("userId", "times")
    if stored is not None:
        first = None if when.first is None else when.first - timedelta(hours=hours)
        held = since(stored, DREAM, first, valid).select("userId", F.array(micros(F.col("createdAt"))).alias("times"))
        out = out.unionByName(held)
    return out.select(F.col("userId").cast(kind).alias("user_id"), F.col("times").alias("held"))


def quota_after(before: DataFrame, accepted: DataFrame, when: Span, limit: int, hours: int) -> DataFrame:
    """The state after a run: each user's last ``limit`` accepted times, none older than ``hours`` before the run's last request.

    The last ones tell as much as all do: a window holds ``limit`` times if and only if it holds the last but ``limit``.
    A user whose times are all older has no row, so the state is as large as the users of the last hours.
    """
    times = before.select("user_id", F.explode("held").alias("at")).unionByName(accepted)
    if when.last is not None:
        times = times.filter(F.col("at") >= micros(F.lit(when.last - timedelta(hours=hours)).cast("timestamp_ntz")))
    # the quota itself bounds how many times a user has in these hours
    last = F.slice(F.sort_array(F.collect_list("at"), asc=False), 1, limit)
    return times.groupBy(F.col("user_id").cast("string").alias("userId")).agg(last.alias("times"))


def draws_before(valid: DataFrame, when: Span, stored: DataFrame | None, state: DataFrame | None) -> DataFrame:
    """(user_id, day, at, own, entry): draws before a run."""
    kind = valid.schema["user_id"].dataType
    out = _empty(valid, DRAWS) if state is None else state.select("userId", "day", "at", "own", "entry")
    if stored is not None:
        first = None if when.first is None else when.first.replace(hour=0, minute=0, second=0, microsecond=0)
        whole = stored.select(*[(F.col(f.name) if f.name in stored.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTRY])
        drawn = since(whole, TAROT, first, valid)
        out = out.unionByName(drawn.select("userId", day_start(F.col("createdAt")).alias("day"), micros(F.col("createdAt")).alias("at"), F.col("id").alias("own"), entry_object().alias("entry")))
    return out.withColumn("userId", F.col("userId").cast(kind)).withColumnRenamed("userId", "user_id")


def draws_after(before: DataFrame, drawn: DataFrame, when: Span, late_days: int) -> DataFrame:
    """The state after a run: the draw of each user and day, of the last request's day and ``late_days`` before it."""
    rows = before.unionByName(drawn)
    if when.last is not None:
        rows = rows.filter(F.col("day") >= F.lit(when.last.replace(hour=0, minute=0, second=0, microsecond=0) - timedelta(days=late_days)).cast("timestamp_ntz"))
    last: Column = F.max(F.struct("at", "own", "entry"))
    return rows.groupBy(F.col("user_id").cast("string").alias("userId"), "day").agg(last.alias("d")).select("userId", "day", "d.*")
