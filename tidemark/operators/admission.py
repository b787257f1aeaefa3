"""Admission by quota: at most so many accepted entries in a rolling window.

Only accepted requests count, so whether one is accepted depends on those
accepted before it; a count over a window of requests gives wrong answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 5
HOURS = 24
WINDOW_MICROS = HOURS * 3600 * 1_000_000


def micros(time: Column) -> Column:
    """Microseconds of a time without zone."""
    return F.unix_micros(time.cast("timestamp"))


def snapshot(entries: DataFrame, as_of: Column, kind: str, limit: int = LIMIT, hours: int = HOURS) -> DataFrame:
    """Per user the stored entries of a kind since ``hours`` before ``as_of``, that instant included and no end set, and whether that blocks."""
    since = as_of - F.expr(f"INTERVAL {hours} HOURS")
    recent = entries.filter((F.col("type") == kind) & (F.col("createdAt") >= since))
    return recent.groupBy("userId").agg(F.count("*").alias("used")).withColumn("blocked", F.col("used") >= limit)


def judge(times: list[int], now: int, limit: int = LIMIT, window: int = WINDOW_MICROS) -> tuple[bool, list[int]]:
    """Whether a request is let in, given the accepted times that may still count; and those that count from now on."""
    still = [t for t in times if t >= now - window]
    return (True, [*still, now]) if len(still) < limit else (False, still)


def admit(requests: DataFrame, user_col: str = "userId", time_col: str = "createdAt", id_col: str = "id", limit: int = LIMIT, hours: int = HOURS) -> DataFrame:
    """``requests`` with a column ``admitted``, judged user by user in order of time, then id.

    Rows are dealt by user, sorted, and read as a stream with the last accepted times of
    one user in hand, so memory is bounded however many requests a user has.
    Null users are one user.  A request without a time is refused, and counts for no other.
    """
    schema = T.StructType([*requests.schema.fields, T.StructField("admitted", T.BooleanType(), False)])
    window = hours * 3600 * 1_000_000
    user_at, time_at = requests.columns.index(user_col), requests.columns.index(time_col)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, times, begun = None, [], False
        for batch in batches:
            flags = []
            micros = batch.column(time_at).cast(pa.timestamp("us")).cast(pa.int64()).to_pylist()
            for who, now in zip(batch.column(user_at).to_pylist(), micros, strict=True):
                if who != user or not begun:
                    user, times, begun = who, [], True
                ok, times = (False, times) if now is None else judge(times, now, limit, window)
                flags.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags)], names=schema.names)

    dealt = requests.repartition(F.col(user_col)).sortWithinPartitions(user_col, time_col, id_col)
    return dealt.mapInArrow(fold, schema)


def admit_native(requests: DataFrame, user_col: str = "userId", time_col: str = "createdAt", id_col: str = "id", limit: int = LIMIT, hours: int = HOURS) -> DataFrame:
    """(user, id, admitted) by a fold in SQL functions.

    Nothing counts after a pause of over ``hours``, so each stretch between pauses is folded on its own, in one row.
    A fold takes the square of its stretch's length: for requests without pause ``admit`` is the way.  A request without a time is refused.
    """
    window = hours * 3_600_000_000
    all_rows = requests.select(F.col(user_col), micros(F.col(time_col)).alias("t"), F.col(id_col).cast("long").alias("id"))
    rows = all_rows.filter("t IS NOT NULL")
    order = Window.partitionBy(user_col).orderBy("t", "id")
    paused = F.coalesce(F.col("t") - F.lag("t").over(order) > window, F.lit(False))
    stretched = rows.withColumn("paused", paused.cast("int")).withColumn("stretch", F.sum("paused").over(order))
    listed = F.array_sort(F.collect_list(F.struct("t", "id")))
    start = F.struct(F.array().cast("array<bigint>").alias("held"), F.array().cast("array<struct<id:bigint,admitted:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        still = F.filter(acc["held"], lambda t: t >= x["t"] - window)
        ok = F.size(still) < limit
        one = F.array(F.struct(x["id"].alias("id"), ok.alias("admitted")))
        return F.struct(F.when(ok, F.array_append(still, x["t"])).otherwise(still).alias("held"), F.concat(acc["out"], one).alias("out"))

    folded = stretched.groupBy(user_col, "stretch").agg(listed.alias("rows")).select(user_col, F.aggregate("rows", start, step, lambda a: a["out"]).alias("out"))
    refused = all_rows.filter("t IS NULL").select(user_col, "id", F.lit(False).alias("admitted"))
    return folded.select(user_col, F.inline("out")).unionByName(refused)
