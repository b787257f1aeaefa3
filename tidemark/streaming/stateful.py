"""Admission and first draws on streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.admission import LIMIT, WINDOW_MICROS, judge, micros

#: States of this kind live on disk, and only they have timers.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Stands for a time that is missing.
_NEVER = -(1 << 63)

#: Verdicts of a frame.
_SEND = 10_000

#: Rows that are gathered before they are reduced to the first ones, besides twice these.
_GATHER = 100_000


class _Quota(StatefulProcessor):
    """A user's accepted times that may still count; forgotten when the watermark has passed the last one's window."""

    def __init__(self, limit: int, window: int, kind: str) -> None:
        self.limit, self.window, self.kind = limit, window, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "times array<bigint>")

    def _keep(self, times: list[int]) -> None:
        self.times.update((times,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        # the window holds both ends
        self.handle.registerTimer((times[-1] + self.window) // 1000 + 1)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802, N803
        # asked once a frame of the initial state
        held = list(self.times.get()[0]) if self.times.exists() else []
        self._keep(sorted([*held, *initialState["at"].tolist()])[-self.limit :])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # 16 bytes a row of the batch are held, as the order of its rows is not known before the last
        found = [(f["at"].to_numpy(np.int64), f["id"].to_numpy(np.int64)) for f in rows]
        at, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids, at))
        times = before = list(self.times.get()[0]) if self.times.exists() else []
        for k in range(0, len(order), _SEND):
            some, flags = order[k : k + _SEND], []
            for now in at[some].tolist():
                ok, times = (False, times) if now == _NEVER else judge(times, now, self.limit, self.window)
                flags.append(ok)
            yield pd.DataFrame({"userId": pd.Series([key[0]] * len(some), dtype=object if self.kind == "string" else None), "id": ids[some], "admitted": flags})
        if times and times != before:
            self._keep(times)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, limit: int = LIMIT, window: int = WINDOW_MICROS, late: str = "24 hours", accepted: DataFrame | None = None) -> DataFrame:
    """(userId, id, admitted) of a stream of (userId, id, createdAt), judged batch after batch, within a batch by time, then id.

    The state of a user is the accepted times that may still count, ``limit`` at most, kept on disk; it
    goes once the watermark, ``late`` behind the latest request, has passed the window of the last of them.  ``accepted`` are
    entries (userId, createdAt) from before the stream.  A request without a time is refused; one that comes later than ``late`` gets no verdict.
    Sets the session's state store to RocksDB.
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = requests.schema["userId"].dataType.simpleString()
    at = F.coalesce(micros(F.col("createdAt")), F.lit(_NEVER)).alias("at")
    # a row without a time has the oldest, which no watermark is behind
    rows = requests.select("userId", F.col("id").cast("long").alias("id"), at, F.coalesce(F.col("createdAt").cast("timestamp"), F.current_timestamp()).alias("stamp")).withWatermark("stamp", late)
    initial = None
    if accepted is not None:
        initial = accepted.filter("createdAt IS NOT NULL").select(F.col("userId").cast(kind).alias("userId"), micros(F.col("createdAt")).alias("at")).groupBy("userId")
    return rows.groupBy("userId").transformWithStateInPandas(_Quota(limit, window, kind), f"userId {kind}, id long, admitted boolean", "Append", "EventTime", initialState=initial)


def first_draws_by_time(requests: DataFrame, late: str = "24 hours") -> DataFrame:
    """The first request by time, then id, of each user and UTC day of a stream, in whatever order its requests arrive.

    It is sent when the watermark, ``late`` behind the latest request, has passed the day, and not before, as an earlier one might
    come until then.  The state is one row a user and day that is open; what comes after its day was sent is dropped.
    A request without a time is not part of any day.
    """
    row = F.struct(*[F.col(c) for c in requests.columns])
    stamped = requests.withColumn("__at", F.col("createdAt").cast("timestamp")).withWatermark("__at", late)
    days = stamped.groupBy("userId", F.window("__at", "1 day"))
    return days.agg(F.min_by(row, F.struct("createdAt", "id")).alias("e")).select("e.*")


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row by time, then id, of each user and day; the rows in hand are at most twice those that are kept, and some."""

    def least(some: list[pa.RecordBatch]) -> pa.Table:
        rows = pa.Table.from_batches(some).sort_by([("createdAt", "ascending"), ("id", "ascending")])
        numbered = rows.append_column("__row", pa.array(np.arange(rows.num_rows)))
        return rows.take(numbered.group_by(["userId", "__day"], use_threads=False).aggregate([("__row", "min")])["__row_min"])

    held, size, kept = [], 0, 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > 2 * kept + _GATHER:
            held = least(held).to_batches()
            size = kept = sum(b.num_rows for b in held)
    if held:
        yield from least(held).to_batches(max_chunksize=_SEND)


def first_draws_stream(requests: DataFrame, late: str = "24 hours") -> DataFrame:
    """The first request to arrive of each user and UTC day, of those that arrive in one batch the first by time, then id; sent at once.

    A task reduces its share of a batch to a row a user and day, and what earlier batches have sent is left out by Spark's own deduplication, so no
    function is called for a single user or day.  The state, on disk, is that a day has a draw; it goes once the day of the latest request
    begins ``late`` after the day's end, and later requests of that day are dropped.  A request without a time is not part of any day.
    Sets the session's state store to RocksDB.  ``first_draws_by_time`` waits for the first by time.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # a whole number of UTC days, whatever the session's zone
    day = F.timestamp_seconds(F.unix_date(F.col("createdAt").cast("date")) * F.lit(86_400).cast("long"))
    dealt = requests.filter("createdAt IS NOT NULL").withColumn("__day", day).repartition(F.col("userId"), F.col("__day"))
    # of a day its beginning is known here, so it stays open for a day more
    firsts = dealt.mapInArrow(_firsts, dealt.schema).withWatermark("__day", f"{late} 1 day")
    return firsts.dropDuplicates(["userId", "__day"]).select(*requests.columns)
