"""Model calls in rounds: at most one open request a group, those of many groups asked together.

What a request gets depends on the requests of its group before it, so a group's requests are asked one after
the other.  Groups do not depend on each other.  Rows are dealt by group and sorted by their number within it, so
a task meets the first request of each of its groups, then the second ones, and so on: those of
one round are open at the same time, and a busy group holds up no other.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import closing
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Model = Callable[[list[str]], list[str | None]]

#: Prompts of a task that are asked at once, and seconds that one may take.
AT_ONCE = 32
SECONDS = 120.0

#: Prompts that are gathered before they are asked, in multiples of those asked at once.
_GATHERED = 8

#: Groups of a partition whose states are held together: one share of so many at most, and of so few that a share has about so many rows.
SHARES = 64
SHARE_ROWS = 20_000

#: What is said of a reply that did not come in time.
LATE = "TimeoutError"


def ask(model: Model, said: str) -> tuple[str | None, str | None]:
    """The model's reply to one prompt, or the kind of error that it failed with.  Each prompt is asked alone, so one that fails takes no other with it."""
    try:
        (reply,) = model([said])
    except Exception as e:  # noqa: BLE001  a model that fails is an answer too, and its kind is told
        return None, type(e).__name__
    return reply, None


class Calls:
    """Up to ``at_once`` threads that ask prompts, one set of them after the other, for as long as a task lasts.

    A thread is made only when a prompt is left that nobody takes, and waits for the next set when none is left, so small sets with quick replies cost
    no threads of their own.  A prompt that takes longer than ``seconds`` has failed; its thread is left to itself, and another may be in its place.
    """

    def __init__(self, model: Model, at_once: int = AT_ONCE, seconds: float = SECONDS) -> None:
        self.model, self.at_once, self.seconds = model, at_once, seconds
        lock = threading.Lock()
        self.more, self.done = threading.Condition(lock), threading.Condition(lock)
        self.prompts: list[str] = []
        self.answers: dict[int, tuple[str | None, str | None]] = {}
        self.began: dict[int, float] = {}
        self.given = self.set = self.threads = self.idle = 0
        self.called = self.closed = False

    def _call(self) -> None:
        """Brings one more thread if prompts are left; it brings the next, so those that come too late are few."""
        if self.called or self.given >= len(self.prompts):
            return
        if self.idle:
            self.idle -= 1
            self.called = True
            self.more.notify()
        elif self.threads < self.at_once:
            threading.Thread(target=self._work, daemon=True).start()
            self.threads += 1
            self.called = True

    def _work(self) -> None:
        called = True
        while True:
            with self.more:
                while True:
                    if called:
                        self.called = called = False
                    if self.closed:
                        return
                    if self.given < len(self.prompts):
                        break
                    self.idle += 1
                    self.more.wait()
                    called = True
                k, of, said = self.given, self.set, self.prompts[self.given]
                self.given += 1
                self.began[k] = time.monotonic()
                self._call()
            answer = ask(self.model, said)
            with self.done:
                if of != self.set or self.began.pop(k, None) is None:  # given up meanwhile, and another thread may be in this one's place
                    return
                self.answers[k] = answer
                if len(self.answers) == len(self.prompts):
                    self.done.notify()

    def ask(self, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        """(reply, kind of error) of each prompt."""
        with self.done:
            self.prompts, self.answers, self.given, self.set = prompts, {}, 0, self.set + 1
            self._call()
            while len(self.answers) < len(prompts):
                now = time.monotonic()
                for k in [k for k, t in self.began.items() if now - t >= self.seconds]:
                    del self.began[k]
                    self.answers[k] = (None, LATE)
                    self.threads -= 1
                    self._call()
                if len(self.answers) < len(prompts):
                    self.done.wait(max(0.0, min([self.seconds, *(t + self.seconds - now for t in self.began.values())])))
            return [self.answers[k] for k in range(len(prompts))]

    def close(self) -> None:
        with self.more:
            self.closed = True
            self.more.notify_all()


def ask_all(model: Model, prompts: list[str], at_once: int = AT_ONCE, seconds: float = SECONDS) -> list[tuple[str | None, str | None]]:
    """(reply, kind of error) of each prompt; ``at_once`` of them are open at a time.

    One that takes longer than ``seconds`` has failed, and its place goes to the next; what it answers later is lost.
    """
    with closing(Calls(model, at_once, seconds)) as calls:
        return calls.ask(prompts)


class Judge:
    """What a group's requests get.  A state is whatever the steps below pass on; ``start`` is that of a group without any rows."""

    start: Any = None

    def carry(self, state: Any, row: dict) -> Any:
        """The state with what an earlier run has left."""
        raise NotImplementedError

    def decide(self, state: Any, row: dict) -> tuple | None:
        """What a request gets at once; None if the model must be asked."""
        raise NotImplementedError

    def close(self, state: Any, row: dict, reply: str | None, failure: str | None) -> tuple[Any, tuple]:
        """The state after a reply, and what the request gets."""
        raise NotImplementedError


def in_rounds(rows: DataFrame, group: list[str], order: list[str], judge: Judge, model: Model, read: list[str], made: T.StructType, at_once: int = AT_ONCE, seconds: float = SECONDS, size: int | None = None) -> DataFrame:
    """``rows`` with the columns ``made``, each group judged in ``order``.

    ``rows`` have columns ``carried`` (what earlier runs left; first in each group, and not in the result), ``prompt``, and
    ``known`` and ``known_failure``: a reply of an earlier attempt, so that it is not asked for again.
    A task holds the states of the groups of one share of a partition, and some gathered rows, however many rows a group has.  A share's groups are
    asked together; where ``size``, about the number of rows, is told and small, shares are fewer, so that they have many.
    """
    place = Window.partitionBy(*group).orderBy(F.desc("carried"), *order)
    names = [c for c in rows.columns if c != "carried"]
    # a number of its own, so that small rows with slow prompts are not gathered into few tasks; the window takes them as they are dealt
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = SHARES if size is None else max(1, min(SHARES, -(-size // (tasks * SHARE_ROWS))))
    share = F.pmod(F.xxhash64(*group, F.lit("share")), F.lit(shares))
    dealt = rows.repartition(tasks, *[F.col(c) for c in group]).withColumn("__round", F.when(F.col("carried"), F.lit(0)).otherwise(F.row_number().over(place))).withColumn("__share", share)
    dealt = dealt.sortWithinPartitions("__share", "__round", *group)
    schema = T.StructType([*[rows.schema[c] for c in names], *made.fields])
    types = [{T.BooleanType(): pa.bool_(), T.LongType(): pa.int64()}.get(f.dataType, pa.string()) for f in made]
    wanted = list(dict.fromkeys([*group, *read, "carried", "prompt", "known", "known_failure", "__share"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(Calls(model, at_once, seconds)) as calls:
            yield from judged(batches, calls)

    def judged(batches: Iterator[pa.RecordBatch], calls: Calls) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        share = None
        for batch in batches:
            held = batch.select(wanted).to_pylist()
            out: list[tuple | None] = [None] * len(held)
            opened: dict[tuple, int] = {}

            def close() -> None:
                asked = [k for k in opened.values() if held[k]["known"] is None and held[k]["known_failure"] is None]
                replies = dict(zip(asked, calls.ask([held[k]["prompt"] for k in asked]), strict=True))
                for key, k in opened.items():
                    reply, failure = replies.get(k) or (held[k]["known"], held[k]["known_failure"])
                    states[key], out[k] = judge.close(states.get(key, judge.start), held[k], reply, failure)
                opened.clear()

            for k, row in enumerate(held):
                key = tuple(row[c] for c in group)
                if key in opened or len(opened) >= _GATHERED * at_once or row["__share"] != share:
                    close()
                if row["__share"] != share:
                    share = row["__share"]
                    states.clear()
                state = states.get(key, judge.start)
                if row["carried"]:
                    states[key] = judge.carry(state, row)
                elif (found := judge.decide(state, row)) is None:
                    opened[key] = k
                else:
                    out[k] = found
            close()
            keep = [k for k, row in enumerate(held) if not row["carried"]]
            columns = [pa.array([out[k][c] for k in keep], kind) for c, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.select(names).take(pa.array(keep, pa.int64())).columns, *columns], names=schema.names)

    return dealt.mapInArrow(run, schema)
