"""Runs of requests that take effect once and one after the other, alone or as the batches of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tidemark.plans.interpretation import Outcome, draw, interpret
from tidemark.plans.rounds import Model
from tidemark.sources.commits import Commit, CommitLog
from tidemark.sources.staging import staged

#: A run: given the state that the last one left and the replies of earlier attempts, what it makes.
Step = Callable[[DataFrame | None, DataFrame | None], Outcome]

#: Attempts at a run, each on top of what other runs have committed meanwhile.
ATTEMPTS = 20


class OutrunError(RuntimeError):
    """Other runs have come first each time."""


def run_once(log: CommitLog, run: str, step: Step, state: str, attempts: int = ATTEMPTS) -> Commit:
    """The commit of a run; a run that is committed already is not made again.

    Entries, answers and the state for the next run are committed together.  If another run comes first, requests are judged
    anew on top of its state.  Replies that an attempt has got are kept beside it, so neither
    another attempt nor a rerun after a failure asks for them again; only those of tasks that had not ended are lost.
    """
    for _ in range(attempts):
        seen = log.commits()
        if done := log.of_run(run):
            return done
        known = [log.spark.read.parquet(p) for p in log.attempts(run, "replies")]
        replies = None
        for more in known:
            replies = more if replies is None else replies.unionByName(more)
        outcome = step(log.last(state), None if replies is None else replies.dropDuplicates(["id"]))
        folder = log.fresh_folder(run)
        made = {"replies": outcome.replies, "entries": outcome.entries, "answers": outcome.answers, state: outcome.state}
        for name, rows in made.items():
            rows.write.parquet(f"{folder}/{name}")
        if log.commit(len(seen), run, {name: f"{folder}/{name}" for name in made if name != "replies"}):
            return log.of_run(run)
    raise OutrunError(run)


def interpret_run(log: CommitLog, run: str, requests: DataFrame, model: Model | None, template: str, **options) -> Commit:
    """``interpret`` as a run, with the quota that runs before it have left."""
    return run_once(log, run, lambda state, replies: interpret(requests, model, template, state=state, replies=replies, **options), "quota")


def draw_run(log: CommitLog, run: str, requests: DataFrame, deck: DataFrame, number_of_cards: int, model: Model | None, template: str, **options) -> Commit:
    """``draw`` as a run, with the draws that runs before it have left."""
    return run_once(log, run, lambda state, replies: draw(requests, deck, number_of_cards, model, template, state=state, replies=replies, **options), "draws")


def interpret_stream(requests: DataFrame, log: CommitLog, name: str, model: Model | None, template: str, **options) -> DataStreamWriter:
    """A writer that makes each batch of a stream of requests a run, known by its number.

    A stream that ends within a batch and is started again does that batch again: if it was committed nothing happens, else
    the replies that it got are taken.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if log.of_run(f"{name}-{number}") is None:
            interpret_run(log, f"{name}-{number}", staged(rows, "requests"), model, template, **options)

    return requests.writeStream.queryName(name).foreachBatch(batch)


def draw_stream(requests: DataFrame, log: CommitLog, name: str, deck: DataFrame, number_of_cards: int, model: Model | None, template: str, **options) -> DataStreamWriter:
    """A writer that makes each batch of a stream of draws a run, like ``interpret_stream``."""

    def batch(rows: DataFrame, number: int) -> None:
        if log.of_run(f"{name}-{number}") is None:
            draw_run(log, f"{name}-{number}", staged(rows, "requests"), deck, number_of_cards, model, template, **options)

    return requests.writeStream.queryName(name).foreachBatch(batch)
