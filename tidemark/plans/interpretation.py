"""From requests to entries: parse, validate, admit, ask the model, check its reply, store."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import json as J
from tidemark.functions.text import MAX_UNITS, join_or, prompt, utf16_length, web_trim
from tidemark.functions.times import day_end, day_start
from tidemark.operators import cards, carried
from tidemark.operators.admission import HOURS, LIMIT, micros
from tidemark.operators.history import orientation
from tidemark.plans.rounds import AT_ONCE, SECONDS, Calls, Judge, Model, in_rounds
from tidemark.sources.entries import draw_rows, dream_rows, entry_object
from tidemark.sources.schemas import ENTRY, FORTUNE, SYMBOLS
from tidemark.sources.staging import staged

#: Answers: no identity, no text, text too long, no time / quota used up / model failed / fine.
BAD, OVER, FAILED, FINE = 400, 429, 502, 200

#: What is said with an answer that is not fine.
ERRORS = {"no user": "Who asks is not known.", "no text": "There is no text.", "too long": "The text is too long.", "no time": "When this was asked is not known.", OVER: "No more requests today.", FAILED: "This went wrong. Try again later."}

#: Kind of failure of a draw whose card the deck lacks.
NO_CARD = "no card"


def normalized(requests: DataFrame) -> DataFrame:
    """Requests (id, user_id, request_ts, raw_body) with dream_text and mood_tags; a malformed body counts as empty."""
    parsed = requests.withColumn("__body", J.body(F.col("raw_body")))
    return parsed.withColumns({"dream_text": web_trim(J.text_member(F.col("__body"), "dreamText")), "mood_tags": J.string_items(F.col("__body"), "moodTags")}).drop("__body")


def validity(user: Column, text: Column, most: int = MAX_UNITS, time: Column | None = None) -> Column:
    """The first rule that a request breaks: no user, no text, too long, and, where a time is given, no time; else null."""
    out = (
        F.when(user.isNull() | (user == ""), "no user")
        .when(F.coalesce(text, F.lit("")) == "", "no text")
        .when(utf16_length(text) > most, "too long")
    )
    return out if time is None else out.when(time.isNull(), "no time")


def status(problem: Column, admitted: Column, replied: Column) -> Column:
    """The answer's code; the first that applies, in this order."""
    return F.when(problem.isNotNull(), BAD).when(~F.coalesce(admitted, F.lit(False)), OVER).when(~F.coalesce(replied, F.lit(False)), FAILED).otherwise(FINE)


def _wanted(model: Model | None) -> Model:
    if model is None:
        raise ValueError("a model is needed")
    return model


def asked(rows: DataFrame, model: Model | None, prompt_col: str = "prompt", at_once: int = AT_ONCE, seconds: float = SECONDS) -> DataFrame:
    """``rows`` with the model's ``reply`` to each prompt, null where it failed, and the kind of ``failure``."""
    model = _wanted(model)
    schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), T.StructField("failure", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with closing(Calls(model, at_once, seconds)) as calls:
            for frame in frames:
                found = calls.ask(frame[prompt_col].tolist())
                column = lambda k: pd.Series([f[k] for f in found], index=frame.index, dtype=object)  # noqa: E731, B023
                yield frame.assign(reply=column(0), failure=column(1))

    return rows.mapInPandas(run, schema)


@dataclass(frozen=True)
class Outcome:
    """What a run makes.

    ``entries`` are to be stored; ``answers`` are all requests with their status, the body of the answer and, where the model failed, the kind of
    ``failure`` or the ``refused`` reply; ``state`` is what the next run needs of this one and those before it; ``replies`` (id, reply, failure)
    are the model's, so that another attempt at the same run need not ask again.
    """

    entries: DataFrame
    answers: DataFrame
    state: DataFrame
    replies: DataFrame


def failures(outcome: Outcome) -> DataFrame:
    """How often the model failed, by kind of error; replies that were no good are one kind."""
    failed = outcome.answers.filter(F.col("status") == FAILED)
    return failed.groupBy(F.coalesce("failure", F.lit("refused")).alias("failure")).agg(F.count("*").alias("n"))


def _error(problem: Column, code: Column) -> Column:
    said = F.create_map(*[F.lit(x) for k, v in ERRORS.items() for x in (str(k), v)])
    return F.to_json(F.struct(said[F.coalesce(problem, code.cast("string"))].alias("error")))


def _with_known(rows: DataFrame, replies: DataFrame | None) -> DataFrame:
    """``rows`` with ``known`` and ``known_failure``, the replies of an earlier attempt."""
    if replies is None:
        return rows.withColumns({"known": F.lit(None).cast("string"), "known_failure": F.lit(None).cast("string")})
    return rows.join(replies.select("id", F.col("reply").alias("known"), F.col("failure").alias("known_failure")), "id", "left")


def _size(span: carried.Span, state: DataFrame | None) -> int:
    """How many rows a run judges; entries that are looked up are of users who ask, so they add no group."""
    return span.size + (0 if state is None else state.count())


class _Quota(Judge):
    """Admission by the accepted times that may still count, the model's reply being one of the conditions."""

    start: tuple = ()

    def __init__(self, limit: int, window: int) -> None:
        self.limit, self.window = limit, window

    def carry(self, state: tuple, row: dict) -> tuple:
        # of all accepted times the last ones tell as much as all do
        return tuple(sorted((*state, *row["held"]))[-self.limit :])

    def decide(self, state: tuple, row: dict) -> tuple | None:
        still = sum(t >= row["at"] - self.window for t in state)
        return (False, None, None, None) if still >= self.limit else None

    def close(self, state: tuple, row: dict, reply: str | None, failure: str | None) -> tuple[tuple, tuple]:
        json = J.parsed_reply(reply)
        if not J.shape_of(json):
            return state, (True, reply, failure, None)
        return tuple(sorted((*state, row["at"]))[-self.limit :]), (True, reply, failure, json)


def interpret(
    requests: DataFrame,
    model: Model | None,
    template: str,
    no_tags: str = "none",
    limit: int = LIMIT,
    hours: int = HOURS,
    stored: DataFrame | None = None,
    state: DataFrame | None = None,
    replies: DataFrame | None = None,
    late_hours: int = HOURS,
    at_once: int = AT_ONCE,
    seconds: float = SECONDS,
) -> Outcome:
    """Runs requests (id, user_id, request_ts, raw_body) through all steps.

    Checks that cost little come first.  Then each user's requests are taken in order of time, then id:
    one that finds ``limit`` entries since ``hours`` before it is over quota and the model is
    not asked; else it is, and the entry counts only if the reply is good.  The entries that it finds are those of this run and of
    runs before it: either told by the ``state`` that these left, or looked up in the table ``stored``, of which
    only the time since ``hours`` before the first request, and only users who ask, are read.

    Requests of different users are asked together (``rounds``).  Judged requests are
    written to the shared folder, so no prompt is sent twice unless a task is run again; ``replies`` of an earlier attempt are taken as they are.
    A null time is refused like a null text.  The state holds times for ``late_hours`` beyond the window, so requests may
    come as much later than those of earlier runs.
    """
    model = _wanted(model)
    window = hours * 3_600_000_000
    rows = normalized(requests).withColumn("problem", validity(F.col("user_id"), F.col("dream_text"), time=F.col("request_ts")))
    # written once: a filter on what is read from a body reads it anew for each time that the condition names it, and both kinds of rows are wanted
    rows = staged(rows.select("id", "user_id", "request_ts", "dream_text", "mood_tags", "problem"), "parsed")
    said = prompt(template, text=F.col("dream_text"), tags=join_or(F.col("mood_tags"), no_tags))
    valid = rows.filter("problem IS NULL").select("id", "user_id", "request_ts", "dream_text", said.alias("prompt"), micros(F.col("request_ts")).alias("at"))
    span = carried.span(rows.filter("request_ts IS NOT NULL"), "request_ts")
    before = carried.quota_before(valid, span, stored, state, hours, limit)
    dealt = _with_known(valid, replies).withColumn("carried", F.lit(False)).unionByName(before.withColumn("carried", F.lit(True)), allowMissingColumns=True)
    made = T.StructType([T.StructField("admitted", T.BooleanType()), *(T.StructField(n, T.StringType()) for n in ("reply", "failure", "json"))])
    judged = staged(in_rounds(dealt, ["user_id"], ["at", "id"], _Quota(limit, window), model, ["at", "held"], made, at_once, seconds, _size(span, state)).drop("held", "known", "known_failure"), "judged")

    fields = "title string, traditional string, psychological string, mood string, advice string, symbols {}, fortune {}".format(SYMBOLS.simpleString(), FORTUNE.simpleString())
    whole = F.try_parse_json("json")
    read = judged.withColumns({"r": F.from_json("json", fields), "symbolsJson": J.stored_member(whole, "symbols"), "fortuneJson": J.stored_member(whole, "fortune")})
    columns = read.select(F.col("id").alias("key"), F.col("user_id").alias("userId"), F.col("user_id").alias("asker"), F.col("dream_text").alias("dreamText"), "r.*", "symbolsJson", "fortuneJson", "request_ts", "admitted", "reply", "failure", F.col("json").isNotNull().alias("good"))
    made = dream_rows(columns, F.col("key"), F.col("request_ts"), keep=("key", "asker", "admitted", "reply", "failure", "good"))
    entries = made.filter("good").select(*ENTRY.names)
    # the created row stands in the answer
    done = made.select(F.col("key").alias("id"), F.col("asker").alias("user_id"), "admitted", "good", F.when(~F.col("good"), F.col("reply")).alias("refused"), "failure", F.when(F.col("good"), entry_object()).alias("entry"))
    early = rows.filter("problem IS NOT NULL").select("id", "user_id", "problem")
    answers = done.unionByName(early, allowMissingColumns=True).withColumn("status", status(F.col("problem"), F.col("admitted"), F.col("good")))
    body = F.when(F.col("status") == FINE, F.to_json(F.struct(F.try_parse_json("entry").alias("entry")))).otherwise(_error(F.col("problem"), F.col("status")))
    after = carried.quota_after(before, judged.filter("json IS NOT NULL").select("user_id", "at"), span, limit, hours + late_hours)
    replied = judged.filter("admitted").select("id", "reply", "failure")
    return Outcome(entries, answers.select("id", "user_id", "problem", "refused", "failure", "status", body.alias("body")), after, replied)


def todays_draws(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, user_id, body): the draw that each request (id, user_id, request_ts) finds for its UTC day, the latest if there are several.

    Where there is none, or who asks or when is not known, or what is stored can't be read, the ``entry`` of the answer is null.
    Of the entries the days from the first request's to the last one's are read, and users who ask.
    """
    day = day_start(F.col("request_ts"))
    asked = requests.select("id", "user_id", F.col("user_id").cast("string").alias("__who"), day.alias("__day"))
    span = carried.span(requests.filter("request_ts IS NOT NULL"), "request_ts")
    drawn = carried.draws_before(requests, span, stored if span.last is None else stored.filter(F.col("createdAt") < day_end(F.lit(span.last).cast("timestamp_ntz"))), None)
    latest = drawn.groupBy(F.col("user_id").cast("string").alias("__who"), F.col("day").alias("__day")).agg(F.max_by("entry", F.struct("at", "own")).alias("entry"))
    found = asked.join(latest, ["__who", "__day"], "left")
    body = F.to_json(F.struct(F.try_parse_json("entry").alias("entry")), {"ignoreNullFields": "false"})
    return found.select("id", "user_id", body.alias("body"))


def read_draws(draws: DataFrame, model: Model | None, template: str) -> DataFrame:
    """Draws (name, orientation, meaning) with the model's advice and a status: where it is missing, null and that of a failure."""
    rows = draws.withColumn("prompt", prompt(template, name=F.col("name"), orientation=F.col("orientation"), meaning=F.col("meaning")))
    advice = J.true_member(F.try_parse_json(J.reply_json(F.col("reply"))), "advice")
    out = asked(rows, model).withColumn("tarotAdvice", advice).drop("prompt", "reply", "failure")
    return out.withColumn("status", F.when(F.col("tarotAdvice").isNull(), FAILED).otherwise(FINE))


class _Day(Judge):
    """One draw a user and day: the first that is read."""

    def carry(self, state: tuple | None, row: dict) -> tuple:
        # of several draws of a day, which earlier races have left, the latest is the one that is found
        last = (row["at"], row["own"], row["entry"])
        return last if state is None or last[:2] > state[:2] else state

    def decide(self, state: tuple | None, row: dict) -> tuple | None:
        if state is not None:
            return (*state[1:], None, True, None, None)
        return (None, None, None, False, None, NO_CARD) if row["prompt"] is None else None

    def close(self, state: tuple | None, row: dict, reply: str | None, failure: str | None) -> tuple[tuple | None, tuple]:
        advice = J.true_text(J.parsed_reply(reply), "advice")
        if advice is None:
            return state, (None, None, None, False, reply, failure)
        entry = J.with_member(row["entry"], "tarotAdvice", advice)
        return (row["at"], row["own"], entry), (row["own"], entry, advice, False, reply, failure)


def draw(
    requests: DataFrame,
    deck: DataFrame,
    number_of_cards: int,
    model: Model | None,
    template: str,
    stored: DataFrame | None = None,
    turned: tuple[str, str] = ("upright", "reversed"),
    state: DataFrame | None = None,
    replies: DataFrame | None = None,
    late_days: int = 1,
    at_once: int = AT_ONCE,
    seconds: float = SECONDS,
) -> Outcome:
    """One draw a user and UTC day, from requests (id, user_id, request_ts) and a deck (number from 0, name, keyword, uprightMeaning, reversedMeaning).

    A request without a user or a time is refused.  Each user's requests of a day are taken in order of time, then id: if
    the day has a draw, it is answered with that; else a card is picked by hash of the
    request's id, read by the model, and stored.  A failed reading is no draw, so the next request tries again; so does a card that the deck lacks.
    Draws of earlier runs are told by the ``state`` that these left, or looked up in the table ``stored``, of which only the days since the first request's, and
    only users who ask, are read.  The state holds days for ``late_days`` before the last one.
    ``answers`` are (id, user_id, status, draw_id, alreadyDrawn, failure, body).
    """
    model = _wanted(model)
    problem = F.when(F.col("user_id").isNull() | (F.col("user_id") == ""), "no user").when(F.col("request_ts").isNull(), "no time")
    rows = requests.select("id", "user_id", "request_ts", problem.alias("problem"))
    named = deck.select("number", F.struct("name", "keyword", "uprightMeaning", "reversedMeaning").alias("card"))
    picked = cards.drawn(rows.filter("problem IS NULL").withColumn("draw_key", F.col("id")), named, number_of_cards)
    said = prompt(template, name=F.col("card.name"), orientation=orientation(F.col("reversed"), *turned), meaning=cards.meaning(F.col("card"), F.col("reversed")))
    columns = picked.select(F.col("id").alias("key"), F.col("user_id").alias("userId"), F.col("card.name").alias("cardName"), F.col("card.keyword").alias("cardKeyword"), "reversed", F.lit(None).cast("string").alias("tarotAdvice"), "request_ts", F.col("user_id").alias("asker"), F.when(F.col("card").isNotNull(), said).alias("prompt"))
    valid = draw_rows(columns, F.col("key"), F.col("request_ts"), keep=("key", "asker", "request_ts", "prompt"))
    valid = valid.select(F.col("key").alias("id"), F.col("asker").alias("user_id"), "request_ts", "cardName", "cardKeyword", "reversed", "prompt", day_start(F.col("request_ts")).alias("day"), micros(F.col("request_ts")).alias("at"), F.col("key").cast("string").alias("own"), entry_object().alias("entry"))
    span = carried.span(requests.filter("request_ts IS NOT NULL"), "request_ts")
    before = carried.draws_before(valid, span, stored, state)
    dealt = _with_known(valid, replies).withColumn("carried", F.lit(False)).unionByName(before.withColumn("carried", F.lit(True)), allowMissingColumns=True)
    made = T.StructType([*(T.StructField(n, T.StringType()) for n in ("draw_id", "drawn", "tarotAdvice")), T.StructField("alreadyDrawn", T.BooleanType()), *(T.StructField(n, T.StringType()) for n in ("reply", "failure"))])
    done = in_rounds(dealt, ["user_id", "day"], ["at", "id"], _Day(), model, ["at", "own", "entry"], made, at_once, seconds, _size(span, state))
    done = staged(done.drop("entry", "known", "known_failure"), "draws")
    new = done.filter("NOT alreadyDrawn AND draw_id IS NOT NULL").withColumn("userId", F.col("user_id"))
    entries = draw_rows(new, F.col("id"), F.col("request_ts"))
    answers = done.select("id", "user_id", "draw_id", "drawn", "alreadyDrawn", "failure").unionByName(rows.filter("problem IS NOT NULL").select("id", "user_id", "problem"), allowMissingColumns=True)
    answers = answers.withColumn("status", status(F.col("problem"), F.lit(True), F.col("draw_id").isNotNull()))
    fine = F.to_json(F.struct(F.try_parse_json("drawn").alias("entry"), "alreadyDrawn"))
    body = F.when(F.col("status") == FINE, fine).otherwise(_error(F.col("problem"), F.col("status")))
    after = carried.draws_after(before, new.select("user_id", "day", "at", F.col("draw_id").alias("own"), F.col("drawn").alias("entry")), span, late_days)
    replied = done.filter("reply IS NOT NULL OR failure IS NOT NULL").filter(~F.col("failure").eqNullSafe(NO_CARD)).select("id", "reply", "failure")
    return Outcome(entries, answers.select("id", "user_id", "problem", "failure", "status", "draw_id", "alreadyDrawn", body.alias("body")), after, replied)
