"""Runs of requests: what they leave to the next, what they read, how the model is asked, and what happens to runs that meet or fail."""

from __future__ import annotations

import json
import threading
import time
from collections import Counter
from contextlib import closing
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import json as J
from tidemark.operators import admission, carried
from tidemark.plans import interpretation, runs
from tidemark.plans.rounds import LATE, Calls, ask_all
from tidemark.sources import entries as S
from tidemark.sources.commits import CommitLog

T0 = datetime(2024, 3, 1, 10)
REQUEST = "id long, user_id string, request_ts timestamp_ntz, raw_body string"
GOOD = json.dumps({f: "x" for f in J.TOP_FIELDS} | {"symbols": [], "fortune": {f: "y" for f in J.FORTUNE_FIELDS} | {"more": [1]}})


def good_model(prompts):
    return [GOOD for _ in prompts]


def requests(spark, rows):
    """(id, user, hours after the start[, text])."""
    return spark.createDataFrame([(r[0], r[1], None if r[2] is None else T0 + timedelta(hours=r[2]), json.dumps({"dreamText": r[3] if len(r) > 3 else "a dream"})) for r in rows], REQUEST)


def statuses(made):
    return {r["id"]: r["status"] for r in made.answers.collect()}


# --- state --------------------------------------------------------------------------


def admitted(rows, limit=5, hours=24):
    """Plain loop over requests in order."""
    held, out = {}, {}
    for key, user, at in sorted(rows, key=lambda r: (r[2], r[0])):
        still = [t for t in held.get(user, []) if t >= at - hours]
        out[key] = 200 if len(still) < limit else 429
        held[user] = [*still, at] if len(still) < limit else still
    return out


def test_state_tells_what_the_history_would(spark):
    rows = [(k, f"u{k * 7 % 4}", k * 0.9) for k in range(120)]
    expected, state, got = admitted(rows), None, {}
    assert set(expected.values()) == {200, 429}
    for lo, hi in ((0, 50), (50, 51), (51, 120)):
        made = interpretation.interpret(requests(spark, rows[lo:hi]), good_model, "{text}", state=state)
        got |= statuses(made)
        state = spark.createDataFrame(made.state.collect(), made.state.schema)
        assert all(len(r["times"]) <= 5 for r in state.collect())
    assert got == expected
    # an empty run passes the state on
    made = interpretation.interpret(requests(spark, rows[:0]), good_model, "{text}", state=state)
    assert made.answers.count() == 0 and {tuple(r["times"]) for r in made.state.collect()} == {tuple(r["times"]) for r in state.collect()}


def test_state_forgets_users_who_have_been_away(spark):
    first = interpretation.interpret(requests(spark, [(1, "a", 0), (2, "b", 0)]), good_model, "{text}")
    state = spark.createDataFrame(first.state.collect(), first.state.schema)
    later = interpretation.interpret(requests(spark, [(3, "c", 49)]), good_model, "{text}", state=state)
    assert {r["userId"] for r in first.state.collect()} == {"a", "b"} and {r["userId"] for r in later.state.collect()} == {"c"}
    # what comes late is still judged by them
    kept = interpretation.interpret(requests(spark, [(3, "c", 49)]), good_model, "{text}", state=state, late_hours=26)
    assert {r["userId"] for r in kept.state.collect()} == {"a", "b", "c"}


def test_no_entry_before_the_window_is_read(spark, tmp_path):
    old = [(k, f"u{k % 3}", k - 200.0) for k in range(200)]
    S.append(interpretation.interpret(requests(spark, old), good_model, "{text}").entries, str(tmp_path / "e"))
    stored = S.read_entries(spark, str(tmp_path / "e"))
    asked = requests(spark, [(1000 + k, "u1", k * 0.1) for k in range(6)])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    held = carried.quota_before(asked, carried.span(asked, "request_ts"), stored, None, 24, 5)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(createdAt,2024-02-29T10:00)" in plan and "LeftSemi" in plan
    assert {r["user_id"] for r in held.collect()} == {"u1"} and held.count() <= 8
    made = interpretation.interpret(asked, good_model, "{text}", stored=stored)
    times = [(k, u, t) for k, u, t in [*old, *[(1000 + k, "u1", k * 0.1) for k in range(6)]]]
    expected = admitted(times)
    assert statuses(made) == {k: s for k, s in expected.items() if k >= 1000}
    # draws: the days since the first request's
    days = carried.draws_before(asked, carried.span(asked, "request_ts"), stored, None)
    assert "GreaterThanOrEqual(createdAt,2024-03-01T00:00)" in days._jdf.queryExecution().executedPlan().toString()


def test_answers_hold_the_created_row(spark):
    made = interpretation.interpret(requests(spark, [(7, "a", 0, "a \U0001f493")]), good_model, "{text}")
    entry = json.loads(made.answers.first()["body"])["entry"]
    assert entry == {"id": "7", "userId": "a", "type": "DREAM", "dreamText": "a \U0001f493", "mood": "x", "advice": "x", "title": "x", "traditional": "x", "psychological": "x", "symbols": [], "fortune": {f: "y" for f in J.FORTUNE_FIELDS} | {"more": [1]}, "cardName": None, "cardKeyword": None, "tarotAdvice": None, "reversed": None, "createdAt": "2024-03-01T10:00:00.000Z"}
    row = made.entries.first()
    assert (row["id"], row["createdAt"], row["title"]) == ("7", T0, "x")


DECK = [(0, "Sun", "k", "up", "down")]
DECK_SCHEMA = "number long, name string, keyword string, uprightMeaning string, reversedMeaning string"


def test_draws_go_on_from_the_state(spark):
    deck = spark.createDataFrame(DECK, DECK_SCHEMA)
    rows = [(k, "ab"[k % 2], T0 + timedelta(hours=5 * k)) for k in range(12)]
    frame = lambda some: spark.createDataFrame(some, "id long, user_id string, request_ts timestamp_ntz")
    model = lambda prompts: ['{"advice": "go"}' for _ in prompts]
    whole = {r["id"]: (r["status"], r["draw_id"], r["alreadyDrawn"], r["body"]) for r in interpretation.draw(frame(rows), deck, 1, model, "{name}").answers.collect()}
    state, got = None, {}
    for lo, hi in ((0, 2), (2, 3), (3, 12)):
        made = interpretation.draw(frame(rows[lo:hi]), deck, 1, model, "{name}", state=state)
        got |= {r["id"]: (r["status"], r["draw_id"], r["alreadyDrawn"], r["body"]) for r in made.answers.collect()}
        state = spark.createDataFrame(made.state.collect(), made.state.schema)
    assert got == whole and {json.loads(b)["entry"]["tarotAdvice"] for _, _, _, b in got.values()} == {"go"}
    assert all(json.loads(b)["entry"]["id"] == d for _, d, _, b in got.values())
    assert {r["day"].day for r in state.collect()} == {2, 3}  # the last day and the one before


def test_a_card_that_the_deck_lacks_is_no_draw(spark):
    deck = spark.createDataFrame([(k, f"card {k}", "k", "up", "down") for k in range(3)], DECK_SCHEMA)
    asked = []
    frame = spark.createDataFrame([(k, "a", T0 + timedelta(minutes=k)) for k in range(40)], "id long, user_id string, request_ts timestamp_ntz")
    made = interpretation.draw(frame, deck, 78, lambda prompts: asked.append(prompts) or [None], "{name}")
    rows = made.answers.collect()
    assert {r["status"] for r in rows} == {502} and {r["failure"] for r in rows} <= {"no card", None} and made.entries.count() == 0
    assert {r["failure"]: r["n"] for r in interpretation.failures(made).collect()}["no card"] > 30
    ok = interpretation.draw(frame, deck, 78, lambda prompts: ['{"advice": "go"}'], "{name}")
    assert ok.entries.filter("cardName IS NULL").count() == 0


# --- times that are missing ------------------------------------------------------------


def test_requests_without_a_time_are_refused(spark):
    rows = [(1, "a", None), (2, "a", 1), (3, "a", None, ""), (4, None, None), (5, "b", None)]
    made = interpretation.interpret(requests(spark, rows), good_model, "{text}")
    got = {r["id"]: (r["status"], r["problem"], r["body"]) for r in made.answers.collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: (400, "no time"), 2: (200, None), 3: (400, "no text"), 4: (400, "no user"), 5: (400, "no time")}
    assert json.loads(got[1][2]) == {"error": interpretation.ERRORS["no time"]}
    only = interpretation.interpret(requests(spark, rows[:1]), good_model, "{text}")
    assert statuses(only) == {1: 400} and only.state.count() == 0
    deck = spark.createDataFrame(DECK, DECK_SCHEMA)
    drawn = interpretation.draw(requests(spark, rows), deck, 1, lambda p: ['{"advice": "go"}'], "{name}")
    assert statuses(drawn) == {1: 400, 2: 200, 3: 400, 4: 400, 5: 400}


def test_admission_refuses_what_has_no_time(spark):
    rows = [(k, "a", None if k % 3 == 0 else T0 + timedelta(minutes=k)) for k in range(12)]
    frame = spark.createDataFrame(rows, "id long, userId string, createdAt timestamp_ntz")
    expected = {k: k % 3 != 0 and k <= 7 for k in range(12)}
    assert {r["id"]: r["admitted"] for r in admission.admit(frame).collect()} == expected
    assert {r["id"]: r["admitted"] for r in admission.admit_native(frame).collect()} == expected


# --- the model ------------------------------------------------------------------------


def test_prompts_of_a_round_are_asked_together():
    open_, most, lock = [0], [0], threading.Lock()

    def model(prompts):
        with lock:
            open_[0] += 1
            most[0] = max(most[0], open_[0])
        time.sleep(0.1)
        with lock:
            open_[0] -= 1
        return [prompts[0].upper()]

    began = time.monotonic()
    got = ask_all(model, [f"p{k}" for k in range(100)], at_once=50)
    assert time.monotonic() - began < 2 and got == [(f"P{k}", None) for k in range(100)] and most[0] <= 50
    assert ask_all(model, []) == []


def test_a_prompt_that_hangs_gives_its_place_to_the_next():
    done = threading.Event()

    def model(prompts):
        if "hang" in prompts[0]:
            done.wait(20)
        if "boom" in prompts[0]:
            raise KeyError(prompts[0])
        return ["a", "b"] if "two" in prompts[0] else [prompts[0]]

    began = time.monotonic()
    got = ask_all(model, ["hang", "hang too", "one", "boom", "two", "last"], at_once=2, seconds=0.3)
    done.set()
    assert time.monotonic() - began < 5
    assert got == [(None, LATE), (None, LATE), ("one", None), (None, "KeyError"), (None, "ValueError"), ("last", None)]


def test_many_users_take_the_time_of_one(spark):
    def model(prompts):
        time.sleep(0.1)
        return [GOOD for _ in prompts]

    rows = [(k, f"u{k % 100}", k / 1000) for k in range(200)]  # two rounds
    began = time.monotonic()
    made = interpretation.interpret(requests(spark, rows), model, "{text}", at_once=100)
    took = time.monotonic() - began
    assert set(statuses(made).values()) == {200} and took < 15  # one by one they take 20 seconds in one task, and these are few


def test_failures_free_their_place_and_are_counted(spark):
    def model(prompts):
        if "bad" in prompts[0]:
            raise ConnectionError("no line")
        return ["no" if "odd" in prompts[0] else GOOD]

    rows = [(k, "a", k / 100, ("bad", "odd", "good")[k % 3]) for k in range(24)]
    made = interpretation.interpret(requests(spark, rows), model, "{text}")
    expected, good = {}, 0
    for k in range(24):
        expected[k] = 429 if good >= 5 else 200 if k % 3 == 2 else 502
        good += k % 3 == 2 and good < 5
    assert statuses(made) == expected
    assert {r["failure"]: r["n"] for r in interpretation.failures(made).collect()} == {"ConnectionError": 5, "refused": 5}


# --- runs that meet, fail and come again ---------------------------------------------------


def logged(path):
    """A model that notes what it is asked, one prompt a file."""

    def model(prompts):
        import uuid

        (path / uuid.uuid4().hex).write_text(prompts[0])
        return [GOOD for _ in prompts]

    path.mkdir()
    return model


def test_a_run_is_made_once(spark, tmp_path):
    log, model = CommitLog(spark, str(tmp_path / "log")), logged(tmp_path / "calls")
    first = runs.interpret_run(log, "one", requests(spark, [(k, "a", k) for k in range(4)]), model, "{text}")
    again = runs.interpret_run(log, "one", requests(spark, [(k, "a", k) for k in range(4)]), model, "{text}")
    assert first == again and first.version == 1 and log.table("entries").count() == 4
    more = runs.interpret_run(CommitLog(spark, str(tmp_path / "log")), "two", requests(spark, [(10 + k, "a", 4 + k) for k in range(4)]), model, "{text}")
    assert more.version == 2 and log.table("entries").count() == 5  # the quota goes on
    assert log.table("entries", upto=1).count() == 4 and len(list((tmp_path / "calls").iterdir())) == 5
    assert Counter(r["status"] for r in log.table("answers").collect()) == {200: 5, 429: 3}


def test_runs_at_once_keep_the_quota(spark, tmp_path):
    model, found = logged(tmp_path / "calls"), []

    def go(name, shift):
        try:
            log = CommitLog(spark, str(tmp_path / "log"))
            rows = [(shift + k, f"u{k % 2}", k / 10, f"{name} {k}") for k in range(8)]
            found.append(runs.interpret_run(log, name, requests(spark, rows), model, "{text}"))
        except Exception as e:  # noqa: BLE001
            found.append(e)

    threads = [threading.Thread(target=go, args=(f"run{k}", 100 * k)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(c.version for c in found) == [1, 2, 3], found
    log = CommitLog(spark, str(tmp_path / "log"))
    assert {r["userId"]: r["count"] for r in log.table("entries").groupBy("userId").count().collect()} == {"u0": 5, "u1": 5}
    assert log.table("answers").count() == 24
    calls = Counter(p.read_text() for p in (tmp_path / "calls").iterdir())
    assert set(calls.values()) == {1}  # a run that came second took the replies that it had


def test_a_run_that_failed_asks_nothing_again(spark, tmp_path, monkeypatch):
    log, model = CommitLog(spark, str(tmp_path / "log")), logged(tmp_path / "calls")
    rows = requests(spark, [(k, f"u{k}", 0, f"text {k}") for k in range(6)])
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            runs.interpret_run(log, "one", rows, model, "{text}")
    assert log.table("entries") is None and log.last("quota") is None
    runs.interpret_run(log, "one", rows, model, "{text}")
    assert log.table("entries").count() == 6 and len(list((tmp_path / "calls").iterdir())) == 6


def test_a_stream_that_is_started_again_goes_on(spark, tmp_path, monkeypatch):
    model = logged(tmp_path / "calls")
    rows = [(k, f"u{k % 3}", k / 2) for k in range(60)]
    for part in range(4):
        requests(spark, rows[15 * part : 15 * part + 15]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    log = CommitLog(spark, str(tmp_path / "log"))
    start = lambda: runs.interpret_stream(source(), log, "dreams", model, "{text}").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    made = CommitLog.commit
    for after_commit in (False, True):  # before the second batch is committed, and right after
        with monkeypatch.context() as m:

            def fail(self, after, run, tables, after_commit=after_commit):
                if run != "dreams-1":
                    return made(self, after, run, tables)
                if after_commit:
                    made(self, after, run, tables)
                raise RuntimeError("stopped")

            m.setattr(CommitLog, "commit", fail)
            with pytest.raises(Exception, match="stopped"):
                start()
    start()
    assert [c.run for c in log.commits()] == [f"dreams-{k}" for k in range(4)]
    assert {r["id"]: r["status"] for r in log.table("answers").collect()} == admitted([(k, u, t) for k, u, t in rows])
    assert log.table("entries").count() == len(list((tmp_path / "calls").iterdir())) == sum(s == 200 for s in admitted(rows).values())


def test_draw_runs_give_one_draw_a_day(spark, tmp_path):
    deck, found = spark.createDataFrame(DECK, DECK_SCHEMA), []
    frame = lambda k: spark.createDataFrame([(10 * k + j, "a", T0 + timedelta(minutes=10 * j + k)) for j in range(3)], "id long, user_id string, request_ts timestamp_ntz")
    go = lambda k: found.append(runs.draw_run(CommitLog(spark, str(tmp_path / "log")), f"r{k}", frame(k), deck, 1, lambda p: ['{"advice": "go"}'], "{name}"))
    threads = [threading.Thread(target=go, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = CommitLog(spark, str(tmp_path / "log"))
    assert len(found) == 2 and log.table("entries").count() == 1
    answers = log.table("answers").collect()
    assert len({r["draw_id"] for r in answers}) == 1 and sum(not r["alreadyDrawn"] for r in answers) == 1
    # the latest of the day, which readers look up, is the one that was kept
    entries = log.table("entries").filter((F.col("userId") == "a") & (F.col("type") == "TAROT"))
    assert entries.orderBy(F.desc("createdAt")).first()["id"] == answers[0]["draw_id"]


def test_threads_are_made_once_a_task_and_not_for_each_round():
    asked_by = set()

    def model(prompts):
        asked_by.add(threading.current_thread())
        return [f"re {prompts[0]}"]

    with closing(Calls(model, at_once=4)) as calls:
        for k in range(200):
            said = [f"{k} {j}" for j in range(5)]
            assert calls.ask(said) == [(f"re {p}", None) for p in said]
        assert calls.ask([]) == []
    assert len(asked_by) <= 4
    for t in asked_by:
        t.join(10)
    assert not any(t.is_alive() for t in asked_by)  # none is left when the task ends


def test_threads_that_hang_are_replaced_in_later_rounds():
    def model(prompts):
        time.sleep(2 if prompts[0] == "hang" else 0.01)
        return prompts

    with closing(Calls(model, at_once=3, seconds=0.2)) as calls:
        assert [f for _, f in calls.ask(["hang"] * 3 + ["a", "b"])] == [LATE] * 3 + [None] * 2
        began = time.monotonic()
        assert calls.ask(["x"] * 30) == [("x", None)] * 30 and time.monotonic() - began < 1.5
        assert [f for _, f in calls.ask(["y", "hang", "z"])] == [None, LATE, None]


def test_small_runs_ask_the_groups_of_a_task_together(spark):
    def model(prompts):
        time.sleep(0.5)
        return [GOOD for _ in prompts]

    rows = requests(spark, [(k, f"u{k}", k / 1000) for k in range(800)])
    began = time.monotonic()
    made = interpretation.interpret(rows, model, "{text}")
    took = time.monotonic() - began
    assert set(statuses(made).values()) == {200} and took < 20  # in shares of a 64th they were asked by ones and twos, which took 25 seconds and more


def test_bodies_are_read_once(spark):
    made = interpretation.interpret(requests(spark, [(1, "a", 0), (2, "", 0), (3, "a", None)]), good_model, "{text}")
    plan = made.answers._jdf.queryExecution().optimizedPlan().toString()
    assert statuses(made) == {1: 200, 2: 400, 3: 400} and "raw_body" not in plan
