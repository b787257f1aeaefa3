"""Boundaries that the tables don't reach."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import json as J
from tidemark.functions import text as X
from tidemark.functions import times as D
from tidemark.operators import admission, cards, draws, history
from tidemark.plans import interpretation
from tidemark.plans.catalogue import CATALOGUE
from tidemark.sources import entries as S
from tidemark.streaming import stateful

T0 = datetime(2024, 3, 1, 10)
ENTRY = "id long, userId string, type string, createdAt timestamp_ntz"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_admission_at_the_edge_of_the_window(spark):
    times = [T0 + timedelta(minutes=m) for m in range(5)]
    at_edge, past = T0 + timedelta(hours=24), T0 + timedelta(hours=24, milliseconds=1)
    rows = [(k, "a", "DREAM", t) for k, t in enumerate([*times, at_edge, past])]
    got = {r["id"]: r["admitted"] for r in admission.admit(spark.createDataFrame(rows, ENTRY)).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 6: True}


def test_admission_by_stretches_agrees(spark):
    hours = [0, 0, 1, 2, 3, 4, 24, 25, 49, 50, 74, 74, 99, 100, 124, 148, 172, 500, 500, 501, 501, 502, 503, 526]
    rows = [(k, u, "DREAM", T0 + timedelta(hours=h)) for k, (u, h) in enumerate((u, h) for u in ("a", "b", None) for h in hours)]
    frame = spark.createDataFrame(rows, ENTRY)
    expected = {r["id"]: r["admitted"] for r in admission.admit(frame, limit=2).collect()}
    assert {r["id"]: r["admitted"] for r in admission.admit_native(frame, limit=2).collect()} == expected
    assert len(expected) == len(rows) and len(set(expected.values())) == 2


def test_rejected_requests_use_no_quota_and_users_are_apart(spark):
    rows = [(k, "a", "DREAM", T0 + timedelta(hours=k)) for k in range(12)] + [(99, None, "DREAM", T0), (100, "b", "DREAM", T0)]
    got = {r["id"]: r["admitted"] for r in admission.admit(spark.createDataFrame(rows, ENTRY)).collect()}
    assert [got[k] for k in range(12)] == [True] * 5 + [False] * 7 and got[99] and got[100]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=60), st.integers(1, 4))
def test_no_window_holds_more_than_the_limit(minutes, limit):
    held, accepted = [], []
    for t in sorted(minutes):
        ok, held = admission.judge(held, t, limit, 1440)
        assert ok == (sum(a >= t - 1440 for a in accepted) < limit)
        if ok:
            accepted.append(t)
    assert all(sum(t - 1440 <= a <= t for a in accepted) <= limit for t in accepted)


def test_snapshot_counts_the_edge_and_one_kind(spark):
    rows = [(1, "a", "DREAM", T0 - timedelta(hours=24)), (2, "a", "DREAM", T0 - timedelta(hours=24, milliseconds=1)), (3, "a", "TAROT", T0), (4, "a", "DREAM", T0 + timedelta(days=9))]
    got = admission.snapshot(spark.createDataFrame(rows, ENTRY), F.lit(T0).cast("timestamp_ntz"), "DREAM", limit=2).first()
    assert (got["used"], got["blocked"]) == (2, True)


def test_days_begin_at_midnight(spark):
    last, first = datetime(2024, 3, 1, 23, 59, 59, 999000), datetime(2024, 3, 2)
    rows = [(1, "a", "TAROT", last), (2, "a", "TAROT", first), (3, "a", "TAROT", first), (4, "a", "TAROT", first + timedelta(hours=3))]
    frame = spark.createDataFrame(rows, ENTRY)
    assert sorted(r["id"] for r in draws.first_of_day(frame).collect()) == [1, 2]
    assert {r["id"]: (r["draw_id"], r["alreadyDrawn"]) for r in draws.answered(frame).collect()} == {1: (1, False), 2: (2, False), 3: (2, True), 4: (2, True)}
    day = F.lit(first).cast("timestamp_ntz")
    assert history.latest_in_day(frame, "TAROT", D.day_start(day), D.day_end(day)).first()["id"] == 4
    assert one(spark, D.display_date(F.lit(last).cast("timestamp_ntz"), "Asia/Seoul")) == "2024. 03. 02."
    assert one(spark, D.in_day(F.lit(last).cast("timestamp_ntz"), day)) is False


def test_history_is_capped_before_it_is_split(spark):
    rows = [(k, "a", "DREAM" if k < 50 else "TAROT", T0) for k in range(160)]
    capped = history.recent_of_user(spark.createDataFrame(rows, ENTRY), "a")
    dreams, tarots = history.split_by_kind(capped)
    assert (dreams.count(), tarots.count()) == (0, 100)
    assert history.counts(capped).first().asDict() == {"userId": "a", "total": 100, "n_dream": 0, "n_tarot": 100}
    assert history.recent_of_user(spark.createDataFrame(rows, ENTRY), None).count() == 0


def test_text_counts_like_a_browser(spark):
    assert one(spark, X.utf16_length(F.lit("💓a"))) == 3
    assert one(spark, X.web_trim(F.lit("　﻿ a b \n"))) == "a b"
    assert one(spark, X.outer_braces(F.lit("x {a} {b} y"))) == "{a} {b}"
    assert one(spark, X.outer_braces(F.lit("} {"))) is None
    for n, problem in ((999, None), (1000, None), (1001, "too long")):
        assert one(spark, interpretation.validity(F.lit("u"), F.lit("x" * n))) == problem
    assert one(spark, interpretation.validity(F.lit(""), F.lit(""))) == "no user"
    assert one(spark, X.is_page(F.lit("/_next/static/a.js"))) is False and one(spark, X.is_page(F.lit("/history")))


@pytest.mark.parametrize(
    ("raw", "text", "tags"),
    [
        ("{", "", []),
        ("[1]", "", []),
        ('{"dreamText": 5, "moodTags": "a"}', "", []),
        ('{"dreamText": " a ", "moodTags": ["a", 1, null, "a", "b", "c", "d", "e"]}', "a", ["a", "a", "b", "c", "d"]),
        (None, "", []),
    ],
)
def test_requests_are_normalized(spark, raw, text, tags):
    row = interpretation.normalized(spark.createDataFrame([(1, "u", T0, raw)], "id long, user_id string, request_ts timestamp_ntz, raw_body string")).first()
    assert (row["dream_text"], row["mood_tags"]) == (text, tags)


@pytest.mark.parametrize(
    ("said", "json"),
    [('{"a": 1} x', '{"a": 1}'), ("```json\n{\"a\": [2]}\n```", '{"a": [2]}'), ("{'a': 1}", None), ("", None), ("{} {}", None), ('{"a": NaN}', None), ('"x"', '"x"'), (None, None)],
)
def test_replies_are_parsed_strictly(spark, said, json):
    assert one(spark.createDataFrame([(said,)], "s string").sparkSession, J.reply_json(F.lit(said).cast("string"))) == json


def test_cards_match_by_whole_name(spark):
    deck = spark.createDataFrame([("Sun", "k", "up", "down", "major", None, "1"), ("", "k", "x", "x", "major", None, "2")], "name string, keyword string, uprightMeaning string, reversedMeaning string, arcana string, suit string, image string")
    rows = spark.createDataFrame([(1, "Sun", True), (2, "sun", False), (3, "", False), (4, None, None), (5, "Sun", None)], "id long, cardName string, reversed boolean")
    got = {r["id"]: r["m"] for r in cards.with_card(rows, deck).select("id", cards.meaning(F.col("card"), F.col("reversed")).alias("m")).collect()}
    assert got == {1: "down", 2: None, 3: None, 4: None, 5: "up"}


def test_failed_replies_use_no_quota(spark):
    rows = [(k, "u", T0 + timedelta(minutes=k), '{"dreamText": "%s"}' % ("bad" if k < 3 else "good")) for k in range(9)]
    requests = spark.createDataFrame(rows, "id long, user_id string, request_ts timestamp_ntz, raw_body string")

    def model(prompts):
        from tidemark.plans.catalogue import echo_model

        return ["no" if "bad" in p else echo_model(["abc"])[0] for p in prompts]

    out = interpretation.interpret(requests, model, "{text}")
    got = {r["id"]: r["status"] for r in out.answers.collect()}
    assert got == {0: 502, 1: 502, 2: 502, 3: 200, 4: 200, 5: 200, 6: 200, 7: 200, 8: 429}
    assert out.entries.count() == 5
    with pytest.raises(ValueError):
        interpretation.interpret(requests, None, "{text}")


def test_no_call_for_requests_over_quota(spark, tmp_path):
    rows = [(k, "u", T0 + timedelta(minutes=k), '{"dreamText": "%s"}' % ("boom" if k in (1, 7) else f"good {k}")) for k in range(9)]
    requests = spark.createDataFrame(rows, "id long, user_id string, request_ts timestamp_ntz, raw_body string")
    stored = spark.createDataFrame([("u", "DREAM", T0 - timedelta(hours=2)), ("u", "DREAM", T0 - timedelta(hours=25)), ("u", "TAROT", T0)], "userId string, type string, createdAt timestamp_ntz")
    calls = tmp_path / "calls"

    def model(prompts):
        from tidemark.plans.catalogue import echo_model

        with open(calls, "a") as log:
            log.writelines(f"{p}\n" for p in prompts)
        if any("boom" in p for p in prompts):
            raise RuntimeError("boom")
        return echo_model(["abc"] * len(prompts))

    out = interpretation.interpret(requests, model, "{text}", stored=stored)
    assert {r["id"]: r["status"] for r in out.answers.collect()} == {0: 200, 1: 502, 2: 200, 3: 200, 4: 200, 5: 429, 6: 429, 7: 429, 8: 429}
    assert sorted(calls.read_text().split("\n")) == sorted(["", "good 0", "boom", "good 2", "good 3", "good 4"])
    assert [r["fortuneJson"] is None for r in out.entries.collect()] == [False] * 4


def test_one_draw_a_day_and_failures_try_again(spark):
    deck = spark.createDataFrame([(0, "Sun", "k", "up", "down")], "number long, name string, keyword string, uprightMeaning string, reversedMeaning string")
    times = [T0, T0 + timedelta(minutes=1), T0 + timedelta(minutes=2), T0 + timedelta(days=1)]
    requests = spark.createDataFrame([(k, who, t) for k, (who, t) in enumerate([(w, t) for w in ("a", "b", "") for t in times])], "id long, user_id string, request_ts timestamp_ntz")
    stored = spark.createDataFrame([("x", "b", "TAROT", "Moon", "m", True, "wait", T0 - timedelta(hours=1))], "id string, userId string, type string, cardName string, cardKeyword string, reversed boolean, tarotAdvice string, createdAt timestamp_ntz")
    out = interpretation.draw(requests, deck, 1, lambda prompts: ['{"advice": "go"}'], "{name}", stored=stored)
    got = {r["id"]: (r["status"], r["draw_id"], r["alreadyDrawn"]) for r in out.answers.collect()}
    assert [got[k] for k in range(4)] == [(200, "0", False), (200, "0", True), (200, "0", True), (200, "3", False)]
    assert [got[k] for k in range(4, 8)] == [(200, "x", True)] * 3 + [(200, "7", False)]
    assert {got[k] for k in range(8, 12)} == {(400, None, None)} and out.entries.count() == 3
    failing = interpretation.draw(requests, deck, 1, lambda prompts: 1 / 0, "{name}")
    assert {r["status"] for r in failing.answers.collect()} == {400, 502} and failing.entries.count() == 0
    with pytest.raises(ValueError):
        interpretation.draw(requests, deck, 1, None, "{name}")


def test_shapes_are_told_alike_by_column_and_by_text(spark):
    import json

    whole = {f: "x" for f in J.TOP_FIELDS} | {"symbols": [], "fortune": {f: "y" for f in J.FORTUNE_FIELDS}}
    odd = [whole, whole | {"title": 0}, whole | {"title": 3.5}, whole | {"title": []}, whole | {"title": False}, whole | {"mood": ""}, whole | {"symbols": {}}, whole | {"fortune": "abc"}, whole | {"fortune": None}, whole | {"fortune": {}}, [], "x", None, {}]
    texts = [json.dumps(v) for v in odd]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", J.has_shape(F.try_parse_json("t")).alias("s")).collect()
    assert {r["k"]: r["s"] for r in rows} == {k: J.shape_of(t) for k, t in enumerate(texts)}


def test_entries_keep_their_columns_with_a_card(spark):
    deck = spark.createDataFrame([("Sun", "k", "1")], "name string, keyword string, image string")
    rows = spark.createDataFrame([(1, "Sun", "mine", "w", "e", 2)], "id long, cardName string, name string, wanted string, entry string, card int")
    got = cards.with_card(rows, deck).first()
    dotted = rows.withColumnRenamed("wanted", "a.b").withColumnRenamed("cardName", "card`name")
    assert cards.with_card(dotted, deck.withColumn("x.y", F.lit(1)), "card`name").first()["card"]["x.y"] == 1
    assert got.asDict(True) == {"id": 1, "cardName": "Sun", "name": "mine", "wanted": "w", "entry": "e", "card": {"keyword": "k", "image": "1"}}


def test_recent_rows_are_capped_by_user(spark):
    rows = [(k, f"u{k % 3}", "DREAM", T0 + timedelta(minutes=k // 6)) for k in range(60)]
    got = {(r["userId"], r["rank"]): r["id"] for r in history.recent_by_user(spark.createDataFrame(rows, ENTRY), 4).collect()}
    expected = {(u, n): k for u in ("u0", "u1", "u2") for n, k in enumerate(sorted((k for k, w, _, _ in rows if w == u), key=lambda k: (k // 6, k), reverse=True)[:4], 1)}
    assert got == expected


def test_written_rows_have_the_whole_schema(spark, tmp_path):
    rows = spark.createDataFrame([("u", "Sun", "k", True, "go")], "userId string, cardName string, cardKeyword string, reversed boolean, tarotAdvice string")
    made = S.append(S.draw_rows(rows), str(tmp_path / "e"))
    back = S.read_entries(spark, str(tmp_path / "e")).first()
    assert back["type"] == "TAROT" and len(back["id"]) == 36 and back["dreamText"] is None and made.count() == 1
    assert history.with_defaults(S.read_entries(spark, str(tmp_path / "e"))).first()["fortune"]["omen"] is None


def test_random_draws_stay_in_range(spark):
    rows = spark.range(20_000).select(cards.random_pick(78, 3).alias("n"), cards.random_chance(seed=4).alias("r"))
    got = rows.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count_distinct("n").alias("k"), F.avg(F.col("r").cast("int")).alias("share")).first()
    assert (got["lo"], got["hi"], got["k"]) == (0, 77, 78) and 0.33 < got["share"] < 0.37


def test_requests_are_read_and_answered(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"user_id": "u", "request_ts": "2024-03-01T10:00:00", "raw_body": "{"}\n{"user_id": null, "more": 1}\n')
    rows = S.read_requests(spark, str(tmp_path))
    assert sorted((tuple(r)[1:] for r in rows.collect()), key=str) == [("u", T0, "{"), (None, None, None)]
    assert len({r["id"] for r in rows.collect()}) == 2 and rows.collect() == rows.collect()
    # what is read goes into the plans as it is
    assert {r["status"] for r in interpretation.interpret(rows, lambda p: [None], "{text}").answers.collect()} == {400}
    assert sorted(r["response"] for r in S.responses(rows, "user_id", "raw_body").collect()) == ['{"user_id":"u","raw_body":"{"}', "{}"]


@pytest.mark.parametrize(("advice", "kept"), [('"go"', "go"), ('""', None), ("0", None), ("false", None), ("3", "3"), ("null", None)])
def test_advice_counts_if_it_is_true(spark, advice, kept):
    said = F.try_parse_json(F.lit('{"advice": %s, "more": {"b": [], "a": 1}}' % advice))
    assert one(spark, J.true_member(said, "advice")) == kept
    assert one(spark, J.stored_member(said, "more")) == '{"a":1,"b":[]}' and one(spark, J.stored_member(said, "none")) is None


def test_streams_agree_with_batches_over_several_batches(spark, tmp_path):
    rows = [(f"u{k % 3}", k, T0 + timedelta(minutes=29 * k)) for k in range(90)]
    frame = spark.createDataFrame(rows, "userId string, id long, createdAt timestamp_ntz")
    for part in range(3):
        frame.filter((F.col("id") >= 30 * part) & (F.col("id") < 30 * part + 30)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = {}
    for name, run in (("admitted", stateful.admit_stream), ("first", stateful.first_draws_stream)):
        made = run(spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        made.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-log")).trigger(availableNow=True).start().awaitTermination()
        out[name] = spark.read.parquet(str(tmp_path / name)).collect()
    expected = {r["id"]: r["admitted"] for r in admission.admit(frame).collect()}
    assert not all(expected.values()) and {r["id"]: r["admitted"] for r in out["admitted"]} == expected
    days = lambda rows: sorted((r["userId"], r["createdAt"].date()) for r in rows)
    assert days(out["first"]) == days(draws.first_of_day(frame).collect())


def test_unpivot_reads_long_props(spark, tmp_path):
    props = '{"a": "' + "x" * 2000 + '", "k": "v"}'
    spark.createDataFrame([(1, 2, T0, "view", 3.0, props)], "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    rows = CATALOGUE["ordered_unpivot"][0](spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["position"], r["key"], r["value"]) for r in rows) == [(1, 0, "z", "view"), (1, 1, "k", "v")]
