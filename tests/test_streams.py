"""Streams: what their state holds and for how long, and what they do with rows that come in any order."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import admission, draws
from tidemark.streaming import stateful

T0 = datetime(2024, 3, 1, 10)
ROW = "userId string, id long, createdAt timestamp_ntz"


class Feed:
    """A stream that takes parts one after the other and goes on from its checkpoint."""

    def __init__(self, spark, path, run, schema=ROW):
        self.spark, self.path, self.run, self.schema = spark, str(path), run, schema

    def take(self, rows):
        """What is written for these rows, and the rows in the state afterwards."""
        frame = rows if hasattr(rows, "schema") else self.spark.createDataFrame(rows, self.schema)
        frame.coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        before = self.written()
        made = self.run(self.spark.readStream.schema(frame.schema).parquet(f"{self.path}/in"))
        query = made.writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/log").trigger(availableNow=True).start()
        query.awaitTermination()
        # of the last batch that had rows in it or the watermark moved
        state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return [r for r in self.written() if r not in before], state[-1]

    def written(self):
        try:
            return [tuple(r) for r in self.spark.read.parquet(f"{self.path}/out").collect()]
        except Exception:  # noqa: BLE001  nothing yet
            return []


def test_quota_state_goes_when_the_window_has_passed(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda s: stateful.admit_stream(s, late="1 hour"))
    hour = lambda h: T0 + timedelta(hours=h)
    got, _ = feed.take([("a", k, hour(k / 10)) for k in range(7)] + [("b", 10, hour(1))])
    assert {r[1]: r[2] for r in got} == {**{k: k < 5 for k in range(7)}, 10: True}
    _, two = feed.take([("c", 20, hour(5))])
    got, three = feed.take([("a", 30, hour(24.2)), ("d", 31, hour(24.2))])
    assert {r[1]: r[2] for r in got} == {30: True, 31: True}  # two of a's times are older than a day
    feed.take([("e", 40, hour(60))])  # the watermark passes the windows of all others
    _, last = feed.take([("e", 41, hour(60.5))])
    assert last < three and last <= 4  # the times of one user, and its timer
    got, _ = feed.take([("a", 50, hour(61))])
    assert {r[1]: r[2] for r in got} == {50: True}


def test_quota_begins_with_what_was_accepted_before(spark, tmp_path):
    accepted = spark.createDataFrame([("a", T0 - timedelta(minutes=k)) for k in range(1, 8)] + [("b", T0 - timedelta(hours=25))], "userId string, createdAt timestamp_ntz")
    feed = Feed(spark, tmp_path, lambda s: stateful.admit_stream(s, accepted=accepted))
    got, _ = feed.take([("a", 1, T0), ("b", 2, T0), ("c", 3, T0)])
    assert {r[1]: r[2] for r in got} == {1: False, 2: True, 3: True}
    got, _ = feed.take([("a", 4, T0 + timedelta(hours=24)), ("a", 5, None)])
    assert {r[1]: r[2] for r in got} == {4: True, 5: False}


def test_a_million_requests_of_one_user(spark, tmp_path):
    rows = spark.range(1_000_000).select(F.lit("busy").alias("userId"), F.col("id"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=(999_999 - F.col("id")).cast("int"))).alias("createdAt"))
    feed = Feed(spark, tmp_path, stateful.admit_stream)
    rows.write.parquet(f"{feed.path}/rows")
    rows = spark.read.parquet(f"{feed.path}/rows")
    rows.repartition(4).write.parquet(f"{feed.path}/in")
    made = feed.run(spark.readStream.schema(rows.schema).parquet(f"{feed.path}/in"))
    query = made.writeStream.format("parquet").option("path", f"{feed.path}/out").option("checkpointLocation", f"{feed.path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{feed.path}/out")
    # five in each stretch of a day and a minute, as a window holds both ends
    assert out.count() == 1_000_000 and out.filter("admitted").count() == 5 * (1_000_000 // 1441) + 5
    assert query.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= 4


@pytest.mark.parametrize("seed", [1, 2])
def test_first_draws_by_time_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"u{rng.randrange(4)}", k, T0 + timedelta(minutes=rng.randrange(60 * 24 * 6))) for k in range(300)]
    rows += [("u0", 1000 + k, T0) for k in range(3)] + [(None, 2000, T0), ("u9", 3000, None)]
    rng.shuffle(rows)
    feed = Feed(spark, tmp_path, lambda s: stateful.first_draws_by_time(s, "10 days"))
    for part in range(3):
        sent, open_ = feed.take(rows[part::3])
        assert sent == [] and open_ > 0
    sent, left = feed.take([("tick", -1, T0 + timedelta(days=40))])
    frame = spark.createDataFrame([r for r in rows if r[2] is not None], ROW)
    assert sorted(sent, key=str) == sorted((tuple(r) for r in draws.first_of_day(frame).collect()), key=str) and left == 1
    # a day that was sent stays as it is
    assert feed.take([("u0", -5, T0 - timedelta(minutes=1)), ("tick", -2, T0 + timedelta(days=80))])[0] == [("tick", -1, T0 + timedelta(days=40))]


def test_stream_and_batch_agree_on_ties_and_edges(spark, tmp_path):
    rows = [("a", k, T0) for k in range(7)] + [("a", 10, T0 + timedelta(hours=24)), ("a", 11, T0 + timedelta(hours=24, milliseconds=1)), (None, 20, T0)]
    frame = spark.createDataFrame(rows, ROW)
    got, _ = Feed(spark, tmp_path, stateful.admit_stream).take(frame)
    assert {r[1]: r[2] for r in got} == {r["id"]: r["admitted"] for r in admission.admit(frame).collect()}


def test_first_draws_to_arrive(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "_GATHER", 10, raising=False)
    rng = random.Random(3)
    rows = [(f"u{rng.randrange(3)}", k, T0 + timedelta(hours=rng.randrange(24 * 3))) for k in range(400)]
    rows += [(None, 900 + k, T0) for k in (1, 0)] + [("u9", 950, None)]
    rng.shuffle(rows)
    feed = Feed(spark, tmp_path, lambda s: stateful.first_draws_stream(s, "10 days"))
    first = lambda some: {tuple(r) for r in draws.first_of_day(spark.createDataFrame([r for r in some if r[2] is not None], ROW)).collect()}
    sent, state = feed.take(rows[:200])
    assert set(sent) == first(rows[:200]) and state == len(sent)
    days = {(r[0], r[2].date()) for r in sent}
    sent, _ = feed.take(rows[200:])  # what was sent stands, though earlier ones come
    assert set(sent) == {r for r in first(rows[200:]) if (r[0], r[2].date()) not in days}
    # no function is called for a single user or day: that took longer than all else
    plan = feed.run(spark.readStream.schema(ROW).parquet(f"{feed.path}/in"))._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "FlatMapGroups" not in plan


def test_first_draws_keep_days_for_as_long_as_late_requests_may_come(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda s: stateful.first_draws_stream(s, "2 hours"))
    midnight = T0.replace(hour=0) + timedelta(days=1)
    assert len(feed.take([("a", 1, T0), ("b", 2, T0)])[0]) == 2
    feed.take([("c", 3, midnight + timedelta(minutes=5))])
    sent, state = feed.take([("a", 4, midnight - timedelta(minutes=100)), ("d", 5, midnight - timedelta(minutes=100))])
    assert [r[1] for r in sent] == [5] and state == 4  # within two hours of the latest
    feed.take([("c", 6, midnight + timedelta(days=2, hours=3))])
    sent, state = feed.take([("e", 7, midnight - timedelta(minutes=1))])
    assert sent == [] and state == 1
