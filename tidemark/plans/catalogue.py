"""Queries over the test tables, one or more for each operator, with DuckDB SQL that gives the same rows.

``events`` stands in for entries, ``customer`` and ``part`` for decks,
``conversations`` and ``documents`` for texts.  What these tables lack (wide
characters, white space around texts, braces, unknown names) is put in on
both sides.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import json as J
from tidemark.functions import text as X
from tidemark.functions import times as D
from tidemark.operators import admission, cards, draws, history
from tidemark.plans import interpretation, runs
from tidemark.sources import clustered
from tidemark.sources import entries as S
from tidemark.sources.commits import CommitLog
from tidemark.sources.staging import fresh_path, staged
from tidemark.streaming import stateful

#: (query, SQL or None) by name.
CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

CAP = history.CAP
AS_OF = "2024-01-20 12:00:00"


def query(sql: str | None = None):
    def add(f):
        CATALOGUE[f.__name__] = f, sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"event_id": "id", "user_id": "userId", "ts": "createdAt", "event_type": "type"}
    return _table(spark, sf_dir, "events").withColumnsRenamed(names)


_RANKED = f"SELECT event_id AS id, user_id AS \"userId\", event_type AS type, ts AS \"createdAt\", row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= {CAP}"

# --- history ----------------------------------------------------------------------


@query(f'SELECT id, "userId", type, "createdAt", rank::INT AS rank FROM ({_RANKED})')
def history_top_n(spark, sf_dir):
    return history.recent_by_user(_entries(spark, sf_dir), CAP).select("id", "userId", "type", "createdAt", "rank")


@query("SELECT event_id AS id, event_type AS type, ts AS \"createdAt\" FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 100")
def history_of_user(spark, sf_dir):
    return history.recent_of_user(_entries(spark, sf_dir), 7).select("id", "type", "createdAt")


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by user: half of them written, the others added later."""
    rows, name = _entries(spark, sf_dir), f"tidemark_entries_{uuid.uuid4().hex}"
    clustered.write_clustered(rows.filter("id % 2 = 0"), name, 16, fresh_path(spark, "clustered"))
    return clustered.append_clustered(rows.filter("id % 2 <> 0"), name)


@query("SELECT event_id AS id, event_type AS type, ts AS \"createdAt\" FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 100")
def history_of_user_clustered(spark, sf_dir):
    """One bucket of sixteen is read."""
    return history.recent_of_user(_clustered(spark, sf_dir), 7).select("id", "type", "createdAt")


@query(f'SELECT id, "userId", type, "createdAt", rank::INT AS rank FROM ({_RANKED})')
def history_top_n_clustered(spark, sf_dir):
    """Nothing is shuffled."""
    return history.recent_by_user(_clustered(spark, sf_dir), CAP).select("id", "userId", "type", "createdAt", "rank")


@query(f"SELECT id, \"userId\", type FROM ({_RANKED}) WHERE type IN ('purchase', 'signup')")
def history_split_after_cap(spark, sf_dir):
    bought, joined = history.split_by_kind(history.recent_by_user(_entries(spark, sf_dir), CAP), "purchase", "signup")
    return bought.unionByName(joined).select("id", "userId", "type")


@query(f"SELECT \"userId\", count(*) AS total, count(*) FILTER (type = 'view') AS n_view, count(*) FILTER (type = 'purchase') AS n_purchase FROM ({_RANKED}) GROUP BY 1")
def history_counts(spark, sf_dir):
    return history.counts(history.recent_by_user(_entries(spark, sf_dir), CAP), "view", "purchase")


@query("SELECT event_id AS id, user_id AS \"userId\", event_type AS type FROM events WHERE event_id = 7 AND user_id = (SELECT min(user_id) FROM events WHERE event_id = 7)")
def entry_point_lookup(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    owner = entries.filter("id = 7").agg(F.min("userId")).first()[0]
    mine, foreign = history.entry_of_user(entries, 7, owner), history.entry_of_user(entries, 7, -1)
    return mine.unionByName(foreign).select("id", "userId", "type")


@query("SELECT event_id AS id, CASE WHEN event_type = 'view' THEN event_type ELSE coalesce(n, '') || CASE WHEN value > 50 THEN ' (reversed)' ELSE '' END END AS headline, CASE WHEN event_type = 'view' THEN props ELSE event_type END AS subtitle, CASE WHEN value > 50 THEN 'reversed' ELSE 'upright' END AS orientation, concat_ws(' · ', nullif(coalesce(n, ''), ''), CASE WHEN value > 50 THEN 'reversed' ELSE 'upright' END) AS line FROM (SELECT *, CASE WHEN event_type = 'click' THEN props WHEN event_type = 'error' THEN '' END AS n FROM events)")
def headline_projection(spark, sf_dir):
    rows = _entries(spark, sf_dir).withColumn("type", F.col("type")).withColumn("name", F.when(F.col("type") == "click", F.col("props")).when(F.col("type") == "error", "")).withColumn("reversed", F.col("value") > 50)
    kind = F.when(F.col("type") == "view", "DREAM").otherwise("TAROT")
    return rows.select(
        "id",
        history.headline(kind, F.col("type"), F.col("name"), F.col("reversed")).alias("headline"),
        history.subtitle(kind, F.col("props"), F.col("type")).alias("subtitle"),
        history.orientation(F.col("reversed"), "upright", "reversed").alias("orientation"),
        history.keyword_line(F.col("name"), F.col("reversed")).alias("line"),
    )


@query("SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'untitled' WHEN event_type = 'click' THEN '' ELSE event_type END AS title, CASE WHEN event_type = 'view' THEN '' ELSE props END AS mood, CASE WHEN event_type = 'error' THEN '' ELSE 'x' END AS symbols, CASE WHEN event_type = 'purchase' THEN props END AS omen, TRUE AS filled FROM events")
def null_defaults(spark, sf_dir):
    rows = _entries(spark, sf_dir)
    symbols = F.when(F.col("type") != "error", F.array(F.struct(F.lit("x").alias("name"), F.lit(None).cast("string").alias("meaning"))))
    rows = rows.select("id", F.when(F.col("type") == "click", "").when(F.col("type") != "view", F.col("type")).alias("title"), F.when(F.col("type") != "view", F.col("props")).alias("mood"), symbols.alias("symbols"), F.when(F.col("type") == "purchase", F.struct(F.col("props").alias("omen"))).alias("fortune"))
    out = history.with_defaults(rows)
    return out.select("id", "title", "mood", F.array_join(F.transform("symbols", lambda s: s["name"]), ",").alias("symbols"), "fortune.omen", F.col("fortune").isNotNull().alias("filled"))


@query("SELECT event_id AS id, i::INT AS position, CASE i WHEN 0 THEN event_type ELSE props END AS name, 'm' || i AS meaning FROM events, (SELECT unnest([0, 1]) AS i) WHERE event_type <> 'error'")
def symbol_rows(spark, sf_dir):
    symbol = lambda i, c: F.struct(F.col(c).alias("name"), F.lit(f"m{i}").alias("meaning"))
    rows = _entries(spark, sf_dir).withColumn("symbols", F.when(F.col("type") != "error", F.array(symbol(0, "type"), symbol(1, "props"))))
    return history.symbol_rows(rows)


@query("SELECT event_id AS id, '/history/' || event_id AS link, json_object('id', event_id, 'type', event_type) AS response FROM events")
def links_and_responses(spark, sf_dir):
    rows = _entries(spark, sf_dir)
    return rows.select("id", X.entry_link(F.col("id")).alias("link"), F.to_json(F.struct("id", "type")).alias("response"))


# --- admission and draws ------------------------------------------------------------


@query(f"SELECT user_id AS \"userId\", count(*) AS used, count(*) >= 5 AS blocked FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS GROUP BY 1")
def quota_snapshot(spark, sf_dir):
    return admission.snapshot(_entries(spark, sf_dir), F.lit(AS_OF).cast("timestamp_ntz"), "view")


_ADMITTED = """
WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (
 SELECT user_id, n, event_id, true AS admitted, [ts] AS held FROM o WHERE n = 1
 UNION ALL
 SELECT user_id, n, event_id, len(still) < 5, CASE WHEN len(still) < 5 THEN list_append(still, ts) ELSE still END
 FROM (SELECT o.*, list_filter(r.held, lambda t: t >= o.ts - INTERVAL 24 HOURS) AS still FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1))
SELECT user_id AS "userId", event_id AS id, admitted FROM r"""


@query(_ADMITTED)
def rolling_admission(spark, sf_dir):
    return admission.admit(_entries(spark, sf_dir).select("userId", "id", "createdAt")).select("userId", "id", "admitted")


@query(_ADMITTED)
def rolling_admission_native(spark, sf_dir):
    return admission.admit_native(_entries(spark, sf_dir))


#: Times at which a run ends and the next one begins.
_RUNS = ("2024-01-08 07:00:00", "2024-01-19 21:30:00")

_FIRST = "row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)"


def _in_batches(spark: SparkSession, parts: list[DataFrame], name: str, start: Callable[[DataFrame, str], None]) -> None:
    """Brings a stream its parts one after the other: it ends when it has taken what is there, and goes on from its checkpoint with the next."""
    at = fresh_path(spark, name)
    for part in parts:
        part.write.mode("append").parquet(f"{at}/in")
        start(spark.readStream.schema(part.schema).parquet(f"{at}/in"), f"{at}/log")


def _written_stream(spark: SparkSession, parts: list[DataFrame], name: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream has written when it has taken all parts."""
    out, schema = fresh_path(spark, f"stream-{name}"), []

    def start(source: DataFrame, log: str) -> None:
        made = run(source)
        schema.append(made.schema)
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()

    _in_batches(spark, parts, name, start)
    return spark.read.schema(schema[0]).parquet(out)


@query(_ADMITTED)
def rolling_admission_stream(spark, sf_dir):
    return _written_stream(spark, [_entries(spark, sf_dir)], "admission", stateful.admit_stream)


@query(f"SELECT event_id AS id, user_id AS \"userId\", ts AS \"createdAt\" FROM events QUALIFY {_FIRST} = 1")
def first_draw_stream(spark, sf_dir):
    return _written_stream(spark, [_entries(spark, sf_dir).select("id", "userId", "createdAt")], "draws", stateful.first_draws_stream)


def _by_time(rows: DataFrame, at: str = "createdAt") -> list[DataFrame]:
    """Rows of each stretch between the times at which runs end."""
    edges = [F.lit(t).cast("timestamp_ntz") for t in _RUNS]
    return [rows.filter(F.col(at) < edges[0]), rows.filter((F.col(at) >= edges[0]) & (F.col(at) < edges[1])), rows.filter(F.col(at) >= edges[1])]


@query(_ADMITTED)
def rolling_admission_batches(spark, sf_dir):
    """Three batches of a stream, which go on from the state on disk."""
    parts = _by_time(_entries(spark, sf_dir).select("userId", "id", "createdAt"))
    return _written_stream(spark, parts, "admission", stateful.admit_stream)


@query(f"SELECT a.* FROM ({_ADMITTED}) a JOIN events e ON e.event_id = a.id WHERE e.ts >= TIMESTAMP '{_RUNS[1]}'")
def rolling_admission_initial(spark, sf_dir):
    """A stream that begins with the entries that were accepted before it."""
    before, middle, last = _by_time(_entries(spark, sf_dir).select("userId", "id", "createdAt"))
    accepted = admission.admit(before.unionByName(middle)).filter("admitted").select("userId", "createdAt")
    return _written_stream(spark, [last], "admission", lambda s: stateful.admit_stream(s, accepted=accepted))


@query(f"SELECT event_id AS id, user_id AS \"userId\", ts AS \"createdAt\" FROM events QUALIFY {_FIRST} = 1")
def first_draw_by_time_stream(spark, sf_dir):
    """Rows shuffled over the batches of a stream; a last one, far ahead, lets the watermark pass all days."""
    rows = _entries(spark, sf_dir).select("id", "userId", "createdAt")
    parts = [rows.filter(F.pmod(F.xxhash64("id"), F.lit(4)) == k) for k in range(4)]
    ahead = rows.agg(F.lit(-1).cast("long").alias("id"), F.lit(-1).cast("long").alias("userId"), (F.max("createdAt") + F.expr("INTERVAL 400 DAYS")).alias("createdAt"))
    return _written_stream(spark, [*parts, ahead], "draws", lambda s: stateful.first_draws_by_time(s, "300 days"))


@query(f"SELECT event_id AS id, user_id AS \"userId\", ts AS \"createdAt\" FROM events QUALIFY {_FIRST} = 1")
def first_draw_per_day(spark, sf_dir):
    return draws.first_of_day(_entries(spark, sf_dir).select("id", "userId", "createdAt"))


@query(f"SELECT event_id AS id, first_value(event_id) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS draw_id, {_FIRST} > 1 AS \"alreadyDrawn\" FROM events")
def already_drawn_flag(spark, sf_dir):
    return draws.answered(_entries(spark, sf_dir)).select("id", "draw_id", "alreadyDrawn")


@query(f"SELECT event_id AS id, user_id AS \"userId\", ts AS \"createdAt\" FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '{AS_OF[:10]}' AND ts < TIMESTAMP '{AS_OF[:10]}' + INTERVAL 24 HOURS QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_in_day(spark, sf_dir):
    day = F.lit(AS_OF).cast("timestamp_ntz")
    return history.latest_in_day(_entries(spark, sf_dir), "view", D.day_start(day), D.day_end(day)).select("id", "userId", "createdAt")


@query("SELECT event_id AS id, date_trunc('day', ts)::TIMESTAMP AS day_start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 24 HOURS AS day_end, strftime(ts, '%Y-%m-%d') AS label, strftime(ts + INTERVAL 9 HOURS, '%Y. %m. %d.') AS shown, date_trunc('millisecond', ts)::TIMESTAMP AS stored FROM events")
def utc_day_labels(spark, sf_dir):
    ts = F.col("createdAt")
    return _entries(spark, sf_dir).select("id", D.day_start(ts).alias("day_start"), D.day_end(ts).alias("day_end"), D.day_label(ts).alias("label"), D.display_date(ts, "Asia/Seoul").alias("shown"), D.milliseconds(ts).alias("stored"))


# --- cards ------------------------------------------------------------------------


@query("SELECT e.event_id AS id, c.c_name AS name, CASE WHEN e.value > 50 THEN c.c_mktsegment ELSE c.c_name END AS meaning FROM events e LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 4000) c ON e.user_id = c.c_custkey")
def card_lookup_left(spark, sf_dir):
    deck = _table(spark, sf_dir, "customer").filter("c_acctbal > 4000").select(F.col("c_custkey").cast("string").alias("name"), F.lit("").alias("keyword"), F.col("c_name").alias("uprightMeaning"), F.col("c_mktsegment").alias("reversedMeaning"), F.lit("").alias("image"))
    rows = _entries(spark, sf_dir).withColumn("cardName", F.col("userId").cast("string"))
    found = cards.with_card(rows, deck)
    return found.select("id", F.col("card.uprightMeaning").alias("name"), cards.meaning(F.col("card"), F.col("value") > 50).alias("meaning"))


@query("SELECT count(*) AS n, TRUE AS in_range, TRUE AS even, TRUE AS share FROM events")
def random_shares(spark, sf_dir):
    """Picks and chances that are drawn by a seed: within bounds that hold but once in millions of draws."""
    rows = _entries(spark, sf_dir).select(cards.random_pick(10, 3).alias("n"), cards.random_chance(seed=4).alias("r"))
    counts = rows.groupBy("n").agg(F.count("*").alias("k"), F.count_if("r").alias("r")).agg(F.sum("k").alias("all"), F.min("k").alias("least"), F.max("k").alias("most"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("r").alias("r"))
    off = lambda count, p: F.abs(count - p * F.col("all")) < 5.5 * F.sqrt(p * (1 - p) * F.col("all"))
    return counts.select(F.col("all").alias("n"), ((F.col("lo") == 0) & (F.col("hi") == 9)).alias("in_range"), (off(F.col("least"), 0.1) & off(F.col("most"), 0.1)).alias("even"), off(F.col("r"), cards.REVERSED_SHARE).alias("share"))


_HASH = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


@query(f"SELECT event_id AS id, {_HASH.format('event_id::VARCHAR')} % 78 AS card FROM events")
def hashed_pick(spark, sf_dir):
    return _entries(spark, sf_dir).select("id", cards.hashed_pick(F.col("id"), 78).alias("card"))


@query(f"SELECT event_id AS id, {_HASH.format('event_id::VARCHAR')}::DOUBLE / 4294967296 < 0.35 AS reversed FROM events")
def hashed_bernoulli(spark, sf_dir):
    return _entries(spark, sf_dir).select("id", cards.hashed_chance(F.col("id"), cards.REVERSED_SHARE).alias("reversed"))


@query(f"SELECT e.event_id AS id, p.p_name AS card, {_HASH.format(chr(39) + chr(39))} IS NOT NULL AND {_HASH.format(chr(39) + chr(39) + ' || e.event_id || ' + chr(39) + '/reversed' + chr(39))}::DOUBLE / 4294967296 < 0.35 AS reversed FROM events e LEFT JOIN part p ON p.p_partkey = {_HASH.format('e.event_id::VARCHAR')} % 78")
def drawn_cards(spark, sf_dir):
    deck = _table(spark, sf_dir, "part").filter("p_partkey < 78").select(F.col("p_partkey").alias("number"), F.col("p_name").alias("card"))
    return cards.drawn(_entries(spark, sf_dir).withColumn("draw_key", F.col("id")), deck, 78).select("id", "card", "reversed")


@query("SELECT p_name AS name, p_brand AS suit FROM part WHERE p_size > 25 UNION ALL SELECT p_name, NULL FROM part WHERE p_size <= 25 UNION ALL SELECT c_name, NULL FROM customer")
def deck_union(spark, sf_dir):
    part, customer = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "customer")
    return S.union_cards(part.filter("p_size > 25").select(F.col("p_name").alias("name"), F.col("p_brand").alias("suit")), part.filter("p_size <= 25").select(F.col("p_name").alias("name")), customer.select(F.col("c_name").alias("name")))


# --- text -------------------------------------------------------------------------

_WIDE = "text || CASE lang WHEN 'en' THEN '💓a' WHEN 'de' THEN '' ELSE ' ' END"
_UNITS = "(length(t) + length(regexp_replace(t, '[\\x{0}-\\x{FFFF}]', '', 'g')))::INT"


@query(f"SELECT doc_id, {_UNITS} AS units, CASE WHEN {_UNITS} > 1000 THEN 'too long' END AS problem FROM (SELECT doc_id, {_WIDE} AS t FROM documents)")
def utf16_length_gate(spark, sf_dir):
    wide = F.concat("text", F.when(F.col("lang") == "en", "💓a").when(F.col("lang") == "de", "").otherwise(" "))
    rows = _table(spark, sf_dir, "documents").select("doc_id", wide.alias("t"))
    return rows.select("doc_id", X.utf16_length(F.col("t")).alias("units"), interpretation.validity(F.lit("u"), F.col("t")).alias("problem"))


@query("SELECT doc_id, text AS trimmed FROM documents")
def js_trim(spark, sf_dir):
    around = F.concat(F.lit("　\n﻿  "), F.col("text"), F.lit("  \t "))
    return _table(spark, sf_dir, "documents").select("doc_id", X.web_trim(around).alias("trimmed"))


@query("SELECT doc_id, CASE WHEN lang <> 'fr' THEN '{' || text || '} b {c}' END AS found, left(text, 1000) AS cut FROM documents")
def brace_extract(spark, sf_dir):
    said = F.when(F.col("lang") == "fr", F.col("text")).otherwise(F.concat(F.lit("a } {"), F.col("text"), F.lit("} b {c} d {")))
    return _table(spark, sf_dir, "documents").select("doc_id", X.outer_braces(said).alias("found"), X.cut_units(F.col("text")).alias("cut"))


@query("SELECT conv_id, turn, text <> '' AND role <> 'system' AS filled, CASE role WHEN 'user' THEN 'a, ' || role WHEN 'assistant' THEN role ELSE 'none' END AS tags, 'Say ' || text || ' to ' || CASE role WHEN 'system' THEN '' ELSE role END || '.' AS prompt FROM conversations")
def text_assembly(spark, sf_dir):
    role = F.col("role")
    rows = _table(spark, sf_dir, "conversations")
    items = F.when(role == "user", F.array(F.lit("a"), role)).when(role == "assistant", F.array(role)).otherwise(F.array().cast("array<string>"))
    who = F.when(role != "system", role)
    return rows.select("conv_id", "turn", (X.is_true(F.col("text")) & X.is_true(F.when(role == "system", "").otherwise(role))).alias("filled"), X.join_or(items, "none").alias("tags"), X.prompt("Say {text} to {who}.", text=F.col("text"), who=who).alias("prompt"))


@query("SELECT page_id, p AS path, NOT (starts_with(p, '/_next/static') OR starts_with(p, '/_next/image') OR starts_with(p, '/favicon.ico')) AS is_page FROM (SELECT page_id, CASE WHEN length(url) > 40 THEN '/_next/static/' || page_id WHEN length(html) > 2000 THEN '/favicon.ico' ELSE '/history/' || page_id END AS p FROM pages)")
def url_matcher(spark, sf_dir):
    path = F.when(F.length("url") > 40, F.concat(F.lit("/_next/static/"), F.col("page_id"))).when(F.length("html") > 2000, "/favicon.ico").otherwise(F.concat(F.lit("/history/"), F.col("page_id")))
    return _table(spark, sf_dir, "pages").select("page_id", path.alias("path"), X.is_page(path).alias("is_page"))


@query("SELECT event_id AS id, CASE WHEN event_type = 'click' THEN lpad(user_id::VARCHAR, 36, '0') END AS kept, event_type <> 'click' AS made FROM events")
def ensured_identity(spark, sf_dir):
    cookie = F.when(F.col("type") == "view", "").when(F.col("type") == "click", F.lpad(F.col("userId").cast("string"), 36, "0"))
    rows = _entries(spark, sf_dir).select("id", cookie.alias("cookie"), X.ensured_identity(cookie).alias("identity"))
    new = F.col("identity").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$") & (F.col("identity") != F.coalesce("cookie", F.lit("")))
    return rows.select("id", F.when(F.col("identity") == F.col("cookie"), F.col("identity")).alias("kept"), new.alias("made"))


@query("SELECT event_id AS id, CASE WHEN event_type IN ('view', 'click') THEN 'no user' WHEN event_type = 'error' THEN 'no text' WHEN length(props) > 12 THEN 'too long' END AS problem FROM events")
def identity_gate(spark, sf_dir):
    kind = F.col("type")
    user = F.when(kind == "view", "").when(kind != "click", "u")
    return _entries(spark, sf_dir).select("id", interpretation.validity(user, F.when(kind != "error", F.col("props")), 12).alias("problem"))


# --- JSON -------------------------------------------------------------------------


@query("SELECT event_id AS id, event_type AS text, event_type || ',x,' || event_type || ',y,z' AS tags, CASE WHEN event_type = 'view' THEN 'x' ELSE 'x,' || event_type END AS toggled, event_type = 'view' AS has FROM events")
def tag_normalize(spark, sf_dir):
    body = F.concat(F.lit('{"dreamText":"　'), F.col("type"), F.lit('\\n","moodTags":["'), F.col("type"), F.lit('",1,"x",null,{"a":2},"'), F.col("type"), F.lit('","y","z","w"]}'))
    rows = _entries(spark, sf_dir).select("id", "type", F.lit("u").alias("user_id"), F.col("createdAt").alias("request_ts"), body.alias("raw_body"))
    rows = interpretation.normalized(rows)
    tags = F.when(F.col("type") == "view", F.array(F.lit("x"), F.lit("view"))).otherwise(F.array(F.lit("x")))
    return rows.select("id", F.col("dream_text").alias("text"), F.array_join("mood_tags", ",").alias("tags"), F.array_join(J.toggled(tags, F.col("type")), ",").alias("toggled"), F.array_contains(tags, F.col("type")).alias("has"))


@query("SELECT event_id AS id, i::INT AS position, k AS key, CASE k WHEN 'z' THEN event_type ELSE v END AS value FROM (SELECT *, json_extract_string(props, '$.k') AS v FROM events), (SELECT unnest(['z', 'k']) AS k, unnest([0, 1]) AS i)")
def ordered_unpivot(spark, sf_dir):
    raw = F.concat(F.lit('{"a":"","z":"'), F.col("type"), F.lit('",'), F.expr("substring(props, 2)"))
    pairs = J.ordered_pairs(raw, ("a", "z", "missing", "k"))
    return _entries(spark, sf_dir).select("id", F.posexplode(pairs).alias("position", "p")).select("id", "position", "p.*")


def _reply(kind, first):
    fields = {f: "x" for f in J.TOP_FIELDS} | {"symbols": [], "fortune": {f: "y" for f in J.FORTUNE_FIELDS}}
    whole = json.dumps(fields)
    broken = json.dumps(fields | {"fortune": {f: "y" for f in J.FORTUNE_FIELDS[1:]}})
    no_list = json.dumps(fields | {"symbols": {"a": 1}})
    number, zero = json.dumps(fields | {"title": 3}), json.dumps(fields | {"title": 0})
    return F.when(kind == "view", whole).when(kind == "click", broken).when(kind == "purchase", no_list).when(first, number).otherwise(zero)


@query("SELECT event_id AS id, event_type = 'view' OR (event_type IN ('signup', 'error') AND value > 50) AS good FROM events")
def shape_validation(spark, sf_dir):
    return _entries(spark, sf_dir).select("id", J.has_shape(F.try_parse_json(_reply(F.col("type"), F.col("value") > 50))).alias("good"))


@query("""SELECT event_id AS id, CASE event_type WHEN 'view' THEN '{"a": 1}' WHEN 'click' THEN '{"a": 2}' WHEN 'purchase' THEN '{"a": 4}' END AS json FROM events""")
def strict_json_parse(spark, sf_dir):
    kind = F.col("type")
    said = F.when(kind == "view", '{"a":1}').when(kind == "click", 'Sure: {"a":1,"a":2} done').when(kind == "purchase", '```json\n{"a":4}\n```').when(kind == "signup", "{'a':5}").otherwise("")
    return _entries(spark, sf_dir).select("id", J.reply_json(said).alias("json"))


@query("""SELECT event_id AS id, CASE WHEN event_type NOT IN ('click', 'error') THEN '{"extra":[1,2],"omen":"' || event_type || '"}' END AS fortune, '[{"name":"a"}]' AS symbols FROM events""")
def stored_members(spark, sf_dir):
    kind = F.col("type")
    fortune = F.when(kind == "click", '"fortune":null,').when(kind == "error", "").otherwise(F.concat(F.lit('"fortune":{"omen":"'), kind, F.lit('","extra":[1,2]},')))
    said = F.try_parse_json(F.concat(F.lit("{"), fortune, F.lit('"symbols":[{"name":"a"}],"other":1}')))
    return _entries(spark, sf_dir).select("id", J.stored_member(said, "fortune").alias("fortune"), J.stored_member(said, "symbols").alias("symbols"))


@query("SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 400 WHEN value < 20 THEN 429 WHEN event_type = 'view' THEN 502 ELSE 200 END::INT AS status FROM events")
def status_chain(spark, sf_dir):
    kind = F.col("type")
    problem = interpretation.validity(F.lit("u"), F.when(kind == "click", F.lit("")).otherwise(kind))
    return _entries(spark, sf_dir).select("id", interpretation.status(problem, F.col("value") >= 20, kind != "view").alias("status"))


# --- tables and plans ---------------------------------------------------------------


@query("SELECT event_id, NULL::VARCHAR AS traditional, event_type FROM events")
def schema_evolution_read(spark, sf_dir):
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("traditional", T.StringType()), T.StructField("event_type", T.StringType())])
    return S.read_entries(spark, f"{sf_dir}/events.parquet", schema)


@query("SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS \"userId\", 'TAROT' AS type, event_type AS \"cardName\", value > 50 AS reversed, date_trunc('millisecond', ts)::TIMESTAMP AS \"createdAt\" FROM events")
def draw_rows(spark, sf_dir):
    rows = _entries(spark, sf_dir).select("userId", F.col("type").alias("cardName"), F.lit(None).alias("cardKeyword"), (F.col("value") > 50).alias("reversed"), F.lit("go").alias("tarotAdvice"), "id", "createdAt")
    return S.draw_rows(rows, F.col("id"), F.col("createdAt")).select("id", "userId", "type", "cardName", "reversed", "createdAt")


def echo_model(prompts: list[str]) -> list[str | None]:
    """Stands in for a text model: the same answer to the same prompt, and none to some."""
    fields = {f: "x" for f in J.TOP_FIELDS} | {"symbols": [{"name": "n", "meaning": "m"}], "fortune": {f: "y" for f in J.FORTUNE_FIELDS} | {"more": "extra"}}
    return [None if len(p) % 7 == 0 else "Here: " + json.dumps(fields) for p in prompts]


def advice_model(prompts: list[str]) -> list[str | None]:
    """Stands in for a text model that reads cards: good advice, a number, what counts as none, and no answer."""
    said = {"view": '{{"advice": "go {}"}}', "click": 'Well: {{"advice": 3}}', "purchase": '{{"advice": 0}}', "signup": '{{"other": "{}"}}'}
    return [said[name].format(way) if name in said else None for name, way in (p.split() for p in prompts)]


@query("SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'go ' || CASE WHEN value > 50 THEN 'reversed' ELSE 'upright' END WHEN 'click' THEN '3' END AS advice FROM events")
def draw_readings(spark, sf_dir):
    rows = _entries(spark, sf_dir).select("id", F.col("type").alias("name"), history.orientation(F.col("value") > 50, "upright", "reversed").alias("orientation"), F.lit("").alias("meaning"))
    return interpretation.read_draws(rows, advice_model, "{name} {orientation}{meaning}").select("id", F.col("tarotAdvice").alias("advice"))


_PIPELINE = """
WITH said AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, text, text = '' OR length(text) > 1000 AS bad, length('Read ' || text || ' with none') % 7 = 0 AS lost FROM conversations),
judged AS (SELECT *, count(*) FILTER (NOT bad AND NOT lost) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM said)
SELECT id, conv_id, text, CASE WHEN bad THEN 400 WHEN used >= 5 THEN 429 WHEN lost THEN 502 ELSE 200 END::INT AS status FROM judged"""


def _requests(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("user_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("turn").cast("int"))).alias("request_ts"), F.to_json(F.struct(F.concat(F.lit(" "), F.col("text")).alias("dreamText"), F.lit(1).alias("moodTags"))).alias("raw_body"))


@query(f"SELECT id, status, status <> 200 AS error FROM ({_PIPELINE})")
def interpretation_pipeline(spark, sf_dir):
    answers = interpretation.interpret(_requests(spark, sf_dir), echo_model, "Read {text} with {tags}").answers
    return answers.select("id", "status", F.get_json_object("body", "$.error").isNotNull().alias("error"))


@query(f"""WITH p AS ({_PIPELINE}) SELECT id::VARCHAR AS id, conv_id::VARCHAR AS "userId", 'DREAM' AS type, text AS "dreamText", 'x' AS title, 'y' AS omen, 1::INT AS symbols, 'extra' AS more, NULL::VARCHAR AS "cardName" FROM p WHERE status = 200""")
def interpretation_entries(spark, sf_dir):
    made = interpretation.interpret(_requests(spark, sf_dir), echo_model, "Read {text} with {tags}").entries
    at = fresh_path(spark, "entries")
    S.append(made, at)
    rows = S.read_entries(spark, at)
    return rows.select("id", "userId", "type", "dreamText", "title", F.col("fortune.omen").alias("omen"), F.size("symbols").alias("symbols"), F.get_json_object("fortuneJson", "$.more").alias("more"), "cardName")


# --- runs that hand on what they leave ---------------------------------------------------

#: Events as requests on many days: no user, no text, replies that fail, and a window that slides.
_SLIDING = """
WITH RECURSIVE q AS (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN '' ELSE user_id::VARCHAR END AS who, ts, CASE WHEN value < 3 THEN '' ELSE event_type || ' ' || props END AS text, length('Read ' || event_type || ' ' || props) % 7 = 0 AS lost FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY ts, id) AS n FROM q WHERE who <> '' AND text <> ''),
r AS (
 SELECT who, n, id, ts, text, true AS asked, lost, CASE WHEN lost THEN [] ELSE [ts] END AS held FROM o WHERE n = 1
 UNION ALL
 SELECT who, n, id, ts, text, len(still) < 5, lost, CASE WHEN len(still) < 5 AND NOT lost THEN list_append(still, ts) ELSE still END
 FROM (SELECT o.*, list_filter(r.held, lambda t: t >= o.ts - INTERVAL 24 HOURS) AS still FROM r JOIN o ON o.who = r.who AND o.n = r.n + 1)),
judged AS (SELECT id, NULL::VARCHAR AS who, NULL::VARCHAR AS text, NULL::TIMESTAMP AS ts, 400 AS status FROM q WHERE who = '' OR text = ''
 UNION ALL SELECT id, who, text, ts, CASE WHEN NOT asked THEN 429 WHEN lost THEN 502 ELSE 200 END FROM r),
told AS (SELECT id, status::INT AS status, CASE WHEN status = 200 THEN who END AS "userId", CASE WHEN status = 200 THEN text END AS "dreamText", CASE WHEN status = 200 THEN 'extra' END AS more, CASE WHEN status = 200 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS "createdAt", CASE WHEN status = 502 THEN 'refused' END AS failed FROM judged)
SELECT id, status, "userId", "dreamText", more, "createdAt", failed FROM told"""

def sliding_model(prompts: list[str]) -> list[str | None]:
    """Stands in for a text model: replies that are no good where the prompt's length is a multiple of seven."""
    return ["nothing" if len(p) % 7 == 0 else echo_model(["abc"])[0] for p in prompts]


def _sliding_requests(spark, sf_dir):
    kind = F.col("type")
    said = F.when(F.col("value") < 3, "").otherwise(F.concat_ws(" ", kind, "props"))
    who = F.when(kind == "error", "").otherwise(F.col("userId").cast("string"))
    return _entries(spark, sf_dir).select("id", who.alias("user_id"), F.col("createdAt").alias("request_ts"), F.to_json(F.struct(said.alias("dreamText"))).alias("raw_body"))


def _told(answers: DataFrame) -> DataFrame:
    """Answers with what stands in them."""
    told = lambda path: F.get_json_object("body", f"$.entry.{path}")
    return answers.select("id", "status", told("userId").alias("userId"), told("dreamText").alias("dreamText"), told("fortune.more").alias("more"), told("createdAt").alias("createdAt"), F.when(F.col("refused").isNotNull(), "refused").alias("failed"))


@query(_SLIDING)
def interpretation_runs(spark, sf_dir):
    """Three runs, each given the quota that the one before has left: no run reads an entry."""
    state, answers = None, None
    for requests in _by_time(_sliding_requests(spark, sf_dir), "request_ts"):
        made = interpretation.interpret(requests, sliding_model, "Read {text}", state=state)
        state = staged(made.state, "quota")
        answers = made.answers if answers is None else answers.unionByName(made.answers)
    return _told(answers)


@query(f"SELECT * FROM ({_SLIDING}) SEMI JOIN (SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '{_RUNS[1]}') USING (id)")
def interpretation_stored(spark, sf_dir):
    """The last run alone, with the entries of those before: only a day of them is read."""
    before, middle, last = _by_time(_sliding_requests(spark, sf_dir), "request_ts")
    at = fresh_path(spark, "entries")
    S.append(interpretation.interpret(before.unionByName(middle), sliding_model, "Read {text}").entries, at)
    return _told(interpretation.interpret(last, sliding_model, "Read {text}", stored=S.read_entries(spark, at)).answers)


@query(_SLIDING)
def interpretation_stream(spark, sf_dir):
    """The runs as batches of a stream; entries, answers and quota are committed once a batch."""
    log = CommitLog(spark, fresh_path(spark, "log"))
    name = f"dreams-{uuid.uuid4().hex[:8]}"

    def start(source: DataFrame, at: str) -> None:
        runs.interpret_stream(source, log, name, sliding_model, "Read {text}").option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()

    _in_batches(spark, _by_time(_sliding_requests(spark, sf_dir), "request_ts"), "requests", start)
    kept = log.table("entries").select("id", F.col("title").isNotNull().alias("stored"))
    answers = log.table("answers").withColumn("key", F.col("id").cast("string")).join(kept.withColumnRenamed("id", "key"), "key", "left")
    return _told(answers.withColumn("body", F.when(F.coalesce("stored", F.lit(False)) == (F.col("status") == 200), F.col("body"))))


_DRAWN = f"""
WITH r AS (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN '' ELSE user_id::VARCHAR END AS who, ts, {_HASH.format('event_id::VARCHAR')} % 78 AS n, {_HASH.format("event_id || '/reversed'")}::DOUBLE / 4294967296 < 0.35 AS reversed FROM events),
t AS (SELECT r.*, p_name, length('Read ' || coalesce(p_name, '') || ' ' || CASE WHEN reversed THEN 'reversed' ELSE 'upright' END || ' ' || coalesce(CASE WHEN reversed THEN p_type ELSE p_brand END, '')) % 7 <> 0 AND p_name IS NOT NULL AS good FROM r LEFT JOIN part ON p_partkey = n),
o AS (SELECT *, row_number() OVER (PARTITION BY who, ts::DATE ORDER BY ts, id) AS place FROM t WHERE who <> ''),
f AS (SELECT *, min(place) FILTER (good) OVER (PARTITION BY who, ts::DATE) AS hit FROM o),
d AS (SELECT *, first_value(id) OVER (PARTITION BY who, ts::DATE ORDER BY (place = hit) DESC NULLS LAST, place) AS first_id FROM f)"""


def draw_model(prompts: list[str]) -> list[str | None]:
    """Stands in for a text model that reads cards, and fails at some."""
    if any(len(p) % 7 == 0 for p in prompts):
        raise ValueError("no answer")
    return ['So: {"advice": "go"}' for _ in prompts]


def _draw_deck(spark, sf_dir):
    return _table(spark, sf_dir, "part").filter("p_partkey < 78").select(F.col("p_partkey").alias("number"), F.col("p_name").alias("name"), F.lit("").alias("keyword"), F.col("p_brand").alias("uprightMeaning"), F.col("p_type").alias("reversedMeaning"))


def _draw_requests(spark, sf_dir):
    who = F.when(F.col("type") == "error", "").otherwise(F.col("userId").cast("string"))
    return _entries(spark, sf_dir).select("id", who.alias("user_id"), F.col("createdAt").alias("request_ts"))


def _draws(spark, sf_dir):
    return interpretation.draw(_draw_requests(spark, sf_dir), _draw_deck(spark, sf_dir), 78, draw_model, "Read {name} {orientation} {meaning}")


@query(f"""{_DRAWN} SELECT id, 400::INT AS status, NULL::VARCHAR AS draw_id, false AS "alreadyDrawn" FROM r WHERE who = ''
UNION ALL SELECT id, CASE WHEN place >= hit THEN 200 ELSE 502 END::INT, CASE WHEN place >= hit THEN first_id::VARCHAR END, coalesce(place > hit, false) FROM d""")
def draw_plan(spark, sf_dir):
    return _draws(spark, sf_dir).answers.select("id", "status", "draw_id", F.coalesce("alreadyDrawn", F.lit(False)).alias("alreadyDrawn"))


@query(f"""{_DRAWN} SELECT id::VARCHAR AS id, who AS "userId", 'TAROT' AS type, p_name AS "cardName", reversed, 'go' AS "tarotAdvice", date_trunc('millisecond', ts)::TIMESTAMP AS "createdAt" FROM d WHERE place = hit""")
def draw_entries(spark, sf_dir):
    return _draws(spark, sf_dir).entries.select("id", "userId", "type", "cardName", "reversed", "tarotAdvice", "createdAt")


@query(f"""{_DRAWN} SELECT id, 400::INT AS status, NULL::VARCHAR AS draw_id, false AS "alreadyDrawn", NULL::VARCHAR AS card, NULL::VARCHAR AS advice FROM r WHERE who = ''
UNION ALL SELECT d.id, CASE WHEN place >= hit THEN 200 ELSE 502 END::INT, CASE WHEN place >= hit THEN first_id::VARCHAR END, coalesce(place > hit, false), CASE WHEN place >= hit THEN f.p_name END, CASE WHEN place >= hit THEN 'go' END FROM d LEFT JOIN t f ON f.id = d.first_id""")
def draw_runs(spark, sf_dir):
    """Three runs, whose borders lie within days, each given the draws that the one before has left."""
    log = CommitLog(spark, fresh_path(spark, "log"))
    for k, requests in enumerate(_by_time(_draw_requests(spark, sf_dir), "request_ts")):
        runs.draw_run(log, f"draws-{k}", requests, _draw_deck(spark, sf_dir), 78, draw_model, "Read {name} {orientation} {meaning}")
    told = lambda path: F.get_json_object("body", f"$.entry.{path}")
    return log.table("answers").select("id", "status", "draw_id", F.coalesce("alreadyDrawn", F.lit(False)).alias("alreadyDrawn"), told("cardName").alias("card"), told("tarotAdvice").alias("advice"))


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, arg_max(event_id, (ts, event_id)) AS found FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT e.event_id AS id, CASE WHEN e.event_type <> 'error' THEN d.found::VARCHAR END AS found, e.event_type = 'error' OR d.found IS NULL AS nothing FROM events e LEFT JOIN d ON d.user_id = e.user_id AND d.day = e.ts::DATE""")
def todays_draws(spark, sf_dir):
    """What each event's user has drawn on its day, with views as draws; errors do not say who asks."""
    rows = _entries(spark, sf_dir)
    stored = rows.filter("type = 'view'").select(F.col("id").cast("string").alias("id"), F.col("userId").cast("string").alias("userId"), F.lit("TAROT").alias("type"), F.col("props").alias("cardName"), "createdAt")
    asked = rows.select("id", F.when(F.col("type") != "error", F.col("userId")).alias("user_id"), F.col("createdAt").alias("request_ts"))
    body = interpretation.todays_draws(asked, stored)
    return body.select("id", F.get_json_object("body", "$.entry.id").alias("found"), (F.col("body") == '{"entry":null}').alias("nothing"))


@query("SELECT user_id::VARCHAR AS \"userId\", event_type AS \"cardName\", count(*) AS n, TRUE AS same FROM events GROUP BY 1, 2")
def appended_rows(spark, sf_dir):
    """Ids and times that are made at writing are those that the caller gets."""
    rows = _entries(spark, sf_dir).select("userId", F.col("type").alias("cardName"), F.lit("").alias("cardKeyword"), F.lit(True).alias("reversed"), F.lit("go").alias("tarotAdvice"))
    at = fresh_path(spark, "rows")
    made = S.append(S.draw_rows(rows), at).select("id", F.col("createdAt").alias("made_at"), F.col("userId").alias("made_for"))
    both = S.read_entries(spark, at).join(made, "id", "full")
    return both.groupBy("userId", "cardName").agg(F.count("*").alias("n"), F.bool_and((F.col("createdAt") == F.col("made_at")) & (F.col("userId") == F.col("made_for"))).alias("same"))


@query("SELECT p_name AS name, p_brand AS keyword, p_type AS \"uprightMeaning\", NULL::VARCHAR AS arcana FROM part")
def cards_read(spark, sf_dir):
    at = fresh_path(spark, "deck")
    _table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("keyword"), F.col("p_type").alias("uprightMeaning")).write.parquet(at)
    return S.read_cards(spark, at).select("name", "keyword", "uprightMeaning", "arcana")
