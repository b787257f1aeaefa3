"""Reading and writing entries, cards and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import milliseconds
from tidemark.sources.schemas import CARD, DREAM, ENTRY, KINDS, REQUEST, TAROT
from tidemark.sources.staging import staged


def session(name: str = "tidemark") -> SparkSession:
    """The process's one session, in UTC."""
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def read_entries(spark: SparkSession, path: str, schema: T.StructType = ENTRY) -> DataFrame:
    """Entries with the whole schema: columns that older files lack are null there."""
    return spark.read.schema(schema).parquet(path)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CARD).parquet(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests as they came, a JSON object with user_id, request_ts and raw_body a line, ready for the plans.

    One that has no ``id`` gets one, made once: the rows are written to the shared folder.  A line that is no object is a request without anything.
    """
    rows = spark.read.schema(REQUEST).json(path)
    return staged(rows.withColumn("id", F.coalesce("id", F.uuid())), "requests")


def union_cards(*lists: DataFrame) -> DataFrame:
    """Lists of cards one after the other; columns that one lacks are null there."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def _row(rows: DataFrame, kind: str, values: dict[str, Column], key: Column | None, now: Column | None, keep: tuple[str, ...] = ()) -> DataFrame:
    if kind not in KINDS:
        raise ValueError(f"no such kind of entry: {kind}")
    made = {"id": F.uuid() if key is None else key, "type": F.lit(kind), "createdAt": milliseconds(F.current_timestamp().cast("timestamp_ntz") if now is None else now), **values}
    columns = [(made[f.name] if f.name in made else F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTRY if f.name not in keep]
    return rows.select(*columns, *keep)


def dream_rows(rows: DataFrame, key: Column | None = None, now: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Entries of accepted readings; columns of the other kind are null.  Id and time are made where they are not given.  Columns to ``keep`` stay as they are."""
    names = ("userId", "dreamText", "mood", "advice", "title", "traditional", "psychological", "symbols", "fortune")
    more = [n for n in ("symbolsJson", "fortuneJson") if n in rows.columns]
    return _row(rows, DREAM, {n: F.col(n) for n in (*names, *more)}, key, now, keep)


def draw_rows(rows: DataFrame, key: Column | None = None, now: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Entries of draws."""
    names = ("userId", "cardName", "cardKeyword", "reversed", "tarotAdvice")
    return _row(rows, TAROT, {n: F.col(n) for n in names}, key, now, keep)


def entry_object() -> Column:
    """A stored row as the JSON object that answers hold: all columns, nulls too, nested members as they came, the time in UTC to the millisecond."""
    nested = {"symbols": "symbolsJson", "fortune": "fortuneJson"}

    def column(name: str) -> Column:
        if name in nested:
            return F.coalesce(F.try_parse_json(nested[name]), F.try_parse_json(F.to_json(name)))
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if name == "createdAt" else F.col(name)

    return F.to_json(F.struct(*[column(f.name).alias(f.name) for f in ENTRY if f.name not in nested.values()]), {"ignoreNullFields": "false"})


def append(rows: DataFrame, path: str) -> DataFrame:
    """Appends rows and returns them as they were written: ids and times that are made on the way are made once."""
    made = staged(rows, "rows")
    made.write.mode("append").parquet(path)
    return made


def responses(rows: DataFrame, *columns: str) -> DataFrame:
    """JSON answers made of columns."""
    return rows.select(F.to_json(F.struct(*columns)).alias("response"))
