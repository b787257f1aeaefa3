"""Entries in a relational database: scans in ranges of time, and reads that the database answers itself."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

#: Ranges of a scan, each read by one task over a connection of its own.
RANGES = 16

#: Rows that a connection fetches at a time.
FETCH = 10_000


def _name(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _settings(options: dict[str, str]) -> dict[str, str]:
    # times have no zone in the table
    return {"fetchsize": str(FETCH), "preferTimestampNTZ": "true", **options}


def read_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table over one connection; filters that Spark pushes are answered by the database."""
    return spark.read.jdbc(url, _name(table), properties=_settings(options))


def _moment(at: datetime) -> str:
    """A time as JDBC drivers of all databases read it."""
    return f"{{ts '{at.isoformat(' ', 'microseconds')}'}}"


def read_range(spark: SparkSession, url: str, table: str, since: datetime, until: datetime, ranges: int = RANGES, time_col: str = "createdAt", **options: str) -> DataFrame:
    """Entries of a half-open time range, in ``ranges`` stretches of equal length that are read side by side.

    Each stretch is a condition that the database answers, by its index on time; further filters are told to it as well.  Entries without a time are in none.
    """
    if since >= until:
        raise ValueError("the range is empty")
    edges = [since + (until - since) * k / ranges for k in range(ranges)] + [until]
    at = _name(time_col)
    stretches = [f"{at} >= {_moment(a)} AND {at} < {_moment(b)}" for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]
    return spark.read.jdbc(url, _name(table), predicates=stretches, properties=_settings(options))


def read_recent(spark: SparkSession, url: str, table: str, user: str | None, cap: int, **options: str) -> DataFrame:
    """One user's most recent entries, chosen by the database: equal times go by id, later first.  A null user has none."""
    who = "1 = 0" if user is None else f"{_name('userId')} = {_text(user)}"
    chosen = f"SELECT * FROM {_name(table)} WHERE {who} ORDER BY {_name('createdAt')} DESC, {_name('id')} DESC FETCH FIRST {int(cap)} ROWS ONLY"
    return spark.read.jdbc(url, f"({chosen}) recent", properties=_settings(options))


def append_rows(rows: DataFrame, url: str, table: str, connections: int = RANGES, **options: str) -> None:
    """Adds rows to a table, over at most so many connections."""
    rows.write.format("jdbc").options(url=url, dbtable=_name(table), numPartitions=str(connections), **options).mode("append").save()
