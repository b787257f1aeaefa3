"""Entries laid out for reads by user: bucketed by user and, within a bucket's files, in order of user and time.

One user's entries are in one bucket, so a read by user opens that bucket's files only, and of these the row groups that may hold
the user; what is grouped by user is not shuffled.  It is the layout that an index over user and time stands for in a database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import quoted

#: Buckets of a table; a bucket's part of the entries should fit a task.
BUCKETS = 256

#: Files of a bucket from which on it is worth while to write the table anew.
MOST_FILES = 8


def _buckets(spark: SparkSession, table: str) -> int:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Num Buckets'").collect()
    if not rows:
        raise ValueError(f"{table} is not clustered")
    return int(rows[0]["data_type"])


def _write(entries: DataFrame, table: str, buckets: int, mode: str, path: str | None = None) -> None:
    # dealt like the buckets, so that each gets one file
    dealt = entries.repartition(buckets, "userId")
    writer = dealt.write.mode(mode).bucketBy(buckets, "userId").sortBy("userId", "createdAt")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def write_clustered(entries: DataFrame, table: str, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """Entries as a new table, in the warehouse or in a folder; the table."""
    _write(entries, table, buckets, "errorifexists", path)
    return entries.sparkSession.table(table)


def append_clustered(entries: DataFrame, table: str) -> DataFrame:
    """Adds entries to a table in its layout: a file for each bucket that gets any."""
    spark = entries.sparkSession
    columns = [F.col(quoted(c)) for c in spark.table(table).columns]
    _write(entries.select(*columns), table, _buckets(spark, table), "append")
    return spark.table(table)


def files_a_bucket(spark: SparkSession, table: str) -> int:
    """Most files that a bucket has: one for each time that something was added to it."""
    bucket = F.regexp_extract("file", r"_(\d+)(?:\.c\d+)?[^_/]*$", 1)
    files = spark.createDataFrame([(f,) for f in spark.table(table).inputFiles()], "file string")
    return files.groupBy(bucket).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def compact_clustered(spark: SparkSession, table: str, into: str, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """The table written anew under another name, with one file a bucket; readers of the old one are not disturbed."""
    return write_clustered(spark.table(table), into, buckets or _buckets(spark, table), path)
