"""Dropping lines that many documents share, with levelled sorted runs.

A line's key is its text without white space around it, in lower case; what travels is 128 bits
of hash of it.  Each document sends a key once.  Batches of documents are added one after
the other to an index of sorted runs: a batch is counted, merged with the runs that are there, and written as a
run of its own that holds the new totals; when a level has as many runs as the fan, they are compacted
into one run of the next level.  So a key's last total is its largest, and the runs are few.

Runs are tables bucketed and sorted by key, so a batch is dealt out once and merged with each run where
that lies; runs are never shuffled.  Lines to drop are found by anti-joining documents with the
keys that reached the limit.  The most frequent of these, whose number has a proven bound, go to every task;
each other one is in so few documents that it can be dealt out by key.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.store import as_one, partitions, quoted, without, written
from tidemark.sources.staging import fresh_path

#: Keys that are sent to every task are at most so many: 16 bytes each.
FREQUENT_KEYS = 1 << 17

#: Batches that a table is added in, and runs of a level that are compacted into one.
BATCHES = 8
FAN = 4

#: Lines of rows that a task sends at a time.
_SEND = 1 << 16

_KEYS = T.StructType([T.StructField(n, T.IntegerType() if n == "batch" else T.LongType()) for n in ("batch", "ref", "hi", "lo")])
_KEYS_ARROW = pa.schema([("batch", pa.int32()), ("ref", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])


def line_keys(data: bytes, min_chars: int = 1) -> list[bytes]:
    """The key of each line as 16 bytes; empty where a line has none, as it is too short."""
    # for bytes, lower() knows A-Z only, and strip() takes U+0020 and U+0009 to U+000D
    whole = [line.strip() for line in data.lower().split(b"\n")]
    if min_chars > 1:
        whole = [k if len(k) >= min_chars and len(k.decode()) >= min_chars else b"" for k in whole]
    return [xxhash.xxh3_128_digest(k) if k else k for k in whole]


def _digests(hi: np.ndarray, lo: np.ndarray) -> list[bytes]:
    data = np.stack((hi, lo), axis=1).astype(">i8").tobytes()
    return [data[i : i + 16] for i in range(0, len(data), 16)]


def _ref(id_col: str, text_col: str):
    """What a document is known by.  Documents that share one by chance share common lines, which is harmless."""
    return F.xxhash64(F.col(quoted(id_col)).cast("string"), F.col(quoted(text_col)))


def keys_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """(batch, ref, hi, lo): the distinct line keys of each document; a batch is some of the tasks that read."""
    rows = docs.select(_ref(id_col, text_col).alias("ref"), F.col(quoted(text_col)).alias("text")).filter("text IS NOT NULL")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() % batches
        refs: list[int] = []
        found: list[bytes] = []

        def send() -> pa.RecordBatch:
            pairs = np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)
            columns = [np.full(len(refs), batch, np.int32), np.array(refs, np.int64), pairs[:, 0], pairs[:, 1]]
            refs.clear()
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], schema=_KEYS_ARROW)

        for frame in frames:
            for ref, text in zip(frame.column(0).to_pylist(), frame.column(1), strict=True):
                own = set(line_keys(text.as_py().encode(), min_chars))
                own.discard(b"")
                found.extend(own)
                refs.extend([ref] * len(own))
                if len(refs) >= _SEND:
                    yield send()
        if refs:
            yield send()

    return rows.mapInArrow(run, _KEYS)


@dataclass(frozen=True)
class LineRuns:
    """An index of line keys and the number of documents that have them: sorted runs by level, the newest last.

    It is nothing but names of folders, so it can be kept from one day to the next.
    """

    buckets: int
    levels: tuple[tuple[str, ...], ...] = ()
    fan: int = FAN

    @property
    def runs(self) -> tuple[str, ...]:
        """All runs, the oldest first."""
        return tuple(r for level in reversed(self.levels) for r in level)

    def _write(self, rows: DataFrame) -> str:
        path = fresh_path(rows.sparkSession, "lines")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        dealt = rows.select("hi", "lo", "n").repartition(self.buckets, "hi", "lo")
        dealt.write.bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").option("path", path).saveAsTable(name)
        return path

    def _read(self, spark: SparkSession, path: str) -> DataFrame:
        name = path.rsplit("/", 1)[1].replace("-", "_")
        if not spark.catalog.tableExists(name):  # written by an earlier session
            where = path.replace("'", "\\'")
            spark.sql(f"CREATE TABLE {name} (hi BIGINT, lo BIGINT, n BIGINT) USING parquet CLUSTERED BY (hi, lo) SORTED BY (hi, lo) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return spark.table(name)

    def add(self, keys: DataFrame) -> LineRuns:
        """The index with a batch of (hi, lo) more, a row for each document and key; compacted where a level is full."""
        spark = keys.sparkSession
        held = keys.groupBy("hi", "lo").agg(F.count("*").alias("n"))
        if self.buckets != partitions(spark):  # else they are dealt like the runs already
            held = held.repartition(self.buckets, "hi", "lo")
        for k, path in enumerate(self.runs):
            run = self._read(spark, path).withColumnRenamed("n", f"n{k}")
            held = held.join(run.hint("merge"), ["hi", "lo"], "left")
        before = [F.coalesce(f"n{k}", F.lit(0)) for k in range(len(self.runs))]
        so_far = F.greatest(*before) if len(before) > 1 else before[0] if before else F.lit(0)
        return self._filled(spark, self._write(held.select("hi", "lo", (F.col("n") + so_far).alias("n"))), 0)

    def _filled(self, spark: SparkSession, run: str, level: int) -> LineRuns:
        """With a run more on a level, the newest there."""
        levels = [*self.levels, *[()] * (level + 1 - len(self.levels))]
        levels[level] = (*levels[level], run)
        grown = LineRuns(self.buckets, tuple(levels), self.fan)
        if len(levels[level]) < self.fan:
            return grown
        merged = self._write(grown._merged(spark, levels[level]))
        levels[level] = ()
        return LineRuns(self.buckets, tuple(levels), self.fan)._filled(spark, merged, level + 1)

    def _merged(self, spark: SparkSession, paths: tuple[str, ...], least: int = 1) -> DataFrame:
        """Keys of some runs with their last totals, of those that have come to ``least``."""
        out = None
        for path in paths:
            run = self._read(spark, path).filter(F.col("n") >= least)
            out = run if out is None else out.unionByName(run)
        return out.groupBy("hi", "lo").agg(F.max("n").alias("n"))

    def common(self, spark: SparkSession, least: int) -> DataFrame:
        """(hi, lo, n) of the keys that at least so many documents have."""
        if not self.runs:
            return spark.createDataFrame([], "hi long, lo long, n long")
        return self._merged(spark, self.runs, least)


def index_lines(keys: DataFrame, runs: LineRuns | None = None) -> LineRuns:
    """The index with all batches of ``keys`` (batch, ref, hi, lo) added, in order of their numbers."""
    runs = runs or LineRuns(partitions(keys.sparkSession))
    for row in keys.select("batch").distinct().orderBy("batch").collect():
        runs = runs.add(keys.filter(F.col("batch") == row["batch"]))
    return runs


def drop_common_lines(docs: DataFrame, keys: DataFrame, runs: LineRuns, least: int = 10, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """``docs`` without the lines whose keys ``runs`` counts in at least ``least`` documents; ``keys`` are those of ``docs``.

    See ``dedup_lines``.
    """
    spark = docs.sparkSession
    common = written(runs.common(spark, least), "common-lines")
    # so many keys at most have a total of ``many``, as the totals sum up to no more than is told here
    total = common.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = max(least, -(-total // FREQUENT_KEYS))
    table = common.filter(F.col("n") >= many).select("hi", "lo").toArrow()
    frequent = frozenset(_digests(*(table.column(c).to_numpy() for c in ("hi", "lo"))))
    shared = spark.sparkContext.broadcast(frequent)

    # every other key is in fewer documents than ``many``, so no key crowds a task
    rarer = common.filter(F.col("n") < many).select("hi", "lo")
    hits = keys.join(rarer, ["hi", "lo"], "left_semi").groupBy("ref").agg(F.collect_set(F.struct("hi", "lo")).alias("more"))
    hits = written(hits, "line-hits")

    names = without(docs, (text_col, "n_lines", "n_dropped"))
    rows = docs.select(as_one(names), F.col(quoted(text_col)).alias("text"), _ref(id_col, text_col).alias("ref"))
    rows = rows.join(hits, "ref", "left").select("kept", "text", "more")
    schema = T.StructType([rows.schema["kept"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = shared.value
        for frame in frames:
            texts, lines, dropped = [], [], []
            for text, more in zip(frame.column(1), frame.column(2), strict=True):
                text = text.as_py()
                if text is None:
                    texts.append(None)
                    lines.append(1)
                    dropped.append(0)
                    continue
                own = frozenset(struct.pack(">qq", x["hi"], x["lo"]) for x in more.as_py() or ())
                data = text.encode()
                keys_ = line_keys(data, min_chars)
                drop = [k in gone or k in own for k in keys_]
                lines.append(len(keys_))
                dropped.append(n := sum(drop))
                texts.append(b"\n".join(line for line, d in zip(data.split(b"\n"), drop, strict=True) if not d).decode() if n else text)
            made = [pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([frame.column(0), *made], names=schema.names)

    own = [F.col("text").alias(c) if c.lower() == text_col.lower() else F.col("kept").getField(c).alias(c) for c in without(docs, ("n_lines", "n_dropped"))]
    return rows.mapInArrow(run, schema).select(*own, "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """``docs`` with the lines gone that at least ``least`` documents have, and n_lines (before) and n_dropped.

    A line ends at \\n.  Lines are equal if their keys are: without white space (U+0020, U+0009 to U+000D) at both
    ends, A-Z in lower case; a key of fewer than ``min_chars`` code points is none, and its line stays.  The others of
    a document's lines stay as they are, in order, joined by \\n; of a document that loses all, the text is empty.
    A key counts once a document, and each row is a document, so rows that are repeated
    count each.  A null text is one empty line and stays null; a null id is an id.  Texts of any length are
    read whole.  Input columns named like the computed ones are replaced; an empty table gives no rows.
    """
    keys = written(keys_of(docs, id_col, text_col, min_chars, batches), "line-keys")
    return drop_common_lines(docs, keys, index_lines(keys), least, id_col, text_col, min_chars)
