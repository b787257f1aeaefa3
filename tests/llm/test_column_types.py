"""Columns of every type go through every operator that keeps columns, and through every stage, as they are."""

from __future__ import annotations

from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tidemark.llm.decontamination import find_contamination
from tidemark.llm.language import fit_languages, identify_languages
from tidemark.llm.licenses import scan_licenses
from tidemark.llm.lines import dedup_lines
from tidemark.llm.mixing import mix_sources
from tidemark.llm.pii import GENERATORS, Trees, find_pii, redact
from tidemark.llm.simhash import drop_near_duplicates, simhash_groups
from tidemark.llm.store import comparable

INNER = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("m", T.MapType(T.StringType(), T.ArrayType(T.FloatType())))])
EXTRA = T.StructType(
    [
        T.StructField("at", T.TimestampNTZType()),
        T.StructField("zoned", T.TimestampType()),
        T.StructField("day", T.DateType()),
        T.StructField("m", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("b", T.BinaryType()),
        T.StructField("f", T.DoubleType()),
        T.StructField("d", T.DecimalType(30, 9)),
        T.StructField("s", INNER),
        T.StructField("l", T.ArrayType(INNER)),
        T.StructField("raw", T.StringType()),
    ]
)
TIME = datetime(2024, 1, 1, 0, 0, 0, 1)
VALUES = [
    (TIME, TIME, date(2024, 1, 1), {"a": 1, "b": None}, b"\x00\xff", float("nan"), Decimal("1.000000001"), ([1.0, None], {"k": [0.5]}), [([], None)], '{"a":1}'),
    (TIME.replace(microsecond=999), TIME, None, {"b": 2}, b"", -0.0, Decimal("1.000000002"), (None, {}), [], '{"a":[1,null]}'),
    (TIME, TIME.replace(microsecond=2), None, {}, None, 0.0, None, None, None, None),
    (None,) * 10,
]


@pytest.fixture(scope="module")
def typed(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *EXTRA])
    rows = [(k, "one two three four five", "en", "s", 23, *v) for k, v in enumerate(VALUES)]
    rows += [(7, "rows of one id and text", "en", "s", 23, *v) for v in VALUES] + [(8, None, "de", None, None, *VALUES[0])]
    # repeated
    rows += [(9, "a row that comes again", "en", "s", 22, *VALUES[1])] * 3
    return spark.createDataFrame(rows, schema).withColumn("v", F.try_parse_json("raw"))


def told(df) -> Counter:
    """The extra columns of each row, as text that tells all values apart."""
    columns = [F.to_json(F.struct("v")) if c == "v" else F.col(c) for c in (*EXTRA.names, "v")]
    return Counter(str([repr(x) for x in r]) for r in df.select("doc_id", *columns).collect())


def test_operators_keep_columns_of_every_type(spark, typed):
    bench = spark.createDataFrame([(1, "not there")], "item_id long, text string")
    every = Trees((1.0,), (1.0,), dict.fromkeys(GENERATORS, 0.5))
    expected = told(typed)
    assert len(expected) == 10 and sum(expected.values()) == 12
    for out in (simhash_groups(typed), scan_licenses(typed), mix_sources(typed), find_contamination(typed, bench), find_pii(typed, every), redact(typed, every), identify_languages(typed, fit_languages(typed)), dedup_lines(typed)):
        assert told(out) == expected


def test_near_duplicates_keep_columns_of_every_type(typed):
    kept = drop_near_duplicates(typed)
    rows = told(kept)
    assert set(rows) <= set(told(typed)) and set(rows.values()) == {1}
    assert {r["doc_id"] for r in kept.collect()} == {0, 7, 8, 9} and kept.schema == typed.schema
    again = drop_near_duplicates(typed.repartition(5).orderBy(F.desc("at")))
    assert told(again) == rows  # whatever the order


def test_stages_keep_columns_of_every_type(spark, typed, tmp_path):
    spark.createDataFrame([(1, "not there")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, typed, str(tmp_path))
        assert out.schema.names == typed.schema.names and set(told(out)) <= set(told(typed)), name


def test_comparable_values_are_told_apart(spark, typed):
    kind = T.StructType([*EXTRA.fields, T.StructField("v", T.VariantType())])
    rows = typed.filter("doc_id < 4").select("doc_id", F.struct(*kind.names).alias("s"))
    keys = rows.select("doc_id", comparable(F.col("s"), rows.schema["s"].dataType).alias("k"))
    assert keys.groupBy("k").count().count() == 4 and [r["doc_id"] for r in keys.unionByName(keys).groupBy("k").agg(F.min("doc_id").alias("doc_id")).orderBy("doc_id").collect()] == [0, 1, 2, 3]
