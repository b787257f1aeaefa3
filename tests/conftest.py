from __future__ import annotations

import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    """Values that compare: missing ones as None, floats by their shortest text."""
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return repr(value)
    return str(value)


def same_rows(frame, expected) -> None:
    """The same columns and the same rows, in any order."""
    columns = sorted(frame.columns)
    assert columns == sorted(expected.columns)
    key = lambda r: tuple((v is not None, v or "") for v in r)
    mine, theirs = (sorted((tuple(plain(v) for v in r) for r in x[columns].itertuples(index=False)), key=key) for x in (frame, expected))
    assert len(mine) == len(theirs)
    wrong = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    assert not wrong, wrong[:3]
