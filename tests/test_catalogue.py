"""Every query against the SQL that gives the same rows."""

import pytest

from tests.conftest import same_rows
from tidemark.plans.catalogue import CATALOGUE


@pytest.mark.parametrize("name", list(CATALOGUE))
def test_query_matches_sql(spark, sf_dir, duck, name):
    run, sql = CATALOGUE[name]
    got = run(spark, sf_dir).toPandas()
    assert len(got)
    same_rows(got, duck.execute(sql).df())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CATALOGUE) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
