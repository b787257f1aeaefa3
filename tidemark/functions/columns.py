"""Columns by their names, whatever these are."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name as one identifier, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of ``df`` but for ``names``, compared as Spark does, without case."""
    drop = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in drop]


def named(name: str) -> Column:
    return F.col(quoted(name))
