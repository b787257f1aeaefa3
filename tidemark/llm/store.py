"""Cutting lineage in the shared folder, and small frame helpers that all operators use."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import quoted, without
from tidemark.sources.staging import staged as written

__all__ = ["apart", "as_one", "comparable", "partitions", "quoted", "without", "written"]


def as_one(names: list[str]) -> Column:
    """Columns as one, ``kept``: so that a task passes them on whatever they are called."""
    return (F.struct(*[F.col(quoted(c)).alias(c) for c in names]) if names else F.lit(0)).alias("kept")


def apart(names: list[str]) -> list[Column]:
    """The columns that ``as_one`` has put together."""
    return [F.col("kept").getField(c).alias(c) for c in names]


def _differs(kind: T.DataType) -> bool:
    """Whether values of a type can't be grouped and ordered as they are, or can't be told apart by it."""
    if isinstance(kind, T.StructType):
        return any(_differs(f.dataType) for f in kind)
    return _differs(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, (T.MapType, T.VariantType, T.FloatType, T.DoubleType))


def comparable(value: Column, kind: T.DataType) -> Column:
    """A value that is equal for equal values only, and that can be grouped and ordered, of a value of any type.

    Maps become their entries in order, variants their JSON, and floating numbers their text, as grouping takes -0.0 for 0.0.
    """
    if not _differs(kind):
        return value
    if isinstance(kind, T.StructType):
        fields = [comparable(value.getField(f.name), f.dataType).alias(f"f{k}") for k, f in enumerate(kind)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: comparable(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(comparable(e["key"], entry["key"].dataType).alias("key"), comparable(e["value"], entry["value"].dataType).alias("value"))))
    return F.to_json(value) if isinstance(kind, T.VariantType) else value.cast("string")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
