"""JSON from outside: what is not as it should be becomes a default, or goes to quarantine."""

from __future__ import annotations

import json as _json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import is_true, outer_braces
from tidemark.sources.schemas import FORTUNE

#: Tags of a request that are kept.
MAX_TAGS = 5

# Names of a reply's fields.
TOP_FIELDS = ("title", "traditional", "psychological", "mood", "advice")
FORTUNE_FIELDS = tuple(FORTUNE.names)


def body(raw: Column) -> Column:
    """A request's body as a variant; null if it is no JSON."""
    return F.try_parse_json(raw)


def _member(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def text_member(value: Column, name: str) -> Column:
    """A member if it is a string, else the empty string."""
    member = _member(value, f"$.{name}")
    return F.coalesce(F.when(_kind(member) == "STRING", F.try_variant_get(member, "$", "string")), F.lit(""))


def string_items(value: Column, name: str, most: int = MAX_TAGS) -> Column:
    """The first ``most`` strings of an array member, without the items that are no strings; empty if it is no array."""
    items = F.try_variant_get(value, f"$.{name}", "array<variant>")
    strings = F.filter(items, lambda x: F.coalesce(_kind(x) == "STRING", F.lit(False)))
    return F.coalesce(F.slice(F.transform(strings, lambda x: F.try_variant_get(x, "$", "string")), 1, most), F.array().cast("array<string>"))


def toggled(items: Column, item: Column) -> Column:
    """Without the item if it is there, else with it at the end."""
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.array_append(items, item))


def ordered_pairs(raw: Column, keys: Sequence[str]) -> Column:
    """(key, value) of an object's members that are not empty, in the order of ``keys``."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.get_json_object(raw, f"$.{k}").alias("value")) for k in keys])
    return F.filter(pairs, lambda p: is_true(p["value"]))


def _refuse(name: str) -> None:
    raise ValueError(name)


def strictly(text: str | None) -> str | None:
    """The text, written anew, if it is JSON to the letter; else null."""
    try:
        return _json.dumps(_json.loads(text, parse_constant=_refuse), ensure_ascii=False) if text else None
    except (ValueError, RecursionError):
        return None


def parsed_reply(text: str | None) -> str | None:
    """``reply_json`` of one text."""
    if (whole := strictly(text)) is not None or not text:
        return whole
    start, end = text.find("{"), text.rfind("}")
    return strictly(text[start : end + 1]) if 0 <= start < end else None


def _true(value: object) -> bool:
    """What a browser takes for true, of what JSON can hold."""
    return value is not None and value is not False and value != "" and (isinstance(value, bool) or value != 0)


def shape_of(json: str | None, fields: Sequence[str] = TOP_FIELDS, fortune: Sequence[str] = FORTUNE_FIELDS) -> bool:
    """``has_shape`` of one text of JSON."""
    reply = _json.loads(json) if json else None
    if not isinstance(reply, dict) or not isinstance(reply.get("symbols"), list) or not isinstance(reply.get("fortune"), dict):
        return False
    return all(_true(reply.get(f)) for f in fields) and all(_true(reply["fortune"].get(f)) for f in fortune)


def true_text(json: str | None, name: str) -> str | None:
    """``true_member`` of one text of JSON."""
    reply = _json.loads(json) if json else None
    value = reply.get(name) if isinstance(reply, dict) else None
    if not _true(value):
        return None
    return value if isinstance(value, str) else _json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def with_member(json: str, name: str, value: str) -> str:
    """A text of JSON with a member of its object set."""
    return _json.dumps(_json.loads(json) | {name: value}, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def strict_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The text if it is JSON to the letter, else null.

    Spark's parsers take more (single quotes, text after the end) and less
    (an object with a key twice), so this is left to Python, by Arrow batches.
    """
    for series in texts:
        yield series.map(strictly, na_action="ignore").astype(object).where(series.notna(), None)


def reply_json(text: Column) -> Column:
    """The JSON of a reply: all of it, or else its stretch from the first to the last brace; null if neither is JSON."""
    return F.coalesce(strict_json(text), strict_json(outer_braces(text)))


def _truthy(value: Column) -> Column:
    """Truth of a variant: not null, not an empty string, not zero, not false."""
    kind = _kind(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(value.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "STRING", text != "")
        .when(kind == "BOOLEAN", F.coalesce(F.try_variant_get(value, "$", "boolean"), F.lit(False)))
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.coalesce(number != 0, F.lit(True)))
        .otherwise(F.lit(True))
    )


def true_member(value: Column, name: str) -> Column:
    """A member as text if it is true, else null."""
    member = _member(value, f"$.{name}")
    return F.when(_truthy(member), F.try_variant_get(member, "$", "string"))


def stored_member(value: Column, name: str) -> Column:
    """A nested member as JSON text with all that it holds; null if it is missing or null."""
    member = _member(value, f"$.{name}")
    return F.when(_kind(member) != "VOID", F.to_json(member))


def has_shape(value: Column, fields: Sequence[str] = TOP_FIELDS, fortune: Sequence[str] = FORTUNE_FIELDS) -> Column:
    """Whether a reply has all top fields, an array of symbols (which may be empty) and all fortune fields."""
    symbols = F.coalesce(F.try_variant_get(value, "$.symbols", "array<variant>").isNotNull() & _kind(_member(value, "$.symbols")).startswith("ARRAY"), F.lit(False))
    out = symbols
    for path in (*fields, *(f"fortune.{f}" for f in fortune)):
        out = out & F.coalesce(_truthy(_member(value, f"$.{path}")), F.lit(False))
    return value.isNotNull() & out
