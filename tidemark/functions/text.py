"""Text with the rules of a browser: trimming, lengths, joining, extraction, truth."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that the web platform trims.
WHITE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

# What static files' paths begin with.
STATIC = ("_next/static", "_next/image", "favicon.ico")

#: Longest text that is let in, in UTF-16 units.
MAX_UNITS = 1000


def web_trim(text: Column) -> Column:
    """Without the white space of the web platform at both ends; Spark's own trim takes U+0020 only."""
    return F.regexp_replace(text, rf"^[{WHITE}]+|[{WHITE}]+\z", "")


def utf16_length(text: Column) -> Column:
    """Number of UTF-16 units: characters beyond the basic plane count twice."""
    return (F.length(text) + F.length(F.regexp_replace(text, r"[\x{0}-\x{FFFF}]", ""))).cast("int")


def cut_units(text: Column, units: int = MAX_UNITS) -> Column:
    """A prefix of ``units`` characters.  A pair that would be split by UTF-16 units stays whole."""
    return F.substring(text, 1, units)


def join_or(items: Column, none: str, separator: str = ", ") -> Column:
    """Items joined, or a marker where there are none."""
    return F.when(F.size(items) > 0, F.array_join(items, separator)).otherwise(F.lit(none))


def outer_braces(text: Column) -> Column:
    """From the first opening brace to the last closing one; null if there is no such stretch."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def is_true(text: Column) -> Column:
    """Truth of a string: neither null nor empty."""
    return F.coalesce(text, F.lit("")) != ""


def or_default(value: Column, default: str) -> Column:
    """The value unless it is null; an empty string stays."""
    return F.coalesce(value, F.lit(default))


def entry_link(key: Column) -> Column:
    """Address of an entry's page."""
    return F.concat(F.lit("/history/"), key.cast("string"))


def is_page(path: Column) -> Column:
    """Whether a path is a page: not under the folders of static files, and not the icon."""
    return path.startswith("/") & ~path.rlike("^/(?:" + "|".join(map(re.escape, STATIC)) + ")")


def ensured_identity(cookie: Column) -> Column:
    """The identity in a cookie; a fresh random one where it is absent or empty."""
    return F.coalesce(F.when(cookie != "", cookie), F.uuid())


def prompt(template: str, **values: Column) -> Column:
    """A template with ``{name}`` places filled; null values print as nothing."""
    parts: list[Column] = []
    rest = template
    while rest:
        before, brace, after = rest.partition("{")
        parts.append(F.lit(before))
        if not brace:
            break
        name, _, rest = after.partition("}")
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)
