"""The history of entries: most recent first, capped, then split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import is_true, or_default
from tidemark.sources.schemas import DREAM, TAROT

#: Rows of a history.
CAP = 100


def recent_of_user(entries: DataFrame, user: object, cap: int = CAP) -> DataFrame:
    """One user's most recent entries; equal times go by id, later first.  A null user has none."""
    mine = entries.filter(F.col("userId") == F.lit(user))
    return mine.orderBy(F.desc("createdAt"), F.desc("id")).limit(cap)


def recent_by_user(entries: DataFrame, cap: int = CAP) -> DataFrame:
    """Every user's most recent entries with their rank.  Spark keeps ``cap`` rows a user and task before it shuffles."""
    order = Window.partitionBy("userId").orderBy(F.desc("createdAt"), F.desc("id"))
    return entries.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def split_by_kind(capped: DataFrame, *kinds: str) -> tuple[DataFrame, ...]:
    """Entries of each kind among those that were kept: the cap comes first."""
    return tuple(capped.filter(F.col("type") == k) for k in (kinds or (DREAM, TAROT)))


def counts(capped: DataFrame, *kinds: str) -> DataFrame:
    """Per user the number of entries kept, of each kind, not of the whole table."""
    return capped.groupBy("userId").agg(F.count("*").alias("total"), *[F.count_if(F.col("type") == k).alias(f"n_{k.lower()}") for k in (kinds or (DREAM, TAROT))])


def entry_of_user(entries: DataFrame, key: object, user: object) -> DataFrame:
    """The entry with an id if it is the user's, else nothing."""
    return entries.filter((F.col("id") == F.lit(key)) & (F.col("userId") == F.lit(user))).limit(1)


def latest_in_day(entries: DataFrame, kind: str, start: Column, end: Column) -> DataFrame:
    """Each user's latest entry of a kind in a half-open time range."""
    some = entries.filter((F.col("type") == kind) & (F.col("createdAt") >= start) & (F.col("createdAt") < end))
    row = F.struct(*[F.col(c) for c in entries.columns])
    return some.groupBy("userId").agg(F.max_by(row, F.struct("createdAt", "id")).alias("e")).select("e.*")


def orientation(reversed_: Column, upright: str, turned: str) -> Column:
    """A label; null counts as upright."""
    return F.when(F.coalesce(reversed_, F.lit(False)), turned).otherwise(upright)


def headline(kind: Column, title: Column, card: Column, reversed_: Column, suffix: str = " (reversed)") -> Column:
    """The title of a dream; the card's name of a draw, marked if it is reversed.  Null parts are empty."""
    drawn = F.concat(or_default(card, ""), F.when(F.coalesce(reversed_, F.lit(False)), suffix).otherwise(""))
    return F.when(kind == DREAM, title).otherwise(drawn)


def subtitle(kind: Column, mood: Column, advice: Column) -> Column:
    return F.when(kind == DREAM, mood).otherwise(advice)


def keyword_line(keyword: Column, reversed_: Column, upright: str = "upright", turned: str = "reversed", separator: str = " · ") -> Column:
    """Keyword and orientation; without a keyword no separator."""
    return F.concat_ws(separator, F.when(is_true(keyword), keyword), orientation(reversed_, upright, turned))


def with_defaults(entries: DataFrame, title: str = "untitled") -> DataFrame:
    """Entries with null fields filled, each by its own default; empty strings stay."""
    filled = {"title": title, **dict.fromkeys(("traditional", "psychological", "mood", "advice"), "")}
    out = {c: or_default(F.col(c), d) for c, d in filled.items() if c in entries.columns}
    kinds = dict(entries.dtypes)
    if "symbols" in kinds:
        out["symbols"] = F.coalesce("symbols", F.array().cast(kinds["symbols"]))
    if "fortune" in kinds:
        none = F.lit(None).cast(kinds["fortune"])
        out["fortune"] = F.coalesce("fortune", F.struct(*[none[f].alias(f) for f in entries.schema["fortune"].dataType.names]))
    return entries.withColumns(out)


def symbol_rows(entries: DataFrame) -> DataFrame:
    """A row for each symbol, numbered from 0; none for null or empty lists."""
    return entries.select("id", F.posexplode("symbols").alias("position", "symbol")).select("id", "position", "symbol.*")
