"""Cards: looking one up by name, and drawing one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import named, without

#: Share of draws that are reversed.
REVERSED_SHARE = 0.35

#: Cards up to which a deck is sent to every task.
BROADCAST_CARDS = 10_000


def with_card(entries: DataFrame, deck: DataFrame, name_col: str = "cardName") -> DataFrame:
    """Entries with the card of their name, or nulls where no card has it; null and empty names match none.

    Of cards that share a name the first by keyword and image counts, so an entry stays one row.
    The deck's size is looked up; a small one is broadcast, a larger one is joined by a shuffle.
    Entries keep their columns, whatever these are called; a column ``card`` is replaced.
    """
    others = without(entries, ("card",))
    held = entries.select(named(name_col).alias("wanted"), F.struct(*[named(c).alias(c) for c in others]).alias("entry"))
    more = [named(c).alias(c) for c in without(deck, ("name", "keyword", "image"))]
    cards = deck.filter(F.col("name") != "").groupBy("name").agg(F.min(F.struct("keyword", "image", *more)).alias("card"))
    small = deck.limit(BROADCAST_CARDS + 1).count() <= BROADCAST_CARDS
    found = held.join(F.broadcast(cards) if small else cards, F.col("wanted") == F.col("name"), "left")
    return found.select(*[F.col("entry").getField(c).alias(c) for c in others], "card")


def meaning(card: Column, reversed_: Column) -> Column:
    return F.when(F.coalesce(reversed_, F.lit(False)), card["reversedMeaning"]).otherwise(card["uprightMeaning"])


def _hash(key: Column) -> Column:
    """32 bits of the key's MD5: the same everywhere, on every run."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def hashed_pick(key: Column, n: int) -> Column:
    """A number from 0 to n - 1 by hash of the key."""
    return _hash(key) % n


def hashed_chance(key: Column, share: float) -> Column:
    """True for about a share of the keys."""
    return _hash(key).cast("double") / F.lit(float(1 << 32)) < share


def random_pick(n: int, seed: int | None = None) -> Column:
    """A number from 0 to n - 1, uniformly."""
    return F.floor(F.rand(seed) * n).cast("int")


def random_chance(share: float = REVERSED_SHARE, seed: int | None = None) -> Column:
    return F.rand(seed) < share


def drawn(draws: DataFrame, numbered: DataFrame, cards: int, key_col: str = "draw_key") -> DataFrame:
    """Draws with a card of the numbered deck (column ``number`` from 0) and an orientation, by hash of their key."""
    key = F.col(key_col)
    picked = draws.withColumn("number", hashed_pick(key, cards)).withColumn("reversed", hashed_chance(F.concat(key.cast("string"), F.lit("/reversed")), REVERSED_SHARE))
    small = cards <= BROADCAST_CARDS
    return picked.join(F.broadcast(numbered) if small else numbered, "number", "left")
