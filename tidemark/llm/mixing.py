"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight that fixes how many words the mix takes from it, and
a schedule that says when in training they come.  The schedule is integrated
to a cumulative demand; the place of a document in its source's stream of
words is put through the inverse of that demand, which gives a training
position between 0 and 1; the result is range-sorted by position.

All of it is DataFrame operations.  Running sums over a source are taken in
two levels (over hash ranges, then within one), so that a source with a third
of all rows is spread over as many tasks as its size asks for.  Rows equal in
all are grouped first, and a range that is crowded, as one id may be that of
very many rows, is split again by the hash of text and id.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import comparable, quoted, without, written

#: What counts as one word.
WORD = r"[^\x20\x09-\x0D]+"

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)

#: Schedules of the sources in the same order, repeating: knots (time, weight)
#: of a piecewise linear curve over [0, 1].
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)),
)

#: Mean number of documents in a hash range of the first level; the square root of all documents, where that is more.
RANGE_DOCS = 500

#: A range with this many times the mean is split again.
CROWDED = 8

#: Copies of a row that are made at once.
COPIES = 1 << 16

_BIG = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2
) -> DataFrame:
    """Targets of (source, source_size) rows: source_rank, weight, target (double), quota (whole words).

    The sources share ``share`` (a fraction) of all words by weight; no target
    is above ``cap`` times its source's size, and what is above goes to the
    others by weight until none is above.  Sorted by size over weight, the
    capped sources are a prefix, so this is one running sum over the table of
    sources, in whole numbers.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    common = math.lcm(*weights)
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    size, weight = F.col("source_size").cast(_BIG), F.col("weight").cast(_BIG)
    ranked = totals.withColumn("source_rank", F.row_number().over(by_source)).withColumn(
        "weight",
        F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")),
    )
    before = F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    filled = (
        ranked.withColumn("ratio", size * (F.lit(common).cast(_BIG) / weight).cast(_BIG))
        .withColumn("left", (F.sum("source_size").over(everything) * share[0] - before * (share[1] * cap)).cast(_BIG))
        .withColumn("per", (F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)) * share[1]).cast(_BIG))
        .withColumn("open", F.col("left") * weight <= size * cap * F.col("per"))
    )
    level = F.min_by(F.struct("left", "per"), F.when(F.col("open"), F.col("ratio"))).over(everything)
    full = F.col("source_size") * cap
    got = F.col("level.left").cast(_BIG) * weight
    per = F.col("level.per").cast(_BIG)
    return filled.withColumn("level", level).select(
        "source",
        "source_size",
        "source_rank",
        "weight",
        F.when(F.col("open"), got.cast("double") / per.cast("double")).otherwise(full.cast("double")).alias("target"),
        F.when(F.col("open"), F.floor(got / per).cast("long")).otherwise(full).cast("long").alias("quota"),
    )


def inverse_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which a schedule has asked for ``share`` (0 to 1) of its whole demand."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or min(w for _, w in knots) <= 0:
        raise ValueError("a schedule goes from 0 to 1 and stays above zero")
    areas = [(t2 - t1) * (w1 + w2) / 2 for (t1, w1), (t2, w2) in zip(knots, knots[1:], strict=False)]
    whole, done, out = sum(areas), 0.0, None
    for (t1, w1), (t2, w2), area in zip(knots, knots[1:], areas, strict=False):
        rest = share * whole - done
        slope = (w2 - w1) / (t2 - t1)
        if slope == 0:
            time = t1 + rest / w1
        else:
            time = t1 + (F.sqrt(F.greatest(rest * (2 * slope) + w1 * w1, F.lit(0.0))) - w1) / slope
        done += area
        # the last piece takes what rounding leaves over
        out = F.when(share * whole < done, time) if out is None else out.when(share * whole < done, time)
    return F.least(out.otherwise(F.lit(1.0)), F.lit(1.0))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: tuple[int, int] = (3, 2),
    cap: int = 2,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
) -> DataFrame:
    """One row per document: the columns of ``docs`` but for the text, then size, source, source_size, target, taken, position, last_position.

    A source's documents stand in the order of the MD5 of their id (of one id, by a hash of text and id) and are
    read round and round; the mix takes the first ``quota`` words of that
    stream.  So ``taken`` is the size times the full rounds, and a part of the
    size for one document of each source at most.  ``position`` is the
    training time of the first word that is taken, ``last_position`` that of the
    document's last round; both are null for a document of which none is taken.
    Rows are range-sorted by position, null last.

    Null or blank text has size 0 and takes part with no words.  A null source
    is a source of its own, the last in order.  A null id hashes like empty
    text.  Repeated rows are documents of their own.  Input columns with the
    name of a computed one are dropped.  An empty table gives no rows.
    """
    own = ("size", "source_size", "source", "target", "taken", "position", "last_position", text_col, source_col)
    keep = without(docs, own)
    sized = docs.select(
        F.struct(*[F.col(quoted(c)) for c in keep]).alias("kept"),
        word_count(F.col(quoted(text_col))).alias("size"),
        F.col(quoted(source_col)).alias("source"),
        F.md5(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).cast("binary")).alias("key"),
        F.xxhash64(F.col(quoted(text_col)), F.col(quoted(id_col))).alias("tie"),
    )
    # rows equal in all are interchangeable, so one stands for them until the end
    same = sized.withColumn("own", comparable(F.col("kept"), sized.schema["kept"].dataType)).groupBy("source", "key", "tie", "own", "size")
    sized = written(same.agg(F.first("kept").alias("kept"), F.count("*").alias("copies")).withColumn("words", F.col("size") * F.col("copies")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("copies").alias("source_docs"))
    rows = totals.agg(F.sum("source_docs")).first()[0] or 0
    mean = max(RANGE_DOCS, math.isqrt(rows))
    ranges = max(1, math.ceil(rows / mean))
    sized = sized.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(1 << 32)))
    crowded = written(sized.groupBy(F.col("source").alias("of"), F.col("range").alias("in")).count().filter(F.col("count") > mean * CROWDED), "mix-crowded")
    if crowded.isEmpty():
        sized = sized.withColumns({"sub": F.lit(""), "bucket": F.lit(0).cast("long")})
    else:
        split = F.col("in").isNotNull()
        sized = sized.join(crowded, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")), "left")
        sized = sized.withColumns({"sub": F.when(split, F.col("key")).otherwise(""), "bucket": F.when(split, F.shiftright("tie", 52)).otherwise(0)})
    cell = ("range", "sub", "bucket")
    earlier = Window.partitionBy("source").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sized.groupBy("source", *cell)
        .agg(F.sum("words").alias("words"))
        .select("source", *cell, F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
        .join(source_targets(totals.select("source", "source_size"), weights, share, cap).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumnsRenamed({c: f"of_{c}" for c in ("source", *cell)})
    )
    within = Window.partitionBy("source", *cell).orderBy("key", "tie", "own", "size").rowsBetween(Window.unboundedPreceding, -1)
    block = F.explode(F.sequence(F.lit(0), F.shiftright(F.col("copies") - 1, COPIES.bit_length() - 1)))
    copy = F.explode(F.sequence(F.col("block") * COPIES, F.least(F.col("copies"), (F.col("block") + 1) * COPIES) - 1))
    placed = (
        sized.withColumn("inner", F.coalesce(F.sum("words").over(within), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("range") == F.col("of_range")) & (F.col("sub") == F.col("of_sub")) & (F.col("bucket") == F.col("of_bucket")))
        .withColumn("block", block)
        .withColumn("copy", copy)
        .withColumn("start", F.col("offset") + F.col("inner") + F.col("copy") * F.col("size"))
        .withColumn("rounds", F.coalesce(F.try_divide(F.col("quota"), F.col("source_size")).cast("long"), F.lit(0)))
        .withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("quota") - F.col("rounds") * F.col("source_size") - F.col("start"))))
        .withColumn("taken", F.col("size") * F.col("rounds") + F.col("part"))
    )

    def position(at: Column) -> Column:
        share_of = at.cast("double") / F.col("quota").cast("double")
        out = None
        for k, knots in enumerate(schedules):
            mine, time = (F.col("source_rank") - 1) % len(schedules) == k, inverse_demand(share_of, knots)
            out = F.when(mine, time) if out is None else out.when(mine, time)
        return F.when(F.col("taken") > 0, out)

    last = F.col("start") + F.col("source_size") * (F.col("rounds") - F.when(F.col("part") > 0, 0).otherwise(1))
    return placed.select(
        *[F.col("kept")[c].alias(c) for c in keep],
        "size",
        "source",
        "source_size",
        "target",
        F.col("taken").cast("long").alias("taken"),
        position(F.col("start")).alias("position"),
        position(last).alias("last_position"),
    ).orderBy(F.col("position").asc_nulls_last(), *([F.col(quoted(id_col))] if id_col in keep else []))
