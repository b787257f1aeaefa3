"""Mining hard negatives: rows of another label that are nearly as close as a positive.

Rows are stored in blocks.  A block scores all its rows against a batch of anchors in whole
numbers and sorts each anchor's scores in full, by score and id.  A positive's limits are then found by binary
search: from its upper limit the first rows of another label are read until the lower one.  Only the few best of each
block go on, and the best of all blocks are ranked.

Anchors are a stated set that meets all rows; blocks and batches are tables in the shared folder that are read
where they meet, once for the positives and once for the negatives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import quoted, written
from tidemark.llm.topk import quantised

#: Mean number of rows of a block, and of anchors that meet it at a time.
BLOCK_ROWS = 8192
BATCH_ANCHORS = 128

#: Whole numbers up to this are exact as doubles.
_EXACT = 1 << 53

_BLOCK = "block int, n int, width int, ids binary, labels binary, vectors binary"


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    """One block's rows as arrays, in order of ids; shorter vectors end in zeros."""
    rows = rows.sort_values("vec_id", kind="stable")
    width = max(map(len, rows["q"]), default=0)
    x = np.zeros((len(rows), width), np.int64)
    for k, v in enumerate(rows["q"]):
        x[k, : len(v)] = v
    one = (int(rows["block"].iloc[0]), len(rows), width, rows["vec_id"].to_numpy(np.int64).tobytes(), rows["label"].to_numpy(np.int64).tobytes(), x.tobytes())
    return pd.DataFrame([one], columns=["block", "n", "width", "ids", "labels", "vectors"])


class Block:
    """Rows of a block, ready for anchors."""

    def __init__(self, n: int, width: int, ids: bytes, labels: bytes, vectors: bytes) -> None:
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.x = np.frombuffer(vectors, np.int64).reshape(n, width)
        self.largest = max((abs(int(f(self.x))) for f in (np.min, np.max)), default=0) if self.x.size else 0
        self.floats = self.x.astype(np.float64) if self.largest < _EXACT else None

    def scores(self, query: list[int]) -> np.ndarray:
        """The inner product with every row, exact: as doubles where these hold all sums, else as 64 bits, else as Python's numbers."""
        q = query[: self.x.shape[1]]
        bound = self.largest * sum(map(abs, q))
        x = self.x[:, : len(q)]
        if bound < _EXACT and self.floats is not None:
            return (self.floats[:, : len(q)] @ np.array(q, np.float64)).astype(np.int64)
        if bound < 1 << 63:
            return x @ np.array(q, np.int64)
        return x.astype(object) @ np.array(q, object) if len(q) else np.zeros(len(x), np.int64)

    def sorted_(self, own: int, query: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All rows but those with the anchor's id, the highest score first, then the smaller id: row numbers, and minus their scores."""
        low = -self.scores(query)
        order = np.lexsort((self.ids, low)) if low.dtype != object else np.array(sorted(range(len(low)), key=lambda r: (low[r], self.ids[r])), np.int64)
        order = order[self.ids[order] != own]
        return order, low[order]

    def positives(self, own: int, label: int, query: list[int], k: int) -> Iterator[tuple[int, int]]:
        """(id, score) of the first ``k`` rows of the same label."""
        order, low = self.sorted_(own, query)
        for at in np.flatnonzero(self.labels[order] == label)[:k].tolist():
            yield int(self.ids[order[at]]), -int(low[at])

    def negatives(self, own: int, label: int, query: list[int], limits: list[tuple[int, int]], k: int) -> Iterator[tuple[int, int, int]]:
        """(number of the limits, id, score) of the first ``k`` rows of another label within each (upper, lower)."""
        order, low = self.sorted_(own, query)
        other = np.flatnonzero(self.labels[order] != label)
        low = low[other]
        for number, (upper, lower) in enumerate(limits):
            start = _first_not_below(low, -upper)
            for at in range(start, min(start + k, len(low))):
                if -int(low[at]) < lower:
                    break
                yield number, int(self.ids[order[other[at]]]), -int(low[at])


def _first_not_below(ascending: np.ndarray, value: int) -> int:
    """The first place whose value is not below; by binary search, in whole numbers of any size."""
    lo, hi = 0, len(ascending)
    while lo < hi:
        mid = (lo + hi) // 2
        if int(ascending[mid]) < value:
            lo = mid + 1
        else:
            hi = mid
    return lo


def limits(score: int, low: int, high: int) -> tuple[int, int]:
    """The highest and the lowest whole score n for which low * score <= 100 * n <= high * score."""
    return high * score // 100, -(-low * score // 100)


def mine_negatives(
    rows: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each positive of each anchor.

    Anchors are the rows for which ``anchor`` holds.  A score is the inner product of components times ``scale``,
    cut to whole numbers.  An anchor's positives are the first ``positives`` other rows of its label, the highest score first,
    then the smaller id.  A positive's negatives are the first ``negatives`` rows of other labels
    whose score is ``low`` to ``high`` hundredths of the positive's, both ends included; so a positive with a negative
    score has none, and one that scores 0 has those that score 0.  Anchors without positives, and positives
    without negatives, give no rows; fewer rows than asked for: all of them.  Rows with a null id, label or vector, or a null or
    non-finite component, take no part.  Shorter vectors count as ending in zeros.
    Rows that are repeated with equal id, label and vector count once.  Rows that share an id otherwise are candidates each and
    anchors each, but never of their own id.  A quantised component beyond 2^63 saturates; scores are exact, and one
    to be returned that does not fit 64 bits stops the query.  Other columns are not looked at; an empty table gives no rows.
    """
    fit = rows.select(
        F.col(quoted(id_col)).cast("long").alias("vec_id"),
        F.col(quoted(label_col)).cast("long").alias("label"),
        quantised(F.col(quoted(vector_col)), scale).alias("q"),
        F.coalesce(anchor, F.lit(False)).alias("asked"),
    )
    fit = written(fit.filter("vec_id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL").groupBy("vec_id", "label", "q").agg(F.bool_or("asked").alias("asked")), "labelled")
    blocks = max(1, math.ceil(fit.count() / block_rows))
    # by id and vector, so that rows of one id do not crowd a block
    index = fit.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    index = written(index.groupBy("block").applyInPandas(_block, _BLOCK), "blocks").drop("block")
    anchors = fit.filter("asked").select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "q")
    anchors = written(anchors, "anchors")  # numbers are the same from here on
    groups = max(1, math.ceil(anchors.count() / BATCH_ANCHORS))

    def met(asked: DataFrame, run, schema: str) -> DataFrame:
        batches = asked.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int").alias("group")).agg(F.collect_list(F.struct(*asked.columns)).alias("asked"))
        batches = written(batches.repartition(groups, "group").select("asked"), "anchor-batches")

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.itertuples():
                    block = Block(r.n, r.width, r.ids, r.labels, r.vectors)
                    found = [x for a in r.asked for x in run(block, a)]
                    # raises where a score does not fit
                    yield pd.DataFrame(np.array(found, np.int64).reshape(-1, schema.count(",") + 1), columns=[c.split()[0] for c in schema.split(", ")])

        # every block meets every batch where it is read: neither is shuffled for it
        return index.hint("shuffle_replicate_nl").crossJoin(batches).mapInPandas(score, schema)

    first = met(anchors, lambda block, a: [(a["anchor"], i, s) for i, s in block.positives(a["vec_id"], a["label"], [int(v) for v in a["q"]], positives)], "anchor long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    ranked = first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    held = ranked.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    held = written(anchors.join(held, "anchor"), "positives")

    def harder(block: Block, a) -> Iterator[tuple]:
        own = a["positives"]
        found = block.negatives(a["vec_id"], a["label"], [int(v) for v in a["q"]], [limits(int(p["positive_score"]), low, high) for p in own], negatives)
        for number, i, s in found:
            p = own[number]
            yield a["anchor"], a["vec_id"], p["place"], p["positive_id"], p["positive_score"], i, s

    second = met(held, harder, "anchor long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    nearest = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    return (
        second.withColumn("rank", F.row_number().over(nearest))
        .filter(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
