"""Exact top-k by inner product with a bit-sliced index.

Vectors are quantised to whole numbers and stored by bit: a slice is a bitmap
over the rows of a block that holds one bit of one component.  The inner product of
a query with all rows of a block is a sum of slices, shifted by the bits of the
query; it is added up with bitmap arithmetic (carry-save adders) and is bit-sliced
again.  The top rows are selected from its most significant slice downward;
rows that tie at the boundary are resolved exactly, by the smaller id.

Blocks of rows meet batches of queries, a stated set, and only each block's top rows go on. Both are
tables in the shared folder that are read where they meet, so what is shuffled is
the rows once, the queries once, and the best rows of each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import quoted, written

#: Mean number of rows of a block, and of queries that meet it at a time.
BLOCK_ROWS = 32768
BLOCK_QUERIES = 128

#: Quantised components saturate here: the largest double that fits 64 bits.
LARGEST = (1 << 63) - 1024

_INDEX = "block int, n int, ids binary, floor binary, bits binary, slices binary"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as double; null if the vector is null or holds null, NaN or an infinity."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    limit = float(LARGEST)
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(limit)), F.lit(-limit))).cast("long"))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), whole)


def _matrix(vectors: list) -> np.ndarray:
    """Rows as one array; shorter vectors end in zeros."""
    wide = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), wide), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def build_block(rows: pd.DataFrame) -> pd.DataFrame:
    """The slices of one block.  Components stand above the least of their column, so that slices hold no signs."""
    rows = rows.sort_values("vec_id", kind="stable")
    x = _matrix(rows["q"].tolist())
    n = len(x)
    floor = x.min(axis=0) if x.size else np.zeros(x.shape[1], np.int64)
    x = x.astype(np.uint64) - floor.astype(np.uint64)  # a difference may take all 64 bits
    bits = np.array([int(m).bit_length() for m in (x.max(axis=0) if x.size else [])], np.int64)
    words = -(-n // 64)
    slices = np.zeros((int(bits.sum()), words * 8), np.uint8)
    at = 0
    for d, b in enumerate(bits.tolist()):
        for k in range(b):
            packed = np.packbits((x[:, d] >> k) & 1, bitorder="little")
            slices[at, : len(packed)] = packed
            at += 1
    one = (int(rows["block"].iloc[0]), n, rows["vec_id"].to_numpy(np.int64).tobytes(), floor.tobytes(), bits.tobytes(), slices.tobytes())
    return pd.DataFrame([one], columns=["block", "n", "ids", "floor", "bits", "slices"])


class _Block:
    """A block's index, ready for queries."""

    def __init__(self, n: int, ids: bytes, floor: bytes, bits: bytes, slices: bytes) -> None:
        self.n, self.ids = n, np.frombuffer(ids, np.int64)
        self.floor, self.bits = np.frombuffer(floor, np.int64).tolist(), np.frombuffer(bits, np.int64).tolist()
        self.first = np.concatenate(([0], np.cumsum(self.bits))).astype(int).tolist()
        plain = np.frombuffer(slices, np.uint64).reshape(self.first[-1], -(-n // 64))
        self.slices = np.concatenate((plain, ~plain))  # complements stand behind
        valid = np.zeros(plain.shape[1] * 8, np.uint8)
        packed = np.packbits(np.ones(n, np.uint8), bitorder="little")
        valid[: len(packed)] = packed
        self.valid = valid.view(np.uint64)

    def scores(self, query: list[int]) -> tuple[list[np.ndarray], int]:
        """The slices of all rows' scores from the least, and what is to be added to each score.

        A negative weight takes complements: -w * x is w * (m - x) - w * m with all bits set in m.
        """
        base, columns = 0, {}
        count = self.first[-1]
        for d, w in enumerate(query[: len(self.bits)]):
            base += w * self.floor[d]
            at, bits = self.first[d], self.bits[d]
            if w < 0:
                base += w * ((1 << bits) - 1)
                at, w = at + count, -w
            shift = 0
            while w:
                if w & 1:
                    for b in range(bits):
                        columns.setdefault(shift + b, []).append(at + b)
                w >>= 1
                shift += 1
        out, carried, weight = [], self.slices[:0], 0
        while weight <= max(columns, default=-1) or len(carried):
            held = self.slices[columns.get(weight, [])]
            if len(carried):
                held = np.concatenate((held, carried))
            carries = []
            while len(held) >= 3:
                m = len(held) // 3
                a, b, c = held[:m], held[m : 2 * m], held[2 * m : 3 * m]
                half = a ^ b
                carries.append((a & b) | (half & c))
                half ^= c
                held = np.concatenate((half, held[3 * m :])) if len(held) > 3 * m else half
            if len(held) == 2:
                carries.append((held[0] & held[1])[None])
                held = (held[0] ^ held[1])[None]
            out.append(held[0] if len(held) else np.zeros_like(self.valid))
            carried = np.concatenate(carries) if carries else self.slices[:0]
            weight += 1
        return out, base

    def top(self, own: int, query: list[int], k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows but for those with the query's id."""
        slices, base = self.scores(query)
        open_ = self.valid.copy()
        for row in range(int(np.searchsorted(self.ids, own)), int(np.searchsorted(self.ids, own, "right"))):
            open_[row >> 6] &= ~np.uint64(1 << (row & 63))
        sure = np.zeros_like(open_)
        for s in reversed(slices):
            above = open_ & s
            together = sure | above
            n = int(np.bitwise_count(together).sum())
            if n > k:
                open_ = above
                continue
            sure = together
            if n == k:
                open_ = np.zeros_like(open_)
                break
            open_ &= ~s
        rows = _set_rows(sure)
        rows += _set_rows(open_, k - len(rows))
        score = lambda r: base + sum(((int(s[r >> 6]) >> (r & 63)) & 1) << w for w, s in enumerate(slices))
        return [(int(self.ids[r]), score(r)) for r in rows]


def _set_rows(bitmap: np.ndarray, most: int | None = None) -> list[int]:
    """Rows of a bitmap in order, ``most`` at most."""
    out: list[int] = []
    for word in np.flatnonzero(bitmap).tolist():
        value = int(bitmap[word])
        while value:
            if most is not None and len(out) >= most:
                return out
            low = value & -value
            out.append(64 * word + low.bit_length() - 1)
            value ^= low
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows of ``vectors`` with the largest integer inner products.

    Ties go to the smaller id.  A row with the query's id is not its candidate.  Fewer
    candidates than ``k``: all of them.  Vectors that are null or hold null
    or non-finite components, and rows with a null id, take no part; the empty
    vector scores 0.  Shorter vectors count as ending in zeros.  Quantised
    components beyond ``LARGEST``, of about 2^63, saturate; a score among a block's best that does not fit 64 bits
    stops the query, as it does in SQL.  A row that is repeated with equal
    id and vector counts once.  Rows of one id and different vectors are candidates each; as queries they
    have one ranking, of the scores of them all.  Other columns are not looked at.  Empty tables give
    no rows.
    """
    fit = lambda df: df.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), quantised(F.col(quoted(vector_col)), scale).alias("q")).filter("vec_id IS NOT NULL AND q IS NOT NULL").distinct()
    rows, asked = written(fit(vectors), "vectors"), written(fit(queries), "queries")
    blocks = max(1, math.ceil(rows.count() / BLOCK_ROWS))
    groups = max(1, math.ceil(asked.count() / BLOCK_QUERIES))
    index = written(rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).repartition(blocks, "block").groupBy("block").applyInPandas(build_block, _INDEX), "slices")
    batches = asked.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("group")).agg(F.collect_list(F.struct("vec_id", "q")).alias("asked"))
    batches = written(batches.repartition(groups, "group").select("asked"), "queries")
    # every block meets every batch where it is read: neither is shuffled for it
    met = index.hint("shuffle_replicate_nl").crossJoin(batches)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                block = _Block(r.n, r.ids, r.floor, r.bits, r.slices)
                found = [(q["vec_id"], i, s) for q in r.asked for i, s in block.top(q["vec_id"], [int(v) for v in q["q"]], k)]
                # raises where a score does not fit
                yield pd.DataFrame(np.array(found, np.int64).reshape(-1, 3), columns=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        met.select("n", "ids", "floor", "bits", "slices", "asked")
        .mapInPandas(score, "query_id long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
