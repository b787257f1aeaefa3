"""How the sources of a language differ in the words they use.

Each source has a probability of each term of its language, in whole billionths with a little added to every count.
Two sources differ by the sum of absolute differences over all terms; the terms that mark a source are those
that it uses more than its language does.

Counts are taken within the tasks that read, added up by group and term, and terms in few documents are left out.
What is left is cut into blocks of terms: a tile is the dense matrix of a language's sources by the terms of
a block, in 64-bit whole numbers.  A tile gives a partial matrix of all pairs of its sources, by
broadcasting one source's row over all, and each source's heap of its most telling terms.  Partial
matrices are summed, heaps are merged.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import quoted, written

#: What probabilities are multiples of, and what is added to each count.
ONE = 1_000_000_000
ADDED = 5

#: Cells of a tile, about.
TILE_CELLS = 1 << 20

#: Counters of a task are sent on when they hold so many terms.
_HELD_TERMS = 1 << 19

#: Bytes of a text that are taken up at a time.
_PIECE = 1 << 22

_TERM = re.compile(rb"[a-z\x80-\xff]+")

_COUNTS = "lang string, source string, term string, n long, docs long"
_COUNTS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

#: What tiles give: a pair's part of a sum (source, item), or a term with its value; ``kind`` tells which.
_FOUND = "lang string, source string, kind int, item string, value long"
_FOUND_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("kind", pa.int32()), ("item", pa.string()), ("value", pa.int64())])

#: Rows of a tile's answer in a batch.
_SEND = 1 << 16


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time: runs of letters A-Z in lower case and of what is not ASCII."""
    data = text.encode().lower()  # bytes: A-Z only
    at = 0
    while at < len(data):
        end = at + _PIECE
        if end < len(data) and (rest := _TERM.match(data, end)):  # not within a term
            end = rest.end()
        yield _TERM.findall(data, at, end)
        at = end


def _count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def send() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            terms, k = list(own), docs[lang, source]
            for i in range(0, len(terms), _SEND):
                some = terms[i : i + _SEND]
                columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array([t.decode() for t in some]), pa.array([own[t] for t in some], pa.int64()), pa.array([k[t] for t in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS_ARROW)
        counts.clear()
        docs.clear()

    held = 0
    for frame in frames:
        for lang, source, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), frame.column(2), strict=True):
            key, seen = (lang, source), set()
            own = counts[key]
            before = len(own)
            for terms in terms_of(text.as_py()):
                own.update(terms)
                seen.update(terms)
            docs[key].update(seen)
            held += len(own) - before
            if held >= _HELD_TERMS:
                yield from send()
                held = 0
    yield from send()


def probabilities(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(ONE * (count + ADDED) / (total + ADDED * terms)), exact; a row of counts for each total."""
    parts = totals[:, None] + ADDED * terms
    if counts.size and int(counts.max()) + ADDED >= (1 << 63) // ONE:  # products of 64 bits don't hold these
        wide = (counts.astype(object) + ADDED) * ONE // parts.astype(object)
        return (wide + 1).astype(np.int64)
    return 1 + (counts + ADDED) * ONE // parts


class _Tile:
    """Sources by terms of one language and block."""

    def __init__(self, table: pa.Table, most: int) -> None:
        self.most = most
        rows = table.to_pydict()
        heads = [k for k, t in enumerate(rows["term"]) if t is None]
        self.lang = rows["lang"][0]
        # the language's own row stands first
        named = sorted((not rows["whole"][k], rows["source"][k], rows["total"][k]) for k in heads)
        self.sources = [s for _, s, _ in named[1:]]
        totals = np.array([n for _, _, n in named], np.int64)
        place = {s: k + 1 for k, s in enumerate(self.sources)}
        cells = [k for k, t in enumerate(rows["term"]) if t is not None]
        self.terms = sorted({rows["term"][k] for k in cells}, key=str.encode)
        at = {t: k for k, t in enumerate(self.terms)}
        self.counts = np.zeros((len(named), len(self.terms)), np.int64)
        for k in cells:
            self.counts[place[rows["source"][k]], at[rows["term"][k]]] = rows["n"][k]
        self.counts[0] = self.counts[1:].sum(axis=0)
        self.p = probabilities(self.counts, totals, rows["terms"][heads[0]])

    def pairs(self) -> Iterator[tuple[str, str, int]]:
        """(source, later source, part of their difference)."""
        p = self.p[1:]
        for k, source in enumerate(self.sources):
            parts = np.abs(p[k + 1 :] - p[k]).sum(axis=1)
            yield from zip([source] * len(parts), self.sources[k + 1 :], parts.tolist(), strict=True)

    def heaps(self) -> Iterator[tuple[str, str, int]]:
        """(source, term, value) of the terms that a source has more of than its language; the first by value, then term."""
        q = self.p[0]
        for k, source in enumerate(self.sources):
            over = self.p[k + 1] - q
            places = np.flatnonzero((over > 0) & (self.counts[k + 1] > 0)).tolist()
            for t in heapq.nsmallest(self.most, places, key=lambda j: (-over[j], j)):
                yield source, self.terms[t], int(over[t])

    def rows(self) -> Iterator[tuple[str, str, int, str, int]]:
        for kind, found in ((0, self.pairs()), (1, self.heaps())):
            for source, item, value in found:
                yield self.lang, source, kind, item, value


def _tiles(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in _Tile(pa.Table.from_batches(batches), most).rows():
            held.append(row)
            if len(held) >= _SEND:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)

    return run


def audit_sources(docs: DataFrame, least_docs: int = 30, most_terms: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tile_cells: int = TILE_CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and the terms that mark it.

    Terms are runs of ASCII letters, in lower case, and of characters that are not ASCII, which stay as they are.  A language keeps
    the V terms that at least ``least_docs`` of its documents have.  A source's p of a kept term is
    1 + floor(ONE * (count + ADDED) / (N + ADDED * V)), with N the count of all kept terms in it; so has the language as a whole.
    Part ``pair``: item is each other source, value the sum of the differences of p, 0 where no term is kept.
    Part ``term``: item is a kept term that occurs in the source with p above the language's, value the difference; the first ``most_terms``.
    Ranks count from 1, by value, the largest first, then by item in UTF-8.

    Null text, language and source are the empty string; a source counts even without terms.  A source alone in its
    language has no pairs.  Each row is a document, so rows that are repeated count each.  Texts of any length are read whole.
    Other columns are not looked at; an empty table gives no rows.  Counts up to 2^63 are exact.
    """
    plain = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).alias("text"))
    by_source = rows.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a term of a language has a row for each of its sources here, however many documents it is in
    cells = by_source.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term"))).filter(F.col("docs") >= least_docs).drop("docs")
    cells = written(cells, "term-counts")
    return _differences(rows.select("lang", "source"), cells, most_terms, tile_cells)


def _differences(rows: DataFrame, cells: DataFrame, most_terms: int, tile_cells: int) -> DataFrame:
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = cells.groupBy("lang").agg(F.countDistinct("term").alias("terms"))
    groups = rows.distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["total", "terms"])
    groups = written(groups, "sources")

    # as many blocks as keep the largest language's tiles small
    langs = groups.groupBy("lang").agg((F.count("*").cast("double") * F.max("terms")).alias("cells"), F.count("*").alias("groups"))
    largest = langs.agg(F.coalesce(F.max("cells"), F.lit(0.0))).first()[0]
    blocks = max(1, math.ceil(largest / tile_cells))
    whole = groups.groupBy("lang").agg(F.lit(None).cast("string").alias("source"), F.sum("total").alias("total"), F.max("terms").alias("terms"))
    heads = groups.select("*", F.lit(False).alias("whole")).unionByName(whole.withColumn("whole", F.lit(True))).filter("terms > 0")
    heads = heads.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    block: Column = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")
    tiles = cells.withColumn("block", block).unionByName(heads, allowMissingColumns=True)
    tiles = tiles.select("lang", "block", "source", "term", "n", "total", "terms", "whole")
    found = written(tiles.groupBy("lang", "block").applyInArrow(_tiles(most_terms), _FOUND), "differences")

    # each pair once: its sum is given to both, and pairs without kept terms differ by 0
    sums = found.filter("kind = 0").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    bare = groups.filter("terms = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    pairs = ranked(sums.unionByName(turned).unionByName(none), "pair")
    heaps = ranked(found.filter("kind = 1").select("lang", "source", "item", "value"), "term").filter(F.col("rank") <= most_terms)
    return pairs.unionByName(heaps)
