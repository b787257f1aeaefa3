"""Benchmark decontamination by winnowing.

Of every window of ``W`` consecutive ``K``-gram hashes the smallest is kept as
a fingerprint.  Any span that a document and a benchmark item share and that
has ``K + W - 1`` words at least (13, the window of the contamination rule)
holds one whole window of hashes, so both keep the same fingerprint from it:
no such span is missed.  Fingerprints are joined, hits are extended word by
word in both directions, and what is long enough counts.

A benchmark whose measured size fits a task goes to every task.  A larger one is winnowed once and
its fingerprints are joined to the documents' by a shuffle; only documents with hits
move, and around the hits windows are looked up whole.  Neither way makes pairs of places: a fingerprint that many items
share is looked up by the windows around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.store import apart, as_one, quoted, without, written
from tidemark.llm.words import WordHashes, chunks, rolling, runs, sliding

#: Words of a span that counts; an item with fewer counts as a whole.
WINDOW = 13
K = 5
W = WINDOW - K + 1

#: Bytes of benchmark text that a task holds; a larger benchmark is joined by a shuffle.
TASK_BYTES = 16 << 20

#: Items with one fingerprint beyond which the windows around it are looked up instead.
CROWD = 64

_SEPARATORS = bytes(c if not (c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F) else 0x20 for c in range(256))
_TABLE = bytes(_SEPARATORS[ord(chr(c).lower())] if c < 0x80 else c for c in range(256))

_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def benchmark_words(data: bytes) -> list[bytes]:
    """Words of UTF-8 text: A-Z lower-cased; letters, digits and whatever is not ASCII."""
    return data.translate(_TABLE).split()


def winnowed(h: np.ndarray) -> np.ndarray:
    """Places of the fingerprints among k-gram hashes: all that are smallest in a window that holds them."""
    if len(h) < W:
        return np.zeros(0, np.int64)
    least = sliding(h, W)
    padded = np.concatenate((np.zeros(W - 1, np.uint64), least, np.zeros(W - 1, np.uint64)))
    return np.flatnonzero(sliding(padded, W, np.maximum) == h)


class _Index:
    """Fingerprints of benchmark items, and short items by their length."""

    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.hashes = WordHashes()
        self.items: list[tuple[str, list[bytes]]] = []
        self.at: dict[int, list[tuple[int, int]]] = {}
        self.short: dict[int, dict[int, list[int]]] = {}
        for name, text in items:
            words = benchmark_words(text.encode())
            if not words:
                continue
            own = len(self.items)
            self.items.append((name, words))
            h = self.hashes.array(words)
            if len(words) < WINDOW:
                self.short.setdefault(len(words), {}).setdefault(int(rolling(h, len(words))[0]), []).append(own)
            else:
                grams = rolling(h, K)
                for p in winnowed(grams).tolist():
                    self.at.setdefault(int(grams[p]), []).append((own, p))
        self.fingerprints = np.array(sorted(self.at), np.uint64)
        self.crowded: dict[int, dict[bytes, list[int]]] = {}
        for gram, places in self.at.items():
            if len(places) > CROWD:
                windows = self.crowded[gram] = {}
                for item, p in places:
                    own = self.items[item][1]
                    for s in range(max(0, p - W + 1), min(p, len(own) - WINDOW) + 1):
                        held = windows.setdefault(b" ".join(own[s : s + WINDOW]), [])
                        if not held or held[-1] != item:
                            held.append(item)
        self.short_hashes = {n: np.array(sorted(found), np.uint64) for n, found in self.short.items()}

    def scan(self, texts: list[bytes]) -> list[tuple[int, np.ndarray | None, set[str]]]:
        """For each text the number of words, which are hit (None: none), and the items found.

        The texts' words stand in one array.  Grams across a border can only
        add hits, and extension stops at the border.
        """
        words: list[bytes] = []
        ends: list[int] = []
        for text in texts:
            words += benchmark_words(text)
            ends.append(len(words))
        border = np.array([0, *ends])
        found: dict[int, tuple[np.ndarray, set[str]]] = {}
        h = self.hashes.array(words)

        def hit(doc: int, start: int, end: int, name: str) -> None:
            lo = int(border[doc])
            mask, names = found.setdefault(doc, (np.zeros(int(border[doc + 1]) - lo, bool), set()))
            mask[start - lo : end - lo] = True
            names.add(name)

        grams = rolling(h, K)
        places = winnowed(grams)
        done: dict[tuple[int, int, int], int] = {}
        for p in places[_member(grams[places], self.fingerprints)].tolist():
            doc = int(np.searchsorted(border, p, side="right")) - 1
            lo, hi = int(border[doc]), int(border[doc + 1])
            if (windows := self.crowded.get(int(grams[p]))) is not None:
                for s in range(max(lo, p - W + 1), min(p, hi - WINDOW) + 1):
                    for item in windows.get(b" ".join(words[s : s + WINDOW]), ()):
                        hit(doc, s, s + WINDOW, self.items[item][0])
                continue
            for item, q in self.at[int(grams[p])]:
                name, own = self.items[item]
                if done.get((doc, item, p - q), -1) >= p:
                    continue
                s, t = p, q
                while s > lo and t > 0 and words[s - 1] == own[t - 1]:
                    s, t = s - 1, t - 1
                e, t = p, q
                while e < hi and t < len(own) and words[e] == own[t]:
                    e, t = e + 1, t + 1
                done[doc, item, p - q] = max(e, p)
                if e - s >= WINDOW:
                    hit(doc, s, e, name)
        for n, known in self.short_hashes.items():
            grams = rolling(h, n)
            for p in np.flatnonzero(_member(grams, known)).tolist():
                doc = int(np.searchsorted(border, p, side="right")) - 1
                for item in self.short[n][int(grams[p])]:
                    name, own = self.items[item]
                    if p + n <= border[doc + 1] and words[p : p + n] == own:
                        hit(doc, p, p + n, name)
        return [(int(border[k + 1] - border[k]), *found.get(k, (None, set()))) for k in range(len(texts))]


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


_OWN = ("n_words", "hit_spans", "items", "n_hit", "n_items", "contaminated")


_RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(mask: np.ndarray | None) -> list[dict]:
    return [] if mask is None else [{"start": s, "end": e} for s, e in zip(*(x.tolist() for x in runs(mask)), strict=True)]


def _scanned(docs: DataFrame, items: list[tuple[str, str]], with_text: bool) -> DataFrame:
    """A benchmark that fits a task against all documents (kept, text)."""
    schema = T.StructType([*docs.schema.fields[: 1 + with_text], *_RESULT.fields])
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(shared.value)
        for batch in batches:
            found = [x for part in chunks(t.as_py() for t in batch.column(1)) for x in index.scan(part)]
            columns = [pa.array([n for n, _, _ in found], pa.int64()), pa.array([_spans(m) for _, m, _ in found], _SPANS_ARROW), pa.array([sorted(x) for *_, x in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + with_text], *columns], names=schema.names)

    return docs.mapInArrow(scan, schema)


# --- by a shuffle -----------------------------------------------------------------


def _both(words: list[bytes], hashes: WordHashes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every run of ``n`` words, as signed numbers."""
    h = hashes.array(words)
    return rolling(h, n).view(np.int64), rolling(h, n, 100).view(np.int64)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, gram, one, two, name) of each window of an item: its fingerprints' hashes as grams, and each window's own."""
    hashes = WordHashes()
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = benchmark_words(text.encode())
            if not words:
                continue
            n = min(len(words), WINDOW)
            one, two = _both(words, hashes, n)
            grams = one if n < WINDOW else (g := rolling(hashes.array(words), K))[winnowed(g)].view(np.int64)
            many = len(one) + len(grams)
            empty = np.zeros(len(grams), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(many, n, np.int32)), pa.array([True] * len(grams) + [False] * len(one)), pa.array(np.concatenate((grams, one))), pa.array(np.concatenate((empty, two))), pa.array([name] * many, pa.string())],
                names=["n", "is_gram", "one", "two", "name"],
            )


def _probing(lengths: list[int]):
    """(of, n, one, place) of each document's fingerprints, and of its runs of as many words as short items have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for of, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = benchmark_words(text.encode())
                h = hashes.array(words)
                for n in (*lengths, WINDOW):
                    grams = rolling(h, K if n == WINDOW else n)
                    at = winnowed(grams) if n == WINDOW else np.arange(len(grams))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([of] * len(at), pa.binary()), pa.array(np.full(len(at), n, np.int32)), pa.array(grams[at].view(np.int64)), pa.array(at.astype(np.int32))], names=["of", "n", "one", "place"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(of, n, one, two, place) of the windows around a document's hits."""
    hashes = WordHashes()
    for batch in batches:
        for of, hits, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            words = benchmark_words(text.encode())
            for n in {h["n"] for h in hits}:
                one, two = _both(words, hashes, n)
                back = W if n == WINDOW else 1
                mask = np.zeros(len(one) + back, bool)
                for h in hits:
                    if h["n"] == n:
                        mask[max(0, h["place"] - back + 1) : h["place"] + 1] = True
                at = np.flatnonzero(mask[: len(one)])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([of] * len(at), pa.binary()), pa.array(np.full(len(at), n, np.int32)), pa.array(one[at]), pa.array(two[at]), pa.array(at.astype(np.int32))], names=["of", "n", "one", "two", "place"])


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A benchmark of any size against documents (kept, text), known by the MD5 of the text; copies get one answer."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("kept", "text", F.unhex(F.md5(text.cast("binary"))).alias("of"))
    given = written(items.select("name", "words").mapInArrow(_item_rows, "n int, is_gram boolean, one long, two long, name string"), "benchmark")
    grams = given.filter("is_gram").select("n", "one").distinct()
    lengths = [r["n"] for r in given.filter(F.col("n") < WINDOW).select("n").distinct().collect()]  # twelve at most
    # windows by the set of their items, told by sums that need no list
    window = ["n", "one", "two"]
    mark = F.struct(F.count_distinct("name").alias("c"), F.bit_xor(F.xxhash64("name")).alias("x"), F.bit_xor(F.xxhash64("name", F.lit(1))).alias("y"))
    sets = written(given.filter("NOT is_gram").select(*window, "name").distinct().groupBy(*window).agg(mark.alias("items")), "windows")
    asked = docs.select("of", text.alias("text")).mapInArrow(_probing(lengths), "of binary, n int, one long, place int")
    hits = asked.join(grams, ["n", "one"], "left_semi").groupBy("of").agg(F.collect_set(F.struct("n", "place")).alias("hits"))
    near = docs.select("of", text.alias("text")).join(hits, "of").select("of", "hits", "text").mapInArrow(_windows, "of binary, n int, one long, two long, place int")
    found = written(near.distinct().join(sets, window), "found")
    heads = found.groupBy("items").agg(F.min(F.struct(*window)).alias("w")).select("items", "w.*")
    named = written(given.filter("NOT is_gram").select(*window, "name").distinct().join(heads, window).select("items", "name"), "named")
    names = found.select("of", "items").distinct().join(named, "items").groupBy("of").agg(F.sort_array(F.collect_set("name")).alias("items"))
    places = found.groupBy("of").agg(F.collect_set(F.struct("place", "n")).alias("places"))
    marked = places.join(names, "of").withColumnRenamed("of", "found_in")
    rows = docs.join(marked, F.col("of") == F.col("found_in"), "left").select("kept", "text", "places", "items")
    schema = T.StructType([*rows.schema.fields[:2], *_RESULT.fields])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, out = [], []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = len(benchmark_words((text or "").encode()))
                mask = np.zeros(n, bool) if places else None
                for p in places or ():
                    mask[p["place"] : p["place"] + p["n"]] = True
                counts.append(n)
                out.append(_spans(mask))
            names = pa.array([x or [] for x in batch.column(3).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts, pa.int64()), pa.array(out, _SPANS_ARROW), names], names=schema.names)

    return rows.mapInArrow(spans, schema)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    task_bytes: int = TASK_BYTES,
    keep_text: bool = False,
) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_spans, n_items, items and contaminated; without the text unless ``keep_text``.

    A document word is hit if it lies in an occurrence of ``WINDOW``
    consecutive words of an item, or of a whole item that has fewer words.
    ``hit_spans`` are the stretches of hit words (end exclusive), ``items`` the
    ids, as sorted strings, of the items with an occurrence.  ``contaminated``
    holds if a twentieth of the words or more are hit.

    The benchmark's size is looked up first.  What fits in ``task_bytes`` goes to
    every task, and words are compared; a larger one is joined by a shuffle, and windows are told by 128 bits of hash.

    Null or blank text has no words and is not contaminated; null or blank items
    have no windows; items with a null id are left out, items with the same id are one
    item.  Repeated documents get equal answers.  Input columns with the name
    of a computed one are dropped.  Empty tables: no rows, or nothing is hit.
    """
    items = benchmark.select(F.col(quoted(item_col)).cast("string").alias("name"), F.col(quoted(item_text_col)).alias("words")).filter("name IS NOT NULL AND words IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("words") + F.octet_length("name") + 64)).first()[0] or 0
    keep = without(docs, (*_OWN, text_col))
    rows = docs.select(as_one(keep), F.col(quoted(text_col)).alias("text"))
    rows = _scanned(rows, [tuple(r) for r in items.collect()], keep_text) if size <= task_bytes else _joined(rows, items)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    text = [F.col("text").alias(text_col)] if keep_text else []
    return (
        rows.select(*apart(keep), *text, "n_words", "hit_spans", "items", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
    )
