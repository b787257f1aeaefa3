"""Removing repeated passages of words, with fixed-block anchors.

Every document is cut into blocks of ``BLOCK`` words that don't overlap; these
are the index.  Every rolling window of ``BLOCK`` words of every document
probes it.  A passage of ``WINDOW`` words is at least twice a block less one word long,
so wherever it occurs it holds a whole block: no repeat is missed.  Hits are extended by comparing all
windows of ``WINDOW`` words that hold one, whole, by 128-bit hashes: windows that have started earlier and overlap make up
the maximal exact repeats.  Extending pairs of places word by word gives the same, but a passage in a thousand documents has a million pairs.

Texts move twice, to be joined with the places of hits and with what is to be removed; keys move
packed (see ``packed``), once a chunk however often they occur in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import packed
from tidemark.llm.store import partitions, written
from tidemark.llm.words import CACHE_WORDS, WordHashes, chunks, rolling

WINDOW = 20
BLOCK = 10

#: Words of the documents of a chunk, about, unless there are very many parts (see ``packed.sizes``).
CHUNK_WORDS = 2 << 20


def _read(frames: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    """Rows whose last column is the text, as bytes."""
    for frame in frames:
        others = [frame.column(k) for k in range(columns)]
        for k, text in enumerate(t for part in chunks(t.as_py() for t in frame.column(columns)) for t in part):
            yield (*(c[k].as_py() for c in others), text)


# --- hits of anchors --------------------------------------------------------------


def _probes(h: np.ndarray, docs: packed.Docs, chunk: int, parts: int) -> Iterator[tuple]:
    """Messages of a chunk: for each part the distinct windows (31 bits of hash, and whether one is a block) and where each is first."""
    keys = rolling(h, BLOCK)
    at = np.arange(len(keys))
    doc = np.searchsorted(docs.border, at, side="right") - 1
    at = at[at + BLOCK <= docs.border[doc + 1]]
    keys = keys[at]
    block = (at - docs.border[doc[at]]) % BLOCK == 0
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.flatnonzero(np.diff(ranked, prepend=ranked[:1] + np.uint64(1)))
    count = np.diff(new, append=len(ranked))
    anchored = np.logical_or.reduceat(block[order], new) if len(new) else block[:0]
    group = np.repeat(np.arange(len(new)), count)
    first = order[new]
    # what repeats within the chunk: hit at once if one of it is a block, else if its first place is hit
    repeated = count[group] > 1
    hit = at[order[repeated & anchored[group]]]
    others = repeated & ~anchored[group]
    others[new] = False
    pairs = np.stack((at[first[group[others]]], at[order[others]]))
    yield packed.message(chunk, packed.LOCAL, *docs.packed(), np.int64([len(hit)]).tobytes() + hit.tobytes() + pairs.tobytes())
    by_place = np.argsort(first, kind="stable")
    first, anchored = first[by_place], anchored[by_place]
    keys = keys[first]
    short = (keys >> np.uint64(33)).astype(np.uint32) * np.uint32(2) + anchored
    part = (keys % np.uint64(parts)).astype(np.int64)
    for p, members in packed.by_part(part, parts):
        yield packed.message(chunk, p, short[members].tobytes(), packed.planes(at[first[members]]))


def _probe_chunks(parts: int, chunk_words: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages() -> Iterator[tuple]:
            numbers, cache = packed.chunk_numbers(), WordHashes()
            ids, hashes, held, size = [], [], [], 0

            def flush() -> Iterator[tuple]:
                docs = packed.Docs(np.array(ids, np.int64), list(hashes), np.cumsum([0, *map(len, held)]))
                yield from _probes(np.concatenate(held), docs, next(numbers), parts)

            for id_, hash_, text in _read(frames, 2):
                own = cache.array(text.split())
                if len(own) < WINDOW:
                    continue
                ids.append(id_)
                hashes.append(hash_)
                held.append(own)
                size += len(own)
                if size >= chunk_words:
                    yield from flush()
                    ids, hashes, held, size = [], [], [], 0
            if held:
                yield from flush()

        yield from packed.batches(messages(), packed.MESSAGE_ARROW)

    return run


def _match(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins blocks and windows of a partition's parts: a key that is a block somewhere and occurs twice is hit everywhere."""

    def answers() -> Iterator[tuple]:
        for part, rows in packed.by_turns(frames):
            if part == packed.LOCAL:
                yield rows[0][1:]
                continue
            rows = [(chunk, a, b) for _, chunk, _, a, b, _, _ in rows]
            keys = np.concatenate([np.frombuffer(a, np.uint32) for _, a, _ in rows])
            sizes = [len(a) // 4 for _, a, _ in rows]
            order = np.argsort(keys >> np.uint32(1), kind="stable")
            ranked = keys[order] >> np.uint32(1)
            new = np.flatnonzero(np.diff(ranked.astype(np.int64), prepend=-1))
            count = np.diff(new, append=len(ranked))
            anchored = np.bitwise_or.reduceat(keys[order] & np.uint32(1), new)
            hit = np.zeros(len(keys), bool)
            hit[order] = np.repeat((count > 1) & (anchored == 1), count)
            at = 0
            for (chunk, _, b), n in zip(rows, sizes, strict=True):
                own = hit[at : at + n]
                at += n
                if own.any():
                    yield chunk, 0, packed.from_planes(b)[own].astype(np.uint32).tobytes(), b"", b"", b""

    yield from packed.batches(answers(), packed.ANSWER_ARROW)


def _candidates(local: tuple, answers: list[tuple]) -> tuple[packed.Docs, np.ndarray]:
    """Starts of windows that hold a hit."""
    docs = packed.Docs.unpacked(*local[2:5])
    n = int(docs.border[-1])
    numbers = np.frombuffer(local[5], np.int64)
    first, other = numbers[1 + numbers[0] :].reshape(2, -1)
    hit = np.zeros(n + 1, bool)
    hit[numbers[1 : 1 + numbers[0]]] = True
    for row in answers:
        hit[np.frombuffer(row[2], np.uint32)] = True
    hit[other] |= hit[first]
    before = np.concatenate(([0], np.cumsum(hit)))
    mask = np.zeros(n, bool)
    if n >= WINDOW:
        starts = np.arange(n - WINDOW + 1)
        some = before[starts + WINDOW - BLOCK + 1] > before[starts]
        mask[: len(starts)] = some & (starts + WINDOW <= docs.border[np.searchsorted(docs.border, starts, side="right")])
    return docs, mask


# --- windows that started earlier -------------------------------------------------


class _Digests(dict):
    """128-bit hashes of words, remembered within bounds."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_128_digest(word)
        return h

    def columns(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()


def _window_chunks(parts: int, chunk_words: int):
    """Messages of a chunk of candidate windows: both halves of a 128-bit hash; where each is first."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages() -> Iterator[tuple]:
            numbers, cache = packed.chunk_numbers(), _Digests()
            ids, hashes, border, held, size = [], [], [0], [], 0
            before = None

            def flush() -> Iterator[tuple]:
                chunk, docs = next(numbers), packed.Docs(np.array(ids, np.int64), list(hashes), np.array(border))
                keys, more, at = (np.concatenate(x) for x in zip(*held, strict=True))
                order, same = packed.alike(keys, more, at)
                fresh = np.ones(len(keys), bool)
                fresh[order] = ~same
                yield packed.message(chunk, packed.LOCAL, *docs.packed(), at[~fresh].tobytes())
                keys, more, at = keys[fresh], more[fresh], at[fresh]
                part = (more % np.uint64(parts)).astype(np.int64)
                tie = np.array([int.from_bytes(h[:4], "big") for h in docs.hashes], np.uint32)
                for p, members in packed.by_part(part, parts):
                    place = at[members]
                    doc, count = np.unique(np.searchsorted(docs.border, place, side="right") - 1, return_counts=True)
                    order = docs.ids[doc].tobytes() + tie[doc].tobytes() + count.astype(np.uint32).tobytes()
                    yield packed.message(chunk, p, keys[members].tobytes() + more[members].tobytes(), packed.planes(place), order)

            for id_, hash_, starts, ends, text in _read(frames, 4):  # equal rows stand together
                if (id_, hash_) == before:
                    continue
                before = id_, hash_
                words = text.split()
                one, two = cache.columns(words)
                places = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends, strict=True)])
                held.append((rolling(one, WINDOW)[places], rolling(two, WINDOW, 100)[places], places + border[-1]))
                ids.append(id_)
                hashes.append(hash_)
                border.append(border[-1] + len(words))
                size += len(places) + len(words) // 4
                if size >= chunk_words // 2:
                    yield from flush()
                    ids, hashes, border, held, size = [], [], [0], [], 0
            if held:
                yield from flush()

        yield from packed.batches(messages(), packed.MESSAGE_ARROW)

    return run


def _later(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal windows of a partition's parts, all but the first: by id, hash of the text, place."""

    def answers() -> Iterator[tuple]:
        for part, rows in packed.by_turns(frames):
            if part == packed.LOCAL:
                yield rows[0][1:]
                continue
            rows = [(chunk, a, b, c) for _, chunk, _, a, b, c, _ in rows]
            keys, more = (np.concatenate(x) for x in zip(*(np.frombuffer(a, np.uint64).reshape(2, -1) for _, a, _, _ in rows), strict=True))
            places = [packed.from_planes(b) for _, _, b, _ in rows]
            ids, ties = [], []
            for *_, c in rows:
                n = len(c) // 16
                count = np.frombuffer(c, np.uint32, n, 12 * n)
                ids.append(np.repeat(np.frombuffer(c, np.int64, n), count))
                ties.append(np.repeat(np.frombuffer(c, np.uint32, n, 8 * n), count))
            order, same = packed.alike(keys, more, np.concatenate(ids), np.concatenate(ties), np.concatenate(places))
            late = np.zeros(len(keys), bool)
            late[order] = same
            at = 0
            for (chunk, *_), own in zip(rows, places, strict=True):
                mine = own[late[at : at + len(own)]]
                at += len(own)
                if len(mine):
                    yield chunk, 0, mine.astype(np.uint32).tobytes(), b"", b"", b""

    yield from packed.batches(answers(), packed.ANSWER_ARROW)


def _covered(local: tuple, answers: list[tuple]) -> tuple[packed.Docs, np.ndarray]:
    """Words under windows that started earlier."""
    docs = packed.Docs.unpacked(*local[2:5])
    n = int(docs.border[-1])
    change = np.zeros(n + WINDOW + 1, np.int64)
    for at in (np.frombuffer(local[5], np.int64), *(np.frombuffer(row[2], np.uint32).astype(np.int64) for row in answers)):
        np.add.at(change, at, 1)
        np.add.at(change, at + WINDOW, -1)
    return docs, np.cumsum(change)[:n] > 0


# --- the operator -----------------------------------------------------------------


_CUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for id_, starts, ends, copy, text in _read(frames, 4):
            words = text.split()
            n = len(words)
            kept, at = [], 0
            if copy and n >= WINDOW:
                at = n
            else:
                for s, e in zip(starts or (), ends or (), strict=True):
                    kept += words[at:s]
                    at = e
            kept += words[at:]
            yield id_, n, n - len(kept), b" ".join(kept).decode()

    yield from packed.batches(rows(), _CUT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = packed.PART_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept): each document without the words that a window that started earlier covers.

    A window is ``WINDOW`` consecutive words of one document; it starts earlier in
    a document with a smaller id, or before in the same document.  Windows are
    judged on the input.  ``kept`` are the words left, joined by one space.

    Null and blank texts have no words; documents with fewer words than a window keep
    all.  A null id counts as the largest there is, 2^63 - 1, and stays null in the
    result.  Documents with the same id and different texts stand in the order of
    the texts' MD5; rows equal in id and text are one document and get equal
    answers.  A copy of a document with a smaller id has nothing new, so all its
    words go.  Equality of windows is that of hashes of 128 bits.  Other columns are not
    looked at.  An empty table gives no rows.
    """
    spread = partitions(docs.sparkSession)
    rows = packed.keyed(docs, id_col, text_col)
    known = written(rows.select("id", "hash", F.octet_length("text").alias("bytes")).distinct(), "known")
    parts, grown = packed.sizes(known.agg(F.sum("bytes")).first()[0] or 0, spread, CHUNK_WORDS, part_bytes)
    chunk_words = int(CHUNK_WORDS * grown)
    heads = known.groupBy(F.col("hash").alias("of")).agg(F.min("id").alias("head"), F.count("*").alias("n"))
    heads = written(heads.filter("n > 1"), "heads")  # apart from the grouping, so that the join can split a hash with many copies
    copies = written(known.join(heads, F.col("hash") == F.col("of")).filter("id <> head").select("id", "hash"), "copies")

    probes = packed.dealt(rows.mapInArrow(_probe_chunks(parts, chunk_words), packed.MESSAGE), spread)
    hits = packed.gathered(probes.mapInArrow(_match, packed.ANSWER), _candidates)
    hits = written(hits, "hits").dropDuplicates(["id", "hash"]).join(copies, ["id", "hash"], "left_anti")

    # dealt before the join, so that equal rows meet in one task whichever way Spark joins
    near = rows.repartition("id", "hash").join(hits, ["id", "hash"]).select("id", "hash", "starts", "ends", "text").sortWithinPartitions("id", "hash")
    windows = packed.dealt(near.mapInArrow(_window_chunks(parts, chunk_words), packed.MESSAGE), spread)
    gone = written(packed.gathered(windows.mapInArrow(_later, packed.ANSWER), _covered), "gone")
    gone = gone.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    cut = rows.join(gone, ["id", "hash"], "left").select(F.col("own").alias("id"), "starts", "ends", F.coalesce("copy", F.lit(False)).alias("copy"), "text")
    return cut.mapInArrow(_cut, "id long, n_words long, n_removed long, kept string")
