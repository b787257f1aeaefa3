"""Removing byte strings that occur more than once, with a sparse enhanced suffix array.

Sorting every suffix of a corpus needs its text many times over.  Instead,
suffixes are taken at anchors: of every ``WINDOW`` - ``GRAM`` + 1 consecutive
``GRAM``-byte strings the one with the smallest hash.  Equal strings of
``WINDOW`` bytes have their anchors at the same places, so each of their
occurrences is seen from one.  Anchors that occur once are dropped; the others
are gathered by what they hold, each with the text around it.

Within such a group the suffixes from the anchor on are sorted (a suffix array),
neighbours' common prefixes are taken, and a stack scan over these
lists the common-prefix intervals, which form a tree.  In each interval the texts left of
the anchors are held against each other: where they differ at once the repeat is
maximal as it stands, where they agree it goes on to the left.  So every
occurrence, not just neighbours, learns how far it is repeated to either side.

A group with very many occurrences can't be gathered in one task: its windows are counted
one by one, dealt out by their own 128-bit hashes, which is the exact way for these.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import packed
from tidemark.llm.store import partitions, written
from tidemark.llm.words import chunks, mixed, runs, sliding

#: Bytes of a string that goes if it occurs again.
WINDOW = 200

#: Bytes of an anchor.
GRAM = 32

#: Occurrences of an anchor beyond which its windows are counted instead.
CROWD = 4096

#: Bytes of text of a chunk, about, unless there are very many parts (see ``packed.sizes``), and of text around anchors that a task sends at a time.
CHUNK_BYTES = 8 << 20

#: Bytes of text for each anchor, about: the least of so many hashes changes twice in as many places.
_SPACING = (WINDOW - GRAM + 2) / 2

#: Windows that are ranked at a time; a power of two.
_SEGMENT = 1 << 17

_LEFT = WINDOW - GRAM
_RANDOM = np.random.default_rng(0x5EED)
_BYTE = _RANDOM.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _RANDOM.integers(0, 1 << 63, (2, 9), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_hashes(data: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``length`` bytes, by doubling."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    power = _BYTE[which][data]  # hashes of runs of 1, 2, 4 ... bytes
    out: np.ndarray | None = None
    have, at = 0, 1
    for k in range(length.bit_length()):
        if length >> k & 1:
            if out is None:
                out = power.copy()
            else:
                n = len(data) - have - at + 1
                out = out[:n] * _STEPS[which][8] + power[have : have + n] * _STEPS[which][k]
            have += at
        if have < length:
            n = len(power) - at
            power = power[:n] * _STEPS[which][k] + power[at : at + n]
            at *= 2
    return mixed(out[: len(data) - length + 1])


def anchors(data: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of the texts between the borders; ties go to the last in a window.

    Segments of windows keep the arrays in the processor's cache, and their
    places in the low bits of what is compared.
    """
    inside = np.zeros(len(data), bool)
    for s, e in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
        inside[s : max(s, e - WINDOW + 1)] = True
    places, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    low = np.uint64(_SEGMENT * 2 - 1)
    for s in range(0, len(data) - WINDOW + 1, _SEGMENT):
        grams = byte_hashes(data[s : s + _SEGMENT + WINDOW - 1], GRAM)
        ranked = (grams | low) - np.arange(len(grams), dtype=np.uint64)
        least = sliding(ranked, WINDOW - GRAM + 1)
        chosen = np.unique((low - (least[inside[s : s + len(least)]] & low)).astype(np.int64))
        places.append(chosen + s)
        keys.append(grams[chosen])
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(keys)[first]


# --- which anchors occur again ----------------------------------------------------


def _offer(keys: np.ndarray, at: np.ndarray, docs: packed.Docs, chunk: int, parts: int) -> Iterator[tuple]:
    """Messages of a chunk: for each part the distinct anchors (32 bits of hash), where each is first, and how often those are that repeat."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.flatnonzero(np.diff(ranked, prepend=ranked[:1] + np.uint64(1)))
    count = np.diff(new, append=len(ranked))
    first = order[new]
    other = np.ones(len(keys), bool)
    other[new] = False
    pairs = np.stack((at[np.repeat(first, count)[other]], at[order[other]]))
    yield packed.message(chunk, packed.LOCAL, *docs.packed(), pairs.tobytes())
    by_place = np.argsort(first, kind="stable")
    first, count = first[by_place], count[by_place]
    part = (keys[first] % np.uint64(parts)).astype(np.int64)
    short = (keys[first] >> np.uint64(32)).astype(np.uint32)
    for p, members in packed.by_part(part, parts):
        many = np.flatnonzero(count[members] > 1)
        sparse = np.stack((many, count[members][many])).astype(np.uint32)
        yield packed.message(chunk, p, short[members].tobytes(), packed.planes(at[first[members]]), sparse.tobytes())


def _offer_chunks(parts: int, chunk_bytes: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages() -> Iterator[tuple]:
            numbers = packed.chunk_numbers()
            ids, hashes, border, found, piece = [], [], [0], [], []

            def flush() -> Iterator[tuple]:
                docs = packed.Docs(np.array(ids, np.int64), list(hashes), np.array(border))
                at, keys = (np.concatenate(x) for x in zip(*found, strict=True))
                yield from _offer(keys, at, docs, next(numbers), parts)

            def take() -> None:
                at, keys = anchors(np.frombuffer(b"".join(piece), np.uint8), np.cumsum([0, *map(len, piece)]))
                found.append((at + border[-1] - sum(map(len, piece)), keys))
                piece.clear()

            size = 0
            for frame in frames:
                names, marks = frame.column(0).to_pylist(), frame.column(1).to_pylist()
                texts = (t for part in chunks(t.as_py() for t in frame.column(2)) for t in part)
                for id_, hash_, text in zip(names, marks, texts, strict=True):
                    if len(text) < WINDOW:
                        continue
                    ids.append(id_)
                    hashes.append(hash_)
                    border.append(border[-1] + len(text))
                    piece.append(text)
                    size += len(text)
                    if size >= 1 << 20 or border[-1] >= chunk_bytes:
                        take()
                        size = 0
                    if border[-1] >= chunk_bytes:
                        yield from flush()
                        ids, hashes, border, found = [], [], [0], []
            if piece:
                take()
            if found:
                yield from flush()

        yield from packed.batches(messages(), packed.MESSAGE_ARROW)

    return run


def _occurs_again(crowd: int):
    """Of a partition's anchors those that occur twice or more: their places, and apart those that occur more than ``crowd`` times."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers() -> Iterator[tuple]:
            for part, rows in packed.by_turns(frames):
                if part == packed.LOCAL:
                    yield rows[0][1:]
                    continue
                rows = [(chunk, a, b, c) for _, chunk, _, a, b, c, _ in rows]
                keys = np.concatenate([np.frombuffer(a, np.uint32) for _, a, _, _ in rows])
                count = np.ones(len(keys), np.int64)
                at, sizes = 0, []
                for _, a, _, c in rows:
                    many, n = np.frombuffer(c, np.uint32).reshape(2, -1)
                    count[at + many] = n
                    sizes.append(len(a) // 4)
                    at += len(a) // 4
                order = np.argsort(keys, kind="stable")
                new = np.flatnonzero(np.diff(keys[order].astype(np.int64), prepend=-1))
                total = np.zeros(len(keys), np.int64)
                total[order] = np.repeat(np.add.reduceat(count[order], new), np.diff(new, append=len(keys)))
                at = 0
                for (chunk, _, b, _), n in zip(rows, sizes, strict=True):
                    own = total[at : at + n]
                    at += n
                    if (own > 1).any():
                        place = packed.from_planes(b).astype(np.uint32)
                        yield chunk, 0, place[(own > 1) & (own <= crowd)].tobytes(), place[own > crowd].tobytes(), b"", b""

        yield from packed.batches(answers(), packed.ANSWER_ARROW)

    return run


_ANCHORED = "id long, hash binary, anchors array<int>, crowded array<int>"
_ANCHORED_ARROW = pa.schema([("id", pa.int64()), ("hash", pa.binary()), ("anchors", pa.list_(pa.int32())), ("crowded", pa.list_(pa.int32()))])


def _anchored(table: pa.Table) -> pa.Table:
    """The places in each document of a chunk at which anchors occur again."""
    place: list[list[np.ndarray]] = [[], []]
    local = None
    for row in packed.rows_of(table.to_batches()):
        if row[1] == packed.LOCAL:
            local = row
        else:
            place[0].append(np.frombuffer(row[2], np.uint32))
            place[1].append(np.frombuffer(row[3], np.uint32))
    docs = packed.Docs.unpacked(*local[2:5])
    first, other = np.frombuffer(local[5], np.int64).reshape(2, -1)
    out: dict[int, list[list[int]]] = {}
    for k in (0, 1):
        at = np.concatenate(place[k] or [np.zeros(0, np.uint32)]).astype(np.int64)
        at = np.sort(np.concatenate((at, other[np.isin(first, at)])))
        doc = np.searchsorted(docs.border, at, side="right") - 1
        for d, a in zip(doc.tolist(), (at - docs.border[doc]).tolist(), strict=True):
            out.setdefault(d, [[], []])[k].append(a)
    rows = [(int(docs.ids[d]), docs.hashes[d], *lists) for d, lists in sorted(out.items())]
    columns = zip(*rows, strict=True) if rows else [[], [], [], []]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ANCHORED_ARROW, strict=True)], schema=_ANCHORED_ARROW)


# --- how far they are repeated ----------------------------------------------------


def _surroundings(parts: int):
    """Messages of a chunk: anchors with the text around them, and windows of crowded anchors by hash.

    Parts from ``parts`` on hold windows.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages() -> Iterator[tuple]:
            numbers = packed.chunk_numbers()
            before, hold = None, _Held()
            for frame in frames:
                columns = [frame.column(k).to_pylist() for k in range(4)]
                texts = (t for part in chunks(t.as_py() for t in frame.column(4)) for t in part)
                for id_, hash_, own, crowded, text in zip(*columns, texts, strict=True):
                    if (id_, hash_) == before:
                        continue
                    before = id_, hash_
                    hold.add(id_, hash_, own, crowded, text)
                    if hold.size >= CHUNK_BYTES:
                        yield from hold.flush(next(numbers), parts)
                        hold = _Held()
            if hold.ids:
                yield from hold.flush(next(numbers), parts)

        yield from packed.batches(messages(), packed.MESSAGE_ARROW)

    return run


class _Held:
    """What a chunk sends: distinct surroundings, and distinct windows."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.hashes: list[bytes] = []
        self.border = [0]
        self.size = 0
        self.slices: dict[tuple[bytes, int], list[int]] = {}
        self.windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, id_: int, hash_: bytes, own: list[int], crowded: list[int], text: bytes) -> None:
        base = self.border[-1]
        for a in own:
            s = max(0, a - _LEFT)
            self.slices.setdefault((text[s : a + WINDOW], a - s), []).append(base + a)
        if crowded:
            mask = np.zeros(len(text), bool)
            for a in crowded:
                mask[max(0, a - _LEFT) : a + 1] = True
            mask[len(text) - WINDOW + 1 :] = False
            data = np.frombuffer(text, np.uint8)
            for s, e in zip(*(x.tolist() for x in runs(mask)), strict=True):
                piece = data[s : e + WINDOW - 1]
                self.windows.append((byte_hashes(piece, WINDOW), byte_hashes(piece, WINDOW, 1), np.arange(base + s, base + e)))
        self.ids.append(id_)
        self.hashes.append(hash_)
        self.border.append(base + len(text))
        self.size += len(text) // 8 + (2 * WINDOW) * len(own) + 200 * len(crowded)

    def flush(self, chunk: int, parts: int) -> Iterator[tuple]:
        docs = packed.Docs(np.array(self.ids, np.int64), self.hashes, np.array(self.border))
        # places that share their surroundings with an earlier place of the chunk, and windows that do
        same = np.array([(at[0], x) for at in self.slices.values() for x in at[1:]], np.int64).reshape(-1, 2).T
        covered = np.zeros(0, np.int64)
        out: list[tuple] = []
        if self.windows:
            keys, more, at = (np.concatenate(x) for x in zip(*self.windows, strict=True))
            order, equal = packed.alike(keys, more, at)
            fresh = np.ones(len(keys), bool)
            fresh[order[equal]] = False
            again = equal.copy()
            again[:-1] |= equal[1:]
            covered = at[order[again]]
            twice = np.zeros(len(keys), bool)
            twice[order[again]] = True
            keys, more, at, twice = keys[fresh], more[fresh], at[fresh], twice[fresh]
            part = (more % np.uint64(parts)).astype(np.int64)
            out += [packed.message(chunk, parts + p, keys[m].tobytes() + more[m].tobytes(), packed.planes(at[m]), np.packbits(twice[m]).tobytes()) for p, m in packed.by_part(part, parts)]
        yield packed.message(chunk, packed.LOCAL, *docs.packed(), np.int64([same.shape[1]]).tobytes() + same.tobytes() + covered.tobytes())
        by_part: dict[int, list[tuple[int, int, bytes, int]]] = {}
        for (around, left), at in self.slices.items():
            key = xxhash.xxh64_intdigest(around[left : left + GRAM])
            by_part.setdefault(key % parts, []).append((at[0], left | (512 if len(at) > 1 else 0), around, len(around)))
        for p, rows in sorted(by_part.items()):
            rows.sort()
            shape = np.array([(left, n) for _, left, _, n in rows], np.uint16)
            out.append(packed.message(chunk, p, b"".join(r[2] for r in rows), packed.planes(np.array([r[0] for r in rows])), shape.tobytes()))
        yield from out


def _agree(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, last) of a suffix array, inner ones first.

    ``prefixes[k]`` is what suffixes k and k + 1 have in common.  The stack holds the
    open intervals, by length; what is closed is complete.
    """
    stack: list[tuple[int, int]] = []
    for k, length in enumerate([*prefixes, 0]):
        first = k
        while stack and stack[-1][0] > length:
            own, first = stack.pop()
            yield own, first, k
        if length and (not stack or stack[-1][0] < length):
            stack.append((length, first))


def maximal_repeats(group: list[tuple[bytes, bytes]], window: int = WINDOW) -> Iterator[tuple[int, int, list[int]]]:
    """The maximal repeats through an anchor: (bytes to its left, bytes from it on, all members of the group that share them).

    ``group`` are the distinct (left text reversed, text from the anchor on).  Common-prefix intervals of
    the sorted suffixes say how far members agree to the right; within one, the intervals of the left texts say
    how far they agree to the left.  A repeat is maximal if its members differ on both sides: on the left they do as
    an interval ends there, on the right if not all of them lie in one interval further down.
    """
    array = sorted(range(len(group)), key=lambda k: group[k][1])
    prefixes = [_agree(group[a][1], group[b][1]) for a, b in zip(array, array[1:], strict=False)]
    for length, first, last in intervals(prefixes):
        if length + _LEFT < window:
            continue
        places = range(first, last + 1)
        if last - first > 1:
            places = sorted(places, key=lambda p: group[array[p]][0])
        shared = [_agree(group[array[p]][0], group[array[q]][0]) for p, q in zip(places, places[1:], strict=False)]
        ends = [p for p in range(first, last) if prefixes[p] == length]
        found = list(intervals(shared))
        if min(shared) == 0:
            found.append((0, 0, len(shared)))
        for left, a, b in found:
            if left + length < window:
                continue
            members = places[a : b + 1]
            low, high = min(members), max(members)
            at = bisect_left(ends, low)
            if at < len(ends) and ends[at] < high:
                yield left, length, [array[p] for p in members]


def reach(group: list[tuple[bytes, bytes, bool]]) -> list[tuple[int, int] | None]:
    """For each (left text reversed, text from the anchor on, whether it is there twice) how far it is repeated: (to the left, to the right).

    Bytes from ``left`` before the anchor to ``right`` after its start are under
    strings of ``WINDOW`` bytes that another member of the group shares, at the same
    place from the anchor: those of all maximal repeats that the member occurs in.
    """
    out: list[tuple[int, int] | None] = [
        (len(left), len(right)) if twice and len(left) + len(right) >= WINDOW else None for left, right, twice in group
    ]
    for left, right, members in maximal_repeats([(a, b) for a, b, _ in group]):
        for k in members:
            far = out[k] or (0, 0)
            out[k] = max(far[0], left), max(far[1], right)
    return out


def _extend(parts: int):
    """Answers for a partition: stretches around anchors, and starts of windows, that occur again."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers() -> Iterator[tuple]:
            for part, rows in packed.by_turns(frames):
                if part == packed.LOCAL:
                    yield rows[0][1:]
                else:
                    yield from (_stretches if part < parts else _counted)([(chunk, a, b, c) for _, chunk, _, a, b, c, _ in rows])

        yield from packed.batches(answers(), packed.ANSWER_ARROW)

    return run


def _stretches(rows: list[tuple]) -> Iterator[tuple]:
    groups: dict[bytes, dict[tuple[bytes, int], list]] = {}
    for k, (_, a, b, c) in enumerate(rows):
        at = 0
        for place, (left, n) in zip(packed.from_planes(b).tolist(), np.frombuffer(c, np.uint16).reshape(-1, 2).tolist(), strict=True):
            text, twice, left = a[at : at + n], left >= 512, left & 511
            at += n
            held = groups.setdefault(text[left : left + GRAM], {}).setdefault((text, left), [twice])
            held[0] = held[0] or len(held) > 1
            held.append((k, place))
    back: dict[int, list[tuple[int, int, int]]] = {}
    while groups:
        members = groups.popitem()[1]
        if len(members) == 1 and not next(iter(members.values()))[0]:
            continue
        found = reach([(text[:left][::-1], text[left:], held[0]) for (text, left), held in members.items()])
        for held, span in zip(members.values(), found, strict=True):
            if span:
                for k, place in held[1:]:
                    back.setdefault(k, []).append((place, place - span[0], place + span[1]))
    for k, found in back.items():
        yield rows[k][0], 0, np.array(found, np.int64).T.tobytes(), b"", b"", b""


def _counted(rows: list[tuple]) -> Iterator[tuple]:
    keys, more = (np.concatenate(x) for x in zip(*(np.frombuffer(a, np.uint64).reshape(2, -1) for _, a, _, _ in rows), strict=True))
    places = [packed.from_planes(b) for _, _, b, _ in rows]
    order, equal = packed.alike(keys, more)
    equal[:-1] |= equal[1:]
    again = np.zeros(len(keys), bool)
    again[order] = equal
    at = 0
    for (chunk, *_), own in zip(rows, places, strict=True):
        mine = own[again[at : at + len(own)]]
        at += len(own)
        if len(mine):
            yield chunk, 0, b"", mine.astype(np.uint32).tobytes(), b"", b""


def _repeated(local: tuple, answers: list[tuple]) -> tuple[packed.Docs, np.ndarray]:
    """Bytes of a chunk's documents under repeated strings."""
    docs = packed.Docs.unpacked(*local[2:5])
    n = int(docs.border[-1])
    numbers = np.frombuffer(local[5], np.int64)
    first, other = numbers[1 : 1 + 2 * numbers[0]].reshape(2, -1)
    change = np.zeros(n + WINDOW + 1, np.int64)

    def cover(starts: np.ndarray, ends: np.ndarray) -> None:
        np.add.at(change, starts, 1)
        np.add.at(change, ends, -1)

    at = numbers[1 + 2 * numbers[0] :]
    cover(at, at + WINDOW)
    order = np.argsort(first, kind="stable")
    for row in answers:
        if row[2]:
            place, starts, ends = np.frombuffer(row[2], np.int64).reshape(3, -1)
            cover(starts, ends)
            # the same surroundings elsewhere in the chunk
            lo, hi = np.searchsorted(first[order], place), np.searchsorted(first[order], place, "right")
            which = np.repeat(np.arange(len(place)), hi - lo)
            where = other[order[np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]]]
            cover(where + (starts - place)[which], where + (ends - place)[which])
        if row[3]:
            starts = np.frombuffer(row[3], np.uint32).astype(np.int64)
            cover(starts, starts + WINDOW)
    return docs, np.cumsum(change)[:n] > 0


# --- the operator -----------------------------------------------------------------

_CUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for frame in frames:
            columns = [frame.column(k).to_pylist() for k in range(4)]
            texts = (t for part in chunks(t.as_py() for t in frame.column(4)) for t in part)
            for id_, starts, ends, copy, text in zip(*columns, texts, strict=True):
                n, kept, at = len(text), [], 0
                gone = [(0, n)] if copy and n >= WINDOW else list(zip(starts or (), ends or (), strict=True))
                for s, e in gone:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                left = b"".join(kept)
                yield id_, n, n - len(left), len(gone), left

    yield from packed.batches(rows(), _CUT)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, part_bytes: int = packed.PART_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): each document without the bytes under a ``WINDOW``-byte string that starts anywhere else too.

    Elsewhere is another document or another place of the same one; overlapping
    occurrences count, all occurrences go, and strings are judged on the input.  Text is UTF-8;
    ``kept`` are the bytes left, which need not be.  ``n_spans`` counts the
    stretches removed.

    Null text is empty; texts shorter than ``WINDOW`` stay.  Copies of a text, repeated
    rows among them, are repeats of each other as a whole; one of them stands for all against other texts.  A null id
    stays null.  Other columns are not looked at.  Texts around anchors are compared byte by
    byte; windows of anchors that occur more than ``crowd`` times by hashes of 128
    bits.  An empty table gives no rows.
    """
    spread = partitions(docs.sparkSession)
    rows = packed.keyed(docs, id_col, text_col)
    known = written(rows.groupBy("id", "hash").agg(F.count("*").alias("rows"), F.first(F.octet_length("text")).alias("bytes")), "known")
    size = known.agg(F.sum("bytes")).first()[0] or 0
    # anchors are small, so their parts grow; texts around them fill a row each
    offered, grown = packed.sizes(size, spread, CHUNK_BYTES / _SPACING, part_bytes)
    parts = packed.parts_of(size, spread, part_bytes)
    heads = known.groupBy(F.col("hash").alias("of")).agg(F.min("id").alias("head"), F.sum("rows").alias("n"))
    heads = written(heads.filter("n > 1"), "heads")  # apart from the grouping, so that the join can split a hash with many copies
    copies = written(known.join(heads, F.col("hash") == F.col("of")).select("id", "hash", (F.col("id") == F.col("head")).alias("stands")), "copies")

    offers = packed.dealt(rows.mapInArrow(_offer_chunks(offered, int(CHUNK_BYTES * grown)), packed.MESSAGE), spread)
    hits = offers.mapInArrow(_occurs_again(crowd), packed.ANSWER).groupBy("chunk").applyInArrow(_anchored, _ANCHORED)
    hits = written(hits, "anchors").dropDuplicates(["id", "hash"]).join(copies.filter(~F.col("stands")), ["id", "hash"], "left_anti")

    near = rows.join(hits, ["id", "hash"]).select("id", "hash", "anchors", "crowded", "text").sortWithinPartitions("id", "hash")
    around = packed.dealt(near.mapInArrow(_surroundings(parts), packed.MESSAGE), spread)
    gone = written(packed.gathered(around.mapInArrow(_extend(parts), packed.ANSWER), _repeated), "gone")
    gone = gone.join(copies, ["id", "hash"], "left_anti").withColumn("copy", F.lit(False)).unionByName(copies.select("id", "hash", F.lit(True).alias("copy")), allowMissingColumns=True)
    cut = rows.join(gone, ["id", "hash"], "left").select(F.col("own").alias("id"), "starts", "ends", F.coalesce("copy", F.lit(False)).alias("copy"), "text")
    return cut.mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
