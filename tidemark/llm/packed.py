"""Exchanging many small keys between tasks in packed form.

A task reads documents a chunk at a time, takes what repeats within the chunk
together, deals the rest of the chunk's keys out by hash and sends each part as one
row of arrays; a key costs a few bytes, not a row.  However often a key
occurs, a chunk sends it once, so no part grows with the copies of one passage.
Answers go back to the chunk, which knows its documents.

The number of parts follows from the bytes of the input, and several share a partition, which Spark sorts by part
(and spills), so a task holds one part at a time.  A part stays as large however large the input is, until a chunk's
keys would be spread over so many parts that a row held few of them; beyond that, parts and chunks both grow with the
square root of the input, so the rows that move stay in proportion to the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import quoted
from tidemark.llm.words import runs

#: Part of the row that stays with the chunk.
LOCAL = -1

#: Bytes of text whose keys make one part, about.
PART_BYTES = 32 << 20

#: Keys that a chunk sends to a part in a row, on average at least, where tasks read enough to fill their chunks.
ROW_KEYS = 32


def parts_of(size: int, partitions: int, part_bytes: int = PART_BYTES) -> int:
    """Parts for texts of ``size`` bytes: a multiple of the partitions."""
    return partitions * max(1, -(-size // (partitions * part_bytes)))


def sizes(size: int, partitions: int, chunk_keys: float, part_bytes: int = PART_BYTES) -> tuple[int, float]:
    """Parts for texts of ``size`` bytes, and how much larger chunks must be than those of ``chunk_keys`` keys, so that rows hold ``ROW_KEYS``."""
    grown = max(1.0, math.sqrt(ROW_KEYS * parts_of(size, partitions, part_bytes) / chunk_keys))
    parts = parts_of(size, partitions, int(part_bytes * grown))
    return parts, max(1.0, ROW_KEYS * parts / chunk_keys)


def alike(keys: np.ndarray, more: np.ndarray, *ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (keys, more, ties), and which of it equal the one before in both halves of the hash."""
    for halves in ((keys,), (more, keys)):  # equal first halves with unequal second ones are next to impossible
        order = np.lexsort((*reversed(ties), *halves))
        one, two = keys[order], more[order]
        same = np.zeros(len(keys), bool)
        same[1:] = one[1:] == one[:-1]
        differ = same[1:] & (two[1:] != two[:-1])
        if not differ.any():
            break
        same[1:] &= ~differ
    return order, same

#: Rows that travel: what they are dealt by, the chunk, the part of the keys (or LOCAL), and arrays.
MESSAGE = "target long, chunk long, part int, a binary, b binary, c binary, d binary"
MESSAGE_ARROW = pa.schema([("target", pa.int64()), ("chunk", pa.int64()), ("part", pa.int32()), *((n, pa.binary()) for n in "abcd")])

#: What an answer holds: places in a chunk.
ANSWER = "chunk long, part int, a binary, b binary, c binary, d binary"
ANSWER_ARROW = pa.schema(list(MESSAGE_ARROW)[1:])

#: Removed or chosen stretches of a document.
STRETCHES = "id long, hash binary, starts array<int>, ends array<int>"
STRETCHES_ARROW = pa.schema([("id", pa.int64()), ("hash", pa.binary()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, text, own): null ids as the largest, null texts as empty, the MD5 of the text, and the id as it was.

    Id and hash are what documents are known by; equal pairs are equal rows.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    own: Column = F.col(quoted(id_col)).cast("long")
    return docs.select(F.coalesce(own, F.lit((1 << 63) - 1)).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("hash"), text.alias("text"), own.alias("own"))


@dataclass
class Docs:
    """The documents of a chunk: ids, hashes, and the borders of their items in the chunk."""

    ids: np.ndarray
    hashes: list[bytes]
    border: np.ndarray

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.ids.tobytes(), b"".join(self.hashes), self.border.tobytes()

    @staticmethod
    def unpacked(ids: bytes, hashes: bytes, border: bytes) -> Docs:
        return Docs(np.frombuffer(ids, np.int64), [hashes[i : i + 16] for i in range(0, len(hashes), 16)], np.frombuffer(border, np.int64))

    def stretches(self, mask: np.ndarray) -> pa.RecordBatch | None:
        """The stretches that hold in a mask over the chunk's items, by document; documents without any are left out."""
        starts, ends = runs(mask)
        if not len(starts):
            return None
        # cut at the borders of documents
        inner = self.border[1:-1]
        cut = inner[(mask[inner - 1] & mask[np.minimum(inner, len(mask) - 1)]) & (inner > 0) & (inner < len(mask))] if len(inner) else inner
        starts, ends = np.sort(np.concatenate((starts, np.unique(cut)))), np.sort(np.concatenate((ends, np.unique(cut))))
        doc = np.searchsorted(self.border, starts, side="right") - 1
        lo = self.border[doc]
        some, at = np.unique(doc, return_index=True)
        offsets = pa.array([*at.tolist(), len(doc)], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array((x - lo).astype(np.int32))) for x in (starts, ends)]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[some]), pa.array([self.hashes[k] for k in some.tolist()], pa.binary()), *lists], schema=STRETCHES_ARROW)


def chunk_numbers() -> Iterator[int]:
    """Numbers for the chunks of this task that no other task has."""
    context = TaskContext.get()
    task = context.partitionId() if context else 0
    yield from range(task << 32, (task + 1) << 32)


def planes(values: np.ndarray) -> bytes:
    """Ascending places as differences, one plane a byte: planes of zeros vanish in compression."""
    d = np.diff(values, prepend=0)
    width = 2 if not len(d) or d.max() < 1 << 16 else 4
    return bytes([width]) + d.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    width = data[0]
    planes_ = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes_.T).view(f"<u{width}")[:, 0].astype(np.int64))


def by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs, with the places of its members in order."""
    small = part.astype(np.uint16) if parts <= 1 << 16 else part
    order = np.argsort(small, kind="stable")
    held = small[order]
    edges = np.flatnonzero(np.diff(held, prepend=held[:1] + 1, append=held[-1:] + 1)) if len(held) else []
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        yield int(held[s]), order[s:e]


def message(chunk: int, part: int, a: bytes = b"", b: bytes = b"", c: bytes = b"", d: bytes = b"") -> tuple:
    return chunk if part == LOCAL else part, chunk, part, a, b, c, d


def batches(rows: Iterable[tuple], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of arrays as record batches of bounded size."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str))) + 64
        if size >= limit:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def rows_of(frames: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for frame in frames:
        columns = frame.columns
        for k in range(frame.num_rows):
            yield tuple(c[k].as_py() for c in columns)


def dealt(messages: DataFrame, partitions: int) -> DataFrame:
    """Messages at the partition they are for, part after part."""
    return messages.repartitionById(partitions, F.pmod("target", F.lit(partitions)).cast("int")).sortWithinPartitions("part")


def by_turns(frames: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Each part of a partition with its rows, one part in hand; each row that stays with its chunk alone."""
    part, held = LOCAL, []
    for row in rows_of(frames):
        if row[2] == LOCAL:
            yield LOCAL, [row]
            continue
        if held and row[2] != part:
            yield part, held
            held = []
        part = row[2]
        held.append(row)
    if held:
        yield part, held


def gathered(answers: DataFrame, gather) -> DataFrame:
    """Stretches by document from what has come back to each chunk: ``gather(local_row, answers)`` gives a mask and the documents."""

    def run(table: pa.Table) -> pa.Table:
        local, back = None, []
        for row in rows_of(table.to_batches()):
            if row[1] == LOCAL:
                local = row
            else:
                back.append(row)
        docs, mask = gather(local, back)
        found = docs.stretches(mask)
        return pa.Table.from_batches([found] if found is not None else [], schema=STRETCHES_ARROW)

    return answers.groupBy("chunk").applyInArrow(run, STRETCHES)
