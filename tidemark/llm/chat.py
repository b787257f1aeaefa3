"""Formatting conversations with compiled templates, and reading the result back.

Rows are dealt by conversation and sorted; each task renders one conversation
after the other as a stream of turns and hands out pieces of bounded length.
So neither a long conversation nor one that holds a large part of all rows has
to fit in memory; its turns still come from one task, as its text is one string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.store import quoted
from tidemark.llm.template import Template

#: Turns between begin and end markers, the role in a header of its own.
TURNS = Template(
    "{% for m in messages %}<s>[INST] {{ m.role|escape }} [/INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}"
    "{% else %}{{ m.text|escape }}{% endif %}</s>\n{% endfor %}",
    ("<s>", "</s>", "[INST]", "[/INST]"),
)

#: Characters after which a piece ends, at the next end of what a template prints.
PIECE = 1 << 20

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def format_conversations(
    turns: DataFrame,
    template: Template = TURNS,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    piece: int = PIECE,
) -> DataFrame:
    """Rows (conv_id, piece, text, spans): the pieces of each conversation, numbered from 0.

    A template sees ``messages``, each with role, text and turn.  ``spans`` are
    the start and end, in characters of the piece, of what the template puts
    under generation markers.  The pieces of a conversation joined together are
    its text; pieces come in order within a partition.

    Turns stand by turn number, null first, then by role and text, so repeated
    numbers and repeated rows have a fixed order and each is a turn.  Null role
    or text prints as nothing.  Rows with a null conversation id form one
    conversation.  Other columns are not looked at.  An empty table gives no rows.
    """
    columns = [F.col(quoted(c)).alias(a) for c, a in ((conv_col, "conv_id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))]
    rows = turns.select(*columns)
    schema = T.StructType(
        [rows.schema["conv_id"], T.StructField("piece", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", _SPANS)]
    )
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = template.compiled()
        kind: pa.DataType | None = None

        def typed() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield from _rows([batch])

        for conv, own in groupby(typed(), key=lambda r: r[0]):
            messages = ({"turn": turn, "role": role, "text": text or ""} for _, turn, role, text in own)
            parts: list[str] = []
            spans: list[dict] = []
            at = number = 0
            for text, marked in run({"messages": messages}):
                if marked and text:
                    spans.append({"start": at, "end": at + len(text)})
                parts.append(text)
                at += len(text)
                if at >= piece:
                    yield _piece(conv, kind, number, parts, spans, arrow, schema.names)
                    parts, spans, at, number = [], [], 0, number + 1
            if parts or not number:
                yield _piece(conv, kind, number, parts, spans, arrow, schema.names)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(render, schema)


def _piece(conv, kind: pa.DataType, number: int, parts: list[str], spans: list[dict], arrow: pa.DataType, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([conv], kind), pa.array([number], pa.int64()), pa.array(["".join(parts)], pa.string()), pa.array([spans], arrow)], names=names
    )


_MARKS = re.compile(r"\\.|<s>\[INST\] | \[/INST\]|</s>\n", re.S)


def read_back(pieces: DataFrame, template: Template = TURNS) -> DataFrame:
    """Digests of what ``format_conversations`` wrote with ``TURNS``, read from the pieces alone.

    A row per conversation: conv_id, n_turns, turns_sha256 (role, newline, text
    and newline of every turn), loss_chars and loss_sha256 (all text under
    generation markers), formatted_chars.  Text is unescaped, digests are
    lowercase hex.  Needs the pieces in the order in which they were written.
    """
    schema = T.StructType(
        [
            pieces.schema["conv_id"],
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list[pa.DataType] = []

        def typed() -> Iterator[tuple]:
            for batch in batches:
                kind[:] = [batch.schema.field(0).type]
                yield from _rows([batch])

        for conv, own in groupby(typed(), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = 0
            held: list[str] = []
            for _, _, text, spans in own:
                chars += len(text)
                for s in spans:
                    said = template.unescape(text[s["start"] : s["end"]])
                    loss_chars += len(said)
                    loss.update(said.encode())
                at = 0
                for m in _MARKS.finditer(text):
                    if m[0][0] == "\\":
                        continue
                    held.append(text[at : m.start()])
                    at = m.end()
                    if m[0].startswith("<s>"):
                        held = []
                    else:
                        turns.update((template.unescape("".join(held)) + "\n").encode())
                        n_turns += m[0] == "</s>\n"
                        held = []
                held.append(text[at:])
            row = (conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
            arrays = [pa.array([v], kind[0] if k == 0 else None) for k, v in enumerate(row)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return pieces.mapInArrow(digest, schema)
