r"""Chat formatting by columnar byte assembly.

A turn becomes ``<turn ROLE>\nTEXT</turn>\n``. In roles and texts each ``\``,
``<`` and ``>`` gets a ``\`` before it, so that no text can hold a control string
and dropping those marks gives the text back. A whole Arrow batch of
conversations is laid out at once: segment lengths, cumulative offsets and
scatter indices are numpy arrays, and headers and contents are copied into one
preallocated buffer that becomes the output column.

``loss`` has the byte spans of the escaped assistant texts in the output.

A formatted conversation is one value of the result, so its turns are brought
together; that group is the unit of the output, whatever its size.

Defined cases: a null text or role is empty; turns are ordered by turn (null
first), then role and text; repeated rows are repeated turns; rows of null
conv_id are one conversation; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.llm.common import bound_batches

OPEN, OPEN_END, CLOSE = b"<turn ", b">\n", b"</turn>\n"
ESCAPE = ord("\\")
LOSS_ROLE = b"assistant"

_SPECIAL = np.zeros(256, bool)
_SPECIAL[[ord(c) for c in "\\<>"]] = True
_BODY = rb"[^\\<>]*(?:\\.[^\\<>]*)*"
_TURN = re.compile(rb"<turn (" + _BODY + rb")>\n(" + _BODY + rb")</turn>\n", re.DOTALL)
_MARKED = re.compile(rb"\\(.)", re.DOTALL)

FORMATTED = "conv_id long, n_turns long, formatted string, loss array<struct<start:long,end:long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Segments:
    """Contents of one string column: bytes, bounds, and what escaping adds."""

    def __init__(self, column: pa.Array) -> None:
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2] if len(column) else None
        self.bytes = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
        self.bounds = bounds - bounds[0]
        self.special = _SPECIAL[self.bytes]
        self.marks = np.concatenate([[0], np.cumsum(self.special)])
        self.raw = np.diff(self.bounds)
        self.lengths = self.raw + np.diff(self.marks[self.bounds])

    def scatter(self, out: np.ndarray, begins: np.ndarray) -> None:
        """Copies each segment to its place, an escape mark before each special byte."""
        first = self.bounds[:-1]
        to = np.repeat(begins - first - self.marks[first], self.raw) + np.arange(len(self.bytes)) + self.marks[1:]
        out[to] = self.bytes
        out[to[self.special] - 1] = ESCAPE


def _constant(out: np.ndarray, begins: np.ndarray, value: bytes) -> None:
    out[begins[:, None] + np.arange(len(value))] = np.frombuffer(value, np.uint8)


def assemble(turns: pa.ListArray) -> tuple[pa.StringArray, pa.ListArray]:
    """Formatted conversations and the spans of their assistant texts, for a list column of (role, text) structs."""
    bounds = np.asarray(turns.offsets).astype(np.int64)
    bounds = bounds - bounds[0]
    flat = turns.flatten()
    roles, texts = _Segments(flat.field("role")), _Segments(flat.field("text"))
    lengths = len(OPEN) + roles.lengths + len(OPEN_END) + texts.lengths + len(CLOSE)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    begins = ends[:-1]
    buffer = pa.allocate_buffer(int(ends[-1]))
    out = np.frombuffer(buffer, np.uint8) if len(buffer) else np.zeros(0, np.uint8)
    role_at = begins + len(OPEN)
    text_at = role_at + roles.lengths + len(OPEN_END)
    _constant(out, begins, OPEN)
    roles.scatter(out, role_at)
    _constant(out, role_at + roles.lengths, OPEN_END)
    texts.scatter(out, text_at)
    _constant(out, text_at + texts.lengths, CLOSE)
    conversation = ends[bounds]
    formatted = pa.StringArray.from_buffers(len(turns), pa.py_buffer(conversation.astype(np.int32)), buffer)
    spoken = np.asarray(pc.fill_null(pc.equal(flat.field("role").cast(pa.binary()), LOSS_ROLE), False).to_numpy(zero_copy_only=False), bool)
    start = text_at - np.repeat(conversation[:-1], np.diff(bounds))
    spans = pa.StructArray.from_arrays([pa.array(start[spoken]), pa.array((start + texts.lengths)[spoken])], ["start", "end"])
    counted = np.concatenate([[0], np.cumsum(spoken)])[bounds]
    return formatted, pa.ListArray.from_arrays(pa.array(counted.astype(np.int32)), spans)


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns = batch.column("turns")
        formatted, loss = assemble(turns)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pc.list_value_length(turns).cast(pa.int64()), formatted, loss], ["conv_id", "n_turns", "formatted", "loss"])


def format_chats(conversations: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, formatted, loss)`` of every conversation."""
    bound_batches(conversations.sparkSession)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.mapInArrow(_format_batches, FORMATTED)


def unescaped(marked: bytes) -> bytes:
    return _MARKED.sub(rb"\1", marked)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of a formatted conversation; raises where it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at byte {at}")
        turns.append((unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    return turns


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for conv_id, formatted, loss in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").cast(pa.binary()).to_pylist(), batch.column("loss").to_pylist(), strict=True):
            turns = parse(formatted)
            masked = b"".join(unescaped(formatted[x["start"] : x["end"]]) for x in loss)
            said = hashlib.sha256(b"".join(role + b"\n" + text + b"\n" for role, text in turns)).hexdigest()
            rows.append((conv_id, len(turns), said, len(masked.decode()), hashlib.sha256(masked).hexdigest(), len(formatted.decode())))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in DIGESTS.split(", ")])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations say, from the output alone."""
    bound_batches(formatted.sparkSession)
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(_digest_batches, DIGESTS)
