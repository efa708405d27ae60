"""Conversations as training text, assembled column-wise in one buffer."""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.llm.columns import SLICE, row_slices, text_column

# A turn of a user, an assistant, and anyone else.  An escaped text has no bare [ < ] or backslash.
OPEN = b"<s>"
USER, ASSISTANT, OTHER = (b"[INST] ", b" [/INST]"), (b" ", b" </s>"), (b"[TURN ", b"] ", b" [/TURN]")
ESCAPED = np.zeros(256, bool)
ESCAPED[list(b"\\[]<")] = True
_BODY = rb"((?:[^\\\[\]<]++|\\.)*+)"
_TURN = re.compile(rb"\[INST\] " + _BODY + rb"\[/INST\]|\[TURN " + _BODY + rb"\] " + _BODY + rb"\[/TURN\]| " + _BODY + rb"</s>", re.S)
_ESCAPE = re.compile(rb"([\\\[\]<])")
_UNESCAPE = re.compile(rb"\\(.)", re.S)


def escape(text: bytes) -> bytes:
    return _ESCAPE.sub(rb"\\\1", text)


def unescape(text: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1", text)


def parse(formatted: bytes) -> list[tuple[bytes, bytes, bool]]:
    """(role, text, under the loss mask) of each turn of a formatted conversation or a part of one."""
    turns, at = [], len(OPEN) if formatted.startswith(OPEN) else 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at byte {at}")
        user, role, other, assistant = m.groups()
        if user is not None:
            turns.append((b"user", unescape(user[:-1]), False))
        elif assistant is not None:
            turns.append((b"assistant", unescape(assistant[:-1]), True))
        else:
            turns.append((unescape(role), unescape(other[:-1]), False))
        at = m.end()
    return turns


def assembled(data: np.ndarray, offsets: np.ndarray, roles: list[bytes], first: np.ndarray):
    """(bytes, offsets, loss starts, loss ends): every row's turn, end to end in one buffer.

    Lengths of head, escaped text and tail give the rows' places; texts, escapes, heads and tails are then
    copied by index arrays.  Loss spans are byte positions of the escaped assistant texts in their row.
    """
    n, lengths = len(roles), np.diff(offsets)
    data, base = data[offsets[0]:offsets[-1]], offsets[:-1] - offsets[0]
    marked = ESCAPED[data]
    before = np.concatenate([[0], np.cumsum(marked)])
    grown = lengths + before[base + lengths] - before[base]
    kinds, kind_of = np.unique(np.array([r + (b"\x01" if f else b"\x00") for r, f in zip(roles, first)], object), return_inverse=True)
    heads, tails = [], []
    for kind in kinds:
        role, opening = kind[:-1], OPEN if kind[-1:] == b"\x01" else b""
        if role == b"user":
            head, tail = USER
        elif role == b"assistant":
            head, tail = ASSISTANT
        else:
            head, tail = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
        heads.append(np.frombuffer(opening + head, np.uint8))
        tails.append(np.frombuffer(tail, np.uint8))
    head_length = np.array([len(h) for h in heads], np.int64)[kind_of]
    tail_length = np.array([len(t) for t in tails], np.int64)[kind_of]
    ends = np.cumsum(head_length + grown + tail_length)
    starts = ends - (head_length + grown + tail_length)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    shift = starts + head_length - base - before[base]
    target = np.repeat(shift, lengths) + np.arange(len(data)) + before[1:]
    out[target] = data
    out[target[marked] - 1] = ord("\\")
    for k, (head, tail) in enumerate(zip(heads, tails)):
        mine = np.flatnonzero(kind_of == k)
        out[starts[mine, None] + np.arange(len(head))] = head
        out[ends[mine, None] - len(tail) + np.arange(len(tail))] = tail
    loss = np.array([r == b"assistant" for r in roles], bool)
    return (out, np.concatenate([[0], ends]), np.where(loss, head_length, 0), np.where(loss, head_length + grown, 0))


TURN_ROWS = "conv_id long, seq long, formatted string, loss_start long, loss_end long"


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, seq, begun = None, 0, False
    for batch in batches:
        data, offsets = text_column(batch)
        ids, roles = batch.column(0).to_pylist(), [r.encode() for r in batch.column(1).to_pylist()]
        for lo, hi in row_slices(offsets, SLICE):
            places = []
            for c in ids[lo:hi]:
                seq = seq + 1 if begun and c == conv else 0
                conv, begun = c, True
                places.append(seq)
            place = np.array(places, np.int64)
            out, at, start, end = assembled(data, offsets[lo:hi + 1], roles[lo:hi], place == 0)
            text = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(place), text, pa.array(start), pa.array(end)],
                                             names=["conv_id", "seq", "formatted", "loss_start", "loss_end"])


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, formatted, loss_start, loss_end): one row per turn, in order within each task.

    A conversation's text is its `formatted` joined by seq; loss spans are byte positions in the row, of
    assistant texts only.  Turns are ordered by turn, then role and text (nulls first); repeated rows stay.
    Null texts and roles are empty; a null conv_id is a conversation of its own.  Empty texts are turns.
    Other columns are ignored.  An empty table gives an empty result.

    A conversation's rows meet in one task, but pass through it as a stream of batches: what is held is a
    batch, however long the conversation is.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"), F.col("turn").cast("long").alias("turn"))
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.select("conv_id", "role", "text").mapInArrow(_formatted, TURN_ROWS)


class _Digest:
    def __init__(self):
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, end: int) -> None:
        raw = formatted.encode()
        for role, text, _ in parse(raw):
            self.all.update(role + b"\n" + text + b"\n")
            self.turns += 1
        masked = unescape(raw[start:end])
        self.loss.update(masked)
        self.loss_chars += len(masked.decode())
        self.chars += len(formatted)

    def row(self, conv):
        return conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST_ROWS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST_NAMES = [c.split()[0] for c in DIGEST_ROWS.split(", ")]


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state, done = None, None, []
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def packed():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=_DIGEST_NAMES)

    for batch in batches:
        for c, seq, formatted, start, end in zip(*(col.to_pylist() for col in batch.columns)):
            if seq == 0:
                if state is not None:
                    done.append(state.row(conv))
                conv, state = c, _Digest()
            state.add(formatted, start, end)
        if len(done) > 1000:
            yield packed()
            done.clear()
    if state is not None:
        done.append(state.row(conv))
    if done:
        yield packed()


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from `format_turns` as it comes, without another shuffle."""
    return turns.mapInArrow(_read_back, DIGEST_ROWS)
