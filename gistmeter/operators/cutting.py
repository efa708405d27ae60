"""Words and sentences of many texts at a time, cut inside tasks as the patterns `text.WORD` and `text.SENTENCE_GAP` cut them."""

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gistmeter.functions import text

POINTS = 0x110000
OTHER, LETTER, JOINER, STOP, BLANK = range(5)
BLANKS = b" \t\n\x0b\f\r"  # \\s of the patterns


_asked: list[tuple[tuple[int, int], ...]] = []


def _letters(spark: SparkSession) -> tuple[tuple[int, int], ...]:
    """First and last code points of the runs of letters and numbers; which they are is asked, once, of the library that reads the patterns."""
    if _asked:
        return _asked[0]
    point = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    found = spark.range(POINTS).filter(point.rlike(text.LETTER)).toArrow().column("id").to_numpy()
    found = np.sort(found)
    starts = np.flatnonzero(np.diff(found, prepend=-2) != 1)
    _asked.append(tuple(zip(found[starts].tolist(), found[np.append(starts[1:], len(found)) - 1].tolist())))
    return _asked[0]


@functools.cache
def _kinds(letters: tuple[tuple[int, int], ...]) -> np.ndarray:
    """The kind of every code point."""
    kinds = np.full(POINTS, OTHER, "uint8")
    for a, b in letters:
        kinds[a:b + 1] = LETTER
    for kind, members in ((JOINER, b"'-"), (STOP, b".!?"), (BLANK, BLANKS)):
        kinds[list(members)] = kind
    return kinds


class Cutter:
    """Cuts columns of lower-cased strings; made where the session is, used in tasks."""

    def __init__(self, spark: SparkSession):
        self.letters = _letters(spark)

    def __call__(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The words of all strings end to end, how many words a string and a sentence have, and how many sentences a string has."""
        column = column.fill_null("")
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, "int32")[column.offset:column.offset + len(column) + 1].astype("int64")
        data = np.frombuffer(data, "uint8")[ends[0]:ends[-1]] if data is not None else np.empty(0, "uint8")
        ends = ends - ends[0]
        at = None
        points = data
        if data.max(initial=0) > 127:
            first = (data & 0xC0) != 0x80  # bytes that open a character
            at = np.flatnonzero(first)
            points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "uint32")
            ends = np.searchsorted(at, ends)
        kind = _kinds(self.letters)[points]
        edge = np.zeros(len(kind) + 1, bool)  # where a string opens
        edge[ends] = True
        apart = edge[1:-1]
        letter, inside = kind == LETTER, kind == LETTER
        # ' and - belong to a word between two of its characters
        inner = (kind[1:-1] == JOINER) & letter[:-2] & letter[2:] & ~apart[:-1] & ~apart[1:]
        inside[1:-1] |= inner
        blank = kind == BLANK
        opens = ~blank
        opens[1:] &= ~(inside[1:] & inside[:-1]) | apart
        starts = np.flatnonzero(opens)
        n_words = np.diff(np.searchsorted(starts, ends))

        # a sentence opens a string, or comes after a stop and blanks
        heads = np.zeros(len(starts), bool)
        later = starts[1:]
        heads[1:] = (kind[starts[:-1]] == STOP) & blank[later - 1]
        firsts = np.cumsum(n_words) - n_words
        heads[firsts[n_words > 0]] = True
        head = np.flatnonzero(heads)
        n_sentences = np.diff(np.searchsorted(head, np.append(firsts, len(starts))))

        # all bytes but blanks belong to words
        solid = _kinds(self.letters)[data] != BLANK
        places, data = np.cumsum(solid, dtype="int32"), data[solid]
        places = np.append(places[starts if at is None else at[starts]] - 1, len(data)).astype("int32")
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data))
        return words, n_words, np.diff(np.append(head, len(starts))), n_sentences
