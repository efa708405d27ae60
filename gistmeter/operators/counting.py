"""Counting the tokens of pairs inside tasks, many pairs at a time.

Spark brings the rows of a pair together; a task then reads them as Arrow batches and counts numbers in numpy.  Tokens
never become rows of their own, so nothing but texts is sorted or shuffled, and a task holds a bounded piece of its pairs.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 1 << 17  # tokens that are counted together, or one pair's if it has more: their numbers stay near the processor
CUT = 1 << 19  # tokens that are cut out of texts together, so that one that comes again is looked up once
BYTES = 16 << 20  # of an Arrow batch
TOKEN_BYTES = 6  # of a text not yet split, for each token
FEW = 8  # segments that are not worth an addition for all
STEP = 1 << 12  # rows that are gathered at once
DENSE = 4  # times as many whole numbers as there are rows are counted in a table


def by_id(pairs: DataFrame, *columns: Column) -> DataFrame:
    """(first, id, columns): the rows of an id next to each other in one task, the first of them marked.  Tables laid out by
    id are not moved."""
    pairs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
    order = F.row_number().over(Window.partitionBy("id").orderBy("id"))
    return pairs.withColumn("_row", order).select((F.col("_row") == 1).alias("first"), "id", *columns)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that hold all rows of each of their ids."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        firsts = np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False))
        if len(firsts):
            if firsts[-1]:
                held.append(batch.slice(0, firsts[-1]))
            if held:
                yield _joined(held)
            held = []
            batch = batch.slice(firsts[-1])
        if batch.num_rows:
            held.append(batch)
    if held:
        yield _joined(held)


def lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype("int64")


def listed(values: pa.Array, like: pa.Array) -> pa.Array:
    """Lists of the lengths of others, NULL where they are."""
    offsets = np.concatenate([[0], np.cumsum(lengths(like))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=like.is_null())


def packed(values: np.ndarray, length: np.ndarray, nulls: pa.Array | None = None) -> pa.Array:
    """Lists of such lengths as bytes, which Spark passes on without a look at each number."""
    ends = np.concatenate([[0], np.cumsum(length)]) * 4
    data = pa.py_buffer(np.ascontiguousarray(values, "int32"))
    made = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends.astype("int32")), data])
    return made if nulls is None else pc.if_else(nulls, pa.scalar(None, pa.binary()), made)


def unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch with the lists that `packed` made bytes."""
    def lists(name: str, column: pa.Array) -> pa.Array:
        if name == "id" or not pa.types.is_binary(column.type):
            return column
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, "int32")[column.offset:column.offset + len(column) + 1] // 4
        values = pa.array([], pa.int32()) if data is None else pa.Array.from_buffers(pa.int32(), data.size // 4, [None, data])
        return pa.ListArray.from_arrays(pa.array(ends), values, mask=column.is_null())

    return pa.RecordBatch.from_arrays([lists(*x) for x in zip(batch.schema.names, batch.columns)], names=batch.schema.names)


def by_sentence(rows: pa.RecordBatch, side: str) -> pa.Array:
    """The words of a side by sentence, of lists or of a list and the sentences' lengths."""
    if f"{side}_sents" not in rows.schema.names:
        return rows.column(side)
    sents = rows.column(f"{side}_sents")
    ends = np.concatenate([[0], np.cumsum(sents.flatten().to_numpy())])
    return listed(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows.column(side).flatten()), sents)


def pieces(batches: Iterator[pa.RecordBatch], piece: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """(rows, number of each row's id, the ids): whole ids, so many that their lists hold about `piece` tokens."""
    for batch in map(unpacked, _whole(batches)):
        first = batch.column("first").to_numpy(zero_copy_only=False)
        first[0] = True
        size = np.ones(batch.num_rows, "int64")
        for column in batch.columns[2:]:
            if pa.types.is_list(column.type):
                size += lengths(column)
                if pa.types.is_list(column.type.value_type):
                    inner = np.concatenate([[0], np.cumsum(lengths(column.flatten()))])
                    ends = np.cumsum(lengths(column))
                    size += inner[ends] - inner[ends - lengths(column)]
            elif pa.types.is_string(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) // TOKEN_BYTES
        starts = np.flatnonzero(first)
        share = np.cumsum(np.add.reduceat(size, starts)) // piece
        cuts = [*starts[np.flatnonzero(np.diff(share, prepend=-1))], batch.num_rows]
        cuts[0] = 0
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            owner = np.cumsum(first[a:b]) - 1
            yield part, owner, part.column("id").take(pa.array(np.flatnonzero(first[a:b])))


def coded(*values: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    """The same numbers for the same strings in each array, and the strings.  Numbers stand for themselves."""
    if all(pa.types.is_integer(v.type) for v in values):
        return [pc.fill_null(v, -1).to_numpy(zero_copy_only=False).astype("int64") for v in values], None
    whole = pa.chunked_array([v.cast(pa.string()) for v in values], pa.string()).combine_chunks().dictionary_encode()
    codes = pc.fill_null(whole.indices, -1).to_numpy(zero_copy_only=False).astype("int64")
    return np.split(codes, np.cumsum([len(v) for v in values])[:-1]), whole.dictionary


def byte_runs(column: pa.Array, member: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of such bytes in each string, end to end, and how many a string has.  No member is part of a longer character."""
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, "int32")[column.offset:column.offset + len(column) + 1].astype("int64")
    data = np.frombuffer(data, "uint8")[ends[0]:ends[-1]] if data is not None else np.empty(0, "uint8")
    ends = ends - ends[0]
    inside = member[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | cut[1:-1]
    closes[:-1] &= ~inside[1:] | cut[1:-1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    places = np.concatenate([[0], np.cumsum(stops - starts)]).astype("int32")
    runs = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[inside]))
    return runs, np.diff(np.searchsorted(starts, ends))


def numbered(keys: np.ndarray) -> np.ndarray:
    """The rank of each of some whole numbers of at least 0 among the distinct ones."""
    n, top = len(keys), int(keys.max(initial=0))
    if top < DENSE * n:
        seen = np.zeros(top + 1, bool)
        seen[keys] = True
        return (np.cumsum(seen) - 1)[keys]
    bits = n.bit_length()
    if top.bit_length() + bits > 63:
        return np.unique(keys, return_inverse=True)[1]
    # sorting numbers with their places in them is faster than sorting places
    both = np.sort(keys << bits | np.arange(n))
    place, keys = both & ((1 << bits) - 1), both >> bits
    out = np.empty(n, "int64")
    out[place] = np.cumsum(np.diff(keys, prepend=keys[:1]) != 0)
    return out


def ranked(*columns: np.ndarray) -> np.ndarray:
    """A number for each distinct combination, in the order of the columns."""
    out = columns[0]
    if len(columns) == 1:
        return out
    most = 1 << (63 - len(out).bit_length())
    span = int(out.max(initial=0)) + 1
    for c in columns[1:]:
        low = int(c.min(initial=0))
        width = int(c.max(initial=0)) - low + 1
        if span * width >= most:
            out = numbered(out)
            span = int(out.max(initial=0)) + 1
        out, span = out * width + (c - low), span * width
    return numbered(out)


def first_of(group: np.ndarray, n: int) -> np.ndarray:
    """The first place of each of n groups."""
    out = np.empty(n, "int64")
    out[group[::-1]] = np.arange(len(group) - 1, -1, -1)
    return out


def within(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the row) of every element of rows of such lengths."""
    row = np.repeat(np.arange(len(length)), length)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)


def sums(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whole-number totals of n groups."""
    out = np.zeros(n, "int64")
    np.add.at(out, group, values.astype("int64"))
    return out


def narrow(table: np.ndarray, most: int) -> np.ndarray:
    """Whole numbers as 32 bits if sums of so many of them fit, else as 64."""
    return table.astype("int32" if int(np.abs(table).max(initial=0)) * most < 1 << 31 else "int64", copy=False)


def gathered_sums(table: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Totals of the rows that `at` names, from each start to the next, which have to fit the table's type.  The first rows of all segments are added,
    then the second ones and so on; the few long segments that are left are added one by one."""
    size = np.diff(np.append(starts, len(at)))
    order = np.argsort(-size, kind="stable")
    begin, size = starts[order], size[order]
    out, done, many = np.zeros((len(starts), table.shape[1]), table.dtype), 0, len(starts)
    while many:
        many = int(np.searchsorted(-size, -done))
        if many < FEW:
            break
        out[:many] += table[at[begin[:many] + done]]
        done += 1
    for i in range(many):
        for a in range(begin[i] + done, begin[i] + size[i], STEP):
            out[i] += table[at[a:min(a + STEP, begin[i] + size[i])]].sum(axis=0)
    back = np.empty((len(starts), table.shape[1]), "int64")
    back[order] = out
    return back


class Grams:
    """The distinct n-grams of two lists per row, the second the summary's, counted by id.

    `words` are n arrays of codes, -1 where a mark stands before a list; `owner` the number of the id.  An id with a list that
    has no gram gets one more, of n codes -2, as an outer explode makes it, if `outer`.
    """

    def __init__(self, batch: pa.RecordBatch, owner: np.ndarray, n_ids: int, n: int, pad: bool, outer: bool = True):
        text, summary = batch.column("t"), batch.column("s")
        (a, b), self.strings = coded(text.flatten(), summary.flatten())
        size = [lengths(text), lengths(summary)]
        parts = []
        for side, codes in enumerate((a, b)):
            row, place = within(size[side])
            words = [np.where(place >= k, np.concatenate([np.full(k, -1), codes[:len(codes) - k]]) if k <= len(codes) else -1, -1)
                     for k in range(n - 1, -1, -1)]
            keep = slice(None) if pad else place >= n - 1
            parts.append((row[keep], np.full(len(row), side)[keep], *[w[keep] for w in words]))
            if outer:
                none = np.flatnonzero(size[side] <= (0 if pad else n - 1))
                parts.append((none, np.full(len(none), 2), *[np.full(len(none), -2)] * n))
        self.row, side, *words = (np.concatenate(x) for x in zip(*parts))
        own = owner[self.row]
        self.context = ranked(own, *words[:-1]) if n > 1 else own
        self.gram = ranked(self.context, words[-1])
        self.n = int(self.gram.max(initial=-1)) + 1
        at = first_of(self.gram, self.n)
        self.owner, self.words = own[at], [w[at] for w in words]
        self.c_text = np.bincount(self.gram[side == 0], minlength=self.n)
        self.c_summary = np.bincount(self.gram[side == 1], minlength=self.n)
        of = self.context[at]
        self.c_context = np.bincount(of, weights=self.c_text).astype("int64")[of] if self.n else self.c_text
        self.n_text = np.bincount(self.owner, weights=self.c_text, minlength=n_ids).astype("int64")
        self.n_summary = np.bincount(self.owner, weights=self.c_summary, minlength=n_ids).astype("int64")

    def strings_of(self, k: int, mark: str | None = None) -> pa.Array:
        """The k-th words as strings; NULL in the grams of empty lists."""
        codes = np.where(self.words[k] == -1, len(self.strings), self.words[k])
        known = pa.concat_arrays([self.strings, pa.array([mark], pa.string())])
        return known.take(pa.array(codes, pa.int64(), mask=codes < 0))

    def largest(self, per_row: np.ndarray) -> np.ndarray:
        """The largest of a number of the rows each gram was found in."""
        out = np.full(self.n, -1)
        np.maximum.at(out, self.gram, per_row[self.row])
        return out


def mapped(rows: DataFrame, count, schema: str, piece: int = PIECE) -> DataFrame:
    """One Arrow batch of the schema, from `count(rows, owner, ids)`, for each piece of rows made by `by_id`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, owner, ids in pieces(batches, piece):
            made = count(part, owner, ids)
            yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))
    return rows.mapInArrow(run, schema)


def key_type(pairs: DataFrame) -> str:
    return pairs.schema["id"].dataType.simpleString()
