"""Text columns of Arrow batches as flat byte arrays, and hashes of words in them."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE = 1 << 20
_FACTOR = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def text_column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the offsets of its rows."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def row_slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer row is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_FACTOR, pow(_FACTOR, -1, 1 << 64))):
            run = np.full(n, base, np.uint64)
            run[0] = 1
            _powers[k] = np.cumprod(run)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; the same bytes have the same hash wherever they stand."""
    up, down = powers(max(len(data), 1))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[data] * up[:len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[np.minimum(starts, len(down) - 1)]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(member: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of members, broken where a row starts."""
    n = len(member)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    fresh = np.zeros(n + 1, bool)
    fresh[row_starts[row_starts < n]] = True
    fresh[n] = True
    first = member.copy()
    first[1:] &= ~member[:-1] | fresh[1:n]
    last = member.copy()
    last[:-1] &= ~member[1:] | fresh[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word, a maximal run of non-blank bytes, in order.  `offsets` start at 0.

    Long texts are taken piece by piece, cut at blanks, so memory stays bounded.
    """
    hashes, rows, at, n = [], [], 0, len(data)
    while at < n:
        end = min(n, at + 2 * SLICE)
        if end < n:
            gap = np.flatnonzero(BLANKS[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:
                while end < n and not BLANKS[data[end]]:
                    end += 1
        piece = data[at:end]
        if lower:
            piece = LOWER[piece]
        near = offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, end)] - at
        starts, ends = runs(~BLANKS[piece], near)
        hashes.append(span_hashes(piece, starts, ends))
        rows.append(np.searchsorted(offsets, starts + at, "right") - 1)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def signed(h: np.ndarray) -> pa.Array:
    """Unsigned numbers as Spark's long."""
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def column_values(batch: pa.RecordBatch, name: str, null: int, dtype=np.int64) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return (column.fill_null(null) if column.null_count else column).to_numpy(zero_copy_only=False).astype(dtype)


def boundaries(rows: np.ndarray, n: int) -> np.ndarray:
    """Of values in row order, where each of the n rows starts, and the end."""
    return np.searchsorted(rows, np.arange(n + 1))
