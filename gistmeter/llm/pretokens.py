"""Splitting texts before the merges, by character classes of whole columns.

The split is that of the public pattern
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from itertools import chain

import numpy as np
import pyarrow as pa

from gistmeter.llm.columns import runs, span_hashes

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
ONE, TWO = [b"s", b"t", b"m", b"d"], [b"re", b"ve", b"ll"]


class Splitter:
    """Classes of characters are asked of a library once each: `probe` takes a list of characters."""

    def __init__(self, probe):
        self.probe = probe
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.classes[:128] = [SPACE if chr(c).isspace() and c not in range(28, 32) else LETTER if chr(c).isalpha() else
                              NUMBER if chr(c).isdigit() else OTHER for c in range(128)]

    def of(self, points: np.ndarray) -> np.ndarray:
        found = self.classes[points]
        if (found == UNKNOWN).any():
            fresh = np.unique(points[found == UNKNOWN])
            self.classes[fresh] = self.probe([chr(c) for c in fresh])
            found = self.classes[points]
        return found

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends, in bytes, of the pieces of all rows in order.  `offsets` start at 0."""
        n = len(data)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # where characters start
        points = data[at].astype(np.int64)
        wide = np.flatnonzero(points >= 0xC0)
        if len(wide):
            points[wide] = _decoded(data, at[wide])
        kind = self.of(points)
        m = len(at)
        rows = np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])  # first characters of rows
        fresh = np.zeros(m + 1, bool)
        fresh[rows] = True
        fresh[m] = True
        start = fresh[:m].copy()
        start[1:] |= kind[1:] != kind[:-1]
        blank_from, blank_to = runs(kind == SPACE, rows)
        inside = ~fresh[blank_to]  # a text goes on behind the blanks
        last = blank_to[inside] - 1
        start[last] = True
        joined = last[points[last] == 0x20]
        start[joined + 1] = False
        self._contractions(data, at, points, fresh, start)
        first = np.flatnonzero(start)
        starts = at[first]
        return starts, np.append(starts[1:], n)

    @staticmethod
    def _contractions(data, at, points, fresh, start) -> None:
        m = len(at)
        quote = np.flatnonzero((points == 0x27) & start)
        for suffixes, length in ((ONE, 1), (TWO, 2)):
            q = quote[quote + length < m]
            for k in range(1, length + 1):
                q = q[~fresh[q + k]]
            hit = np.zeros(len(q), bool)
            for s in suffixes:
                same = np.ones(len(q), bool)
                for k, c in enumerate(s):
                    same &= points[q + 1 + k] == c
                hit |= same
            q = q[hit]
            start[q + 1] = False
            after = q + length + 1
            start[after[after < m]] = True

    def pieces(self, data: np.ndarray, offsets: np.ndarray):
        """(starts, ends, first, which): piece spans, an example of each distinct piece, and which one each is."""
        starts, ends = self.split(data, offsets)
        coded = pa.array(span_hashes(data, starts, ends)).dictionary_encode()  # distinct ones in order of appearance
        which = coded.indices.to_numpy()
        first = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))
        return starts, ends, coded.dictionary.to_numpy(), first, which


def _decoded(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of multi-byte characters of valid UTF-8."""
    lead, padded = data[at].astype(np.int64), np.concatenate([data, np.zeros(3, np.uint8)])
    b1, b2, b3 = (padded[at + k].astype(np.int64) & 0x3F for k in (1, 2, 3))
    return np.where(lead < 0xE0, (lead & 0x1F) << 6 | b1,
                    np.where(lead < 0xF0, (lead & 0x0F) << 12 | b1 << 6 | b2, (lead & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))


def expanded(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions of spans end to end."""
    ends = np.cumsum(length)
    return np.repeat(begin - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


class Memo:
    """Ids of pieces by their hash, in sorted arrays: about the `most` pieces used last."""

    def __init__(self, encode, most: int):
        self.encode, self.most, self.now = encode, most, 0
        self.keys, self.begin, self.length, self.used = np.empty(0, np.uint64), *(np.empty(0, np.int32) for _ in range(3))
        self.pool, self.filled = np.empty(1 << 16, np.uint32), 0

    def ids(self, data: np.ndarray, splitter: Splitter, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): ids of all rows end to end, and where each row's ids end."""
        starts, ends, distinct, first, which = splitter.pieces(data, offsets)
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == distinct
        fresh = np.flatnonzero(~known)
        if len(fresh):
            fresh = fresh[np.argsort(distinct[fresh])]
            spans = first[fresh]
            self._learn(distinct[fresh], place[fresh], [data[a:b].tobytes() for a, b in zip(starts[spans].tolist(), ends[spans].tolist())])
            place = np.searchsorted(self.keys, distinct)
        self.used[place] = self.now
        each = self.length[place][which].astype(np.int64)
        ids = self.pool[expanded(self.begin[place][which].astype(np.int64), each)]
        self.now += 1
        if len(self.keys) > self.most:
            self._forget()
        row = np.searchsorted(starts, offsets[1:])
        return ids, np.concatenate([[0], np.cumsum(each)])[row]

    def _learn(self, keys: np.ndarray, place: np.ndarray, pieces: list[bytes]) -> None:
        parts = list(self.encode(pieces))
        length = np.fromiter(map(len, parts), np.int32, len(parts))
        size = int(length.sum())
        if self.filled + size > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.filled], np.empty(self.filled + 2 * size, np.uint32)])
        self.pool[self.filled:self.filled + size] = np.fromiter(chain.from_iterable(parts), np.uint32, size)
        begin = self.filled + np.cumsum(length) - length
        self.filled += size
        news = keys, begin, length, np.full(len(keys), self.now)
        self.keys, self.begin, self.length, self.used = (
            np.insert(old, place, new.astype(old.dtype)) for old, new in zip((self.keys, self.begin, self.length, self.used), news))

    def _forget(self) -> None:
        """Keep the half that was used last."""
        keep = np.sort(np.argsort(self.used, kind="stable")[-(self.most // 2):])
        pool = self.pool[expanded(self.begin[keep].astype(np.int64), self.length[keep].astype(np.int64))]
        self.keys, self.length, self.used = self.keys[keep], self.length[keep], self.used[keep]
        self.begin = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.pool, self.filled = pool, len(pool)
