"""Benchmark passages in documents, found by shared q-grams in diagonal bands and verified by alignment."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.llm.columns import mixed, powers, row_slices, text_column
from gistmeter.llm.shared import text_documents

Q = 12
EDIT_SHARE = 0.05  # edits allowed, as a share of the passage's length
BLOCK_CHARS = 4_000_000  # characters of benchmark text that are searched for at once
SLICE = 1 << 17
FILTER_BITS = 22
HITS = 1 << 21  # hits that are counted at once
SHIFT = 1 << 40  # makes diagonals positive


_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_VALUES = mixed(np.arange(1, 0x110001, dtype=np.uint64))  # of code points


def folded(text: bytes) -> np.ndarray:
    """Code points of UTF-8 with A-Z in lower case and blanks as spaces, one for one."""
    return np.frombuffer(text.translate(_FOLD).decode().encode("utf-32-le"), np.uint32)


def budget(length: int, q: int = Q, share: float = EDIT_SHARE) -> int:
    """Edits allowed in a passage: by share, but few enough that a match shares a q-gram for certain."""
    return min(int(length * share), length // q - 1)


def gram_hashes(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q characters from each position on."""
    if len(points) < q:
        return np.empty(0, np.uint64)
    up, down = powers(len(points))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_VALUES[points] * up, out=sums[1:])
    return (sums[q:] - sums[:-q]) * down[:len(points) - q + 1]


@dataclass
class Passages:
    """q-grams of a bounded block of passages: sorted hashes, and the passages and places of each."""

    ids: list
    points: list
    grams: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    edits: np.ndarray
    needed: np.ndarray
    q: int

    @classmethod
    def of(cls, items: list[tuple], q: int = Q, share: float = EDIT_SHARE) -> "Passages":
        points = [folded(t.encode()) for _, t in items]
        hashes = [gram_hashes(p, q) for p in points]
        flat = np.concatenate([np.empty(0, np.uint64), *hashes])
        item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(h)) for h in hashes]])
        order = np.argsort(flat, kind="stable")
        grams, begin = np.unique(flat[order], return_index=True)
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[grams >> np.uint64(64 - FILTER_BITS)] = True
        edits = np.array([budget(len(p), q, share) for p in points], np.int64)
        needed = np.array([len(p) + 1 for p in points], np.int64) - q * (edits + 1)
        return cls([i for i, _ in items], points, grams, np.append(begin, len(flat)), item[order], place[order], seen, edits, needed, q)

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, gram): where the text has a q-gram of some passage."""
        h = gram_hashes(points, self.q)
        if not len(self.grams):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(self.seen[h >> np.uint64(64 - FILTER_BITS)])
        gram = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        real = self.grams[gram] == h[at]
        return at[real], gram[real]

    def regions(self, position: np.ndarray, gram: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """(first, last) diagonal of each band with enough q-grams, by passage.

        A match of length m with k edits keeps m + 1 - q(k + 1) q-grams of the passage, all on diagonals at
        most k apart.  Bands are 2k + 1 wide and begin every k + 1, so one of them holds all of these.
        Distinct q-grams of the passage are counted, so a text that repeats one of them gains nothing.
        """
        kept: dict[tuple[int, int], np.ndarray] = {}
        width = self.begin[gram + 1] - self.begin[gram]
        piece = np.cumsum(width) // HITS  # a gram that many passages repeat may give many hits
        for lot in np.unique(piece):
            g, pos, w = (x[piece == lot] for x in (gram, position, width))
            each = np.repeat(self.begin[g] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
            item, place = self.item[each], self.place[each]
            cell = (np.repeat(pos, w) - place + SHIFT) // (self.edits[item] + 1)
            for band in (cell, cell - 1):
                order = np.lexsort((band, item))
                fresh = np.flatnonzero(np.diff(item[order], prepend=-1) | np.diff(band[order], prepend=-1))
                for a, b in zip(fresh.tolist(), [*fresh[1:].tolist(), len(order)]):
                    key = (int(item[order[a]]), int(band[order[a]]))
                    own = kept.setdefault(key, np.zeros(len(self.points[key[0]]), bool))
                    own[place[order[a:b]]] = True
        out: dict[int, list] = {}
        for (item, band), own in sorted(kept.items(), key=lambda x: x[0]):
            k = int(self.edits[item])
            if own.sum() >= self.needed[item]:
                low = band * (k + 1) - SHIFT
                own_bands = out.setdefault(item, [])
                if own_bands and low <= own_bands[-1][1]:  # bands come in order; overlapping ones are aligned together
                    low = own_bands.pop()[0]
                own_bands.append((low, (band + 2) * (k + 1) - SHIFT))
        return out

    def find(self, points: np.ndarray, position: np.ndarray, gram: np.ndarray) -> list[tuple]:
        """(item_id, start, end, edits): the best match of each passage in the text, the leftmost of equals."""
        found = []
        for item, bands in self.regions(position, gram).items():
            passage = self.points[item]
            k = int(self.edits[item])
            best = min((m for low, high in bands if (m := aligned(passage, points, low, high, k))), default=None, key=lambda m: (m[2], m[0]))
            if best is not None:
                found.append((self.ids[item], *best))
        return found


def aligned(passage: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the whole passage in the text along diagonals low - k .. high + k, or None if it
    takes over k edits.  Fewest edits first, then the leftmost end, then the shortest match.

    One row of the banded table for each character of the passage, for all diagonals at once: insertions
    along a row are a running minimum.
    """
    low, high = low - k, high + k
    width, far = high - low + 1, 1 << 30
    offset = np.arange(width)
    a, b = max(low, 0), min(high + len(passage), len(text))
    if b - a >= len(passage):
        same = (np.lib.stride_tricks.sliding_window_view(text[a:b], len(passage)) == passage).all(axis=1)
        if same.any():
            start = a + int(same.argmax())
            return start, start + len(passage), 0
    where = offset + low  # text position before which the empty passage ends
    cost = np.where((where >= 0) & (where <= len(text)), 0, far)
    begin = where.copy()
    padded = np.full(width + len(passage) + 1, -1, np.int64)
    b = min(low + len(padded), len(text))
    if b > a:
        padded[a - low:b - low] = text[a:b]
    for i, c in enumerate(passage.tolist()):
        here = where + i + 1
        diagonal = cost + (padded[i:i + width] != c)
        up = np.append(cost[1:] + 1, far)
        take = up < diagonal
        new, source = np.where(take, up, diagonal), np.where(take, np.append(begin[1:], 0), begin)
        new = np.where((here >= 0) & (here <= len(text)), new, far)
        # an insertion costs one a step: the least of new[j] - j to the left
        lowest = np.minimum.accumulate(new - offset)
        left = lowest + offset
        at = np.maximum.accumulate(np.where(new - offset == lowest, offset, 0))
        cost, begin = np.minimum(new, left), source[at]
        if cost.min() > k:
            return None
    end = int(cost.argmin())
    return int(begin[end]), int(where[end] + len(passage)), int(cost[end])


MATCHES = "doc_id long, item_id long, start long, end long, edits long"
_NAMES = [c.split()[0] for c in MATCHES.split(", ")]


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, q: int = Q) -> Iterator[list[tuple]]:
    """The distinct passages in blocks of bounded text, one block on the driver at a time."""
    rows = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
            .filter(F.char_length("text") >= q).distinct().orderBy("item_id", "text"))
    block, held = [], 0
    for r in rows.toLocalIterator():
        if block and held + len(r["text"]) > block_chars:
            yield block
            block, held = [], 0
        block.append((r["item_id"], r["text"]))
        held += len(r["text"])
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, edits): every passage that occurs as a whole in a document with at most
    min(share * m, m // q - 1) edits of its m characters, in its best place there (in characters).

    A-Z counts as lower case and blanks as spaces.  Passages of fewer than q characters, null or empty, and
    null or empty documents match nothing.  A repeated row of documents has its matches again; equal
    passages under two item_ids are two items, repeated rows of `benchmark` one.  Other columns are ignored.
    Empty tables give an empty result.

    Documents are not moved: a bounded block of passages goes to every task, and a larger benchmark takes
    more passes over the documents.  The filter loses no match, as the bands count what a match must keep.
    """
    spark = docs.sparkSession
    texts, found = text_documents(docs), None
    for block in blocks(benchmark, block_chars, q):
        shared = spark.sparkContext.broadcast(Passages.of(block, q, share))

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _matched(batch, shared.value)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=_NAMES)

        part = texts.mapInArrow(task, MATCHES)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], MATCHES) if found is None else found


def _matched(batch: pa.RecordBatch, passages: Passages) -> list[tuple]:
    data, offsets = text_column(batch)
    out = []
    for lo, hi in row_slices(offsets, SLICE):
        # one text: q-grams that reach over two rows are left out below
        points = folded(data[offsets[lo]:offsets[hi]].tobytes())
        position, gram = passages.hits(points)
        if not len(position):
            continue
        texts = batch.column(1).slice(lo, hi - lo).to_pylist()
        ends = np.cumsum([len(t) for t in texts])
        row = np.searchsorted(ends, position, "right")
        inside = position + passages.q <= ends[row]
        inside &= np.bincount(row[inside], minlength=len(texts))[row] >= passages.needed.min()
        position, gram, row = position[inside], gram[inside], row[inside]
        ids = batch.column(0).slice(lo, hi - lo).to_pylist()
        for k in np.unique(row):
            mine = row == k
            start = int(ends[k]) - len(texts[k])
            out += [(ids[k], *m) for m in passages.find(points[start:ends[k]], position[mine] - start, gram[mine])]
    return out


def without_matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no passage by the rule of `matches`; no shuffle."""
    for block in blocks(benchmark, block_chars, q):
        shared = docs.sparkSession.sparkContext.broadcast(Passages.of(block, q, share))
        asked = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("rest"))

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = {m[0] for m in _matched(batch, shared.value)}
                yield batch.select([2]).filter(pa.array([r not in held for r in batch.column(0).to_pylist()], pa.bool_()))

        docs = asked.mapInArrow(task, asked.select("rest").schema).select("rest.*")
    return docs
