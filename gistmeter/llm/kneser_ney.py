"""An interpolated modified Kneser-Ney bigram model, counted in Spark and kept in mapped sorted arrays."""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.llm.columns import SLICE, boundaries, mixed, row_slices, text_column, words
from gistmeter.llm.shared import file_system, fresh_folder, mapped_array, text_documents, write_arrays

END = 1  # the end's hash
VOCABULARY_BYTES = 128 << 20  # text for each shard of the vocabulary
PAIR_BYTES = 32 << 20  # text for each bucket of pairs
HOT = 1 << 20  # a word counted more often has its followers dealt over many buckets
FOLLOWERS = 1 << 16  # followers of such a word that stay together
HELD = 1 << 22  # keys a task holds before it counts them
MOST_WORDS = (1 << 32) - 2
FIGURES = ("contexts", "once", "twice", "more")  # contexts of a word; its followers by how often they follow


def packed(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys as differences and columns of 32-bit numbers, in byte planes."""
    parts = [len(keys).to_bytes(8, "little")]
    for values, kind in [(np.diff(keys, prepend=np.uint64(0)), "<u8"), *((c, "<u4") for c in columns)]:
        values = np.ascontiguousarray(values.astype(kind))
        parts.append(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())
    return zstandard.compress(b"".join(parts), 1)


def unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind, size in [("<u8", 8)] + [("<u4", 4)] * columns:
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * size
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def merged(blobs, columns: int) -> list[np.ndarray]:
    """Distinct keys in order, and the sums of their columns."""
    parts = [unpacked(b, columns) for b in blobs]
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return [keys[first]] + [np.add.reduceat(np.concatenate([p[c] for p in parts])[order].astype(np.int64), first) if len(first) else np.empty(0, np.int64)
                            for c in range(1, columns + 1)]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the rows' words, each row closed by END.  `offsets` start at 0."""
    h, row = words(data, offsets)
    n = len(offsets) - 1
    ends = boundaries(row, n)[1:]
    return np.insert(h, ends, np.uint64(END)), np.insert(row, ends, np.arange(n))


def _vocabulary_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _blob_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["shard", "blob"])


def _split(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(shard, kind="stable")
    first = np.flatnonzero(np.diff(shard[order], prepend=-1))
    return [(int(shard[order[a]]), packed(keys[order[a:b]], counts[order[a:b]])) for a, b in zip(first, np.append(first[1:], len(order)))]


def _counted(batches: Iterator[pa.RecordBatch], keys_of, shard_of) -> Iterator[pa.RecordBatch]:
    """Keys of each slice of texts, counted in the task before they are moved."""
    held, size = [], 0

    def flushed():
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        return _blob_batch(_split(keys, counts, shard_of(keys)))

    for batch in batches:
        data, offsets = text_column(batch)
        for lo, hi in row_slices(offsets, SLICE):
            held.append(keys_of(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]))
            size += len(held[-1])
            if size >= HELD:
                yield flushed()
                held, size = [], 0
    if size:
        yield flushed()


@dataclass(frozen=True)
class Model:
    """What a worker needs besides the folder: a bounded number of figures and a base for each shard."""

    folder: str
    bases: tuple[int, ...]  # rank of each vocabulary shard's first word; the last is the number of words
    buckets: int
    documents: int
    total: int
    discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    unigram_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    pairs: int = 0
    unigram_rest: float = 1.0

    @property
    def words(self) -> int:
        return self.bases[-1]

    def bucket(self, context: np.ndarray, word: np.ndarray, count: np.ndarray) -> np.ndarray:
        block = np.where(count > HOT, word // FOLLOWERS + 1, 0).astype(np.uint64)
        return (mixed(context.astype(np.uint64) * np.uint64(0x9E3779B1) + block) % np.uint64(self.buckets)).astype(np.int64)


class Tables:
    """The mapped arrays of a model, each opened when it is first asked for."""

    def __init__(self, folder: str):
        self.folder, self.open = folder, {}

    def __call__(self, name: str, key: str, dtype) -> np.ndarray:
        found = self.open.get((name, key))
        if found is None:
            if len(self.open) > 4000:
                self.open.clear()
            found = self.open[name, key] = mapped_array(self.folder, name, key, dtype)
        return found

    def ranks(self, model: Model, h: np.ndarray, columns: list[str]) -> list[np.ndarray]:
        """For sorted hashes: the word's rank, -1 if unknown, and its columns, 0 if unknown."""
        out = [np.full(len(h), -1, np.int64)] + [np.zeros(len(h), np.int64) for _ in columns]
        shard = _vocabulary_shard(h, len(model.bases) - 1)
        edges = np.searchsorted(shard, np.arange(len(model.bases)))
        for k in np.unique(shard):
            mine = slice(edges[k], edges[k + 1])
            known = self(f"v{k}", "hash", np.uint64)
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, h[mine]), len(known) - 1)
            hit = known[at] == h[mine]
            out[0][mine] = np.where(hit, at + model.bases[k], -1)
            for values, c in zip(out[1:], columns):
                values[mine] = np.where(hit, self(f"v{k}", c, np.int64 if c == "count" else np.uint32)[at], 0)
        return out

    def pair_counts(self, model: Model, context: np.ndarray, word: np.ndarray, count: np.ndarray) -> np.ndarray:
        """How often each pair of ranks was seen."""
        out = np.zeros(len(context), np.int64)
        key, bucket = _pair_key(context, word), model.bucket(context, word, count)
        order = np.lexsort((key, bucket))
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(order))):
            mine, k = order[a:b], int(bucket[order[a]])
            known = self(f"p{k}", "key", np.uint64)
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, key[mine]), len(known) - 1)
            small = np.where(known[at] == key[mine], self(f"p{k}", "count", np.uint8)[at], 0).astype(np.int64)
            large = np.flatnonzero(small == 255)
            if len(large):
                spot = np.searchsorted(self(f"p{k}", "large_at", np.int64), at[large])
                small[large] = self(f"p{k}", "large", np.int64)[spot]
            out[mine] = small
        return out


def _pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return context.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)


@lru_cache(maxsize=2)
def _tables(folder: str) -> Tables:
    return Tables(folder)


def sequences(model: Model, tables: Tables, data: np.ndarray, offsets: np.ndarray, columns: list[str]):
    """(row, context rank, word rank, context's columns, word's columns) of every token.

    The context of a row's first token is the start, whose rank is the number of words; -1 is unknown.
    """
    h, row = tokens(data, offsets)
    distinct, which = np.unique(h, return_inverse=True)
    found = [c[which] for c in tables.ranks(model, distinct, columns)]
    first = np.ones(len(h), bool)
    first[1:] = row[1:] != row[:-1]
    before = [np.where(first, start, np.roll(c, 1)) for c, start in zip(found, [model.words, *_start_columns(model, tables, columns)])]
    return row, before[0], found[0], before[1:], found[1:]


def _start_columns(model: Model, tables: Tables, columns: list[str]) -> list[int]:
    return [model.documents if c == "count" else int(tables("start", c, np.uint32)[0]) for c in columns]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from numbers of counts of 1 to 4; half a count more each where one of them is 0."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(float(min(max(k - (k + 1) * y * b / a, 0.0), k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _discounted(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *by])[np.minimum(counts, 3)], 0.0)


def train(docs: DataFrame) -> Model | None:
    """Count all of `docs` and write the model's arrays to the shared folder; None if there are no rows.

    First the vocabulary, by ranges of word hashes; a word's rank is its place in these sorted arrays.  Then
    pairs of ranks, by a hash of the context, and of a block of followers where the context is frequent, so
    no bucket depends on one word.  Then, by vocabulary shard, in how many contexts a word was seen and how
    many followers it had once, twice and more often.  Every step counts in the task first and moves packed
    runs of sorted keys.  Arrays in the shared folder outlive executors; only figures for each shard reach
    the driver.
    """
    spark, folder = docs.sparkSession, fresh_folder(docs.sparkSession, "bigrams")
    texts = text_documents(docs).select("text")
    bytes_, documents = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    if not documents:
        return None
    shards, buckets = max(1, -(-bytes_ // VOCABULARY_BYTES)), max(1, -(-bytes_ // PAIR_BYTES))

    def word_counts(batches):
        return _counted(batches, lambda data, offsets: tokens(data, offsets)[0], lambda h: _vocabulary_shard(h, shards))

    def vocabulary(key, rows: pd.DataFrame) -> pd.DataFrame:
        h, count = merged(rows["blob"], 1)
        write_arrays(folder, f"v{key[0]}", {"hash": h, "count": count})
        return pd.DataFrame({"shard": [key[0]], "words": [len(h)], "total": [int(count.sum())]})

    made = (texts.mapInArrow(word_counts, "shard long, blob binary").groupBy("shard")
            .applyInPandas(vocabulary, "shard long, words long, total long").collect())
    sizes = {r["shard"]: r["words"] for r in made}
    for k in set(range(shards)) - set(sizes):
        write_arrays(folder, f"v{k}", {"hash": np.empty(0, np.uint64), "count": np.empty(0, np.int64)})
    bases = tuple(np.concatenate([[0], np.cumsum([sizes.get(k, 0) for k in range(shards)])]).tolist())
    if bases[-1] > MOST_WORDS:
        raise ValueError(f"{bases[-1]} distinct words; pairs of ranks are held in 64 bits")
    model = Model(folder, bases, buckets, documents, sum(r["total"] for r in made))

    def pair_counts(batches):
        tables = _tables(folder)

        def keys(data, offsets):
            _, context, word, _, _ = sequences(model, tables, data, offsets, [])
            return _pair_key(context, word)

        def bucket(key):
            context, word = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            count = np.full(len(key), documents)
            edges = np.searchsorted(context, [*bases])
            for k in range(shards):
                mine = slice(edges[k], edges[k + 1])
                count[mine] = tables(f"v{k}", "count", np.int64)[context[mine] - bases[k]]
            return model.bucket(context, word, count)

        return _counted(batches, keys, bucket)

    def pairs(key, rows: pd.DataFrame) -> pd.DataFrame:
        pair, count = merged(rows["blob"], 1)
        large = np.flatnonzero(count >= 255)
        write_arrays(folder, f"p{key[0]}", {"key": pair, "count": np.minimum(count, 255).astype(np.uint8), "large_at": large, "large": count[large]})
        context, word = pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)
        owners, at = np.unique(context, return_index=True)
        often = [np.add.reduceat((count == k if k < 3 else count >= k).astype(np.int64), at) for k in (1, 2, 3)]
        seen, contexts = np.unique(word, return_counts=True)
        zero = np.zeros(len(seen), np.int64)
        everyone = np.concatenate([owners, seen])
        columns = [np.concatenate([np.zeros(len(owners), np.int64), contexts])] + [np.concatenate([o, zero]) for o in often]
        order = np.argsort(everyone, kind="stable")
        everyone, columns = everyone[order], [c[order] for c in columns]
        shard = np.searchsorted(np.array(bases[1:]), everyone.astype(np.int64), "right")
        edges = np.searchsorted(shard, np.arange(shards + 2))
        out = [(k, packed(everyone[edges[k]:edges[k + 1]], *[c[edges[k]:edges[k + 1]] for c in columns])) for k in range(shards + 1) if edges[k] < edges[k + 1]]
        out.append((-1, packed(np.arange(1, 5, dtype=np.uint64), np.bincount(np.minimum(count, 5), minlength=6)[1:5], *[np.zeros(4)] * 3)))
        return pd.DataFrame(out, columns=["shard", "blob"])

    def figures(key, rows: pd.DataFrame) -> pd.DataFrame:
        rank, contexts, *often = merged(rows["blob"], 4)
        k = int(key[0])
        if k < 0:
            n = contexts
        else:
            size, arrays = bases[k + 1] - bases[k] if k < shards else 1, {}  # the start has a shard of its own
            for name, values in zip(FIGURES, [contexts, *often]):
                arrays[name] = np.zeros(size, np.uint32)
                arrays[name][rank.astype(np.int64) - bases[k]] = values
            write_arrays(folder, f"v{k}" if k < shards else "start", arrays)
            n = np.bincount(np.minimum(contexts, 5), minlength=6)[1:5]
        return pd.DataFrame({"shard": [k], "n1": [int(n[0])], "n2": [int(n[1])], "n3": [int(n[2])], "n4": [int(n[3])],
                             "contexts": [0 if k < 0 else int(contexts.sum())], "words": [0 if k < 0 else int((contexts > 0).sum())]})

    counted = (texts.mapInArrow(pair_counts, "shard long, blob binary").groupBy("shard").applyInPandas(pairs, "shard long, blob binary"))
    totals = (counted.groupBy("shard").applyInPandas(figures, "shard long, n1 long, n2 long, n3 long, n4 long, contexts long, words long").collect())
    by = {r["shard"]: r for r in totals}
    for k in set(range(shards)) - set(by):
        write_arrays(folder, f"v{k}", {name: np.zeros(bases[k + 1] - bases[k], np.uint32) for name in FIGURES})
    store, base = file_system(folder)
    for k, info in enumerate(store.get_file_info([f"{base}/p{k}.large" for k in range(buckets)])):
        if not info.is_file:  # no pair fell into this bucket
            write_arrays(folder, f"p{k}", {name: np.empty(0, np.int64) for name in ("key", "count", "large_at", "large")})
    n = [by[-1][f"n{i}"] for i in range(1, 5)]
    own = [r for k, r in by.items() if 0 <= k < shards]
    t = [sum(r[f"n{i}"] for r in own) for i in range(1, 5)]
    pairs_total, seen = sum(r["contexts"] for r in own), sum(r["words"] for r in own)
    d, u = discounts(*n), discounts(*t)
    rest = (u[0] * t[0] + u[1] * t[1] + u[2] * (seen - t[0] - t[1])) / pairs_total
    return Model(folder, bases, buckets, documents, model.total, d, u, pairs_total, rest)


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"
BASE_ADDED = 0.1


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score), one row per row of `docs`, without a shuffle.

    score is the model's log10 probability of the words and the end; a text's first word follows the start,
    which is no token.  p(w|v) = (c(vw) - D)+ / c(v) + rest(v) p(w), p(w) = (contexts(w) - D)+ / pairs +
    rest / (words + 1), so unknown words have a share and all shares sum to one; behind an unknown word p(w)
    alone counts.  base_score is the sum of log10((c + 0.1) / (N + 0.1 (V + 1))).  A null or empty text is
    the end alone.  Without training rows N, V and all counts are 0 and score is 0 for every token, as the
    share of unknown words is all there is.  Repeated rows are scored each, other columns are ignored, and
    an empty table gives an empty result.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_column(batch)
            for lo, hi in row_slices(offsets, SLICE):
                columns = _scores(model, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, columns)], names=[c.split()[0] for c in SCORES.split(", ")])

    return text_documents(docs).mapInArrow(task, SCORES)


def _scores(model: Model | None, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    if model is None:
        count = np.bincount(tokens(data, offsets)[1], minlength=n)
        return [count, np.zeros(n, np.int64), count * np.log10(BASE_ADDED / (BASE_ADDED * 1)), np.zeros(n)]
    tables = _tables(model.folder)
    row, context, word, before, own = sequences(model, tables, data, offsets, ["count", *FIGURES])
    share = _discounted(own[1], model.unigram_discounts) / model.pairs + model.unigram_rest / (model.words + 1)
    followed = before[0] > 0
    base = np.maximum(before[0], 1)
    rest = np.where(followed, (model.discounts[0] * before[2] + model.discounts[1] * before[3] + model.discounts[2] * before[4]) / base, 1.0)
    seen = np.flatnonzero((context >= 0) & (word >= 0))
    together = np.zeros(len(row), np.int64)
    together[seen] = tables.pair_counts(model, context[seen], word[seen], before[0][seen])
    chance = _discounted(together, model.discounts) / base + rest * share
    simple = np.log10((own[0] + BASE_ADDED) / (model.total + BASE_ADDED * (model.words + 1)))
    return [np.bincount(row, minlength=n), np.bincount(row, own[0] > 0, n).astype(np.int64), np.bincount(row, simple, n), np.bincount(row, np.log10(chance), n)]


def held_out(doc_id):
    """Whether crc32 of the id as text is divisible by ten; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 10 == 0
