"""Repeated lines removed by probing a sharded minimal perfect hash."""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmeter.llm.columns import mixed
from gistmeter.llm.shared import fresh_folder, mapped_array, write_arrays, written

BLANK = b" \t\n\x0b\x0c\r"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SHORTEST = 10  # code points of a key that counts
SHARD_KEYS = 250_000
NO_ID = (1 << 63) - 1  # a row without an id counts as one last document
GAMMA = 1.5


def line_key(line: bytes) -> bytes:
    return line.translate(LOWER).strip(BLANK)


def _counts(key: bytes) -> bool:
    return len(key) >= 4 * SHORTEST or len(key) >= SHORTEST and len(key.decode("utf-8", "replace")) >= SHORTEST


def line_digests(text: str) -> list[bytes | None]:
    """A 128-bit digest of every line's key; None for a key too short to count."""
    return [xxhash.xxh3_128_digest(k) if _counts(k) else None for k in map(line_key, text.encode().split(b"\n"))]


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, ids, n = [], [], 0
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            own = set(line_digests(text.as_py()))
            own.discard(None)
            digests.extend(own)
            ids.append((NO_ID if doc_id.as_py() is None else doc_id.as_py(), len(own)))
            if len(digests) > 200_000:
                yield _digest_batch(digests, ids)
                digests, ids = [], []
        yield _digest_batch(digests, ids)


def _digest_batch(digests: list[bytes], ids: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    owner = np.repeat(np.array([i for i, _ in ids], np.int64), [n for _, n in ids])
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])),
                                       pa.array(owner)], names=["hi", "lo", "doc_id"])


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(hi, lo, first, docs): digests of keys found in at least two documents, and the smallest doc_id."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = found.mapInArrow(_digest_rows, "hi long, lo long, doc_id long")
    return (rows.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("docs"))
            .filter("first < last").drop("last"))


def _position(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return (mixed(hi ^ mixed(lo + step)) % np.uint64(size)).astype(np.int64)


def perfect_hash(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, bits, ranks) of a minimal perfect hash of distinct keys.

    A key takes its place in the first level where no other key falls on it; the others go on to the next.
    """
    sizes, words = [], []
    while len(hi):
        size = int(np.ceil(len(hi) * GAMMA / 64) + 1) * 64
        at = _position(hi, lo, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        rest = ~alone[at]
        hi, lo = hi[rest], lo[rest]
    bits = np.concatenate(words) if words else np.empty(0, np.uint64)
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.uint32)]).astype(np.uint32)
    return np.array(sizes, np.int64), bits, ranks


def hash_index(hi: np.ndarray, lo: np.ndarray, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The index of each key from 0 on; some index or -1 for keys the hash was not made of."""
    out = np.full(len(hi), -1, np.int64)
    left, base = np.arange(len(hi)), 0
    for level, size in enumerate(sizes):
        at = _position(hi[left], lo[left], level, int(size)) + base
        word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
        out[left[hit]] = ranks[at[hit] >> 6].astype(np.int64) + below
        left, base = left[~hit], base + int(size)
    return out


class LineIndex:
    """Shards of a written index, each mapped when it is first asked for."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards, self.open = folder, shards, {}

    def shard(self, k: int):
        if k not in self.open:
            kinds = (("sizes", np.int64), ("bits", np.uint64), ("ranks", np.uint32), ("print", np.uint64), ("first", np.int64), ("docs", np.uint32))
            self.open[k] = [mapped_array(self.folder, f"s{k}", key, dtype) for key, dtype in kinds]
        return self.open[k]

    def first_holders(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The smallest doc_id that holds each key, or -1 where the key was in one document only; and where found."""
        first, found = np.full(len(hi), -1, np.int64), np.zeros(len(hi), bool)
        shard = hi.view(np.int64) % self.shards
        for k in np.unique(shard):
            mine = np.flatnonzero(shard == k)
            sizes, bits, ranks, prints, firsts, _ = self.shard(int(k))
            if not len(prints):
                continue
            at = hash_index(hi[mine], lo[mine], sizes, bits, ranks)
            hit = (at >= 0) & (prints[np.maximum(at, 0)] == lo[mine])
            first[mine[hit]], found[mine[hit]] = firsts[at[hit]], True
        return first, found


@lru_cache(maxsize=4)
def _index(folder: str, shards: int) -> LineIndex:
    return LineIndex(folder, shards)


def build_index(repeated: DataFrame, folder: str) -> int:
    """Write the index of `repeated_lines` to the shared folder, one shard to a task; returns the number of shards."""
    shards = max(1, -(-repeated.count() // SHARD_KEYS))

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        hi, lo = rows["hi"].to_numpy().view(np.uint64), rows["lo"].to_numpy().view(np.uint64)
        sizes, bits, ranks = perfect_hash(hi, lo)
        at = hash_index(hi, lo, sizes, bits, ranks)
        order = np.empty(len(at), np.int64)
        order[at] = np.arange(len(at))
        write_arrays(folder, f"s{int(key[0])}", {
            "sizes": sizes, "bits": bits, "ranks": ranks, "print": lo[order], "first": rows["first"].to_numpy()[order],
            "docs": np.minimum(rows["docs"].to_numpy()[order], (1 << 32) - 1).astype(np.uint32)})
        return pd.DataFrame({"shard": [int(key[0])], "keys": [len(hi)]})

    keyed = repeated.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("long"))
    built = keyed.groupBy("shard").applyInPandas(build, "shard long, keys long").collect()  # a row for each shard
    for k in set(range(shards)) - {r["shard"] for r in built}:
        write_arrays(folder, f"s{k}", {key: np.empty(0, np.int64) for key in ("sizes", "bits", "ranks", "print", "first", "docs")})
    return shards


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`docs` without repeated lines: text is what stays, and n_lines (before) and n_dropped (long) are added.

    A line's key is the line without blanks at its ends and with A-Z in lower case.  A key of at least
    SHORTEST code points that at least two documents hold is kept in the one with the smallest doc_id, in
    all its lines there; elsewhere its lines go.  Other lines stay as they are, joined by a line break.
    A null or empty text is one empty line.  Rows that repeat a doc_id are one document; rows whose doc_id
    is null are together one last document.  Other columns pass through; n_lines and n_dropped replace
    columns of these names.  An empty table gives an empty result.

    Digests of 128 bits are counted by Spark with partial counts in each task, so a line that all documents
    share is one row a task.  Keys of one document alone need no entry, as nothing is done about them; the
    fingerprint tells them from the others.  Documents are read once more and probe the mapped shards; no
    line is joined and no document moved.
    """
    spark, folder = docs.sparkSession, fresh_folder(docs.sparkSession, "line-index")
    shards = build_index(written(repeated_lines(docs), "repeated-lines"), folder)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    asked = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text"), F.struct(*rest).alias("rest"))
    schema = T.StructType([asked.schema["rest"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(folder, shards)
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                yield _probed(part, index)

    kept = asked.mapInArrow(probe, schema)
    return kept.select("rest.*", "text", "n_lines", "n_dropped").select(
        *[f"`{c}`" for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def _probed(batch: pa.RecordBatch, index: LineIndex) -> pa.RecordBatch:
    ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
    texts = batch.column(1).to_pylist()
    digests = [line_digests(t) for t in texts]
    flat = np.frombuffer(b"".join(d for own in digests for d in own if d), np.uint64).reshape(-1, 2)
    first, found = index.first_holders(np.ascontiguousarray(flat[:, 0]), np.ascontiguousarray(flat[:, 1]))
    owner = np.repeat(ids, [sum(d is not None for d in own) for own in digests])
    drop = iter((found & (first != owner)).tolist())
    out, lines, dropped = [], [], []
    for text, own in zip(texts, digests):
        parts = text.split("\n")
        stay = [p for p, d in zip(parts, own) if d is None or not next(drop)]
        out.append("\n".join(stay))
        lines.append(len(parts))
        dropped.append(len(parts) - len(stay))
    return pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.string()), pa.array(lines, pa.int64()),
                                       pa.array(dropped, pa.int64())], names=["rest", "text", "n_lines", "n_dropped"])
