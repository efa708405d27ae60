"""Ranked lexical search: inverted lists in blocks of documents, read a term at a time with few accumulators.

A query's terms are taken from the rarest on.  Once what the remaining terms can add at most is less than the
k-th best partial score, no further document can enter: no accumulators are made any more, and those that exist
are updated to their exact scores.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gistmeter.llm.columns import LOWER, row_slices, runs, text_column
from gistmeter.llm.shared import text_documents, written

# What a term is, and the constants of its score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UNIT, STEP, LENGTH, WEIGHT, HALF = 1_000_000_000, 1000, 20, 1000, 50
TOP = 50

BLOCK_BYTES = 8 << 20  # text of a block of documents; a longer text is a block of its own
PIECE = 2 << 20  # bytes of text that are cut into terms at once
QUERY_TERMS = 1_000_000  # (item, term) pairs that are searched for at once
INDEX = "block long, term string, docs array<int>, counts array<int>, ids array<long>"
_IN_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms(piece: np.ndarray, near: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of some bytes in order, dictionary-encoded, and where each starts."""
    member = _IN_TERM[piece]
    starts, ends = runs(member, near)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = LOWER[piece[member]]
    strings = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))
    return strings.dictionary_encode(), starts


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that cut no term in two."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        while end < n and (gap := np.flatnonzero(~_IN_TERM[data[end - 1:end + PIECE]])).size == 0:
            end = min(n, end + PIECE)
        if end < n:
            end = end + int(gap[0])
        yield at, end
        at = end


def _inverted(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, where each one's list starts, documents and counts of all lists, terms per document) of some rows."""
    rows = len(offsets) - 1
    names, keys, weights, lengths = [], [], [], np.zeros(rows, np.int64)
    for at, end in _pieces(data):
        near = offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, end)] - at
        found, starts = _terms(data[at:end], near)
        row = np.searchsorted(offsets, starts + at, "right") - 1
        lengths += np.bincount(row, minlength=rows)
        pairs, times = np.unique(found.indices.to_numpy().astype(np.int64) * rows + row, return_counts=True)
        names.append(found.dictionary)
        keys.append(pairs)
        weights.append(times)
    if not names:
        return pa.array([], pa.string()), np.zeros(1, np.int64), np.empty(0, np.int32), np.empty(0, np.int32), lengths
    both = pa.concat_arrays(names).dictionary_encode()  # pieces share terms
    codes, base = both.indices.to_numpy().astype(np.int64), np.cumsum([0] + [len(n) for n in names])
    key = np.concatenate([codes[base[k] + pairs // rows] * rows + pairs % rows for k, pairs in enumerate(keys)])
    key, where = np.unique(key, return_inverse=True)
    counts = np.bincount(where, np.concatenate(weights), len(key)).astype(np.int32)
    starts = np.searchsorted(key // rows, np.arange(len(both.dictionary) + 1))
    return both.dictionary, starts, (key % rows).astype(np.int32), counts, lengths


def build_index(docs: DataFrame) -> DataFrame:
    """Write and return the index (INDEX) of all documents; texts do not move and no row leaves its task.

    Each block has a row per term: its documents, as places in the block, and how often each holds it.  One more
    row, whose term is null, has the ids of the block's documents and how many terms each has.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = text_column(batch)
            for lo, hi in row_slices(offsets, BLOCK_BYTES):
                near = offsets[lo:hi + 1] - offsets[lo]
                terms, starts, places, counts, lengths = _inverted(data[offsets[lo]:offsets[hi]], near)
                rows = len(terms) + 1
                starts = np.append(starts, starts[-1] + hi - lo).astype(np.int32)
                places = np.append(places, np.arange(hi - lo, dtype=np.int32))
                counts = np.append(counts, lengths.astype(np.int32))
                ids = pa.ListArray.from_arrays(pa.array(np.append(np.zeros(rows, np.int32), hi - lo), pa.int32()),
                                               batch.column(0).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, block), pa.int64()), pa.concat_arrays([terms, pa.nulls(1, pa.string())]),
                     pa.ListArray.from_arrays(starts, places), pa.ListArray.from_arrays(starts, counts), ids],
                    names=["block", "term", "docs", "counts", "ids"])
                block += 1

    return written(text_documents(docs).mapInArrow(task, INDEX), "lexical-index")


@dataclass
class Queries:
    """A bounded block of items: the numbers of their terms from the rarest on, and the weight of each term."""

    ids: list
    terms: list[np.ndarray]
    weights: np.ndarray
    documents: int  # with at least one term
    total: int  # terms of all documents


def _chunks(benchmark: DataFrame, most: int) -> Iterator[dict]:
    """{item_id: terms} of a bounded part of the benchmark at a time."""
    lowered = F.translate("text", _UPPER, _LOWER)
    pairs = benchmark.select("item_id", F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term"))
    chunk, held = {}, 0
    for row in pairs.distinct().orderBy("item_id", "term").toLocalIterator():
        if held >= most and row["item_id"] not in chunk:
            yield chunk
            chunk, held = {}, 0
        chunk.setdefault(row["item_id"], []).append(row["term"])
        held += 1
    if chunk:
        yield chunk


def _lengths(n: np.ndarray, queries: Queries) -> np.ndarray:
    """Each document's m, in whole numbers even where a product takes more than 63 bits."""
    if len(n) and HALF * int(n.max()) * queries.documents >= 1 << 63:
        return np.array([HALF + HALF * int(v) * queries.documents // queries.total for v in n], np.int64)
    return HALF + HALF * n * queries.documents // max(queries.total, 1)


class _Best:
    """The best documents of an item so far: highest score first, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.nulls = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        scores, ids, nulls = (np.concatenate(both) for both in ((self.scores, scores), (self.ids, ids), (self.nulls, nulls)))
        first = np.lexsort((ids, nulls, -scores))[:self.k]
        self.scores, self.ids, self.nulls = scores[first], ids[first], nulls[first]

    @property
    def bound(self) -> int:
        """A score that k documents have at least; 0 while there are fewer."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0


def _accumulated(lists: list[tuple[np.ndarray, np.ndarray, int]], size: int, k: int, bound: int) -> np.ndarray:
    """Scores of a block's documents, exact for every one that may be among the best k, else 0 or too low.

    `lists` are (documents, what the term adds, the most it adds), rarest term first.
    """
    scores = np.zeros(size, np.int64)
    rest = sum(most for _, _, most in lists)
    creating, kept = True, None
    for places, adds, most in lists:
        if creating and rest < bound:
            creating, kept = False, scores > 0
        if creating:
            scores[places] += adds
            live = scores[scores > 0]
            if len(live) >= k:
                bound = max(bound, int(np.partition(live, len(live) - k)[len(live) - k]))
        else:
            mine = kept[places]
            scores[places[mine]] += adds[mine]
        rest -= most
    return scores


def _search_block(lists: dict[int, tuple[np.ndarray, np.ndarray]], ids: pa.Array, n: np.ndarray, queries: Queries, best: list[_Best]) -> None:
    m, adds = _lengths(n.astype(np.int64), queries), {}
    for t, (places, counts) in lists.items():
        tf = counts.astype(np.int64)
        gain = queries.weights[t] * (UNIT * tf // (STEP * tf + LENGTH * m[places]))
        adds[t] = places, gain, int(gain.max())
    numbers, nulls = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    for terms, top in zip(queries.terms, best):
        mine = [adds[t] for t in terms.tolist() if t in adds]
        if sum(most for _, _, most in mine) < max(top.bound, 1):
            continue
        scores = _accumulated(mine, len(n), top.k, top.bound)
        found = np.flatnonzero(scores >= max(top.bound, 1))
        if len(found):
            top.add(scores[found], numbers[found], nulls[found])


def search(index: DataFrame, benchmark: DataFrame, k: int = TOP, query_terms: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its k documents of highest score above 0, from rank 1.

    Equal scores are ranked by doc_id, null ids last.  Rows that share an item_id, null included, are one item with
    the terms of all.  Items without terms, or without a document that holds one, have no rows.  Null and empty texts
    have no terms.  Repeated rows of `documents` are documents of their own.  Other columns are ignored.  Empty
    tables give an empty result.

    Items are taken in blocks of `query_terms` (item, term) pairs.  Only lists of a block's terms are shuffled, by
    block of documents; each task keeps the best k of an item over its blocks, whose k-th score is the bound the next
    block starts from, and passes on at most k rows per item.
    """
    spark = index.sparkSession
    sizes = index.filter("term is null").select(F.explode("counts").alias("n"))
    corpus = sizes.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    kind = benchmark.schema["item_id"].dataType
    shape = f"item_id {kind.simpleString()}, doc_id long, score long"
    arrow_kind, found = to_arrow_type(kind), None
    for chunk in _chunks(benchmark, query_terms):
        names = sorted({t for terms in chunk.values() for t in terms})
        number = {t: i for i, t in enumerate(names)}
        asked = F.broadcast(spark.createDataFrame(list(number.items()), "term string, t int"))  # at most a block's terms
        lists = index.join(asked, "term", "left").filter("t is not null or term is null")
        df = np.zeros(len(names), np.int64)
        for row in lists.filter("t is not null").groupBy("t").agg(F.sum(F.size("docs")).alias("df")).collect():  # a row for each term of the block
            df[row["t"]] = row["df"]
        weights = np.array([math.floor(WEIGHT * math.log((2 * corpus["documents"] + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        order = [np.array(sorted((number[t] for t in terms), key=lambda i: (df[i], i))) for terms in chunk.values()]
        shared = spark.sparkContext.broadcast(Queries(list(chunk), order, weights, corpus["documents"], corpus["total"]))

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            queries = shared.value
            best = [_Best(k) for _ in queries.ids]
            block, lists, ids, n = None, {}, None, None
            for batch in batches:
                blocks, numbers = batch.column(0).to_numpy(), batch.column(1).fill_null(-1).to_numpy()
                for r in range(len(batch)):
                    if blocks[r] != block:
                        if block is not None:
                            _search_block(lists, ids, n, queries, best)
                        block, lists = blocks[r], {}
                    counts = batch.column(3)[r].values.to_numpy()
                    if numbers[r] < 0:
                        ids, n = batch.column(4)[r].values, counts
                    else:
                        lists[int(numbers[r])] = batch.column(2)[r].values.to_numpy(), counts
            if block is not None:
                _search_block(lists, ids, n, queries, best)
            for item, top in zip(queries.ids, best):
                if len(top.scores):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(top.scores), arrow_kind), pa.array(top.ids, pa.int64(), mask=top.nulls), pa.array(top.scores, pa.int64())],
                        names=["item_id", "doc_id", "score"])

        dealt = lists.select("block", "t", "docs", "counts", "ids").repartition("block").sortWithinPartitions("block")
        part = dealt.mapInArrow(task, shape)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], shape)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
