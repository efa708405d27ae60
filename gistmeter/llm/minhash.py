"""Near duplicates by bottom-k sketches, inverted lists and exact verification."""

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmeter.llm.columns import SLICE, boundaries, column_values, mixed, row_slices, signed, text_column, words
from gistmeter.llm.shared import fresh_folder, mapped_array, text_documents, write_arrays, written

SIMILAR = 80  # per cent
KEPT = 20  # values of a sketch
# Sets of 80 % similarity share at least ENOUGH of their KEPT values but in about two cases of ten million;
# sets of fewer than FULL elements are compared by all they have.
ENOUGH, FULL = 6, 17
COMMON = 2  # values of the rare part that candidates share
HUBS = 8  # members of a large cluster that all others are compared with first
SHARD_IDS = 1_000_000  # ids in a mapped array
LIST_BLOCK = 500  # members of a list, and members and values of a cluster, that a task compares with each other or another block
SET_BLOCK, SET_VALUES = 1000, 1_000_000
PAIRS = 50_000  # pairs of sketches that are looked at at once
EDGE_BLOCK = 100_000  # links that a task joins without rounds


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the rows' distinct shingles, by row and hash.  A row of fewer words is one shingle."""
    h, row = words(data, offsets)
    n = len(offsets) - 1
    edges = boundaries(row, n)
    count = np.diff(edges)
    grams, rows = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(h) >= size:
        grams = mixed(h[size - 1:] + np.uint64(size))
        for j in range(2, size + 1):
            grams = mixed(grams * np.uint64(0x9FB21C651E98DF25) + h[size - j:len(h) - j + 1])
        whole = row[size - 1:] == row[:len(row) - size + 1]
        grams, rows = grams[whole], row[size - 1:][whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        single = []
        for r in short:
            value = np.uint64(0x51ED270B)
            for w in h[edges[r]:edges[r + 1]]:
                value = mixed(np.array([value ^ w]) * np.uint64(0x9FB21C651E98DF25))[0]
            single.append(value)
        grams, rows = np.concatenate([grams, np.array(single, np.uint64)]), np.concatenate([rows, short])
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    return grams[fresh], rows[fresh]


def _per_slice(batch: pa.RecordBatch, size: int):
    data, offsets = text_column(batch)
    for lo, hi in row_slices(offsets, SLICE):
        grams, rows = shingle_hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], size)
        yield lo, hi, grams, boundaries(rows, hi - lo)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, a, b, sketch): size of the shingle set, a fingerprint of 128 bits of the whole set, and
    its KEPT smallest values, in order."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, grams, edges in _per_slice(batch, size):
                count = np.diff(edges)
                a, b = _fingerprints(grams, edges)
                length = np.minimum(count, KEPT)
                ends = np.cumsum(length)
                index = np.repeat(edges[:-1] - (ends - length), length) + np.arange(int(length.sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), signed(grams[index]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(count), pa.array(a), pa.array(b), lists],
                                                 names=["doc_id", "n", "a", "b", "sketch"])

    return text_documents(docs).mapInArrow(task, "doc_id long, n long, a long, b long, sketch array<long>")


def needed(n: Column) -> Column:
    """Values of its sketch that a set of n elements shares with any similar set."""
    return F.when(n < FULL, F.ceil(n * SIMILAR / 100)).otherwise(ENOUGH).cast("int")


def rare_pairs(sets: DataFrame) -> DataFrame:
    """(key, rep, n, head, head_n): inverted lists of pairs of rare retained values, with each list's first set.

    Sketches that share `needed` values share two of the rarest `size - needed + 2` of each, whatever the
    order.  So a set is listed under the pairs of these, and lists of frequent values are left to texts that
    have little else.  Values of one set alone link nothing but take their place among the rarest.  Sets of
    under four elements are similar to no other set.
    """
    values = sets.filter("n > 3").select("rep", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    mine = values.join(shared, "value").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("list")).join(sets.select("rep", "n"), "rep")
    kept = F.least("n", F.lit(KEPT)).cast("int")
    room = kept - needed(F.col("n")) + COMMON - (kept - F.size("list"))
    rare = mine.filter(room >= COMMON).select("rep", "n", F.transform(F.slice("list", F.lit(1), room), lambda v: v["value"]).alias("v"))
    pairs = F.flatten(F.transform("v", lambda x, k: F.transform(F.slice("v", k + 2, F.size("v")), lambda y: F.xxhash64(x, y))))
    listed = rare.select("rep", F.col("n").cast("int").alias("n"), F.explode(pairs).alias("key"))
    heads = listed.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last"), F.min_by("n", "rep").alias("head_n")).filter("head < last").drop("last")
    return listed.join(heads, "key")


def _near_size(n: str, m: str) -> Column:
    return (F.col(n) * 100 >= F.col(m) * SIMILAR) & (F.col(m) * 100 >= F.col(n) * SIMILAR)


def _short(sketch: str) -> Column:
    """The values' upper halves: enough to tell those of two sketches apart, in the same order."""
    return F.transform(sketch, lambda v: F.shiftrightunsigned(v, 33).cast("int"))


def _alike(a: str, b: str, n: str, m: str) -> Column:
    """Union sketch estimate: enough of the smallest values of the union are in both sketches."""
    both = F.array_intersect(a, b)
    union = F.slice(F.array_sort(F.array_union(a, b)), F.lit(1), F.greatest(F.size(a), F.size(b)))
    small = (F.col(n) < FULL) & (F.col(m) < FULL)
    return F.when(small, F.size(both) * 100 >= (F.col(n) + F.col(m) - F.size(both)) * SIMILAR).otherwise(F.size(F.array_intersect(both, union)) >= F.least(needed(F.col(n)), needed(F.col(m))))


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): the smallest node that edges (u, v) reach from each node, where that is another one."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(place, 2)
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _settled(links: DataFrame, what: str) -> DataFrame:
    """`components` of at most EDGE_BLOCK links, in one task."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.empty(0, np.int64)] * 2, *([c.to_numpy() for c in batch.columns] for batch in batches)]
        node, root = _stars(*(np.concatenate(x) for x in zip(*parts)))
        own = np.unique(root)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, own])), pa.array(np.concatenate([root, own]))], names=["node", "component"])

    pairs = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a != b")
    return written(pairs.repartition(1).mapInArrow(task, "node long, component long"), what)


def components(links: DataFrame, what: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for nodes with a link.

    Every node is pointed at the smallest neighbour it knows, in turn for smaller and larger neighbours,
    until nothing changes; each round is written, so its lineage is cut.  A node of many links is one window of narrow
    rows, which spills.  Once at most EDGE_BLOCK edges are left, a task joins them without further rounds.
    """
    if links.count() <= EDGE_BLOCK:
        return _settled(links, what)

    def mark(rows: DataFrame):
        return rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    around = Window.partitionBy("u")
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), what)
    before, now = None, mark(edges)
    while now != before and now[0] > EDGE_BLOCK:
        # larger neighbours of a node go to its smallest neighbour, known to its own row by a window of one shuffle
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        large = both.withColumn("m", F.least(F.min("v").over(around), F.col("u"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        # a node and its smaller neighbours go to the smallest of them
        joined = large.withColumn("m", F.min("v").over(around)).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = written(joined.filter("u > v").distinct(), what)
        before, now = now, mark(edges)
    if now != before:
        return _settled(edges.select(F.col("u").alias("a"), F.col("v").alias("b")), what)
    roots = edges.groupBy("u").agg(F.min("v").alias("component"))
    return roots.select(F.col("u").alias("node"), "component").union(roots.select(F.col("component").alias("node"), "component").distinct())


class _Forest:
    """Which numbers have been joined, directly or in steps."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (up := self.parent.get(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            self.parent[y] = x
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _complete(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Of rows sorted by their first columns: whole groups, and where each one starts, and the end."""
    def edges(rows: pa.RecordBatch) -> np.ndarray:
        values = [c.to_numpy() for c in rows.columns[:keys]]
        fresh = reduce(np.logical_or, [v[1:] != v[:-1] for v in values])
        return np.concatenate([[0], np.flatnonzero(fresh) + 1, [len(rows)]])

    held = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        starts = edges(rows)
        if starts[-2]:
            yield rows.slice(0, int(starts[-2])), starts[:-1]
        held = rows.slice(int(starts[-2]))
    if held is not None:
        yield held, edges(held)


def _links_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sketch_matrix(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches side by side, filled up with numbers that no sketch holds, and how long each is."""
    ends = lists.offsets.to_numpy()
    size = np.diff(ends)
    out = np.full((len(lists), KEPT), 1 << 40)
    out[np.arange(KEPT) < size[:, None]] = lists.values.to_numpy()[ends[0]:ends[-1]]
    return out, size


def _needed(n: np.ndarray) -> np.ndarray:
    return np.where(n < FULL, -(-n * SIMILAR // 100), ENOUGH)


def _alike_pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """`_alike` of pairs of rows of sketches."""
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    same = np.zeros(both.shape, bool)
    same[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] < 1 << 40)
    place = np.arange(both.shape[1]) - np.cumsum(same, axis=1)  # in the union
    shared, early = same.sum(1), (same & (place < longest[:, None])).sum(1)
    small = (n < FULL) & (m < FULL)
    return np.where(small, shared * 100 >= (n + m - shared) * SIMILAR, early >= np.minimum(_needed(n), _needed(m)))


def _linked_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join every two clusters of which a list holds an alike pair, directly or in steps.

    Columns: key, lo, hi, side, rep, n, cluster, sketch; where lo is not hi, only rows of different sides are compared.
    Pairs are looked at some thousands at once and nothing is passed on for clusters that the task has joined before.
    """
    forest = _Forest()
    for rows, starts in _complete(batches, 3):
        lo, hi, side, rep, n, cluster = (rows.column(k).to_numpy() for k in range(1, 7))
        sketch, size = _sketch_matrix(rows.column(7))
        index = np.arange(len(rows))
        after = starts[np.searchsorted(starts, index, "right")] - index - 1
        upto = np.concatenate([[0], np.cumsum(after)])
        known, place = np.unique(cluster, return_inverse=True)
        found, at = [], 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
            i = np.repeat(index[at:end], after[at:end])
            j = i + 1 + np.arange(len(i)) - (np.repeat(upto[at:end], after[at:end]) - upto[at])
            root = np.fromiter(map(forest.root, known.tolist()), np.int64, len(known))[place] if len(i) else cluster
            open_ = (root[i] != root[j]) & ((lo[i] == hi[i]) | (side[i] != side[j])) & (n[i] * 100 >= n[j] * SIMILAR) & (n[j] * 100 >= n[i] * SIMILAR)
            i, j = i[open_], j[open_]
            alike = _alike_pairs(sketch[i], sketch[j], n[i], n[j], np.maximum(size[i], size[j])) if len(i) else np.empty(0, bool)
            found += [(a, b) for a, b, c, d in zip(rep[i[alike]].tolist(), rep[j[alike]].tolist(), cluster[i[alike]].tolist(), cluster[j[alike]].tolist())
                      if forest.join(c, d)]
            at = end
        yield _links_batch(found)


def candidate_clusters(sets: DataFrame, lists: DataFrame) -> DataFrame:
    """(rep, cluster): sets that may be linked, directly or in steps, have one cluster; others have none.

    First each set is compared with two heads of its lists alone, which joins large groups of near copies in
    rows in proportion to their members.  Then lists in which several clusters remain are compared member by member
    inside tasks, long ones block by block; a task passes on links that join clusters, not pairs.
    """
    sketch = sets.select("rep", "n", _short("sketch").alias("sketch"))
    # two heads for each set: the smallest, and the one of most lists; near copies have many between them
    heads = lists.filter((F.col("rep") != F.col("head")) & _near_size("n", "head_n")).groupBy("rep", "head").count()
    chosen = heads.groupBy("rep").agg(F.min("head").alias("low"), F.max_by("head", F.struct("count", F.bitwise_not("head"))).alias("most"))
    star = chosen.select(F.explode(F.array_distinct(F.array("low", "most"))).alias("a"), F.col("rep").alias("b"))
    left = sketch.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sketch.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    links = written(star.join(left, "a").join(right, "b").filter(_alike("sa", "sb", "na", "nb")).select("a", "b"), "star-links")
    first = components(links).select(F.col("node").alias("rep"), "component")
    placed = lists.join(first, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("cluster"))
    mixed = placed.groupBy("key").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.ceil(F.count(F.lit(1)) / LIST_BLOCK).cast("int").alias("blocks"))
    rest = placed.join(mixed.filter("low < high").select("key", "blocks"), "key").join(sketch, "rep")
    dealt = _dealt(rest, F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1))
    joined = _by_group(dealt.select("key", "lo", "hi", "side", "rep", "n", "cluster", "sketch")).mapInArrow(_linked_lists, "a long, b long")
    return components(links.union(written(joined, "list-links"))).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))


def _dealt(rows: DataFrame, block: Column, partners: Column) -> DataFrame:
    """Each row once for every block that its own is compared with: lo and hi are the two, side is its own."""
    both = rows.withColumn("side", block).withColumn("other", F.explode(partners))
    return both.select("*", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))


def _by_group(rows: DataFrame) -> DataFrame:
    keys = rows.columns[:3]
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _linked_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between similar whole sets that join every two linked components of a group, directly or in steps.

    Columns: cluster, lo, hi, side, rep, n, component, set (sorted 64-bit numbers); where lo is not hi, only rows of
    different sides are compared.  Values that one set of the group has alone can be in no intersection: a set with
    more than a fifth of such is similar to none.  Of the others, each is marked once and counted in those that are
    not yet in its component.
    """
    for rows, starts in _complete(batches, 3):
        found = []
        for at, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if end - at > 1:
                found += _group_links(rows.slice(at, end - at))
        yield _links_batch(found)


def _group_links(rows: pa.RecordBatch) -> list[tuple[int, int]]:
    side, rep, n = (rows.column(k).to_numpy() for k in (3, 4, 5))
    across = rows.column(1)[0] != rows.column(2)[0]
    label = np.unique(rows.column(6).to_numpy(), return_inverse=True)[1]
    sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in rows.column(7)]
    owner = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    code, owner = code[shared], owner[shared]
    edges = boundaries(owner, len(sets))
    able = np.diff(edges) * 100 >= n * SIMILAR
    mark, found = np.zeros(len(times), bool), []
    for i in np.flatnonzero(able).tolist():
        others = np.flatnonzero((label != label[i]) & able & (n * 100 >= n[i] * SIMILAR) & (n[i] * 100 >= n * SIMILAR))
        others = others[(others > i) & ((side[others] != side[i]) | (not across))]
        if not len(others):
            continue
        own = code[edges[i]:edges[i + 1]]
        mark[own] = True
        if len(others) * 8 < len(sets):
            both = np.array([np.count_nonzero(mark[code[edges[j]:edges[j + 1]]]) for j in others.tolist()])
        else:
            upto = np.concatenate([[0], np.cumsum(mark[code])])
            both = upto[edges[others + 1]] - upto[edges[others]]
        mark[own] = False
        for j in others[both * 100 >= (n[i] + n[others] - both) * SIMILAR].tolist():
            if label[j] != label[i]:
                found.append((int(rep[i]), int(rep[j])))
                label[label == label[j]] = label[i]
    return found


def _fingerprints(grams: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each row's whole set."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (mixed(grams + np.uint64(1)), mixed(grams ^ np.uint64(0xA5A5A5A5)))]
    return [mixed(s[edges[1:]] - s[edges[:-1]]).view(np.int64) for s in sums]


@lru_cache(maxsize=64)
def _ids(folder: str, shard: int) -> np.ndarray:
    return mapped_array(folder, f"ids{shard}", "rep", np.int64)


def with_ids(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(rep, text): documents whose id is asked for.  The ids are written as sorted arrays that tasks map, so
    the other texts are not moved."""
    folder, shards = fresh_folder(docs.sparkSession, "ids"), max(1, -(-asked.count() // SHARD_IDS))

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        write_arrays(folder, f"ids{key[0]}", {"rep": np.unique(rows["rep"].to_numpy())})
        return pd.DataFrame({"shard": [key[0]]})

    keyed = asked.select("rep", F.pmod("rep", F.lit(shards)).cast("long").alias("shard"))
    built = {r["shard"] for r in keyed.groupBy("shard").applyInPandas(build, "shard long").collect()}  # a row for each shard

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column_values(batch, "rep", 0)
            wanted = np.zeros(len(ids), bool)
            for k in set((ids % shards).tolist()) & built:
                known = _ids(folder, k)
                wanted |= (ids % shards == k) & (known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids)
            yield batch.filter(pa.array(wanted))

    return docs.select(F.col("doc_id").cast("long").alias("rep"), "text").filter("rep is not null").mapInArrow(task, "rep long, text string")


def whole_sets(docs: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """(rep, cluster, n, set): the whole shingle sets of the asked documents, as sorted numbers."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.column(2)
            for lo, hi, grams, edges in _per_slice(batch, size):
                own = rest.slice(lo, hi - lo)
                a, b = _fingerprints(grams, edges)
                same = (a == own.field("a").to_numpy()) & (b == own.field("b").to_numpy())  # not another text of this id
                sets = [grams[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary()), own], names=["rep", "set", "rest"]).filter(pa.array(same))

    kept = asked.select("rep", F.struct("cluster", "n", "a", "b").alias("rest"))
    texts = with_ids(docs, asked).join(kept, "rep").select("rep", "text", "rest")
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("set", T.BinaryType()), texts.schema["rest"]])
    return texts.mapInArrow(task, schema).select("rep", "rest.cluster", "rest.n", "set")


def _compared(rows: DataFrame) -> DataFrame:
    return _by_group(rows.select("cluster", "lo", "hi", "side", "rep", "n", "component", "set")).mapInArrow(_linked_sets, "a long, b long")


def _parts(members: str, values: str) -> Column:
    return F.ceil(F.greatest(F.col(members) / SET_BLOCK, F.col(values) / SET_VALUES)).cast("int")


def verified_links(sets: DataFrame) -> DataFrame:
    """(a, b): links between whole sets that join every two linked sets of a cluster, directly or in steps.

    A cluster that fits a block is compared in one task.  A larger one is dealt to blocks, and each block is first
    compared with a few hubs, which joins near copies in rows in proportion to their number.  Then its largest component
    needs no comparison within itself: blocks of the other members are compared with each other and with its
    blocks.  Tasks hold two blocks and pass on links that join components, not pairs.
    """
    placed = written(sets, "whole-sets")
    size = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("values"))
    large = written(size.select("cluster", _parts("members", "values").alias("parts")).filter("parts > 1"), "large-clusters")
    zero = F.lit(0)
    small = placed.join(large, "cluster", "left_anti").select("*", zero.alias("lo"), zero.alias("hi"), zero.alias("side"), F.col("rep").alias("component"))
    links = written(_compared(small), "links")
    return links if large.isEmpty() else links.union(_large_links(placed.join(large, "cluster")))


def _large_links(placed: DataFrame) -> DataFrame:
    spread = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")
    best = F.min(F.struct(F.xxhash64("rep", F.lit(2)).alias("h"), F.col("rep"))).alias("x")
    hubs = placed.groupBy("cluster", F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(HUBS)).alias("hub")).agg(best).select("cluster", F.col("x.rep").alias("rep"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("lo")
    around = placed.join(hubs, ["cluster", "rep"]).select("*", every, F.lit(0).alias("side"))
    members = placed.select("*", spread.alias("lo"), F.lit(1).alias("side"))
    star = members.unionByName(around).select("*", (F.col("lo") + 1).alias("hi"), F.col("rep").alias("component"))
    links = written(_compared(star), "hub-links")
    found = components(links).select(F.col("node").alias("rep"), "component")
    state = written(placed.drop("set").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "state")
    sizes = state.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("values"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("members", "component")).alias("m"), F.sum("members").alias("members"), F.sum("values").alias("values"),
                                        F.max_by("values", F.struct("members", "component")).alias("inside"))
    main = main.select("cluster", F.col("m.component").alias("largest"), (F.col("members") - F.col("m.members")).alias("left"), (F.col("values") - F.col("inside")).alias("over"))
    outer = main.filter("left > 0").select("cluster", "largest", _parts("left", "over").alias("outer"))
    rest = state.join(outer, "cluster").join(placed.select("cluster", "rep", "set"), ["cluster", "rep"])
    inside = F.col("component") == F.col("largest")
    last = F.col("parts") + F.col("outer") - 1
    block = F.when(inside, spread).otherwise(F.col("parts") + F.pmod(F.xxhash64("rep", F.lit(4)), F.col("outer")).cast("int"))
    dealt = _dealt(rest, block, F.when(inside, F.sequence(F.col("parts"), last)).otherwise(F.sequence(F.lit(0), last)))
    return links.union(written(_compared(dealt), "block-links"))


def near_duplicates(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of `docs`.

    Words are runs of non-blanks with A-Z in lower case; a document's set is its distinct shingles of `size`
    words, or the whole sequence if it has fewer.  Documents whose sets have 100 * intersection >= SIMILAR *
    union are linked, and component_id is the smallest doc_id that links reach.  Empty or null texts have
    empty sets and are linked with nothing.  A null doc_id is linked with nothing either: its component is
    null and it is kept.  Rows that repeat a doc_id share their links.  Other columns are ignored, and an
    empty table gives an empty result.

    Equal sets are one from the start, by a fingerprint of the whole set.  Sketches find what may be linked,
    and whole sets, of those documents alone, decide.
    """
    rows = written(sketches(docs, size), "sketches")
    key = ["n", "a", "b"]
    # the rows of one key have the same sketch
    sets = written(rows.filter("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "sets")
    lists = written(rare_pairs(sets), "lists")
    clusters = written(candidate_clusters(sets, lists), "clusters")
    asked = sets.join(clusters, "rep")
    found = components(verified_links(whole_sets(docs, asked, size))).select(F.col("node").alias("rep"), "component")
    grouped = sets.select(*key, "rep").join(found, "rep", "left").select(*key, F.coalesce("component", "rep").alias("component"))
    joined = rows.select("doc_id", *key).join(grouped, key, "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return (joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
