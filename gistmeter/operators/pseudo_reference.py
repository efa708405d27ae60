"""Pseudo-references: sentences of a text nearest to its cluster centres, and the score
of a summary against them.

Sentence vectors are whole numbers, so sums, distances and ties do not depend on the order
of rows.  Each text is clustered on its own; Spark spreads the texts, and the blocks of long ones.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.functions import text
from gistmeter.functions.vectors import as_vector, component_sums
from gistmeter.operators import counting
from gistmeter.operators.layout import lookup_join, materialise
from gistmeter.operators.long_texts import clustered
from gistmeter.operators.similarity import Keyed, held_lookup, looked_up, own_key, vector_dim
from gistmeter.operators.tokens import SUMMARY, TEXT, is_coded, sentence_rows

SCALE = 1000
STEP = 4096
LONG = 8192  # sentences of a text that one task clusters
TOGETHER = 1 << 14  # sentences of texts that are clustered together, of one text more
FEW = 16  # clusters of a text that is clustered together with others


def sentence_vectors(pairs: DataFrame, vectors: DataFrame, token_key=own_key, scale: int = SCALE) -> DataFrame:
    """(id, side, sent_pos, vec): floor of the mean fixed-point token vector of each sentence."""
    dim = vector_dim(vectors)
    toks = sentence_rows(pairs).select("id", "side", "sent_pos", F.explode(text.words(F.col("sent"))).alias("tok"))
    counts = toks.select("id", "side", "sent_pos", token_key(F.col("tok")).alias("key")).groupBy(
        "id", "side", "sent_pos", "key").count()
    whole = vectors.select("key", F.transform(
        "vec", lambda x: F.floor(x.cast("double") * scale)).alias("vec"))
    found = lookup_join(counts, whole, "key", how="inner")
    sums = found.groupBy("id", "side", "sent_pos").agg(
        F.sum("count").alias("_n"), *component_sums("vec", F.col("count"), dim))
    return sums.select("id", "side", "sent_pos", F.transform(
        as_vector(dim), lambda x: F.floor(x.cast("double") / F.col("_n"))).alias("vec"))


def _sentences(rows, owner: np.ndarray, lookup, scale: int):
    """Sentences with vectors: their id's number, position, side and vector, by id, side and position."""
    made = []
    for side, name in ((TEXT, "t"), (SUMMARY, "s")):
        column = counting.by_sentence(rows, name)
        sents = column.flatten()
        row, place = counting.within(counting.lengths(column))
        sent, _ = counting.within(counting.lengths(sents))
        at = looked_up(rows, name, lookup)
        # sentences at one position of rows with one id are one
        same = counting.ranked(owner[row], place)
        key, at = same[sent][at >= 0], at[at >= 0]
        first = counting.first_of(same, int(same.max(initial=-1)) + 1)
        if (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(starts):
            continue
        n, row_of = np.diff(np.append(starts, len(at))), counting.numbered(at)
        used = at[counting.first_of(row_of, int(row_of.max()) + 1)]
        whole = counting.narrow(np.floor(lookup.take(used) * scale).astype("int64"), int(n.max()))
        total = counting.gathered_sums(whole, row_of, starts)
        here = first[key[starts]]
        made.append((owner[row][here], place[here], np.full(len(starts), side), np.floor(total / n[:, None]).astype("int64")))
    if not made:
        return None
    own, place, side, vec = (np.concatenate(x) for x in zip(*made))
    order = np.lexsort((place, side, own))
    return own[order], place[order], side[order], vec[order]


def _each_text(pairs: DataFrame, shared, token_key, choose, schema: str, scale: int = SCALE, keyed: DataFrame | None = None) -> DataFrame:
    """What `choose(positions, vectors, starts, middles, ends)` gives for each text, as columns after the id.  The vectors are those of
    many texts and summaries; each text's start, then its summary's."""
    names = [c.split()[0] for c in schema.split(",")]

    def count(rows, owner, ids):
        found = _sentences(rows, owner, shared.value, scale)
        which, out = [], [[] for _ in names]
        if found is not None:
            own, place, side, vec = found
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            ends = np.append(starts[1:], len(own))
            middles = starts + np.add.reduceat(side != SUMMARY, starts, dtype="int64")
            text, *out = choose(place, vec, starts, middles, ends)
            which = own[starts][text]
        kinds = {"long": pa.int64(), "double": pa.float64()}
        return {"id": ids.take(pa.array(which, pa.int64())), **{c: pa.array(v, kinds[t.split()[1]]) for c, v, t in zip(names, out, schema.split(","))}}

    def keys(side: str):
        return F.transform(text.sentences(F.col(side)), lambda s: F.transform(text.words(s), token_key)).alias(side[0])

    rows = counting.by_id(pairs, keys("text"), keys("summary")) if keyed is None else counting.by_id(keyed, *[F.col(c) for c in keyed.columns if c in ("t", "s", "t_sents", "s_sents", "at")])
    return counting.mapped(rows, count, f"id {counting.key_type(pairs)}, {schema}")


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre per point, the lowest index on ties."""
    best = np.empty(len(points), dtype="int64")
    for start in range(0, len(points), STEP):
        part = points[start:start + STEP]
        far = (part * part).sum(axis=1)[:, None] - 2 * (part @ centres.T) + (centres * centres).sum(axis=1)[None, :]
        best[start:start + STEP] = far.argmin(axis=1)
    return best


def _clusters(k: int, points: np.ndarray):
    """Rounds of assignment and floored means until no centre moves, or centres come back that were there
    before; yields (cluster, index of the nearest member)."""
    ids = np.arange(k)
    centres = points[ids * len(points) // k]
    seen = set()
    while (state := ids.tobytes() + centres.tobytes()) not in seen:
        seen.add(state)
        label = _nearest(points, centres[:k])
        size = np.bincount(label, minlength=len(ids))
        keep = size > 0
        remap = np.cumsum(keep) - 1
        order = np.argsort(label, kind="stable")
        total = np.add.reduceat(points[order], (np.cumsum(size) - size)[keep], axis=0)
        centres, ids, label = total // size[keep][:, None], ids[keep], remap[label]
        k = len(ids)
    far = ((points - centres[label]) ** 2).sum(axis=1)
    for j, cluster in enumerate(ids):
        members = np.flatnonzero(label == j)
        yield int(cluster), int(members[far[members].argmin()])


def _far(points: np.ndarray, centres: np.ndarray, spans: list, of: np.ndarray) -> np.ndarray:
    """Squared distance of each point to the centres of its text, without the point's own square; the texts' points lie one after another."""
    out, at = np.empty((len(of), centres.shape[1]), centres.dtype), 0
    for c, (a, b) in zip(centres, spans):
        np.matmul(points[a:b], c.T, out=out[at:at + b - a])
        at += b - a
    return (centres * centres).sum(axis=2)[of] - 2 * out


def _member_sums(points: np.ndarray, spans: list, label: np.ndarray, k: int) -> np.ndarray:
    """The sum of the points of each of k clusters of each text."""
    member = (label[:, None] == np.arange(k)).astype(points.dtype)
    out, at = np.empty((len(spans), k, points.shape[1]), points.dtype), 0
    for total, (a, b) in zip(out, spans):
        np.matmul(member[at:at + b - a].T, points[a:b], out=total)
        at += b - a
    return out.astype("int64")


def _clusters_together(k: int, points: np.ndarray, size: np.ndarray):
    """`_clusters` of many texts, each with so many of the points and at least k: arrays of text, cluster and index of the member."""
    n, top = len(size), np.iinfo("int64").max
    first = np.cumsum(size) - size
    centres = points[first[:, None] + np.arange(k) * size[:, None] // k]
    alive, label = np.ones((n, k), bool), np.zeros(len(points), "int64")
    of, active, seen = np.repeat(np.arange(n), size), np.arange(n), [set() for _ in range(n)]
    # sums of products of doubles are exact below 2^53
    largest = int(np.abs(points).max(initial=0))
    exact = max(largest ** 2 * points.shape[1] * 4, largest * int(size.max(initial=0))) < 1 << 53
    numbers = points.astype("float64") if exact else points
    while True:
        going = []
        for i in active:
            state = alive[i].tobytes() + centres[i].tobytes()
            if state not in seen[i]:
                seen[i].add(state)
                going.append(i)
        if not going:
            break
        active = np.array(going)
        rank = np.full(n, -1)
        rank[active] = np.arange(len(active))
        here = np.flatnonzero(rank[of] >= 0) if len(active) < n else np.arange(len(points))
        mine = rank[of[here]]
        spans = list(zip(first[active].tolist(), (first + size)[active].tolist()))
        far = _far(numbers, centres[active].astype(numbers.dtype), spans, mine).astype("int64")
        far[~alive[active][mine]] = top
        label[here] = far.argmin(axis=1)
        key = mine * k + label[here]
        count = np.bincount(key, minlength=len(active) * k)
        used = count > 0
        total = _member_sums(numbers, spans, label[here], k).reshape(len(count), -1)[used]
        fresh = np.zeros((len(active) * k, points.shape[1]), "int64")
        fresh[used] = total // count[used][:, None]
        centres[active], alive[active] = fresh.reshape(len(active), k, -1), used.reshape(len(active), k)
    far = ((points - centres[of, label]) ** 2).sum(axis=1)
    key = of * k + label
    order = np.lexsort((far, key))
    member = order[np.flatnonzero(np.diff(key[order], prepend=-1))]
    return of[member], label[member], member


def _clusters_of(points: np.ndarray, starts: np.ndarray, size: np.ndarray, k: np.ndarray):
    """(text, cluster, index of the member) of texts with these points and numbers of clusters, by text and cluster."""
    made = [(np.empty(0, "int64"),) * 3]
    for few in np.unique(k[(k > 0) & (k <= FEW)]):
        texts = np.flatnonzero(k == few)
        share = np.cumsum(size[texts]) // TOGETHER
        for group in np.split(texts, np.flatnonzero(np.diff(share)) + 1):
            row, place = counting.within(size[group])
            at = starts[group][row] + place
            text, cluster, member = _clusters_together(int(few), points[at], size[group])
            made.append((group[text], cluster, at[member]))
    for i in np.flatnonzero(k > FEW):
        found = np.array(list(_clusters(int(k[i]), points[starts[i]:starts[i] + size[i]])), "int64").reshape(-1, 2)
        made.append((np.full(len(found), i), found[:, 0], starts[i] + found[:, 1]))
    text, cluster, member = (np.concatenate(x) for x in zip(*made))
    order = np.lexsort((cluster, text))
    return text[order], cluster[order], member[order]


def _split_sides(rows: pd.DataFrame):
    """Vectors of the text's sentences with their positions, and of the summary's sentences."""
    own = rows[rows.side == TEXT].sort_values("sent_pos")
    other = rows[rows.side == SUMMARY].sort_values("sent_pos")
    stacked = [np.stack(x.vec.to_numpy()).astype("int64") if len(x) else None for x in (own, other)]
    return own.sent_pos.to_numpy(), stacked[0], other.sent_pos.to_numpy(), stacked[1]


def _by_text(pairs: DataFrame, vectors: DataFrame, token_key, choose, schema: str, keyed: Keyed | None = None) -> DataFrame:
    """(id, columns of schema): `choose` for each text, with the vectors of a table that tasks hold or map or, of others, joined."""
    if keyed is not None:
        return _each_text(pairs, keyed.held, token_key, choose, schema, keyed=keyed.rows)
    shared = held_lookup(vectors)
    if shared is not None:
        return _each_text(pairs, shared, token_key, choose, schema)
    sents = sentence_vectors(pairs, vectors, token_key)
    names = [c.split()[0] for c in schema.split(",")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        where, points, _, asked = _split_sides(rows)
        sides = [v for v in (points, asked) if v is not None]
        m, n = (0 if v is None else len(v) for v in (points, asked))
        _, *made = choose(where, np.concatenate(sides), *(np.array([x]) for x in (0, m, m + n)))
        return pd.DataFrame({"id": [rows.id.iloc[0]] * len(made[0]), **dict(zip(names, made))})

    return sents.groupBy("id").applyInPandas(run, f"id {counting.key_type(sents)}, {schema}")


def _by_length(pairs: DataFrame, long: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of at most so many sentences on each side, and the others if there are any."""
    def lengthy(side: str):
        return F.coalesce((F.length(side) > 2 * long) & (F.size(text.sentences(F.col(side))) > long), F.lit(False))

    many = lengthy("text") | lengthy("summary")
    others = pairs.filter(many)
    return (pairs, None) if others.isEmpty() else (pairs.filter(~many), others)


def pseudo_references(pairs: DataFrame, vectors: DataFrame, token_key=own_key, long: int = LONG) -> DataFrame:
    """(id, cluster, sent_pos): one sentence of the text per non-empty cluster.  Texts of more than `long` sentences are
    clustered in blocks of so many, with the same result."""
    pairs, others = _by_length(pairs, long)

    def choose(where, vecs, starts, middles, ends):
        size = middles - starts
        of, cluster, member = _clusters_of(vecs, starts, size, np.minimum(ends - middles, size))
        return of, cluster, where[member]

    found = _by_text(pairs, vectors, token_key, choose, "cluster long,sent_pos long")
    if others is None:
        return found
    return found.unionByName(clustered(materialise(sentence_vectors(others, vectors, token_key), "sentences"), long, _nearest))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m.astype("float64"), axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros(m.shape), where=norm > 0)


def supert_score(pairs: DataFrame, vectors: DataFrame, token_key=own_key, long: int = LONG, keyed: Keyed | None = None) -> DataFrame:
    """(id, supert_score): mean over summary sentences of the best cosine to a pseudo-reference.
    0 where one side has no sentence.  Texts of more than `long` sentences are clustered in blocks of so many."""
    pairs, others = _by_length(pairs, long)
    if keyed is not None and others is not None:
        # a sentence has a word, so there are as many lists as sentences
        size = (lambda side: F.length(f"{side}_sents") / 4) if is_coded(keyed.rows) else F.size
        keyed = Keyed(keyed.rows.filter((F.coalesce(size("t"), F.lit(-1)) <= long) & (F.coalesce(size("s"), F.lit(-1)) <= long)), keyed.held)

    def best(where, vecs, starts, middles, ends):
        size, asked = middles - starts, ends - middles
        k = np.minimum(asked, size)
        of, _, member = _clusters_of(vecs, starts, size, k)
        unit, rows = _unit(vecs[member]), np.searchsorted(of, np.arange(len(k) + 1))
        times = np.where(k > 0, asked, 1)
        out, at = np.zeros(times.sum()), np.cumsum(times) - times
        for i in np.flatnonzero(k):
            out[at[i]:at[i] + times[i]] = (_unit(vecs[middles[i]:ends[i]]) @ unit[rows[i]:rows[i + 1]].T).max(axis=1)
        return np.repeat(np.arange(len(k)), times), out

    key = pairs.schema["id"].dataType.simpleString()
    scored = _by_text(pairs, vectors, token_key, best, "best double", keyed)
    if others is not None:
        scored = scored.unionByName(_best_of_long(others, vectors, token_key, long, key))
    return scored.groupBy("id").agg(F.avg("best").alias("supert_score"))


def _best_of_long(pairs: DataFrame, vectors: DataFrame, token_key, long: int, key: str) -> DataFrame:
    """(id, best): for every sentence of a summary its best cosine, in blocks of them; 0 where the text or summary has none."""
    sents = materialise(sentence_vectors(pairs, vectors, token_key), "sentences")
    found = clustered(sents, long, _nearest).select("id", "sent_pos")
    refs = materialise(found.join(sents.filter(F.col("side") == TEXT), ["id", "sent_pos"]).select("id", "vec"), "references")
    asked = sents.filter(F.col("side") == SUMMARY).select("id", F.floor(F.col("sent_pos") / long).alias("block"), "vec")

    def best(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(own):
            return pd.DataFrame({"id": rows.id.iloc[:1], "best": [0.0] * min(len(rows), 1)})
        both = [_unit(np.stack(f.vec.to_numpy()).astype("int64")) for f in (rows, own)]
        return pd.DataFrame({"id": rows.id.iloc[0], "best": (both[0] @ both[1].T).max(axis=1)})

    copies = refs.join(materialise(asked.select("id", "block").distinct(), "blocks"), "id")
    found = asked.groupBy("id", "block").cogroup(copies.groupBy("id", "block")).applyInPandas(best, f"id {key}, best double")
    without = sents.select("id").distinct().join(asked.select("id").distinct(), "id", "left_anti").select("id", F.lit(0.0).alias("best"))
    return found.unionByName(without)
