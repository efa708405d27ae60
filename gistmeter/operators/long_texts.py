"""Clustering the sentences of texts too long for one task: block by block, a round at a time.

Each round every block of a text assigns its sentences to the text's centres and passes on sums per cluster; these
are merged into the next centres.  Whole numbers make the result the one a single task would have.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmeter.operators.layout import materialise
from gistmeter.operators.tokens import SUMMARY, TEXT

# ids of the centres that are left and their vectors, as bytes, before and after the last round
STATE = "ids binary, centres binary, before_ids binary, before binary, seen array<binary>, done boolean, dim int"


def _matrix(vecs) -> np.ndarray:
    return np.stack(vecs.to_numpy()).astype("int64")


def _numbers(data: bytes, dim: int = 0) -> np.ndarray:
    flat = np.frombuffer(data, "int64")
    return flat.reshape(-1, dim) if dim else flat


def _mark(ids: np.ndarray, centres: np.ndarray) -> bytes:
    return hashlib.sha256(ids.tobytes() + centres.tobytes()).digest()


def _ranked(sents: DataFrame, block: int) -> DataFrame:
    """(id, block, sent_pos, rank, vec) of the texts' sentences; rank counts those of the text before."""
    rows = sents.filter(F.col("side") == TEXT).withColumn("block", F.floor(F.col("sent_pos") / block))
    sizes = rows.groupBy("id", "block").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("id").orderBy("block")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("id", "block").orderBy("sent_pos")) - 1
    return rows.withColumn("own", own).join(base, ["id", "block"]).select("id", "block", "sent_pos", (F.col("base") + F.col("own")).alias("rank"), "vec")


def _first_state(points: DataFrame, sents: DataFrame, key: str) -> DataFrame:
    """Sentence floor(i * m / k) of the m of a text is the first centre of cluster i of k."""
    sides = sents.groupBy("id").agg(F.count(F.when(F.col("side") == TEXT, 1)).alias("m"), F.count(F.when(F.col("side") == SUMMARY, 1)).alias("other"))
    sides = sides.withColumn("k", F.least("m", "other")).filter("k > 0")
    starts = sides.select("id", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda i: F.struct(
        i.alias("cluster"), F.floor(i * F.col("m") / F.col("k")).alias("rank")))).alias("s")).select("id", "s.*")

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cluster")
        ids, centres = rows.cluster.to_numpy("int64"), _matrix(rows.vec)
        return pd.DataFrame({"id": [rows.id.iloc[0]], "ids": [ids.tobytes()], "centres": [centres.tobytes()], "before_ids": [b""], "before": [b""],
                             "seen": [[]], "done": [False], "dim": [centres.shape[1]]})

    return starts.join(points, ["id", "rank"]).select("id", "cluster", "vec").groupBy("id").applyInPandas(gather, f"id {key}, {STATE}")


def _by_block(points: DataFrame, state: DataFrame, blocks: DataFrame):
    """Each block of a text with a copy of the text's state."""
    return points.groupBy("id", "block").cogroup(state.join(blocks, "id").groupBy("id", "block"))


def clustered(sents: DataFrame, block: int, nearest) -> DataFrame:
    """(id, cluster, sent_pos): of each cluster of the sentences of a text the one nearest to its centre.

    `sents` are (id, side, sent_pos, vec) of whole numbers.  Rounds go on for the texts whose centres still
    move.  A task holds `block` sentences and the centres of one text, of which there are no more than
    sentences in its summary.
    """
    key = sents.schema["id"].dataType.simpleString()
    points = materialise(_ranked(sents, block), "long-texts")
    blocks = materialise(points.select("id", "block").distinct(), "blocks")

    def assigned(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(state):
            return pd.DataFrame(columns=["id", "j", "n", "total"], dtype=object)
        x, centres = _matrix(rows.vec), _numbers(state.centres.iloc[0], int(state.dim.iloc[0]))
        label = nearest(x, centres)
        used, size = np.unique(label, return_counts=True)
        total = np.add.reduceat(x[np.argsort(label, kind="stable")], np.cumsum(size) - size, axis=0)
        return pd.DataFrame({"id": [rows.id.iloc[0]] * len(used), "j": used, "n": size, "total": list(total)})

    def moved(parts: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        out, dim = state.iloc[:1].copy(), int(state.dim.iloc[0])
        ids, centres = _numbers(out.ids.iloc[0]), _numbers(out.centres.iloc[0], dim)
        size, total = np.zeros(len(ids), "int64"), np.zeros((len(ids), dim), "int64")
        np.add.at(size, parts.j.to_numpy("int64"), parts.n.to_numpy("int64"))
        np.add.at(total, parts.j.to_numpy("int64"), _matrix(parts.total))
        keep = size > 0
        new_ids, new = ids[keep], total[keep] // size[keep][:, None]
        seen = [bytes(s) for s in out.seen.iloc[0]] + [_mark(ids, centres)]
        return out.assign(ids=[new_ids.tobytes()], centres=[new.tobytes()], before_ids=[ids.tobytes()], before=[centres.tobytes()],
                          seen=[seen], done=[_mark(new_ids, new) in seen])

    def best(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(state):
            return pd.DataFrame(columns=["id", "cluster", "far", "sent_pos"], dtype=object)
        x, s = _matrix(rows.vec), state.iloc[0]
        ids, own = _numbers(s.ids), _numbers(s.before_ids)[nearest(x, _numbers(s.before, int(s.dim)))]
        j = np.searchsorted(ids, own)
        far = ((x - _numbers(s.centres, int(s.dim))[j]) ** 2).sum(axis=1)
        found = pd.DataFrame({"cluster": own, "far": far, "sent_pos": rows.sent_pos.to_numpy()}).sort_values(["cluster", "far", "sent_pos"]).groupby("cluster").head(1)
        found.insert(0, "id", rows.id.iloc[0])
        return found

    state = materialise(_first_state(points, sents, key), "centres")
    over = []
    while not state.isEmpty():
        parts = _by_block(points, state, blocks).applyInPandas(assigned, f"id {key}, j long, n long, total array<long>")
        after = materialise(parts.groupBy("id").cogroup(state.groupBy("id")).applyInPandas(moved, f"id {key}, {STATE}"), "centres")
        over.append(after.filter("done"))
        state = after.filter("not done")
    if not over:
        return sents.sparkSession.createDataFrame([], f"id {key}, cluster long, sent_pos long")
    ended = over[0]
    for more in over[1:]:
        ended = ended.unionByName(more)
    found = _by_block(points, ended, blocks).applyInPandas(best, f"id {key}, cluster long, far long, sent_pos long")
    return found.groupBy("id", "cluster").agg(F.min_by("sent_pos", F.struct("far", "sent_pos")).alias("sent_pos"))
