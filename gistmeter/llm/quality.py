"""A quality score by logistic regression on hashed word n-grams, trained by FTRL-proximal updates."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.llm.columns import BLANKS, LOWER, SLICE, mixed, row_slices, runs, span_hashes, text_column
from gistmeter.llm.shared import text_documents

DIMENSIONS = 1 << 20
TRAIN_ROWS = 40_000  # labelled rows that are learned from, at most
LEARNERS = 8
PASSES = 2
THRESHOLD = 0.7
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.02

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER, _SMALL, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _SMALL[97:123] = _DIGIT[48:58] = True


def _count(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[ends] - sums[starts]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dimension, value) of the rows' sparse vectors, in row order.  `offsets` start at 0.

    Tokens are runs of word bytes and runs of marks.  Counted are tokens in lower case, pairs of them, and
    pairs and triples of token forms: case, digits, which mark, and whether a word repeats the one before.
    Values are dampened counts, scaled to length one for each row; dimension 0 is 1 in every row.
    """
    n = len(offsets) - 1
    starts = offsets[:-1]
    spans = [runs(member, starts) for member in (_WORD[data], ~_WORD[data] & ~BLANKS[data])]
    begin, end = (np.concatenate(x) for x in zip(*spans))
    is_word = np.concatenate([np.ones(len(spans[0][0]), bool), np.zeros(len(spans[1][0]), bool)])
    order = np.argsort(begin, kind="stable")
    begin, end, is_word = begin[order], end[order], is_word[order]
    row = np.searchsorted(offsets, begin, "right") - 1
    token = span_hashes(LOWER[data], begin, end)
    upper, small, digit = (_count(x[data], begin, end) for x in (_UPPER, _SMALL, _DIGIT))
    form = np.where(digit > 0, 1, np.where(small == 0, np.where(upper > 1, 2, 3), np.where(upper > 0, np.where(upper > 1, 4, 5), 6))).astype(np.uint64)
    glued = np.zeros(len(begin), bool)
    glued[1:] = (begin[1:] == end[:-1]) & (row[1:] == row[:-1])
    form = np.where(is_word, form, token) * np.uint64(2) + glued.astype(np.uint64)
    place = np.flatnonzero(is_word)
    again = np.zeros(len(begin), np.uint64)
    if len(place) > 1:
        again[place[1:]] = ((token[place[1:]] == token[place[:-1]]) & (row[place[1:]] == row[place[:-1]])).astype(np.uint64)
    form = mixed(form * np.uint64(2) + again)

    def grams(values: np.ndarray, k: int, salt: int):
        if len(values) < k:
            return values[:0], row[:0]
        h = values[k - 1:] + np.uint64(salt)
        for j in range(2, k + 1):
            h = mixed(h) * np.uint64(31) + values[k - j:len(values) - j + 1]
        whole = row[k - 1:] == row[:len(row) - k + 1]
        return h[whole], row[k - 1:][whole]

    every = [grams(token, 1, 1), grams(token, 2, 2), grams(form, 2, 3), grams(form, 3, 4)]
    hashes, rows = (np.concatenate(x) for x in zip(*every))
    dims = (mixed(hashes) % np.uint64(DIMENSIONS - 1) + np.uint64(1)).astype(np.int64)
    key, count = np.unique(rows * DIMENSIONS + dims, return_counts=True)
    row_of, dim, value = key // DIMENSIONS, key % DIMENSIONS, np.log1p(count)
    scale = np.sqrt(np.bincount(row_of, value * value, n))
    value = value / scale[row_of]
    row_of, dim, value = np.concatenate([row_of, np.arange(n)]), np.concatenate([dim, np.zeros(n, np.int64)]), np.concatenate([value, np.ones(n)])
    order = np.argsort(row_of, kind="stable")
    return row_of[order], dim[order], value[order]


class Learner:
    """FTRL-proximal: a step size for each dimension, and weights that stay 0 until the evidence exceeds L1."""

    def __init__(self):
        self.z, self.n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)

    def weights(self, dims=slice(None)) -> np.ndarray:
        z = self.z[dims]
        free = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -free / ((BETA + np.sqrt(self.n[dims])) / ALPHA + L2)

    def learn(self, dims: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(dims)
        g = (1 / (1 + np.exp(-np.clip(w @ values, -30, 30))) - label) * values
        n = self.n[dims]
        self.z[dims] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[dims] = n + g * g


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    learner = Learner()
    seen = False
    for batch in batches:
        data, offsets = text_column(batch)
        labels = batch.column(batch.schema.get_field_index("label")).to_numpy()
        for lo, hi in row_slices(offsets, SLICE):
            rows, dims, values = features(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            at = np.searchsorted(rows, np.arange(hi - lo + 1))
            for k in range(hi - lo):
                own = slice(at[k], at[k + 1])
                learner.learn(dims[own], values[own], int(labels[lo + k]))
                seen = True
    if seen:
        w = learner.weights()
        dim = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(dim, -1)), pa.array(np.append(w[dim], 1.0))], names=["dim", "weight"])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """The weights.  labels: (doc_id, label); nulls and values other than 0 and 1 are left out, and of
    several labels of one document the larger counts.

    Of the labelled rows those whose doc_id hashes lowest are taken, at most `train_rows`: a fixed bound,
    so they are broadcast to the scan.  LEARNERS tasks each make PASSES over their part as it streams by;
    the weights are the mean over the learners that had rows.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
             .filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))
    texts = text_documents(docs).join(F.broadcast(known), "doc_id")
    passes = texts.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(PASSES)))).withColumn("learner", F.pmod(F.xxhash64("doc_id"), F.lit(LEARNERS)))
    dealt = passes.repartition(LEARNERS, "learner").sortWithinPartitions("learner", "turn", F.xxhash64("doc_id", "text"))
    parts = dealt.select("text", "label").mapInArrow(_learned, "dim long, weight double")
    summed = parts.groupBy("dim").agg(F.sum("weight").alias("weight")).toPandas()  # at most DIMENSIONS rows
    weights, learners = np.zeros(DIMENSIONS, np.float32), 0
    if len(summed):
        dim, weight = summed["dim"].to_numpy(), summed["weight"].to_numpy()
        learners = weight[dim < 0].sum()
        weights[dim[dim >= 0]] = weight[dim >= 0] / learners
    return weights


def scored(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 if score >= threshold, else 0) added, without a shuffle.

    The score is the logistic of a sparse dot product over the whole text and of nothing else.  A null or
    empty text has the score of the constant term; with no weights every score is 0.5.  Repeated rows have
    equal scores, other columns pass through, score and predicted replace columns of these names, and an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # DIMENSIONS numbers
    rest = [f"`{c}`" for c in docs.columns if c not in ("score", "predicted")]
    asked = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.struct(*rest).alias("rest"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            data, offsets = text_column(batch)
            for lo, hi in row_slices(offsets, SLICE):
                rows, dims, values = features(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                margin = np.bincount(rows, w[dims] * values, hi - lo)
                score = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                                 names=["rest", "score", "predicted"])

    schema = asked.select("rest", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return asked.mapInArrow(task, schema).select("rest.*", "score", "predicted")


def held_out(doc_id, rest: int = 2, modulus: int = 4):
    """Whether crc32 of the id as text leaves this remainder; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % modulus == rest
