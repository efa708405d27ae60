"""Whitening of vectors: covariances from exact sums of squares of single dimensions and of pairs of them.

Cov(a, b) = (Var(a + b) - Var(a) - Var(b)) / 2.  Entries become whole numbers, so every sum is exact in any
order, and a lost executor that is run again changes no digit of the result.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000  # fixed values: an entry c becomes floor(SCALE * c) + SHIFT
COMPONENTS = 8
RANK = 1e-12  # an eigenvalue below this share of the trace is rounding, not spread
SLICE = 4096  # rows that are worked on at once
SAFE = 1 << 62
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vec) of rows whose vector is not null or empty and holds finite entries alone."""
    vec = F.col(column).cast("array<double>")
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).filter(vec.isNotNull() & (F.size(vec) > 0) & finite)


def _whole(vec: pa.Array, size: int) -> np.ndarray:
    """Whole numbers of the entries, a row for each vector: int64 where they fit, otherwise Python's."""
    entries = np.floor(vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) * SCALE)
    if not len(entries) or np.abs(entries).max() < 2.0 ** 40:
        return entries.astype(np.int64) + SHIFT
    return np.array([[int(v) + SHIFT if np.isfinite(v) else int(c) * SCALE + SHIFT for v, c in zip(row, raw)]
                     for row, raw in zip(entries, vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, size))], object)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)


def _squared(values: np.ndarray) -> int:
    """The exact sum of the squares of whole numbers."""
    if not len(values):
        return 0
    most = max(int(values.max()), -int(values.min()))
    if values.dtype == object or most * most * len(values) >= SAFE:
        return sum(int(v) ** 2 for v in values.tolist())
    return int(values @ values)


def _cells(totals: dict[tuple[int, int], int]) -> Iterator[pa.RecordBatch]:
    """Exact totals as pieces of 28 digits, which add up in a decimal however many tasks there are."""
    rows = []
    for (a, b), total in totals.items():
        sign, rest, place = (1 if total >= 0 else -1), abs(total), 0
        while rest or not place:
            rest, piece = divmod(rest, 10 ** 28)
            rows.append((a, b, place, sign * piece))
            place += 1
    a, b, place, piece = zip(*rows)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(place, pa.int32()),
                                      pa.array(piece, pa.decimal128(38, 0))], names=["a", "b", "place", "piece"])


def _collected(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Totals of all tasks.  A row for each pair of dimensions: their number bounds it, not the data."""
    sums = parts.groupBy("a", "b", "place").agg(F.sum("piece").alias("piece")).collect()
    totals: dict[tuple[int, int], int] = {}
    for row in sums:
        totals[row["a"], row["b"]] = totals.get((row["a"], row["b"]), 0) + int(row["piece"]) * 10 ** (28 * row["place"])
    return totals


def _summed(vectors: DataFrame, of_slice) -> dict[tuple[int, int], int]:
    """Exact sums by (a, b) over all rows; `of_slice` gives those of a few rows, one task adds its own up."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for part in _slices(batches):
            for key, value in of_slice(part.column(part.schema.get_field_index("vec"))):
                totals[key] = totals.get(key, 0) + value
        if totals:
            yield from _cells(totals)

    return _collected(vectors.mapInArrow(task, "a int, b int, place int, piece decimal(38,0)"))


@dataclass
class Whitening:
    """What a fit leaves: counts, exact sums per dimension, eigenvalues, unit vectors and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    unit: int  # eigenvalues and trace are in units of 4 to this power; 0 unless entries are huge

    @property
    def size(self) -> int:
        return len(self.sums)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all rows of `usable` vectors; None where there are none.

    Vectors of a length other than the most frequent one (the shorter on ties) are left out.  The first pass adds up
    the dimensions.  The second takes each dimension's rounded mean off, squares single dimensions and sums of two,
    and adds these squares up; what rounding left of the means is corrected in whole numbers.  Memory of a task is
    a slice of rows and a number for each pair of dimensions.
    """
    lengths = vectors.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if lengths is None:
        return None
    size, n = lengths["size"], lengths["count"]
    rows = vectors.filter(F.size("vec") == size)

    def sums(vec: pa.Array):
        x = _whole(vec, size)
        return [((i, i), int(x[:, i].sum())) for i in range(size)]

    total = _summed(rows, sums)
    s = [total[i, i] for i in range(size)]
    middle = [v // n for v in s]

    def squares(vec: pa.Array):
        x = _whole(vec, size)
        centres = np.array(middle, object if x.dtype == object or max(map(abs, middle)) >= SAFE else np.int64)
        y = np.ascontiguousarray((x - centres).T)
        for i in range(size):
            yield (i, i), _squared(y[i])
            for j in range(i + 1, size):
                yield (i, j), _squared(y[i] + y[j])

    raw = _summed(rows, squares)
    left = [v - n * m for v, m in zip(s, middle)]  # the sum of each centred dimension
    # n times the sum of squares about the true mean
    spread = {(a, b): n * q - (left[a] + (left[b] if a != b else 0)) ** 2 for (a, b), q in raw.items()}
    # squares of huge entries pass a double's range: whole units of a power of two keep them in it
    unit = max(0, max(abs(q).bit_length() for q in spread.values()) - 2 * n.bit_length() - 900) // 2
    cov = np.empty((size, size))
    for (a, b), q in spread.items():
        exact = Fraction(q if a == b else q - spread[a, a] - spread[b, b], (1 if a == b else 2) * n * n << 2 * unit)
        cov[a, b] = cov[b, a] = float(exact)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    values, axes = values[order], axes[:, order].T
    for axis in axes:  # of the two signs, the one whose largest entry is positive
        axis *= np.sign(axis[np.argmax(np.abs(axis))]) or 1.0
    return Whitening(n, s, values, axes, float(np.trace(cov)), unit)


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """x - S/n on each component over the root of its eigenvalue; NaN for a component without spread."""
    middle = [v // model.n for v in model.sums]
    rest = np.array([float(Fraction(v - m * model.n, model.n)) for v, m in zip(model.sums, middle)])
    if x.dtype == object:
        whole = np.array([[int(v - m) / (1 << model.unit) for v, m in zip(row, middle)] for row in x])
        centred = whole.reshape(x.shape) - rest / 2.0 ** min(model.unit, 1000)
    else:
        centred = x - np.array(middle, object).astype(float) if model.unit else (x - np.array(middle, x.dtype)).astype(float)
        centred = (centred - rest) / 2.0 ** min(model.unit, 1000)
    lively = model.values > RANK * model.trace
    roots = np.sqrt(np.where(lively, model.values, 1.0))
    return np.where(lively, centred @ model.axes.T / roots, np.nan)


def _deviation(x: np.ndarray, model: Whitening) -> list[int | None]:
    """The sum over dimensions of (n*x - S)^2, exact; None where it takes more than 63 bits."""
    d = [x[:, i] - v // model.n for i, v in enumerate(model.sums)]
    left = [v - v // model.n * model.n for v in model.sums]
    most = max((int(np.abs(c).max()) for c in d), default=0)
    if x.dtype != object and ((most + 1) * model.n) ** 2 * len(d) < SAFE:
        return sum((c * model.n - r) ** 2 for c, r in zip(d, left)).tolist()
    out = [0] * len(x)
    for c, r in zip(d, left):
        out = [t + (int(v) * model.n - r) ** 2 for t, v in zip(out, c.tolist())]
    return [v if v < 1 << 63 else None for v in out]


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained) for every vector the fit took; no shuffle.

    `whitened` is null for a component without spread, `explained` where no dimension has any, `deviation` where it
    takes more than 63 bits.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        share = [float(v / model.trace) if model.trace > 0 else None for v in model.values]
        for part in _slices(batches):
            x = _whole(part.column(1), model.size)
            w, m = _projected(x, model), len(part)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                 pa.array(np.full(m * k, model.n), pa.int64()), pa.array(_deviation(x, model), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                 pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel())), pa.array(share * m, pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return vectors.filter(F.size("vec") == model.size).select("vec_id", "vec").mapInArrow(task, OUT)


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the covariance of the whitened values minus the identity; None without components."""
    lively = np.flatnonzero(model.values > RANK * model.trace)
    if not len(lively):
        return None
    k = len(lively)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, rows = np.zeros(k), np.zeros((k, k)), 0
        for part in _slices(batches):
            w = _projected(_whole(part.column(0), model.size), model)[:, lively]
            first += w.sum(0)
            second += w.T @ w
            rows += len(w)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([first, second.ravel()]).tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = vectors.filter(F.size("vec") == model.size).select("vec").mapInArrow(task, "sums array<double>")
    row = parts.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("total")).orderBy("pos").collect()
    sums = np.array([r["total"] for r in row]) / model.n
    cov = sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])
    return float(np.abs(cov - np.eye(k)).max())


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): every usable vector on the first components.

    Rows whose vector is null, empty, or holds a null, NaN or infinite entry are dropped, as are vectors of
    another length than most.  Repeated rows and ids each count and each have their rows; vec_id may be null.  Other
    columns are ignored.  Without usable vectors the result is empty.  See `whitened` for undefined values.
    """
    rows = usable(vectors, column)
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], OUT + ", identity_error double")
    return whitened(rows, model).withColumn("identity_error", F.lit(identity_error(rows, model)).cast("double"))
