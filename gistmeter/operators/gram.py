"""Sums of products of many columns, as matrix products of Arrow batches: any number of columns in one pass."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 8192
CELLS = "i int, j int, n long, si double, sj double, p double, qi double, qj double, lo_i double, hi_i double, lo_j double, hi_j double"
_NAMES = [c.split()[0] for c in CELLS.split(", ")]


def _batch_sums(x: np.ndarray) -> dict[str, np.ndarray]:
    """Of rows of columns, NaN where missing: for each two columns the sums over the rows that have both."""
    there = ~np.isnan(x)
    m, z = there.astype(float), np.where(there, x, 0.0)
    low, high = np.where(there, x, np.inf), np.where(there, x, -np.inf)
    lows = np.array([np.where(there[:, [j]], low, np.inf).min(0) for j in range(x.shape[1])]).T
    highs = np.array([np.where(there[:, [j]], high, -np.inf).max(0) for j in range(x.shape[1])]).T
    return {"n": m.T @ m, "s": z.T @ m, "p": z.T @ z, "q": (z * z).T @ m, "lo": lows, "hi": highs}


def _merged(a: dict | None, b: dict) -> dict:
    if a is None:
        return b
    ends = {"lo": np.minimum, "hi": np.maximum}
    return {k: ends.get(k, np.add)(a[k], b[k]) for k in b}


def column_matrix(batch: pa.RecordBatch, first: int = 0) -> np.ndarray:
    """Columns of doubles from `first` on, side by side, NaN where missing."""
    return np.column_stack([c.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in batch.columns[first:]])


def pair_sums(values: DataFrame) -> DataFrame:
    """(i, j, n, mean_i, mean_j, cov, var_i, var_j, moves) for i <= j of the double columns, over rows that have both.

    A first scan finds each column's mean; it is taken off before anything is multiplied, so sums stay small.  A task
    keeps the matrices of its rows and passes on one row for each two columns.
    """
    cols = values.columns
    means = values.agg(*[F.avg(f"`{c}`") for c in cols]).first()
    pilot = np.array([m if m is not None else 0.0 for m in means])
    upper = np.triu_indices(len(cols))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                sums = _merged(sums, _batch_sums(column_matrix(batch.slice(at, SLICE)) - pilot))
        if sums is not None:
            i, j = upper
            by_row = [sums["n"][i, j].astype(np.int64), sums["s"][i, j], sums["s"][j, i], sums["p"][i, j], sums["q"][i, j], sums["q"][j, i],
                      sums["lo"][i, j], sums["hi"][i, j], sums["lo"][j, i], sums["hi"][j, i]]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, by_row)], names=_NAMES)

    blank = values.sparkSession.createDataFrame([(int(a), int(b), 0, *[0.0] * 5, *[float("inf"), -float("inf")] * 2) for a, b in zip(*upper)], CELLS)
    rows = values.mapInArrow(task, CELLS).unionByName(blank)
    n = F.nullif(F.sum("n"), F.lit(0)).cast("double")
    sums = rows.groupBy("i", "j").agg(
        F.sum("n").alias("n"), *[(F.sum(c) / n).alias(c) for c in ("si", "sj", "p", "qi", "qj")],
        ((F.min("lo_i") < F.max("hi_i")) & (F.min("lo_j") < F.max("hi_j"))).alias("moves"))
    pilots = F.array(*map(F.lit, pilot.tolist()))
    return sums.select("i", "j", "n", (F.col("si") + F.get(pilots, "i")).alias("mean_i"), (F.col("sj") + F.get(pilots, "j")).alias("mean_j"),
                       (F.col("p") - F.col("si") * F.col("sj")).alias("cov"), (F.col("qi") - F.col("si") * F.col("si")).alias("var_i"),
                       (F.col("qj") - F.col("sj") * F.col("sj")).alias("var_j"), "moves")
