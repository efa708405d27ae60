"""Column statistics and normalisation of score tables.

Each pass over the table returns one small row of statistics; no pass sorts the table or
brings a column together in one task.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.functions import transforms as X
from gistmeter.operators.gram import SLICE, column_matrix, pair_sums
from gistmeter.operators.relational import numeric_columns, quoted

LOW, HIGH = 0.01, 0.99
SKEWED = 0.5
ACCURACY = 10_000
# Tries of an exponent, in thousandths: half width and step of the first row, and the last step.
EXPONENT_PASS = (4000, 400)
EXPONENT_STEP = 4


def _value(c: str):
    return X.no_nan(F.col(quoted(c)))


def _values(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns as doubles c0, c1, ... with NaN read as missing."""
    return df.select(*[_value(c).alias(f"c{i}") for i, c in enumerate(cols)])


def skew_of(x):
    """Sample skewness with the usual bias correction."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(F.greatest(n * (n - 1), F.lit(0.0))) / F.nullif(n - 2, F.lit(0.0)))


def skew(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(metric, n, skew) per numeric column, in one pass."""
    cols = cols or numeric_columns(df)
    wide = _values(df, cols).agg(*[F.struct(F.lit(c).alias("metric"), F.count(f"c{i}").alias("n"),
                                            skew_of(F.col(f"c{i}")).alias("skew")).alias(f"s{i}")
                                   for i, c in enumerate(cols)])
    return wide.select(F.inline(F.array(*[f"s{i}" for i in range(len(cols))])))


def quantiles(df: DataFrame, cols: list[str], probs=(LOW, HIGH), accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of every column.

    A mergeable sketch with a known rank error fences in each wanted rank; the rows below the fence are counted, and
    only rows inside are looked at in the next pass, until a fence holds one value.  Each step leaves some four
    ten-thousandths of the rows, so large tables take few more steps than small ones.
    """
    values = _values(df, cols)
    sizes = values.agg(*[F.count(f"c{i}").alias(f"c{i}") for i in range(len(cols))]).first()
    found: dict[tuple[int, float], float] = {}
    # wanted[(column, rank)] = (low, high, rows below low)
    wanted = {}
    for i in range(len(cols)):
        for p in probs:
            rank = (sizes[i] - 1) * p
            for k in {math.floor(rank), math.ceil(rank)} if sizes[i] else ():
                wanted[(i, k)] = (None, None, 0, sizes[i])
    while wanted:
        wanted = _narrow(values, wanted, accuracy, found)
    out = {}
    for i, c in enumerate(cols):
        out[c] = []
        for p in probs:
            rank = (sizes[i] - 1) * p
            low, high = found.get((i, math.floor(rank))), found.get((i, math.ceil(rank)))
            out[c].append(None if low is None else low + (high - low) * (rank - math.floor(rank)))
    return out


def _inside(i: int, low, high):
    x = F.col(f"c{i}")
    return x if low is None else F.when((x >= low) & (x <= high), x)


def _per_range(values: DataFrame, wanted: dict, aggregate) -> dict:
    """One aggregate per column and fence for all ranks inside it; its array has an entry per rank."""
    groups: dict[tuple, list] = {}
    for w, (low, high, _, _) in wanted.items():
        groups.setdefault((w[0], low, high), []).append(w)
    sums = [aggregate(_inside(*g), ws).alias(f"g{j}") for j, (g, ws) in enumerate(groups.items())]
    got = values.agg(*sums).first()
    return {w: got[j][n] for j, ws in enumerate(groups.values()) for n, w in enumerate(ws)}


def _narrow(values: DataFrame, wanted: dict, accuracy: int, found: dict) -> dict:
    """One fencing step for all wanted ranks: new bounds, then exact counts below and inside."""
    keys = list(wanted)
    reach = 2.0 / accuracy
    at = {w: (w[1] - f[2]) / max(f[3] - 1, 1) for w, f in wanted.items()}

    def ends(x, ws):
        marks = [F.lit(min(max(at[w] + side, 0.0), 1.0)) for w in ws for side in (-reach, reach)]
        q, lo, hi = F.percentile_approx(x, F.array(*marks), accuracy), F.min(x), F.max(x)
        return F.array(*[F.struct(F.get(q, F.lit(2 * n)).alias("low"), F.get(q, F.lit(2 * n + 1)).alias("high"),
                                  lo.alias("lo"), hi.alias("hi")) for n in range(len(ws))])

    got = _per_range(values, wanted, ends)
    fences, counts = [], []
    for i, k in keys:
        here = got[(i, k)]
        low = here["lo"] if at[(i, k)] - reach <= 0 else here["low"]
        high = here["hi"] if at[(i, k)] + reach >= 1 else here["high"]
        if (low, high) == wanted[(i, k)][:2] and low < high:
            # two frequent values on both sides of the rank: part them in the middle
            high = low + (high - low) / 2
        fences.append((low, high))
        x = F.col(f"c{i}")
        counts += [F.count(F.when(x < low, 1)), F.count(F.when((x >= low) & (x <= high), 1))]
    sizes = values.agg(*[c.alias(f"n{j}") for j, c in enumerate(counts)]).first()
    left = {}
    for j, key in enumerate(keys):
        low, high = fences[j]
        below, inside = sizes[2 * j], sizes[2 * j + 1]
        before = wanted[key]
        if key[1] < below:
            # the fence missed the rank: it is in what lies below
            low, high = got[key]["lo"], math.nextafter(low, -math.inf)
            below, inside = before[2], below - before[2]
        elif key[1] >= below + inside:
            low, high = math.nextafter(high, math.inf), got[key]["hi"]
            below, inside = below + inside, before[2] + before[3] - below - inside
        if low == high:
            found[key] = low
        else:
            left[key] = (low, high, below, inside)
    return left


def quantile_clip(df: DataFrame, cols: list[str] | None = None, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Clip every column to its own low and high quantile."""
    cols = cols or numeric_columns(df)
    bounds = quantiles(df, cols, (low, high))
    return df.withColumns({c: X.clip(_value(c), F.lit(bounds[c][0]), F.lit(bounds[c][1])) for c in cols})


def yeo_johnson_lambda(df: DataFrame, cols: list[str], bounds: dict | None = None) -> DataFrame:
    """(metric, lambda): exponent of highest likelihood per column, to four thousandths."""
    best = exponents(df, cols, bounds)
    rows = [(c, best[c]) for c in cols]
    return df.sparkSession.createDataFrame(rows, "metric string, lambda double")


def _powered(x: np.ndarray, milli: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The power transform of values under each exponent in thousandths, times exp(-scale): no exponent overflows."""
    lam, u = milli / 1000.0, np.log1p(np.abs(x))[:, None]
    part = np.where(x[:, None] >= 0, lam, 2 - lam)
    flat = part == 0
    bent = (np.exp(u * part - scale) - np.exp(-scale)) / np.where(flat, 1.0, part)
    return np.where(x[:, None] >= 0, 1.0, -1.0) * np.where(flat, u * np.exp(-scale), bent)


def _fits(rows: DataFrame, tries: dict[int, np.ndarray], ends: dict[int, dict]) -> dict[int, np.ndarray]:
    """The log-likelihood of every exponent tried for every column, from one scan; NaN where nothing varies.

    Transformed values are scaled by the largest of them and taken from the transform of the column's mean, then
    added up in the task; a column and try is one row of what tasks pass on.
    """
    scale, middle = {}, {}
    for i, milli in tries.items():
        lam = milli / 1000.0
        reach = [np.log1p(e) * p for e, p in ((max(ends[i]["high"], 0.0), lam), (max(-ends[i]["low"], 0.0), 2 - lam))]
        scale[i] = np.maximum(np.maximum(*reach), 0.0)
        middle[i] = _powered(np.array([ends[i]["mean"]]), milli, scale[i])[0]

    def task(batches):
        sums = {i: np.zeros((2, len(m))) for i, m in tries.items()}
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                x = column_matrix(batch.slice(at, SLICE))
                for i, milli in tries.items():
                    own = x[:, i][~np.isnan(x[:, i])]
                    y = _powered(own, milli, scale[i]) - middle[i]
                    sums[i] += [y.sum(0), (y * y).sum(0)]
        cells = [(i, t, a, b) for i, (one, two) in sums.items() for t, (a, b) in enumerate(zip(one.tolist(), two.tolist()))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*cells)], names=["i", "t", "a", "b"])

    out = {i: np.full(len(m), np.nan) for i, m in tries.items()}
    for r in rows.mapInArrow(task, "i long, t long, a double, b double").groupBy("i", "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect():
        i, t, n = r["i"], r["t"], ends[r["i"]]["n"]
        spread = r["b"] / n - (r["a"] / n) ** 2
        if spread > 0:
            # scaled back in logarithms
            out[i][t] = -n / 2 * (math.log(spread) + 2 * scale[i][t]) + (tries[i][t] / 1000.0 - 1) * ends[i]["logs"]
    return out


def exponents(df: DataFrame, cols: list[str], bounds: dict | None = None) -> dict[str, float]:
    """The best exponent per column, all columns at once: a row of tries a scan, then a finer row around the best one.
    Where the best try is the outermost, the next row is twice as wide around it, however far out that leads."""
    if not cols:
        return {}
    x = {c: _value(c) for c in cols}
    if bounds:
        x = {c: X.clip(x[c], F.lit(bounds[c][0]), F.lit(bounds[c][1])) for c in cols}
    rows = df.select(*[x[c].alias(f"c{i}") for i, c in enumerate(cols)])
    got = rows.agg(*[f.alias(f"{k}{i}") for i in range(len(cols)) for k, f in (
        ("n", F.count(f"c{i}")), ("low", F.min(f"c{i}")), ("high", F.max(f"c{i}")), ("mean", F.avg(f"c{i}")),
        ("logs", F.sum(X.signed_log1p(F.col(f"c{i}")))))]).first()
    ends = {i: {k: got[f"{k}{i}"] for k in ("n", "low", "high", "mean", "logs")} for i in range(len(cols))}
    half, step = EXPONENT_PASS
    state = {i: (0, half, step) for i in range(len(cols)) if ends[i]["n"]}
    best = {i: -half for i in range(len(cols))}
    while state:
        tries = {i: np.arange(c - h, c + h + 1, s) for i, (c, h, s) in state.items()}
        left = {}
        for i, fits in _fits(rows, tries, ends).items():
            centre, half, step = state[i]
            if np.isnan(fits).all():
                continue
            best[i] = int(tries[i][np.nanargmax(fits)])
            if abs(best[i] - centre) == half:
                left[i] = best[i], 2 * half, 2 * step
            elif step > EXPONENT_STEP:
                left[i] = best[i], step, max(step // 10, EXPONENT_STEP)
        state = left
    return {c: best[i] / 1000.0 for i, c in enumerate(cols)}


def log1p_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    return normalize(df, cols, route={c: "log" for c in cols})


def power_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    return normalize(df, cols, route={c: "power" for c in cols})


def minmax_scale(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Every column to [0, 1]; the bounds come from one aggregation."""
    cols = cols or numeric_columns(df)
    ends = _values(df, cols).agg(*[f(f"c{i}") for i in range(len(cols)) for f in (F.min, F.max)]).first()
    return df.withColumns({c: X.min_max(_value(c), F.lit(ends[2 * i]), F.lit(ends[2 * i + 1])) for i, c in enumerate(cols)})


def skew_routes(df: DataFrame, cols: list[str]) -> dict[str, str]:
    found = {r["metric"]: r["skew"] for r in skew(df, cols).collect()}
    return {c: "log" if (found[c] or 0) > SKEWED else "power" if (found[c] or 0) < -SKEWED else "plain" for c in cols}


def normalize(df: DataFrame, cols: list[str] | None = None, route: dict[str, str] | None = None) -> DataFrame:
    """Clip every numeric column, pull in its long tail and scale it to [0, 1].

    All three transforms rise with their input, so the ends of a transformed column are the
    transforms of its clip bounds and need no further pass.
    """
    cols = cols or numeric_columns(df)
    route = route or skew_routes(df, cols)
    bounds = quantiles(df, cols)
    lam = exponents(df, [c for c in cols if route[c] == "power"], bounds)

    def shaped(c, x):
        if route[c] == "log":
            return X.safe_log1p(x)
        return X.yeo_johnson(x, F.lit(lam[c])) if route[c] == "power" else x

    out = {}
    for c in cols:
        low, high = (F.lit(b).cast("double") for b in bounds[c])
        out[c] = X.min_max(shaped(c, X.clip(_value(c), low, high)), shaped(c, low), shaped(c, high))
    return df.withColumns(out)


def histogram(df: DataFrame, cols: list[str], bins: int = 30) -> DataFrame:
    """(metric, bin, low, high, n): equal-width bins, empty ones included."""
    spark = df.sparkSession
    ends = _values(df, cols).agg(*[f(f"c{i}") for i in range(len(cols)) for f in (F.min, F.max)]).first()
    spans = {}
    for i, c in enumerate(cols):
        lo, hi = ends[2 * i], ends[2 * i + 1]
        if lo is not None:
            spans[c] = (float(lo), float(hi)) if hi > lo else (lo - 0.5, hi + 0.5)
    boxes = spark.createDataFrame([(c, lo, hi) for c, (lo, hi) in spans.items()], "metric string, lo double, hi double")
    boxes = boxes.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    cells = F.array(*[
        F.struct(F.lit(c).alias("metric"),
                 F.when(_value(c).isNotNull(), F.least(F.floor((_value(c) - lo) / (hi - lo) * bins), F.lit(bins - 1)))
                 .cast("int").alias("bin"))
        for c, (lo, hi) in spans.items()])
    counts = df.select(F.inline(cells)).filter("bin is not null").groupBy("metric", "bin").count()
    edge = (F.col("hi") - F.col("lo")) / bins
    return boxes.join(counts, ["metric", "bin"], "left").select(
        "metric", "bin", (F.col("lo") + F.col("bin") * edge).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * edge).alias("high"), F.coalesce("count", F.lit(0)).alias("n"))


def pearson(a, b):
    """Correlation of the rows where both are there; NULL if one does not vary."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    moves = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(moves, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(metric_a, metric_b, r, n) for every ordered pair of columns, from one pass of matrix products."""
    cols = cols or numeric_columns(df)
    names = F.array(*map(F.lit, cols))
    r = F.when(F.col("moves"), F.try_divide(F.col("cov"), F.sqrt(F.greatest("var_i", F.lit(0.0))) * F.sqrt(F.greatest("var_j", F.lit(0.0)))))
    halves = pair_sums(_values(df, cols)).select("i", "j", r.alias("r"), "n")
    both = F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))
    rows = halves.select("r", "n", F.inline(F.array_distinct(both)))
    return rows.select(F.get(names, F.col("a")).alias("metric_a"), F.get(names, F.col("b")).alias("metric_b"), "r", "n")


def correlation_square(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The same numbers as a square table, one row per metric."""
    cols = cols or numeric_columns(df)
    return correlation_matrix(df, cols).groupBy("metric_a").pivot("metric_b", cols).agg(F.first("r"))
