"""Search for the weighting of metrics that agrees best with human scores.

A weighting's correlation depends on the table only through means and covariances.  They
are taken in one pass; every weighting after that is arithmetic on a handful of numbers.
"""

from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmeter.operators.gram import pair_sums
from gistmeter.operators.relational import join_scores, quoted
from gistmeter.operators.stats import correlation_matrix, pearson

# The metrics of the search, their groups and the columns of the report.
METRICS = ["shannon_score", "supert_score", "grammar_score", "flesch_score", "perplexity", "sdc_unigram",
           "embedding_similarity"]
GROUPS = [["shannon_score", "supert_score"], ["grammar_score", "flesch_score"], ["perplexity"],
          ["sdc_unigram", "embedding_similarity"]]
REPORT = ["composite_score", "human_score", "BERT F1", "ROUGE-1 F1", "ROUGE-2 F1", "ROUGE-L F1", "overall_score_llm",
          "information_similarity_llm", "grammatical_correctness_llm", "conciseness_llm", "cohesion_llm"]
HUMAN = "overall_score_human"
TENTHS = 10
QUARTERS = 4
TIE_DIGITS = 9


def composite_score(df: DataFrame, cols: list[str], weights: list[float]) -> DataFrame:
    """(id, score): weighted sum of metrics."""
    total = sum((F.lit(float(w)) * F.col(quoted(c)) for c, w in zip(cols, weights)), F.lit(0.0))
    return df.select("id", total.alias("score"))


def pearson_to_human(df: DataFrame, human: DataFrame, cols: list[str], weights: list[float]) -> DataFrame:
    """(n, r) of the composite with `human_score` in (id, human_score)."""
    both = join_scores(composite_score(df, cols, weights), human)
    complete = F.col("score").isNotNull() & F.col("human_score").isNotNull()
    return both.agg(F.count(F.when(complete, 1)).alias("n"), pearson(F.col("score"), F.col("human_score")).alias("r"))


def metric_moments(df: DataFrame, cols: list[str] = METRICS, target: str = HUMAN) -> DataFrame:
    """(metric_a, metric_b, n, mean_a, mean_b, cov) over rows where all columns are there."""
    names = cols + [target]
    whole = df.select(*[F.nanvl(F.col(quoted(c)).cast("double"), F.lit(None).cast("double")).alias(f"c{i}")
                        for i, c in enumerate(names)]).na.drop()
    labels = F.array(*map(F.lit, names))
    return pair_sums(whole).select(F.get(labels, F.col("i")).alias("metric_a"), F.get(labels, F.col("j")).alias("metric_b"), "n",
                                   F.col("mean_i").alias("mean_a"), F.col("mean_j").alias("mean_b"), "cov")


class Moments:
    """The covariances of one table on the driver: at most a few dozen numbers."""

    def __init__(self, df: DataFrame, cols: list[str] = METRICS, target: str = HUMAN):
        self.cols, self.target = cols, target
        names = cols + [target]
        self.cov, self.mean = np.zeros((len(names), len(names))), np.zeros(len(names))
        for row in metric_moments(df, cols, target).collect():
            i, j = names.index(row["metric_a"]), names.index(row["metric_b"])
            self.cov[i, j] = self.cov[j, i] = row["cov"] or 0.0
            self.mean[i] = row["mean_a"] or 0.0
            self.mean[j] = row["mean_b"] or 0.0

    def correlation(self, weights: list[Column]) -> Column:
        """r of a weighting given as columns; NULL where the composite does not vary."""
        k = len(self.cols)
        shared = sum((w * F.lit(float(self.cov[i, k])) for i, w in enumerate(weights)), F.lit(0.0))
        spread = sum((weights[i] * weights[j] * F.lit(float(self.cov[i, j])) for i in range(k) for j in range(k)), F.lit(0.0))
        whole = spread * F.lit(float(self.cov[k, k]))
        return F.when(whole > 0, shared / F.sqrt(F.greatest(whole, F.lit(0.0))))

    def scored_lattice(self, lattice: DataFrame, steps: int) -> DataFrame:
        """(units, mask, r) of the weightings that can be correlated: two matrix products a batch of the lattice."""
        k = len(self.cols)
        cov, shared, own = self.cov[:k, :k], self.cov[:k, k], self.cov[k, k]

        def score(batches):
            for batch in batches:
                w = batch.column(0).flatten().to_numpy().reshape(-1, k) / steps
                spread = ((w @ cov) * w).sum(1) * own
                some = spread > 0
                r = (w @ shared)[some] / np.sqrt(spread[some])
                yield pa.RecordBatch.from_arrays([*(c.filter(pa.array(some)) for c in batch.columns), pa.array(r)], names=["units", "mask", "r"])

        return lattice.select("units", "mask").mapInArrow(score, "units array<int>, mask long, r double")


def _names(mask: Column, cols: list[str]) -> Column:
    parts = [F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for i, c in enumerate(cols)]
    return F.concat_ws("+", *parts)


def metric_subsets(spark: SparkSession, cols: list[str] = METRICS) -> DataFrame:
    """(mask, metrics): every non-empty set of metrics; bit i of the mask stands for metric i."""
    masks = spark.range(1, 2 ** len(cols)).select(F.col("id").alias("mask"))
    return masks.withColumn("metrics", _names(F.col("mask"), cols))


def group_product(spark: SparkSession, groups=GROUPS, cols: list[str] = METRICS) -> DataFrame:
    """(mask, metrics): every choice of one metric per group."""
    masks = [(sum(1 << cols.index(c) for c in choice),) for choice in product(*groups)]
    return spark.createDataFrame(masks, "mask long").withColumn("metrics", _names(F.col("mask"), cols))


def uniform_weights(subsets: DataFrame, moments: Moments) -> DataFrame:
    """Add `r` of equal weights; 0.0 and fallback = true where nothing can be correlated."""
    ws = [F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, 1.0).otherwise(0.0) / F.bit_count("mask")
          for i in range(len(moments.cols))]
    r = moments.correlation(ws)
    return subsets.withColumn("r", F.coalesce(r, F.lit(0.0))).withColumn("fallback", r.isNull())


def weight_lattice(spark: SparkSession, k: int, steps: int, signed: bool = False) -> DataFrame:
    """(units, mask): all weightings in whole steps that add up to one.  Signed ones reach from -1 to 1.

    The first weights are dealt out before the others are added, so many tasks expand the lattice.
    """
    low = -steps if signed else 0
    lattice = spark.range(low, steps + 1).select(F.array(F.col("id").cast("int")).alias("units"), (F.lit(steps) - F.col("id")).alias("rest"))
    for i in range(1, k):
        if i == k - 1:
            choices = F.array(F.col("rest"))
        else:
            choices = F.sequence(F.lit(low).cast("long"), F.lit(steps).cast("long") if signed else F.col("rest"))
        lattice = lattice.withColumn("u", F.explode(choices)).filter(F.abs("u") <= steps)
        lattice = lattice.select(F.concat("units", F.array(F.col("u").cast("int"))).alias("units"), (F.col("rest") - F.col("u")).alias("rest"))
        if i == 2:
            lattice = lattice.repartition("units")
    mask = sum((F.when(F.col("units")[i] != 0, 1 << i).otherwise(0) for i in range(k)), F.lit(0).cast("long"))
    return lattice.select("units", mask.alias("mask"))


def weight_sweep(moments: Moments, spark: SparkSession, positive: bool = True) -> DataFrame:
    """(mask, metrics, units, weights, steps, r, fallback): the best lattice weighting of every set of metrics.

    Zero weights are allowed, so a set also inherits the best weighting of the sets inside it.  A set none
    of whose weightings can be correlated has equal weights, no units, an r of 0.0 and fallback = true.
    """
    k = len(moments.cols)
    steps = TENTHS if positive else QUARTERS
    lattice = weight_lattice(spark, k, steps, signed=not positive)
    scored = moments.scored_lattice(lattice, steps)
    rank = F.struct(F.round("r", TIE_DIGITS).alias("r"), F.col("units"))
    own = scored.groupBy("mask").agg(F.max(rank).alias("best"))
    sets = metric_subsets(spark, moments.cols)
    inside = own.select(F.col("mask").alias("part"), "best")
    # both sides have a row for each set of metrics at most
    best = (sets.join(inside, F.col("mask").bitwiseAND(F.col("part")) == F.col("part"), "left")
            .groupBy("mask", "metrics").agg(F.max("best").alias("best")))
    equal = F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, 1.0).otherwise(0.0) / F.bit_count("mask") for i in range(k)])
    weights = F.coalesce(F.transform("best.units", lambda u: u / F.lit(float(steps))), equal)
    return best.select("mask", "metrics", F.col("best.units").alias("units"), weights.alias("weights"), F.lit(steps).alias("steps"),
                       F.coalesce("best.r", F.lit(0.0)).alias("r"), F.col("best").isNull().alias("fallback"))


def least_squares(moments: Moments, spark: SparkSession) -> DataFrame:
    """(mask, metrics, weights, r, reachable): the weighting of highest r for every set.

    That direction is the least-squares fit.  Weights are scaled to absolute sum one;
    `reachable` is false where, scaled to a sum of one, some weight would lie outside [-1, 1], or the
    sum is zero or less.
    """
    cov, k = moments.cov, len(moments.cols)

    def solve(batches):
        for batch in batches:
            out = []
            for mask in batch["mask"]:
                use = [i for i in range(k) if mask >> i & 1]
                w = np.zeros(k)
                w[use] = np.linalg.lstsq(cov[np.ix_(use, use)], cov[use, k], rcond=1e-12)[0]
                size = np.abs(w).sum()
                if size > 0:
                    w = w / size
                    r = float(w @ cov[:k, k] / np.sqrt(w @ cov[:k, :k] @ w * cov[k, k]))
                else:
                    w[use], r = 1 / len(use), 0.0
                out.append((w.tolist(), r, bool(w.sum() > 0 and np.abs(w).max() <= w.sum() + 1e-12)))
            yield pd.DataFrame({"mask": batch["mask"], "weights": [o[0] for o in out], "r": [o[1] for o in out],
                                "reachable": [o[2] for o in out]})

    sets = metric_subsets(spark, moments.cols)
    fitted = sets.select("mask").mapInPandas(solve, "mask long, weights array<double>, r double, reachable boolean")
    return fitted.withColumn("metrics", _names(F.col("mask"), moments.cols))


def _bounded_optimum(cov: np.ndarray, shared: np.ndarray) -> np.ndarray | None:
    """The w of highest shared.w / sqrt(w.cov.w) with a sum of one and every weight in [-1, 1]; None if nothing varies.

    Each face of that polytope fixes some weights at -1 or 1.  On the plane through a face the ratio has one
    maximum, a linear solve; the best of those that lie in their face is the best of all.  Where covariances
    are singular, the optima reach a smaller face on which the solve is regular.
    """
    k, sd = len(shared), np.sqrt(np.diag(cov))
    best, top = None, -np.inf
    for n_fixed in range(k + 1):
        for fixed in combinations(range(k), n_fixed):
            free = [i for i in range(k) if i not in fixed]
            for ends in product((1.0, -1.0), repeat=n_fixed):
                w = np.zeros(k)
                w[list(fixed)] = ends
                rest = 1 - sum(ends)
                if not free and rest or abs(rest) > len(free):
                    continue
                if free:
                    w[free] = rest / len(free)
                if len(free) > 1:
                    plane = np.zeros((k, len(free)))  # the first column is a point of the plane, the others its directions
                    plane[:, 0] = w
                    plane[free[:-1], range(1, len(free))] = 1
                    plane[free[-1], 1:] = -1
                    y = np.linalg.lstsq(plane.T @ cov @ plane, plane.T @ shared, rcond=1e-12)[0]
                    if y[0] <= 1e-12 * np.abs(y).max():
                        continue  # the plane's only stationary point is a minimum or infinitely far
                    w = plane @ (y / y[0])
                if np.abs(w).max() > 1 + 1e-9:
                    continue
                spread = w @ cov @ w
                if spread > 1e-12 * (np.abs(w) @ sd) ** 2:
                    ratio = shared @ w / np.sqrt(spread)
                    if ratio > top + 1e-12 * abs(ratio):
                        best, top = w, ratio
    return best


def bounded_weights(moments: Moments, spark: SparkSession) -> DataFrame:
    """(mask, metrics, weights, r, fallback): the best weighting of every set with a sum of one and weights in [-1, 1].

    Weights are then scaled to absolute sum one.  Where `least_squares` is reachable, this is its weighting.
    A set none of whose weightings can be correlated has equal weights, an r of 0.0 and fallback = true.
    """
    still = np.diag(moments.cov) <= 1e-26 * moments.mean ** 2  # a constant column's variance is rounding
    cov, k = np.where(still[:, None] | still, 0.0, moments.cov), len(moments.cols)

    def solve(batches):
        for batch in batches:
            out = []
            for mask in batch["mask"]:
                use = [i for i in range(k) if mask >> i & 1]
                found = _bounded_optimum(cov[np.ix_(use, use)], cov[use, k]) if cov[k, k] > 0 else None
                w, r = np.zeros(k), 0.0
                w[use] = 1 / len(use) if found is None else found / np.abs(found).sum()
                if found is not None:
                    r = float(w @ cov[:k, k] / np.sqrt(w @ cov[:k, :k] @ w * cov[k, k]))
                out.append((w.tolist(), r, found is None))
            yield pd.DataFrame({"mask": batch["mask"], "weights": [o[0] for o in out], "r": [o[1] for o in out],
                                "fallback": [o[2] for o in out]})

    sets = metric_subsets(spark, moments.cols)
    found = sets.select("mask").mapInPandas(solve, "mask long, weights array<double>, r double, fallback boolean")
    return found.withColumn("metrics", _names(F.col("mask"), moments.cols))


def fit_weights(train: DataFrame, cols: list[str] = METRICS, target: str = HUMAN) -> DataFrame:
    """(metric, weight, reachable): least-squares weights of the table itself, absolute sum one."""
    rows = train.select(*[F.col(quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(cols)],
                        F.col(quoted(target)).cast("double").alias("label")).na.drop()
    vectors = VectorAssembler(inputCols=[f"c{i}" for i in range(len(cols))], outputCol="features").transform(rows)
    fitted = LinearRegression(solver="normal").fit(vectors).coefficients.toArray()
    size = float(np.abs(fitted).sum())
    weights = fitted / size if size > 0 else np.full(len(cols), 1 / len(cols))
    reachable = bool(weights.sum() > 0 and np.abs(weights).max() <= weights.sum() + 1e-12)
    return train.sparkSession.createDataFrame(
        [(c, float(w), reachable) for c, w in zip(cols, weights)], "metric string, weight double, reachable boolean")


def with_test_r(found: DataFrame, test: Moments, weights: str = "weights") -> DataFrame:
    ws = [F.col(weights)[i].cast("double") for i in range(len(test.cols))]
    return found.withColumn("test_r", test.correlation(ws))


def select_best(found: DataFrame) -> DataFrame:
    """The set with the highest test_r, the first one on ties; none at or below -1."""
    rank = F.struct(F.round("test_r", TIE_DIGITS).alias("r"), (-F.col("mask")).alias("order"))
    kept = found.filter("test_r > -1")
    return kept.agg(F.max_by(F.struct(*[F.col(c) for c in found.columns]), rank).alias("best")).select("best.*")


def composite_report(test: DataFrame, cols: list[str], weights: list[float], report: list[str] = REPORT) -> DataFrame:
    """(metric_a, metric_b, r, n) of the composite with human, model and overlap scores."""
    total = sum((F.lit(float(w)) * F.col(quoted(c)) for c, w in zip(cols, weights)), F.lit(0.0))
    named = test.withColumn("composite_score", total).withColumnsRenamed({"cohesion": "cohesion_llm", HUMAN: "human_score"})
    return correlation_matrix(named, report)
