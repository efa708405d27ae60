"""Shift of the word distribution when the summary is read before the text."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.operators.tokens import token_counts

UNSEEN = 1e-6


def unigram_probs(pairs: DataFrame) -> DataFrame:
    """(id, tok, p) of the text's own tokens."""
    counts = token_counts(pairs).filter("c_text > 0")
    return counts.select("id", "tok", (F.col("c_text").cast("double") / F.col("n_text")).alias("p"))


def token_probs(pairs: DataFrame) -> DataFrame:
    """(id, tok, n, p): each distinct summary token under the text's distribution."""
    p = F.try_divide(F.col("c_text").cast("double"), F.col("n_text").cast("double"))
    probs = token_counts(pairs).withColumn("p", F.when(F.col("c_text") > 0, p).otherwise(F.lit(UNSEEN)))
    return probs.filter("c_summary > 0").select("id", "tok", F.col("c_summary").alias("n"), "p")


def sdc_unigram(pairs: DataFrame, worded: DataFrame | None = None) -> DataFrame:
    """(id, sdc_shift, sdc_correlation, sdc_unigram).

    The correlation runs over token positions and does not change with scale, so it is
    taken from whole-number sums over token counts: exact in any order of rows.
    """
    counts = token_counts(pairs, words=False, worded=worded).withColumn("n_both", F.col("n_text") + F.col("n_summary"))
    # tokens of a pair with the same counts are one row
    w, a, b = F.col("c_text") * F.col("tokens"), F.col("c_text"), F.col("c_text") + F.col("c_summary")
    shift = F.abs(F.try_divide(b.cast("double"), F.col("n_both").cast("double"))
                  - F.try_divide(a.cast("double"), F.col("n_text").cast("double")))

    def total(x):
        return F.sum(x.cast("decimal(38,0)"))

    sums = counts.groupBy("id").agg(
        F.max("n_text").cast("decimal(38,0)").alias("n"), total(w * a).alias("sa"), total(w * b).alias("sb"),
        total(w * a * a).alias("saa"), total(w * b * b).alias("sbb"), total(w * a * b).alias("sab"),
        F.sum(w * shift).alias("sdc_shift"),
    )
    spread_a = F.expr("n * saa - sa * sa").cast("double")
    spread_b = F.expr("n * sbb - sb * sb").cast("double")
    r = F.expr("n * sab - sa * sb").cast("double") / (F.sqrt(spread_a) * F.sqrt(spread_b))
    c = F.when((spread_a > 0) & (spread_b > 0), r).otherwise(F.lit(0.0))
    enough = F.col("n") >= 2
    return (sums.withColumn("sdc_correlation", F.when(enough, c))
            .withColumn("sdc_shift", F.when(enough, F.col("sdc_shift")))
            .select("id", "sdc_shift", "sdc_correlation",
                    (F.col("sdc_shift") * (F.col("sdc_correlation") + 1) / 2).alias("sdc_unigram")))
