"""Smoothed n-gram model of each text, scored on its summary."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.operators import counting
from gistmeter.operators.tokens import START, both_sides


def _counted(pairs: DataFrame, n: int, words: bool, worded: DataFrame | None = None) -> DataFrame:
    names = [f"w{i + 1}" for i in range(n)] if words else []

    def count(rows, owner, ids):
        g = counting.Grams(rows, owner, len(ids), n, pad=True)
        codes, _ = counting.coded(rows.column("t").flatten())
        row, _ = counting.within(counting.lengths(rows.column("t")))
        word = counting.ranked(row, codes[0])
        per_row = np.bincount(row[counting.first_of(word, int(word.max(initial=-1)) + 1)], minlength=rows.num_rows)
        per_row[rows.column("t").is_null().to_numpy(zero_copy_only=False)] = -1
        vocab = g.largest(per_row)
        at = np.arange(g.n)
        if not words:
            # the summary's n-grams and one of each id
            kept = g.c_summary > 0
            kept[np.unique(g.owner, return_index=True)[1]] = True
            at = np.flatnonzero(kept)
        vocab = vocab[at]
        return {"id": ids.take(pa.array(g.owner[at])), **{c: g.strings_of(k, START) for k, c in enumerate(names)}, "c_text": pa.array(g.c_text[at]),
                "c_summary": pa.array(g.c_summary[at]), "vocab": pa.array(vocab, pa.int32(), mask=vocab < 0), "c_context": pa.array(g.c_context[at])}

    rows = both_sides(pairs, worded=worded)
    words_of = "".join(f"{c} string, " for c in names)
    return counting.mapped(rows, count, f"id {counting.key_type(pairs)}, {words_of}c_text long, c_summary long, vocab int, c_context long")


def ngram_model(pairs: DataFrame, n: int = 3) -> DataFrame:
    """(id, w1..wn, c_text, c_summary, vocab, c_context): counts of every n-gram of a pair.

    Both sides are counted together, so model and evaluation need no join.  A pair
    with a side without tokens has one row with NULL words.
    """
    return _counted(pairs, n, words=True)


def laplace_prob(model: DataFrame) -> DataFrame:
    """Add-one probability of each n-gram; NULL where the text has no words."""
    p = F.try_divide((F.col("c_text") + 1).cast("double"), (F.col("c_context") + F.col("vocab")).cast("double"))
    return model.withColumn("prob", F.when(F.col("vocab") > 0, p))


def perplexity(pairs: DataFrame, n: int = 3, worded: DataFrame | None = None) -> DataFrame:
    """(id, perplexity): exp of the mean surprisal of the summary's tokens."""
    scored = laplace_prob(_counted(pairs, n, False, worded))
    logs = F.sum(F.col("c_summary") * F.ln("prob"))
    return scored.groupBy("id").agg(
        F.exp(-F.try_divide(logs, F.sum("c_summary").cast("double"))).alias("perplexity"))
