"""Overlap of summary and text: n-grams, longest common subsequence, synonyms."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmeter.functions import porter, text
from gistmeter.functions.porter import stem_of
from gistmeter.operators import counting
from gistmeter.operators.layout import lookup_join
from gistmeter.operators.tokens import SUMMARY, TEXT, side_rows, token_counts


def precision_recall_f1(hits: Column, n_summary: Column, n_text: Column, name: str) -> list[Column]:
    """Three score columns; 0 wherever nothing can be divided."""
    hit, s, t = hits.cast("double"), n_summary.cast("double"), n_text.cast("double")
    p = F.coalesce(F.try_divide(hit, s), F.lit(0.0))
    r = F.coalesce(F.try_divide(hit, t), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return [f.alias(f"{name} F1"), r.alias(f"{name} Recall"), p.alias(f"{name} Precision")]


def rouge_tokens_by_side(pairs: DataFrame, stem: bool = True) -> DataFrame:
    """(id, side, toks): overlap tokens in order, one row per text.

    Stems are computed where the tokens are: no shuffle, and no dictionary that grows with
    the corpus.
    """
    sides = side_rows(pairs, text.rouge_tokens)
    return sides.withColumn("toks", porter.stems(F.col("toks"))) if stem else sides


_TOKEN_BYTES = np.zeros(256, bool)  # of text.ROUGE_TOKEN
_TOKEN_BYTES[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True


def rouge_codes_by_side(pairs: DataFrame, stem: bool = True) -> DataFrame:
    """(id, side, toks): `rouge_tokens_by_side` with a number for each token, the same in all texts of an id and in the order
    of the tokens.  Tokens are cut, stemmed and numbered many pairs at a time."""
    def count(rows, owner, ids):
        cut = [counting.byte_runs(rows.column(c), _TOKEN_BYTES) for c in ("t", "s")]
        whole = pa.chunked_array([tokens for tokens, _ in cut], pa.string()).combine_chunks().dictionary_encode()
        known = whole.dictionary.to_pylist()
        if stem:
            known = [stem_of(t) for t in known]
        stems = pa.array(known, pa.string()).dictionary_encode()
        rank = np.empty(len(stems.dictionary), "int32")
        rank[pc.sort_indices(stems.dictionary).to_numpy()] = np.arange(len(rank))
        codes = rank[stems.indices.to_numpy(zero_copy_only=False)][whole.indices.to_numpy(zero_copy_only=False)]
        parts, at = [], 0
        for c, (tokens, n) in zip(("t", "s"), cut):
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            parts.append(pa.ListArray.from_arrays(offsets, pa.array(codes[at:at + len(tokens)]), mask=rows.column(c).is_null()))
            at += len(tokens)
        side = np.repeat(np.array([TEXT, SUMMARY], "int32"), rows.num_rows)
        return {"id": pa.concat_arrays([rows.column("id")] * 2), "side": pa.array(side), "toks": pa.concat_arrays(parts)}

    rows = counting.by_id(pairs, F.lower("text").alias("t"), F.lower("summary").alias("s"))
    return counting.mapped(rows, count, f"id {counting.key_type(pairs)}, side int, toks array<int>", counting.CUT)


def _gram_scores(sides: DataFrame, n: int) -> DataFrame:
    def count(rows, owner, ids):
        g = counting.Grams(rows, owner, len(ids), n, pad=False)
        hits = np.bincount(g.owner, weights=np.minimum(g.c_text, g.c_summary), minlength=len(ids)).astype("int64")
        return {"id": ids, "hits": pa.array(hits), "s": pa.array(g.n_summary), "t": pa.array(g.n_text)}

    def of(side: int, name: str) -> Column:
        return F.when(F.col("side") == side, F.col("toks")).alias(name)

    rows = counting.by_id(sides, of(TEXT, "t"), of(SUMMARY, "s"))
    sums = counting.mapped(rows, count, f"id {counting.key_type(sides)}, hits long, s long, t long")
    return sums.select("id", *precision_recall_f1(F.col("hits"), F.col("s"), F.col("t"), f"ROUGE-{n}"))


def rouge_n(pairs: DataFrame, n: int = 1, stem: bool = True, sides: DataFrame | None = None) -> DataFrame:
    """(id, ROUGE-n F1, Recall, Precision) from clipped n-gram counts."""
    return _gram_scores(rouge_tokens_by_side(pairs, stem) if sides is None else sides, n)


def _lcs(a, b) -> int:
    """Length of the longest common subsequence, one bit row per token (Hyyro 2004)."""
    if len(a) > len(b):
        a, b = b, a
    where: dict = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        hit = row & where.get(t, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((_lcs(x.tolist(), y.tolist()) for x, y in zip(a, b)), dtype="int64", count=len(a)))


def rouge_l(pairs: DataFrame, stem: bool = True, sides: DataFrame | None = None) -> DataFrame:
    """(id, lcs, ROUGE-L F1, Recall, Precision)."""
    sides = rouge_tokens_by_side(pairs, stem) if sides is None else sides
    wide = sides.groupBy("id").agg(F.max(F.when(F.col("side") == TEXT, F.col("toks"))).alias("t"),
                                   F.max(F.when(F.col("side") == SUMMARY, F.col("toks"))).alias("s"))
    empty = F.array().cast(sides.schema["toks"].dataType)
    codes = wide.select("id", F.coalesce("t", empty).alias("t"), F.coalesce("s", empty).alias("s"))
    scored = codes.select("id", F.size("t").alias("nt"), F.size("s").alias("ns"), lcs_length("s", "t").alias("lcs"))
    return scored.select("id", "lcs", *precision_recall_f1(F.col("lcs"), F.col("ns"), F.col("nt"), "ROUGE-L"))


def rouge_ss(pairs: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(id, ROUGE-SS F1, Recall, Precision): distinct summary tokens met by a token of the
    text or by one of its synonyms (word, synonym)."""
    counts = token_counts(pairs, text.ws_tokens).select("id", "tok", "c_text", "c_summary")
    known = synonyms.select(F.col("word").alias("tok"), text.clean_lemma(F.col("synonym")).alias("synonym"))
    known = known.groupBy("tok").agg(F.collect_set("synonym").alias("synonyms"))
    widened = lookup_join(counts, known, "tok")
    # each token of the text stands for itself and for its synonyms
    own = F.array(F.struct(F.col("tok").alias("word"), (F.col("c_text") > 0).alias("listed"), "c_text", "c_summary"))
    more = F.when((F.col("c_text") > 0) & F.col("synonyms").isNotNull(), F.transform(
        "synonyms", lambda s: F.struct(s.alias("word"), F.lit(True).alias("listed"),
                                       F.lit(0).cast("long").alias("c_text"), F.lit(0).cast("long").alias("c_summary"))))
    words = widened.select("id", F.inline(F.concat(own, F.coalesce(
        more, F.array().cast("array<struct<word:string,listed:boolean,c_text:bigint,c_summary:bigint>>")))))
    merged = words.groupBy("id", "word").agg(F.max("listed").alias("listed"), F.sum("c_text").alias("c_text"),
                                             F.sum("c_summary").alias("c_summary"))
    sums = merged.groupBy("id").agg(
        F.count(F.when(F.col("listed") & (F.col("c_summary") > 0), 1)).alias("hits"),
        F.sum("c_summary").alias("s"), F.sum("c_text").alias("t"))
    return sums.select("id", *precision_recall_f1(F.col("hits"), F.col("s"), F.col("t"), "ROUGE-SS"))
