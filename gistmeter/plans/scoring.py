"""The scoring job: every metric of every pair in one table."""

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.operators import distribution, grammar, overlap, perplexity, pseudo_reference, readability, similarity, surprisal
from gistmeter.operators.layout import Bucketed, fresh_path, materialise, removed
from gistmeter.operators.relational import quoted

FREE_METRICS = ["embedding_similarity", "flesch_score", "grammar_score", "perplexity", "sdc_unigram", "shannon_score",
                "supert_score"]
BERT_METRICS = ["BERT Precision", "BERT Recall", "BERT F1"]
SYNONYM_METRICS = [f"ROUGE-SS {part}" for part in ("F1", "Recall", "Precision")]


def _rouge(n: str) -> list[str]:
    return [f"ROUGE-{n} {part}" for part in ("F1", "Recall", "Precision")]


BASE_METRICS = BERT_METRICS + _rouge("1") + _rouge("2") + _rouge("L")

Part = tuple[list[str], Callable[[], DataFrame]]


def _gathered(ids: DataFrame, parts: list[Part]) -> DataFrame:
    """(id, all metrics of all parts), a row for every id.

    Each part is computed and written on its own, as narrow rows (id, metric, value), so no task holds the
    sorts and hash maps of more than one metric.  One group-by then makes them columns again; a metric
    without a value is NULL.
    """
    spark, path = ids.sparkSession, fresh_path(ids.sparkSession, "metrics")
    names = [c for metrics, _ in parts for c in metrics]
    for k, (metrics, build) in enumerate(parts):
        cells = F.array(*[F.struct(F.lit(names.index(c)).alias("metric"), F.col(quoted(c)).cast("double").alias("value")) for c in metrics])
        build().select("id", F.inline(cells)).filter("value is not null").write.parquet(f"{path}/{k}")
    blank = ids.select("id", F.lit(-1).alias("metric"), F.lit(None).cast("double").alias("value"))
    rows = spark.read.schema(blank.schema).parquet(*[f"{path}/{k}" for k in range(len(parts))]).unionByName(blank)
    wide = rows.groupBy("id").agg(*[F.max(F.when(F.col("metric") == k, F.col("value"))).alias(c) for k, c in enumerate(names)])
    made = materialise(wide, "scores")
    removed(spark, path)
    return made


def _base_parts(pairs: DataFrame, vectors: DataFrame, token_key, synonyms: DataFrame | None, sides: DataFrame, subsequence: bool,
                keyed: similarity.Keyed | None = None) -> list[Part]:
    parts = [(BERT_METRICS, lambda: similarity.bert_score(pairs, vectors, token_key, keyed=keyed)),
             (_rouge("1"), lambda: overlap.rouge_n(pairs, 1, sides=sides)), (_rouge("2"), lambda: overlap.rouge_n(pairs, 2, sides=sides))]
    if subsequence:
        parts.append((_rouge("L"), lambda: overlap.rouge_l(pairs, sides=sides)))
    if synonyms is not None:
        parts.append((SYNONYM_METRICS, lambda: overlap.rouge_ss(pairs, synonyms)))
    return parts


def _free_parts(pairs: DataFrame, vectors: DataFrame, token_key, dictionary: DataFrame | None, known: DataFrame | None, order: int,
                worded: DataFrame | None = None, keyed: similarity.Keyed | None = None) -> list[Part]:
    return [
        (["embedding_similarity"], lambda: similarity.embedding_similarity(pairs, vectors, token_key, keyed)),
        (["flesch_score"], lambda: readability.flesch_score(pairs, dictionary)),
        (["grammar_score"], lambda: grammar.grammar_score(pairs, known, worded)),
        (["perplexity"], lambda: perplexity.perplexity(pairs, worded=worded)),
        (["sdc_unigram"], lambda: distribution.sdc_unigram(pairs, worded)),
        (["shannon_score"], lambda: surprisal.shannon_score(pairs, order, worded)),
        (["supert_score"], lambda: pseudo_reference.supert_score(pairs, vectors, token_key, keyed=keyed)),
    ]


def scores_of(pairs: DataFrame, vectors: DataFrame, token_key=similarity.own_key, dictionary: DataFrame | None = None,
              synonyms: DataFrame | None = None, stem: bool = True, subsequence: bool = True, known: DataFrame | None = None,
              order: int = 2, free: bool = True, base: bool = True, buckets: int | None = None) -> DataFrame:
    """(id, metrics): seven that need no gold summary, and 12 of overlap, three more with synonyms, which are
    0.0 where they have no value.

    Pairs, numbers for their words, the vectors' places of these and stemmed tokens are written once, laid out by id; every metric reads them in a stage of its
    own without moving texts again.  These tables are removed at the end, also when a metric fails.  `buckets` is how
    many parts pairs are laid out in.
    """
    with contextlib.ExitStack() as laid_out:
        def kept(table: DataFrame, placed: bool = True) -> DataFrame:
            return laid_out.enter_context(Bucketed(table, buckets=buckets, placed=placed))

        texts = kept(pairs.select("id", "text", "summary"), placed=False)
        held = similarity.held_lookup(vectors)
        worded = kept(similarity.coded_rows(texts, token_key, held)) if free or held is not None else None
        keyed = None if held is None else similarity.Keyed(worded, held)
        free_parts = _free_parts(texts, vectors, token_key, dictionary, known, order, worded, keyed) if free else []
        base_parts = _base_parts(texts, vectors, token_key, synonyms, kept(overlap.rouge_codes_by_side(texts, stem)), subsequence, keyed) if base else []
        wide = _gathered(texts.select("id"), free_parts + base_parts)
    overlaps = [c for metrics, _ in base_parts for c in metrics]
    return wide.select("id", *[F.coalesce(F.col(quoted(c)), F.lit(0.0)).alias(c) if c in overlaps else quoted(c) for c in wide.columns if c != "id"])


def base_scores(pairs: DataFrame, vectors: DataFrame, token_key=similarity.own_key, synonyms: DataFrame | None = None,
                stem: bool = True, subsequence: bool = True) -> DataFrame:
    """(id, 12 overlap scores, three more with synonyms); 0.0 where a score has no value."""
    return scores_of(pairs, vectors, token_key, None, synonyms, stem, subsequence, free=False)


def free_scores(pairs: DataFrame, vectors: DataFrame, token_key=similarity.own_key,
                dictionary: DataFrame | None = None, known: DataFrame | None = None, order: int = 2) -> DataFrame:
    """(id, seven metrics that need no gold summary)."""
    return scores_of(pairs, vectors, token_key, dictionary, known=known, order=order, base=False)


def score_all(pairs: DataFrame, vectors: DataFrame, token_key=similarity.own_key, dictionary: DataFrame | None = None,
              synonyms: DataFrame | None = None, stem: bool = True, subsequence: bool = True) -> DataFrame:
    """Pairs with all their scores, in the order of the study."""
    return pairs.join(scores_of(pairs, vectors, token_key, dictionary, synonyms, stem, subsequence), "id", "left")
