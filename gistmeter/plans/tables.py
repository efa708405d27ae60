"""Tables the weighting queries start from."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmeter.operators import composite, ratings, relational, stats
from gistmeter.operators.layout import materialise, parts_of
from gistmeter.plans import corpus, scoring

_held: dict[tuple[str, str], DataFrame] = {}


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, metrics) of the document pairs, laid out in as many parts as the documents' files ask for."""
    return scoring.scores_of(corpus.pairs_doc(spark, sf_dir), *corpus.token_vectors(spark, sf_dir), buckets=parts_of(corpus.table(spark, sf_dir, "documents")))


def raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored document pairs with model ratings and human scores, no texts.

    Scoring is the costly part and many weightings are tried on its result, so the table is written once
    per application, as Parquet: a query reads the columns it needs.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    for other in [k for k in _held if k[0] != key[0]]:
        del _held[other]  # its application, and the folder it wrote to, are gone
    if key not in _held:
        pairs = corpus.pairs_doc(spark, sf_dir)
        rated = ratings.attach_ratings(pairs, corpus.responses(pairs))
        rated = relational.canonical_columns(relational.drop_texts(rated), relational.MODEL_COLUMNS)
        scores = document_scores(spark, sf_dir)
        human = corpus.human_scores(spark, sf_dir)
        _held[key] = materialise(scores.join(rated, "id", "left").join(human, "id", "left"), "raw-scores")
    return _held[key]


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores as the study searches them: the metrics clipped, pulled in and scaled to [0, 1]."""
    scores = raw_scores(spark, sf_dir)
    return stats.normalize(scores, composite.METRICS)


def two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rated tables of the search as one: each source is normalised by itself before the union."""
    scores = raw_scores(spark, sf_dir)
    halves = [scores.filter(F.col("id") % 2 == k) for k in (0, 1)]
    return relational.union_sources(*[stats.normalize(h, composite.METRICS) for h in halves])


def split_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return relational.train_test_split(two_sources(spark, sf_dir))


def human_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document pairs as the human-rated source names its columns."""
    pairs = corpus.pairs_doc(spark, sf_dir)
    return pairs.join(corpus.human_scores(spark, sf_dir), "id").select(
        "id", F.col("text").alias("article"), F.col("summary").alias("highlights"),
        F.col("overall_score_human").alias("overall"))
