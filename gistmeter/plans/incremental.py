"""Scores kept from run to run: a pair is scored again only if its text, its summary or the metrics changed."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmeter.operators.layout import Bucketed
from gistmeter.operators.relational import quoted
from gistmeter.sources.versions import BUCKETS, VersionedTable

MARK = "_fingerprint"


def fingerprint(version: str) -> Column:
    """Of a pair's text and summary and the metrics' version.  A null differs from an empty text."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("v"), F.col("text").alias("t"), F.col("summary").alias("s"))), 256)


class ScoreTable:
    """Rows (id, fingerprint, metrics), each written once.  A row whose fingerprint no pair has any more is never read.

    `metrics` names the columns that `score` adds to (id, text, summary); each pair's values must follow from that pair
    and from what `version` stands for, so a dictionary that metrics use belongs into the version.  `parts` tells that all pairs
    are laid out by id in so many parts.
    """

    def __init__(self, spark: SparkSession, folder: str, id_type: T.DataType, metrics: list[str], score: Callable[[DataFrame], DataFrame],
                 version: str, buckets: int = BUCKETS, parts: int | None = None):
        self.metrics, self.score, self.version, self.parts = metrics, score, version, parts
        fields = [T.StructField("id", id_type), T.StructField(MARK, T.StringType()), *(T.StructField(m, T.DoubleType()) for m in metrics)]
        self.table = VersionedTable(spark, folder, "id", T.StructType(fields), buckets)

    def _marked(self, pairs: DataFrame) -> DataFrame:
        return pairs.select("id", fingerprint(self.version).alias(MARK))

    def missing(self, pairs: DataFrame) -> DataFrame:
        """The pairs that have no scores yet.  Only ids and fingerprints are shuffled to tell; texts laid out by id stay where they are."""
        known = self.table.read().select("id", MARK)
        asked = pairs.select("id", "text", "summary", fingerprint(self.version).alias(MARK))
        fresh = asked.select("id", MARK).join(known, ["id", MARK], "left_anti")
        # one row for an id, so that the id alone is the key
        marks = fresh.groupBy("id").agg(F.collect_set(MARK).alias("_marks"))
        return asked.join(marks.hint("merge"), "id").filter(F.array_contains("_marks", F.col(MARK))).drop("_marks")

    def update(self, pairs: DataFrame) -> int:
        """Score what is missing and add it; returns how many rows that wrote.  `score` gets these pairs laid out by id, in
        `parts` parts."""
        with Bucketed(self.missing(pairs), buckets=self.parts, placed=self.parts is not None) as changed:
            n = changed.count()
            if n:
                scores = self.score(changed.drop(MARK)).select("id", *[F.col(quoted(m)).cast("double").alias(m) for m in self.metrics])
                self.table.write(changed.select("id", MARK).join(scores, "id", "left"))
        return n

    def scores(self, pairs: DataFrame) -> DataFrame:
        """(id, metrics) of the pairs, as they were last updated."""
        rows = self._marked(pairs).join(self.table.read(), ["id", MARK], "left")
        return rows.select("id", *[quoted(m) for m in self.metrics])
