"""Column and row plumbing of the score tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Source column -> canonical column.
MODEL_COLUMNS = {
    "overall_score": "overall_score_llm",
    "information_similarity": "information_similarity_llm",
    "grammatical_correctness": "grammatical_correctness_llm",
    "conciseness": "conciseness_llm",
    "cohesion": "cohesion_llm",
}
HUMAN_COLUMNS = {
    "article": "text",
    "highlights": "summary",
    "note_human": "note",
    "overall": "overall_score_human",
    "accuracy": "accuracy_human",
    "coverage": "coverage_human",
    "coherence": "coherence_human",
}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def metric_extract(df: DataFrame, *metrics: str) -> DataFrame:
    return df.select("id", *[quoted(m) for m in metrics])


def canonical_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename what is there; names the table lacks are passed over."""
    return df.withColumnsRenamed(mapping or {**HUMAN_COLUMNS, **MODEL_COLUMNS})


def drop_texts(df: DataFrame) -> DataFrame:
    return df.drop("text", "summary")


def merge_labels(model_rated: DataFrame, human_rated: DataFrame) -> DataFrame:
    """Model ratings next to human ratings, pairs present on both sides only."""
    return canonical_columns(drop_texts(model_rated).join(human_rated, "id", "inner"))


def join_scores(scores: DataFrame, human: DataFrame) -> DataFrame:
    return scores.join(human, "id", "inner")


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Ids held by more than one row: every one would multiply rows in a join on id."""
    return df.groupBy("id").count().filter("count > 1").withColumnRenamed("count", "n")


def assert_unique_id(df: DataFrame) -> DataFrame:
    found = duplicate_ids(df).limit(5).collect()
    if found:
        raise ValueError(f"id is not unique, for example {[r['id'] for r in found]}")
    return df


def first_n(df: DataFrame, n: int, order: str = "id") -> DataFrame:
    return df.orderBy(order).limit(n)


def union_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.name != "id" and isinstance(f.dataType, T.NumericType)]


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c) for c in numeric_columns(df)])


def select_metrics(df: DataFrame, metrics: list[str]) -> DataFrame:
    return df.select(*[quoted(m) for m in metrics])


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    c = F.col(quoted(column))
    return df.filter(c.isNotNull() & ~F.isnan(c.cast("double")))


def train_test_split(df: DataFrame, test_tenths: int = 3, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Split on a hash of the key: the same rows on every run and in every layout."""
    flagged = df.withColumn("_test", is_test(key, test_tenths))
    return flagged.filter("not _test").drop("_test"), flagged.filter("_test").drop("_test")


def is_test(key: str = "id", test_tenths: int = 3):
    head = F.substring(F.md5(F.col(key).cast("string")), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(10)) < test_tenths
