"""From raw documents to token ids: each stage works on what the one before it kept."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmeter.llm import byte_bpe, decontaminate, line_dedup, minhash, quality
from gistmeter.llm.shared import written

SHINGLE_WORDS = 5


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): the other columns, whatever their names, out of the way of those that operators add."""
    return docs.select("doc_id", "text", F.struct(*[f"`{c}`" for c in docs.columns if c != "text"]).alias("row"))


def _unpacked(packed: DataFrame, columns: list[str]) -> DataFrame:
    return packed.select(*["text" if c == "text" else F.col(f"row.`{c}`") for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality classifier accepts, unchanged, with all their columns.

    It learns from the labelled rows that op3 learns from.  Where there are none, nothing is known and all rows stay.
    Null and empty texts have the score of an empty text; repeated rows stay or go together; a null doc_id is never
    labelled; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    labels = labels.filter(~quality.held_out(F.col("doc_id")))
    if labels.join(docs.select("doc_id"), "doc_id", "left_semi").filter("label is not null").isEmpty():
        return docs
    packed = _packed(docs)
    weights = quality.train(packed.select("doc_id", "text"), labels)
    return _unpacked(quality.scored(packed, weights).filter("predicted = 1"), docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that a document of smaller doc_id holds.  n_chars, where there is one, follows the text;
    other columns stay.  A null text becomes empty.  Rows that repeat a doc_id are one document, and those of a null doc_id
    together the last one, so neither loses lines to itself.  An empty table stays empty.
    """
    kept = _unpacked(line_dedup.dedup_lines(_packed(docs)), docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the smallest doc_id of each group of near duplicates, unchanged.  Null and empty texts and rows of a null
    doc_id are in no group and stay; so do all rows of a doc_id that stays, repeated ones too.  An empty table stays empty.
    """
    dropped = minhash.near_duplicates(docs, SHINGLE_WORDS).filter("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a benchmark passage, unchanged.  Null and empty texts hold none, an empty benchmark has none, and
    repeated rows stay or go together.  An empty table stays empty."""
    return decontaminate.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row, repeated ones too.  Null and empty texts have no ids.  Other
    columns are left behind.  An empty table gives an empty result."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encoded(docs, ranks, public_tokenizers.PATTERN, ("n_tokens", "ids", "decoded_sha256"))


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontamination", benchmark_stage),
          ("byte_bpe", encoding_stage)]
ORACLE_SQL = None  # no SQL for the classifier and the encoder; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
