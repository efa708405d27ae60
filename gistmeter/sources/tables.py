"""Reading and writing pair and score tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gistmeter.operators.ratings import RATING_KEYS


def _table(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_TEXT, _NUMBER = T.StringType(), T.DoubleType()

PAIRS = _table(("id", _TEXT), ("text", _TEXT), ("summary", _TEXT))
NEWS = _table(("id", _TEXT), ("article", _TEXT), ("highlights", _TEXT))
MODEL_RATED = T.StructType(PAIRS.fields + [T.StructField(k, _NUMBER) for k in RATING_KEYS])
HUMAN_RATED = T.StructType(NEWS.fields + _table(
    ("note_human", _TEXT), ("overall", _NUMBER), ("accuracy", _NUMBER), ("coverage", _NUMBER), ("coherence", _NUMBER)).fields)
CACHE = _table(("entity", _TEXT), ("qid", _TEXT), ("last_updated", T.LongType()))

# A quoted field may hold line breaks and doubled quotes.  A quoted empty field is an empty
# text, a bare one is missing.
_CSV = {"header": "true", "quote": '"', "escape": '"'}
CSV_READ = {**_CSV, "multiLine": "true", "emptyValue": "", "nullValue": "\u0000"}
CSV_WRITE = {**_CSV, "emptyValue": '""', "nullValue": ""}


def read_pairs_csv(spark: SparkSession, path: str, schema: T.StructType = PAIRS) -> DataFrame:
    """Header CSV with quoted multi-line text.  Such a file is read by one task, so large
    tables should come as many files or as Parquet."""
    return spark.read.schema(schema).options(**CSV_READ).csv(path)


def read_scores(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, the format to keep large tables in."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_scores(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if form == "csv":
        writer.options(**CSV_WRITE).csv(path)
    else:
        writer.parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "id", mode: str = "errorifexists") -> None:
    """A table laid out by pair: jobs that group by the key read it without a shuffle."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
