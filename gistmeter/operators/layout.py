"""Physical helpers: checkpoints and dictionary joins that survive hot keys."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
UNPACKED = 4  # times that rows may be larger than their files
SALT_ROWS = 100_000
PART = 8 << 20  # bytes of files that make a task's share of texts
MOST_PARTS = 10_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  A cluster must name it; only a local session gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="gistmeter-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str = "table") -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: a lost executor costs no recomputation,
    and later reads take only the columns they need."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more, wherever they are kept."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Bucketed:
    """A table written once, laid out by a key: group-bys on it need no shuffle, however often it is read.

    A bucket is one task's share, so a large table asks for as many as it has times some 128 MB.  Rows that are made from a
    table with the same buckets are `placed`: they are written where they are read.
    """

    def __init__(self, df: DataFrame, key: str = "id", buckets: int | None = None, placed: bool = False):
        self.spark = df.sparkSession
        self.name, self.path = f"gistmeter_{uuid.uuid4().hex}", fresh_path(df.sparkSession, "bucketed")
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ((df if placed else df.repartition(buckets, key)).write.bucketBy(buckets, key).sortBy(key).option("path", self.path).saveAsTable(self.name))
        self.rows = self.spark.table(self.name)

    def __enter__(self) -> DataFrame:
        return self.rows

    def __exit__(self, *failure) -> None:
        self.close()

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        removed(self.spark, self.path)


def by_pair(pairs: DataFrame, key: str = "id", parts: int | None = None) -> DataFrame:
    """Move each pair's text once.  Group-bys and windows led by the key then need no shuffle.  Of a table larger than the
    usual number of tasks can sort in memory, `parts` says how many it is dealt to."""
    return pairs.repartition(parts, key) if parts else pairs.repartition(key)


def parts_of(files: DataFrame) -> int | None:
    """How many tasks share the texts of a table of files, so that a task's share does not grow with the table; None if the
    usual number does or the table's size is not known."""
    usual, size = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(files)
    parts = -(-size // PART)
    return parts if usual < parts <= MOST_PARTS else None


def plan_bytes(df: DataFrame) -> int:
    """What the optimizer takes a table's size for; of files it is theirs, of local rows it is unknown and huge."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def lookup_join(facts: DataFrame, table: DataFrame, key: str, how: str = "left", spread: str = "id",
                broadcast_bytes: int = BROADCAST_BYTES, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Join facts to a dictionary with one row per key.

    A dictionary of at most `broadcast_bytes` goes to every task.  Where its plan cannot promise that, it is written
    once and its files are measured.  Beyond that, a key takes one salt for each `salt_rows` fact rows it has, so a
    frequent key is met by many tasks and a rare one is copied nowhere.  The result is the same.
    """
    if broadcast_bytes and plan_bytes(table) > broadcast_bytes:
        table = materialise(table, "dictionary")
        fits = plan_bytes(table) * UNPACKED <= broadcast_bytes
    else:
        fits = plan_bytes(table) <= broadcast_bytes
    if fits:
        return facts.join(F.broadcast(table), key, how)
    heavy = facts.groupBy(key).count().filter(F.col("count") > salt_rows)
    salts = heavy.select(key, F.ceil(F.col("count") / salt_rows).cast("int").alias("_salts"))
    copies = table.join(salts, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    marked = facts.join(salts, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    return marked.join(copies, [key, "_salt"], how).drop("_salt")
