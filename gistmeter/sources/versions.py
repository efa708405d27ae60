"""A table kept as plain Parquet folders, by bucket of a key, with a list of parts for each version.

    <folder>/data/<part>/bucket=<b>/*.parquet      rows, never changed once written
    <folder>/versions/version=<n>/*.parquet        (bucket, part) of every part that version n consists of

A write makes new parts and then, as its last step, the list of the next version.  What fails before that leaves
parts that no list names; readers never see them.  Two writers of one version clash on the list's folder, and the
later one fails.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

BUCKETS = 64
LISTING = "bucket int, part string"


class VersionedTable:
    """`schema` is of the rows; `key` names the column whose hash picks the bucket.

    Lists have a row for each part of each bucket, so the driver reads as many rows as there are parts, not data.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: T.StructType, buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.schema, self.buckets = spark, folder.rstrip("/"), key, schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _lists(self) -> DataFrame:
        return self.spark.read.schema(f"{LISTING}, version int").parquet(f"{self.folder}/versions")

    def latest(self) -> int:
        """The newest version, 0 where nothing was written yet."""
        try:
            return self._lists().agg(F.max("version")).first()[0] or 0
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0

    def parts(self, version: int | None = None) -> list[tuple[int, str]]:
        version = self.latest() if version is None else version
        if not version:
            return []
        found = [(r["bucket"], r["part"]) for r in self._lists().filter(F.col("version") == version).select("bucket", "part").collect()]
        if not found:
            raise ValueError(f"{self.folder} has no version {version}")
        return sorted((b, p) for b, p in found if p is not None)

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, the newest unless one is named; with `buckets` only of those."""
        paths = [f"{self.folder}/data/{p}/bucket={b}" for b, p in self.parts(version) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read_for(self, asked: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of the buckets that the keys of `asked` fall into."""
        return self.read(version, self.buckets_of(asked))

    def buckets_of(self, rows: DataFrame) -> set[int]:
        return {r["bucket"] for r in rows.select(self.bucket()).distinct().collect()}  # at most `buckets` rows

    def write(self, rows: DataFrame, replaced: set[int] | None = None) -> int:
        """Add rows as new parts and return the new version.  Parts of the `replaced` buckets are left out of it."""
        part, base = uuid.uuid4().hex, self.latest()
        kept = [(b, p) for b, p in self.parts(base) if not replaced or b not in replaced]
        names = [f.name for f in self.schema.fields]
        path = f"{self.folder}/data/{part}"
        rows.select(*[F.col(f"`{n}`") for n in names], self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(path)
        made = self.spark.read.schema("bucket int").option("basePath", path).parquet(path).select("bucket").distinct()
        listing = kept + [(r["bucket"], part) for r in made.collect()] or [(-1, None)]  # an empty version is listed too
        self.spark.createDataFrame(listing, LISTING).coalesce(1).write.parquet(f"{self.folder}/versions/version={base + 1}")
        return base + 1

    def compact(self, parts: int = 8) -> int:
        """Rewrite the buckets that consist of more than so many parts, each as one."""
        listed = [b for b, _ in self.parts()]
        many = {b for b in listed if listed.count(b) > parts}
        return self.write(self.read(buckets=many), many) if many else self.latest()
