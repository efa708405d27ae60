"""Shards by fixed virtual slots and a versioned map from slots to shards."""

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gistmeter.llm.shared import fresh_folder, text_documents, written

SLOTS = 8192
TOLERANCE = 1.01  # of the mean: a stored map whose heaviest shard is above this is edited


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot).  size: UTF-8 bytes and one more.  The slot depends on the row alone."""
    crc = F.crc32(F.encode("text", "UTF-8"))
    return text_documents(docs).select(
        "doc_id", (F.octet_length("text").cast("long") + 1).alias("size"), crc.alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", crc), F.lit(slots)).cast("int").alias("vslot"))


def slot_loads(rows: DataFrame) -> DataFrame:
    """(vslot, bytes, rows): at most as many rows as there are slots."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(loads: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """Slot -> shard: heaviest slot first, each to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    of = [0] * slots
    for slot in sorted(range(slots), key=lambda v: (-loads.get(v, 0), v)):
        load, shard = heapq.heappop(heap)
        of[slot] = shard
        heapq.heappush(heap, (load + loads.get(slot, 0), shard))
    return of


def edited_map(old: list[int], loads: dict[int, int], shards: int) -> list[int]:
    """The next version for `shards` shards, moving slots only from shards above the mean to those below.

    Shards that are no more give all slots away.  Largest fitting slots move first.
    """
    new, total = list(old), sum(loads.values())
    weight = [0] * max(shards, max(old, default=0) + 1)
    for slot, shard in enumerate(old):
        weight[shard] += loads.get(slot, 0)
    mean = total / shards
    loose = []
    for slot in sorted(range(len(old)), key=lambda v: (-loads.get(v, 0), v)):
        shard, load = old[slot], loads.get(slot, 0)
        if shard >= shards or weight[shard] - load >= mean and load:
            weight[shard] -= load
            loose.append(slot)
    heap = [(weight[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in loose:
        load, shard = heapq.heappop(heap)
        new[slot] = shard
        heapq.heappush(heap, (load + loads.get(slot, 0), shard))
    return new


def map_table(spark: SparkSession, of: list[int], version: int) -> DataFrame:
    """(version, vslot, shard): one version of the map, as many rows as there are slots."""
    return spark.createDataFrame([(version, v, s) for v, s in enumerate(of)], "version int, vslot int, shard int")


def stored_map(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, list[int]]:
    """A version of the map in a folder, the newest unless one is named; (0, []) where there is none yet."""
    try:
        kept = spark.read.schema("version int, vslot int, shard int").parquet(f"{folder}/*")
        version = version or kept.agg(F.max("version")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, []
    return version, [r["shard"] for r in kept.filter(F.col("version") == version).orderBy("vslot").collect()]  # a row for each slot


def next_map(spark: SparkSession, folder: str, loads: dict[int, int], shards: int, slots: int = SLOTS) -> tuple[int, list[int]]:
    """The newest map if it still fits: it is for as many shards and none is heavier than TOLERANCE above the mean.
    Otherwise it is edited, or a first one made, and stored as the next version.  Old versions stay."""
    version, old = stored_map(spark, folder)
    weight = [0] * shards
    for slot, shard in enumerate(old):
        if shard < shards:
            weight[shard] += loads.get(slot, 0)
    if old and len(set(old) | set(range(shards))) == shards == max(old) + 1 and max(weight) <= TOLERANCE * sum(weight) / shards:
        return version, old
    of = edited_map(old, loads, shards) if old else first_map(loads, shards, slots)
    if of != old:
        version += 1
        map_table(spark, of, version).coalesce(1).write.parquet(f"{folder}/version-{version}")
    return stored_map(spark, folder, version)


def sharded(docs: DataFrame, shards: int = 16, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, vslot, shard, slot): every row with its shard and its place there.

    Shards have near equal bytes.  slot counts from 0 without a gap in each shard, by virtual slot, then
    doc_id (null first), then crc and size.  A null text has size 1 and crc 0, repeated rows are rows of
    their own, other columns are ignored, and an empty table gives an empty result.

    The map from slots to shards is kept in versions in the folder `maps`: a later run, with more rows or another
    number of shards, edits the newest one, so few slots move.  Without a folder the map has one of its own.

    A scan makes the narrow rows, which are written once.  Slot loads and the map are of fixed size.  Rows
    are numbered within a virtual slot, a fixed small share of all rows even where a source or a text is
    hot, and the slots' starts come from a window over the loads.
    """
    spark = docs.sparkSession
    rows = written(slotted(docs, slots), "slotted")
    loads = slot_loads(rows).collect()
    _, of = next_map(spark, maps or fresh_folder(spark, "slot-maps"), {r["vslot"]: r["bytes"] for r in loads}, shards, slots)
    start, at = [], [0] * shards
    counts = {r["vslot"]: r["rows"] for r in loads}
    for v, s in enumerate(of):
        start.append((v, s, at[s]))
        at[s] += counts.get(v, 0)
    table = written(spark.createDataFrame(start, "vslot int, shard int, start long"), "slot-map")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return (rows.withColumn("place", place).join(F.broadcast(table), "vslot")
            .select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("start") + F.col("place")).alias("slot")))
