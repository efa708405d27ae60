"""Entity overlap: mentions, links through an alias table, and a table of earlier lookups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.functions import text
from gistmeter.operators.gazetteer import name_mentions
from gistmeter.operators.layout import lookup_join
from gistmeter.operators.similarity import bert_score, own_key
from gistmeter.operators.tokens import SUMMARY, TEXT, side_rows
from gistmeter.sources.tables import CACHE
from gistmeter.sources.versions import BUCKETS, VersionedTable

LAMBDA = 0.7
DAY = 86400
KEEP_DAYS = 30


def entity_mentions(pairs: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """(id, side, entity): distinct capitalised runs of each text or, with a gazetteer (entity), the listed names in it."""
    if gazetteer is not None:
        return name_mentions(pairs, gazetteer)
    rows = side_rows(pairs, text.capital_runs).select(
        "id", "side", F.explode("toks").alias("mention"))
    found = rows.select("id", "side", text.clean_mention(F.col("mention")).alias("entity"))
    return found.filter("entity is not null").distinct()


def mentions_with(pairs: DataFrame, tagger) -> DataFrame:
    """(id, side, entity) from a tagger: a function over batches of (id, side, text) frames."""
    key = pairs.schema["id"].dataType.simpleString()
    texts = pairs.select("id", F.inline(F.array(
        F.struct(F.lit(TEXT).alias("side"), F.col("text").alias("text")),
        F.struct(F.lit(SUMMARY).alias("side"), F.col("summary").alias("text")))))
    return texts.mapInPandas(tagger, f"id {key}, side int, entity string")


def first_hits(alias: DataFrame) -> DataFrame:
    """(entity, qid): the best-ranked id of each name in (entity, qid, rank)."""
    return alias.groupBy("entity").agg(F.min_by("qid", F.struct("rank", "qid")).alias("qid"))


def link_entities(mentions: DataFrame, alias: DataFrame) -> DataFrame:
    """(id, side, qid) distinct; names without an id drop out."""
    linked = lookup_join(mentions, first_hits(alias), "entity", how="inner")
    return linked.filter("qid is not null").select("id", "side", "qid").distinct()


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(entity, qid, hit).  A name stored without an id is a hit too."""
    known = cache.select("entity", "qid", F.lit(True).alias("hit"))
    return requests.select("entity").join(known, "entity", "left").select(
        "entity", "qid", F.coalesce("hit", F.lit(False)).alias("hit"))


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.select("entity").distinct().join(cache, "entity", "left_anti")


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row per entity; the latest wins, and of equally late ones the fresh one."""
    both = cache.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    latest = F.max_by(F.struct("qid", "last_updated"), F.struct("last_updated", "_fresh", "qid")).alias("row")
    return both.groupBy("entity").agg(latest).select("entity", "row.qid", "row.last_updated")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("total"), F.count("qid").alias("matches"))


def cache_expire(cache: DataFrame, now: int, days: int = KEEP_DAYS) -> DataFrame:
    return cache.filter(F.col("last_updated") >= F.lit(now - days * DAY))


class EntityCache:
    """The lookups (entity, qid, last_updated) of all runs, kept in versions: a run rewrites the buckets it changes."""

    def __init__(self, spark, folder: str, buckets: int = BUCKETS):
        self.table = VersionedTable(spark, folder, "entity", CACHE, buckets)

    def lookup(self, requests: DataFrame, version: int | None = None) -> DataFrame:
        """`cache_lookup` in the buckets that the requests fall into."""
        return cache_lookup(requests, self.table.read_for(requests, version))

    def upsert(self, fresh: DataFrame) -> int:
        """Merge lookups into the newest version, by the rule of `cache_upsert`; returns the new version."""
        touched = self.table.buckets_of(fresh)
        return self.table.write(cache_upsert(self.table.read(buckets=touched), fresh), touched)

    def expire(self, now: int, days: int = KEEP_DAYS) -> int:
        """Leave out lookups older than `days`; only buckets that hold such are rewritten."""
        rows = self.table.read()
        old = self.table.buckets_of(rows.filter(F.col("last_updated") < F.lit(now - days * DAY)))
        return self.table.write(cache_expire(self.table.read(buckets=old), now, days), old) if old else self.table.latest()


def kg_score(pairs: DataFrame, alias: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """(id, n_text, n_shared, kg_score): share of the text's entities found in the summary."""
    links = link_entities(entity_mentions(pairs) if mentions is None else mentions, alias)
    sides = links.groupBy("id", "qid").agg(
        F.max((F.col("side") == TEXT).cast("long")).alias("t"), F.max((F.col("side") == SUMMARY).cast("long")).alias("s"))
    sums = sides.groupBy("id").agg(F.sum("t").alias("n_text"), F.sum(F.col("t") * F.col("s")).alias("n_shared"))
    every = pairs.select("id").join(sums, "id", "left").select(
        "id", F.coalesce("n_text", F.lit(0)).alias("n_text"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
    share = F.col("n_shared").cast("double") / F.greatest("n_text", F.lit(1))
    return every.withColumn("kg_score", share)


def kg_bertscore(pairs: DataFrame, alias: DataFrame, vectors: DataFrame, token_key=own_key,
                 lam: float = LAMBDA) -> DataFrame:
    """(id, kg_bertscore): weighted mean of token matching and entity overlap."""
    bert = bert_score(pairs, vectors, token_key).select("id", F.col("BERT F1").alias("_bert"))
    both = kg_score(pairs, alias).join(bert, "id", "left")
    score = F.lit(lam) * F.coalesce("_bert", F.lit(0.0)) + F.lit(1 - lam) * F.col("kg_score")
    return both.select("id", score.alias("kg_bertscore"))
