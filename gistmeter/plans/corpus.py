"""Pair, rating and dictionary tables derived from the given corpus tables."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gistmeter.functions import text
from gistmeter.functions.digests import md5_heads
from gistmeter.operators import counting, entities
from gistmeter.operators.layout import by_pair, parts_of

RANGE = 4096
NOW = 1_700_000_000
PHRASE_SHARE = 100  # one text in so many

# Small inline dictionaries.
LEXICON = [
    ("a", 1), ("about", 2), ("after", 2), ("all", 1), ("an", 1), ("and", 1), ("are", 1), ("as", 1), ("at", 1), ("be", 1),
    ("been", 1), ("but", 1), ("by", 1), ("for", 1), ("from", 1), ("had", 1), ("has", 1), ("have", 1), ("he", 1),
    ("her", 1), ("his", 1), ("in", 1), ("is", 1), ("it", 1), ("not", 1), ("of", 1), ("on", 1), ("one", 1), ("or", 1),
    ("over", 2), ("that", 1), ("the", 1), ("their", 1), ("they", 1), ("this", 1), ("to", 1), ("was", 1), ("were", 1),
    ("which", 1), ("will", 1), ("with", 1), ("der", 1), ("die", 1), ("und", 1), ("la", 1), ("le", 1), ("les", 1),
    ("que", 1), ("qui", 1), ("el", 1), ("los", 1), ("para", 2),
]
SYNONYMS = [
    ("the", "this"), ("the", "that"), ("and", "plus"), ("and", "as_well_as"), ("is", "be"), ("is", "exists"),
    ("with", "by"), ("by", "with"), ("of", "from"), ("in", "inside"), ("la", "el"), ("le", "la"), ("und", "sowie"),
    ("die", "der"), ("que", "which"), ("this", "the"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def next_first_sentence(documents: DataFrame, width: int = RANGE) -> DataFrame:
    """(doc_id, next_sent): first sentence of the next document of the same language; NULL behind the last one.

    A window over a whole language would be one task.  Windows run over short ranges of
    ids instead; the last document of a range looks at the head of the next range.
    """
    heads = documents.select("doc_id", "lang", F.floor(F.col("doc_id") / width).alias("range"),
                             F.get(text.sentences(F.col("text"), 2), F.lit(0)).alias("sent"))
    own = heads.withColumn("within", F.lead(F.struct("sent")).over(
        Window.partitionBy("lang", "range").orderBy("doc_id")))
    first = heads.groupBy("lang", "range").agg(F.min_by("sent", "doc_id").alias("sent"))
    across = first.select("lang", "range", F.lead(F.struct("sent")).over(
        Window.partitionBy("lang").orderBy("range")).alias("beyond"))
    return (own.join(across, ["lang", "range"], "left")
            .withColumn("next", F.coalesce("within", "beyond"))
            .select("doc_id", F.col("next.sent").alias("next_sent")))


def pairs_from_documents(documents: DataFrame, width: int = RANGE) -> DataFrame:
    """Each document with its own first two sentences and the first of the next document, if there is one.
    The texts are moved once, by document, and stay where they are."""
    placed = by_pair(documents.select("doc_id", "text"), "doc_id", parts_of(documents))
    # a merge join keeps that layout at every size
    joined = placed.join(next_first_sentence(documents, width).hint("merge"), "doc_id")
    lead_in = F.slice(text.sentences(F.col("text"), 3), 1, 2)
    return joined.select(F.col("doc_id").alias("id"), "text",
                         F.concat_ws(" ", lead_in, F.col("next_sent")).alias("summary"))


def pairs_from_conversations(conversations: DataFrame) -> DataFrame:
    """Each assistant turn with the user turn right before it."""
    a = conversations.filter("role = 'assistant'").select("conv_id", "turn", "text")
    b = conversations.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                                     F.col("text").alias("summary"))
    joined = a.join(b, ["conv_id", "turn"])
    return by_pair(joined.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "summary"))


def pairs_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_from_documents(table(spark, sf_dir, "documents"))


def pairs_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_from_conversations(table(spark, sf_dir, "conversations"))


def human_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("overall_score_human"))


def hash_key(n: int):
    """Token -> one of n vectors, by hash."""
    def key(token: Column) -> Column:
        return F.pmod(F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(n))

    # the same of many tokens at a time, inside a task
    def of_strings(toks):
        return pa.array(md5_heads(toks) % n, mask=toks.is_null().to_numpy(zero_copy_only=False))

    key.of_strings = of_strings
    return key


def token_vectors(spark: SparkSession, sf_dir: str):
    """The vector table (key, vec) and the key of a token."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))
    return vectors, hash_key(vectors.count())


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "word string, min_syllables int")


def synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYNONYMS, "word string, synonym string")


def alias_table(pairs: DataFrame, min_texts: int = 2) -> DataFrame:
    """(entity, qid, rank) for capitalised runs of at least two texts; the second reading of
    a name is there to be passed over."""
    runs = entities.entity_mentions(pairs).filter("side = 0").groupBy("entity").count()
    known = runs.filter(F.col("count") >= min_texts).select("entity")
    head = F.substring(F.md5(F.col("entity").cast("binary")), 1, 6)
    readings = F.array(F.struct(F.lit(1).alias("rank"), F.concat(F.lit("Q"), head).alias("qid")),
                       F.struct(F.lit(2).alias("rank"), F.concat(F.lit("R"), head).alias("qid")))
    return known.select("entity", F.inline(readings))


def name_list(pairs: DataFrame) -> DataFrame:
    """(entity): the names of the alias table, and lower-case runs of two and three tokens that a share of all
    texts hold.  Many of them overlap."""
    toks = pairs.select(text.words(F.col("text")).alias("toks"))
    least = pairs.count() / PHRASE_SHARE
    # a run is no more frequent than its tokens, and few tokens are in such a share of the texts
    held = toks.select(F.explode(F.array_distinct("toks")).alias("tok")).groupBy("tok").count().filter(F.col("count") >= least)
    shared = pairs.sparkSession.sparkContext.broadcast(held.select("tok").toArrow().column("tok").combine_chunks())

    def runs(batches):
        frequent, n = shared.value, len(shared.value) + 1
        for batch in batches:
            lists = batch.column("toks")
            row, _ = counting.within(counting.lengths(lists))
            code = pc.fill_null(pc.index_in(lists.flatten(), value_set=frequent), -1).to_numpy(zero_copy_only=False).astype("int64")
            for size in (2, 3):
                at = np.arange(max(len(code) - size + 1, 0))
                at = at[row[at] == row[at + size - 1]]
                for i in range(size):
                    at = at[code[at + i] >= 0]
                run = counting.ranked(*[code[at + i] for i in range(size)])
                each = run[np.unique(row[at] * (run.max(initial=0) + 1) + run, return_index=True)[1]]
                found, times = np.unique(each, return_counts=True)
                first = at[counting.first_of(run, int(run.max(initial=-1)) + 1)][found]
                words = [frequent.take(pa.array(code[first + i])) for i in range(size)]
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*words, " "), pa.array(times, pa.int64())], names=["entity", "n"])

    common = toks.mapInArrow(runs, "entity string, n long").groupBy("entity").agg(F.sum("n").alias("count"))
    return alias_table(pairs).select("entity").union(common.filter(F.col("count") >= least).select("entity")).distinct()


def cache_table(alias: DataFrame) -> DataFrame:
    """(entity, qid, last_updated): names looked up within the last 64 days, some without a hit."""
    h = F.conv(F.substring(F.md5(F.col("entity").cast("binary")), 1, 4), 16, 10).cast("long")
    known = entities.first_hits(alias).filter(h % 3 != 0)
    return known.select("entity", F.when(h % 5 != 0, F.col("qid")).alias("qid"),
                        (F.lit(NOW) - (h % 64) * entities.DAY).alias("last_updated"))


def fresh_lookups(alias: DataFrame) -> DataFrame:
    """(entity, qid, last_updated) of a later run over part of the names."""
    h = F.conv(F.substring(F.md5(F.col("entity").cast("binary")), 5, 4), 16, 10).cast("long")
    return entities.first_hits(alias).filter(h % 2 == 0).select(
        "entity", "qid", (F.lit(NOW) - (h % 32) * entities.DAY).alias("last_updated"))


def responses(pairs: DataFrame) -> DataFrame:
    """(id, raw): a rating reply per pair; every few replies are faulty in some way."""
    i = F.col("id")

    def mark(k):
        return F.format_string("%.2f", ((i * k) % 101) / F.lit(100.0))

    head = F.concat(F.lit('{"information_similarity": '), mark(3), F.lit(', "grammatical_correctness": '), mark(5),
                    F.lit(', "cohesion": '), mark(7))
    rest = F.concat(F.lit(', "conciseness": '), mark(11))
    last = F.concat(F.lit(', "overall_score": '), mark(13), F.lit("}"))
    raw = (F.when(i % 7 == 0, head)
           .when(i % 11 == 0, F.concat(head, rest, F.lit(', "overall_score": 1.5}')))
           .when(i % 13 == 0, F.concat(head, rest, F.lit("}")))
           .when(i % 17 == 0, F.concat(head, rest, F.lit(', "overall_score": "0.5"}')))
           .when(i % 19 == 0, F.concat(head, rest, F.lit(', "overall_score": true}')))
           .when(i % 23 == 0, F.concat(head, rest, last, F.lit(" Thank you.")))
           .otherwise(F.concat(F.lit(" "), head, rest, last, F.lit("\n"))))
    return pairs.select("id", raw.alias("raw"))


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric columns of different shape, one row per order line."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("rebate"),
        (F.lit(20.0) - F.col("l_extendedprice") * F.col("l_discount") / 100).alias("remainder"),
        F.when(F.col("l_returnflag") != "N", F.col("l_tax")).alias("tax_if_closed"))


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value")
