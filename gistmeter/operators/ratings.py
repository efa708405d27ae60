"""Model ratings: the requests to send and the replies that came back."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The rating keys and the wording of a request.
RATING_KEYS = ["information_similarity", "grammatical_correctness", "cohesion", "conciseness", "overall_score"]
SYSTEM_MESSAGE = (
    "You are an evaluation assistant. Please rate the following text on five criteria: "
    "information similarity, grammatical correctness, cohesion, conciseness, and provide an overall score.\n"
    "Output your response strictly as a valid JSON object with numeric scores for each of these five attributes "
    "on a scale from 0 to 1.\n"
    "Example format:\n"
    "{\n"
    '  "information_similarity": 0.95,\n'
    '  "grammatical_correctness": 0.90,\n'
    '  "cohesion": 0.85,\n'
    '  "conciseness": 0.80,\n'
    '  "overall_score": 0.88\n'
    "}"
)
USER_MESSAGE = [
    "Input: ",
    "\nSummary: ",
    "\n\nExtract the following subjective measures as a JSON object with keys 'information_similarity', "
    "'grammatical_correctness', 'cohesion', 'conciseness', and 'overall_score' (scale of 0-1).",
]
OBJECT = r"(?s)^\{.*\}$"

RATING_SCHEMA = T.StructType([T.StructField(k, T.DoubleType()) for k in RATING_KEYS])


def rating_requests(pairs: DataFrame) -> DataFrame:
    """(id, system, user): the two messages asking for a rating of each pair."""
    user = F.concat(F.lit(USER_MESSAGE[0]), F.col("text"), F.lit(USER_MESSAGE[1]), F.col("summary"), F.lit(USER_MESSAGE[2]))
    return pairs.select("id", F.lit(SYSTEM_MESSAGE).alias("system"), user.alias("user"))


def rating_messages(requests: DataFrame) -> DataFrame:
    """(id, messages): a request as the JSON list of role and content."""
    both = F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("content")),
                   F.struct(F.lit("user").alias("role"), F.col("user").alias("content")))
    return requests.select("id", F.to_json(both).alias("messages"))


def _reason() -> Column:
    fields = [F.col(f"_r.{k}") for k in RATING_KEYS]
    inside, present = F.lit(True), F.lit(True)
    for f in fields:
        inside, present = inside & f.between(0, 1), present & f.isNotNull()
    return (F.when(F.col("_whole").isNull() | ~F.col("_whole") | F.col("_bad"), "malformed")
            .when(~present, "missing key")
            .when(~inside, "out of range")
            .otherwise("valid"))


def parse_ratings(responses: DataFrame) -> DataFrame:
    """(id, five scores, reason): scores are NULL unless the reply is one JSON object with
    all five keys numeric and inside [0, 1]; it may hold more than these."""
    raw = F.regexp_replace("raw", r"^\s+|\s+$", "")
    alone = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))  # as a list of one, so nothing may follow
    schema = T.StructType(RATING_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
    parsed = responses.select(
        "id", (raw.rlike(OBJECT) & alone.isNotNull() & F.try_variant_get(alone, "$[1]", "string").isNull()).alias("_whole"),
        F.from_json(raw, schema, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("_r"))
    # a wrong type inside a well-formed object counts as a missing number, not as broken text
    broken = F.col("_r").isNull() | F.get_json_object(F.col("_r._corrupt_record"), "$").isNull() & F.col(
        "_r._corrupt_record").isNotNull()
    parsed = parsed.withColumn("_bad", broken).withColumn("reason", _reason())
    valid = F.col("reason") == "valid"
    return parsed.select("id", *[F.when(valid, F.col(f"_r.{k}")).alias(k) for k in RATING_KEYS], "reason")


def attach_ratings(pairs: DataFrame, responses: DataFrame) -> DataFrame:
    """Pairs with their scores; a reply that was refused leaves NULLs and rating_valid = false."""
    parsed = parse_ratings(responses)
    return pairs.join(parsed, "id", "left").select(
        "id", "text", "summary", *RATING_KEYS,
        F.coalesce(F.col("reason") == "valid", F.lit(False)).alias("rating_valid"))


def rating_reject_report(responses: DataFrame) -> DataFrame:
    return parse_ratings(responses).groupBy("reason").agg(F.count("*").alias("n"))
