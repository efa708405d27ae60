"""Reading ease of the summaries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.functions import text
from gistmeter.operators.layout import lookup_join

# Coefficients of the reading ease formula.
EASE_BASE = 206.835
EASE_PER_UNIT = 1.015
EASE_PER_SYLLABLE = 84.6


def syllable_dictionary(pronunciations: DataFrame) -> DataFrame:
    """(word, min_syllables) from (word, phones): fewest stress-marked phones of any reading."""
    stressed = F.size(F.filter("phones", lambda p: p.rlike("[0-9]$")))
    return pronunciations.groupBy(F.lower("word").alias("word")).agg(F.min(stressed).alias("min_syllables"))


def word_rows(pairs: DataFrame) -> DataFrame:
    """(id, word, n): counted ASCII words of each summary, lower case; one NULL row if none."""
    rows = pairs.select("id", F.explode_outer(text.ascii_words(F.lower("summary"))).alias("word"))
    return rows.groupBy("id", "word").agg(F.count("word").alias("n"))


def syllables(words: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Add `syllables`: from the dictionary, where an unknown word has none, or from vowel groups."""
    if dictionary is None:
        return words.withColumn("syllables", text.vowel_groups(F.col("word")))
    found = lookup_join(words, dictionary, "word")
    return found.withColumn("syllables", F.coalesce("min_syllables", F.lit(0))).drop("min_syllables")


def _ease(per_unit, syllable_count, word_count):
    words, sylls = word_count.cast("double"), syllable_count.cast("double")
    score = (F.lit(EASE_BASE) - F.lit(EASE_PER_UNIT) * F.try_divide(words, per_unit.cast("double"))
             - F.lit(EASE_PER_SYLLABLE) * F.try_divide(sylls, words))
    return F.when(word_count == 0, F.lit(0.0)).otherwise(score)


def word_and_syllable_counts(pairs: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(id, n_words, n_syllables, n_sentences) of each summary."""
    n_sentences = F.coalesce(F.size(text.sentences(F.col("summary"))), F.lit(0)).alias("n_sentences")
    if dictionary is None:
        # no dictionary: everything is computed inside the row, nothing is shuffled
        groups = F.transform(text.ascii_words(F.col("summary")), text.vowel_groups)
        counted = pairs.select("id", groups.alias("g"), n_sentences)
        return counted.select(
            "id", F.coalesce(F.size("g"), F.lit(0)).cast("long").alias("n_words"),
            F.coalesce(F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("n_syllables"),
            "n_sentences")
    rows = pairs.select("id", n_sentences, F.explode_outer(text.ascii_words(F.lower("summary"))).alias("word"))
    counts = rows.groupBy("id", "word").agg(F.count("word").alias("n"), F.max("n_sentences").alias("n_sentences"))
    return syllables(counts, dictionary).groupBy("id").agg(
        F.sum("n").alias("n_words"), F.sum(F.col("n") * F.col("syllables")).alias("n_syllables"),
        F.max("n_sentences").alias("n_sentences"))


def flesch_score(pairs: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(id, n_words, n_syllables, flesch_score) with words per syllable in the first term."""
    counts = word_and_syllable_counts(pairs, dictionary)
    score = _ease(F.col("n_syllables"), F.col("n_syllables"), F.col("n_words"))
    return counts.select("id", "n_words", "n_syllables", score.alias("flesch_score"))


def flesch_standard(pairs: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(id, flesch_standard): the textbook form, words per sentence in the first term."""
    counts = word_and_syllable_counts(pairs, dictionary)
    score = _ease(F.col("n_sentences"), F.col("n_syllables"), F.col("n_words"))
    return counts.select("id", "n_words", "n_syllables", "n_sentences", score.alias("flesch_standard"))
