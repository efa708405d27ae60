"""Writing findings of the summaries, as rules over text and tokens."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.functions import text
from gistmeter.operators import counting
from gistmeter.operators.layout import lookup_join, materialise
from gistmeter.operators.tokens import is_coded, listed_words, of_words

# Patterns of the text rules.
TEXT_RULES = {
    "blank_before_punctuation": r" [,.;:!?]",
    "double_blank": r" {2,}",
    "double_punctuation": r",{2,}|;{2,}|:{2,}|!{2,}|\?{2,}|\.{2,}",
}
LOWER_START = r"^\s*\p{Ll}"
WORD_START = r"^[\p{L}\p{N}]"
A_BEFORE_VOWEL = "^[aeiou]"
AN_BEFORE_OTHER = "^[b-df-hj-np-tv-z]"
MIN_TEXTS = 2


def lexicon(pairs: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(tok): words found in at least `min_texts` source texts."""
    toks = pairs.select(F.explode(F.array_distinct(text.words(F.col("text")))).alias("tok"))
    return (toks.filter(F.col("tok").rlike(WORD_START)).groupBy("tok").count()
            .filter(F.col("count") >= min_texts).select("tok"))


def _lexicon_of_words(worded: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """The same from words laid out by `sentence_words` or `word_codes`: tasks pass on a row for each distinct token of a batch."""
    def count(batches):
        for batch in batches:
            lists = counting.unpacked(batch).column("toks")
            row, _ = counting.within(counting.lengths(lists))
            if "words" in batch.schema.names:
                names = listed_words(batch.column("words"))
                size, names = counting.lengths(names), names.flatten()
                has = np.zeros(len(names), bool)
                has[(np.cumsum(size) - size)[row] + lists.flatten().to_numpy(zero_copy_only=False)] = True
                (each,), words = counting.coded(names.filter(pa.array(has)))
            else:
                (code,), words = counting.coded(lists.flatten())
                each = np.unique(row * max(len(words), 1) + code) % max(len(words), 1)
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(each, minlength=len(words)), pa.int64())], names=["tok", "n"])

    rows = worded.select(F.col("t").alias("toks"), "words") if is_coded(worded) else worded.select(F.flatten("t").alias("toks"))
    found = rows.mapInArrow(count, "tok string, n long").groupBy("tok").agg(F.sum("n").alias("n"))
    return found.filter((F.col("n") >= min_texts) & F.col("tok").rlike(WORD_START)).select("tok")


def _neighbours(toks):
    return text.gram_structs(toks, 2, ["a", "b"])


def _row_rules():
    """(rule, count) for everything that can be told from one row alone."""
    s = F.col("summary")
    two = _neighbours(F.col("toks"))
    doubled = F.filter(two, lambda g: (g["a"] == g["b"]) & g["a"].rlike(WORD_START))
    article = F.filter(two, lambda g: ((g["a"] == "a") & g["b"].rlike(A_BEFORE_VOWEL))
                       | ((g["a"] == "an") & g["b"].rlike(AN_BEFORE_OTHER)))
    lower = F.filter(text.sentences(s), lambda x: x.rlike(LOWER_START))
    counts = {
        "article_mismatch": F.size(article),
        "doubled_word": F.size(doubled),
        "lower_case_start": F.size(lower),
    }
    counts.update({rule: F.regexp_count(s, F.lit(p)) for rule, p in TEXT_RULES.items()})
    return counts


def _summary_words(coded: DataFrame) -> DataFrame:
    """(id, tok, n): how often each word is in the summaries of an id, from words laid out by `word_codes`."""
    def count(rows, owner, ids):
        own = owner[counting.within(counting.lengths(rows.column("s")))[0]]
        codes = rows.column("s").flatten().to_numpy(zero_copy_only=False).astype("int64")
        word = counting.ranked(own, codes)
        times = np.bincount(word)
        at = counting.first_of(word, len(times))
        return {"id": ids.take(pa.array(own[at])), "tok": of_words(rows, "words", "s").take(pa.array(at)), "n": pa.array(times, pa.int64())}

    rows = counting.by_id(coded, F.col("s"), F.col("words"))
    return counting.mapped(rows, count, f"id {counting.key_type(coded)}, tok string, n long")


def _unknown_words(pairs: DataFrame, known: DataFrame, worded: DataFrame | None = None) -> DataFrame:
    """(id, n): summary words outside the lexicon."""
    if is_coded(worded):
        counts = _summary_words(worded).filter(F.col("tok").rlike(WORD_START))
    else:
        rows = pairs.select("id", F.explode(text.words(F.col("summary"))).alias("tok"))
        counts = rows.filter(F.col("tok").rlike(WORD_START)).groupBy("id", "tok").agg(F.count("*").alias("n"))
    return lookup_join(counts, known, "tok", how="left_anti").groupBy("id").agg(F.sum("n").alias("n"))


def lint_findings(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, rule, n) for every rule that found something."""
    known = materialise(lexicon(pairs)) if known is None else known
    base = pairs.select("id", "summary", text.words(F.col("summary")).alias("toks"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), c.cast("long").alias("n")) for r, c in _row_rules().items()])
    in_row = base.select("id", F.inline(rules)).filter("n > 0")
    unknown = _unknown_words(pairs, known).select("id", F.lit("unknown_word").alias("rule"), "n")
    return in_row.unionByName(unknown)


def grammar_score(pairs: DataFrame, known: DataFrame | None = None, worded: DataFrame | None = None) -> DataFrame:
    """(id, n_findings, grammar_score): findings per word, higher is worse."""
    if known is None:
        known = materialise(lexicon(pairs) if worded is None else _lexicon_of_words(worded))
    base = pairs.select("id", "summary", text.words(F.col("summary")).alias("toks"))
    in_row = sum((F.coalesce(c, F.lit(0)) for c in _row_rules().values()), F.lit(0).cast("long"))
    n_words = F.greatest(F.size(text.ascii_words(F.col("summary"))), F.lit(1))
    scored = base.select("id", in_row.alias("_row"), n_words.alias("_words"))
    joined = scored.join(_unknown_words(pairs, known, worded), "id", "left")
    found = F.col("_row") + F.coalesce("n", F.lit(0))
    return joined.select("id", found.alias("n_findings"), (found.cast("double") / F.col("_words")).alias("grammar_score"))
