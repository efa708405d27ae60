"""Token tables: one row per token, n-gram or stem of a pair."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.functions import porter, text
from gistmeter.operators import counting
from gistmeter.operators.cutting import Cutter

START = "<s>"
TEXT, SUMMARY = 0, 1


def side_rows(pairs: DataFrame, split) -> DataFrame:
    """(id, side, toks): one row per text, so both sides share the steps that follow."""
    both = F.array(
        F.struct(F.lit(TEXT).alias("side"), split(F.col("text")).alias("toks")),
        F.struct(F.lit(SUMMARY).alias("side"), split(F.col("summary")).alias("toks")),
    )
    return pairs.select("id", F.inline(both))


def sentence_rows(pairs: DataFrame) -> DataFrame:
    return side_rows(pairs, text.sentences).select("id", "side", F.posexplode("toks").alias("sent_pos", "sent"))


def token_rows(pairs: DataFrame, split=text.words) -> DataFrame:
    return side_rows(pairs, split).select("id", "side", F.posexplode("toks").alias("pos", "tok"))


def sentence_words(pairs: DataFrame) -> DataFrame:
    """(id, t, s): the words of both sides, by sentence.  No word goes over a gap of sentences, so joined lists are the words of a side."""
    def lists(side: str, name: str):
        return F.transform(text.sentences(F.col(side)), lambda sent: text.words(sent)).alias(name)
    return pairs.select("id", lists("text", "t"), lists("summary", "s"))


def word_codes(pairs: DataFrame, rows_of=None) -> DataFrame:
    """(id, t, t_sents, s, s_sents, words): a number for each word of both sides, the same in all texts of an id, how many words each
    sentence has, and the words of the id by their numbers, between blanks.  With `rows_of`, asked for many words at a time, also
    `at`: a number of its own for each of the words.  Lists of numbers are `packed`."""
    cutter = Cutter(pairs.sparkSession)

    def count(rows, owner, ids):
        cut = [cutter(rows.column(c)) for c in ("t", "s")]
        whole = pa.chunked_array([words for words, *_ in cut], pa.string()).combine_chunks().dictionary_encode()
        codes = whole.indices.to_numpy(zero_copy_only=False).astype("int64")
        own = np.concatenate([np.repeat(owner, n_words) for _, n_words, _, _ in cut])
        rank = counting.ranked(own, codes)
        first = counting.first_of(rank, int(rank.max(initial=-1)) + 1)
        known = np.bincount(own[first], minlength=len(ids))
        base = np.cumsum(known) - known
        number, at, made = (rank - base[own]).astype("int32"), 0, {"id": rows.column("id")}
        for c, (words, n_words, n_sentence, n_sentences) in zip(("t", "s"), cut):
            nulls = rows.column(c).is_null()
            made[c] = counting.packed(number[at:at + len(words)], n_words, nulls)
            made[f"{c}_sents"] = counting.packed(n_sentence, n_sentences, nulls)
            at += len(words)
        ends = pa.array(np.concatenate([[0], np.cumsum(known)]), pa.int32())
        named = {"words": pc.binary_join(pa.ListArray.from_arrays(ends, whole.dictionary.take(pa.array(codes[first]))), " ")}
        if rows_of is not None:
            named["at"] = counting.packed(rows_of(whole.dictionary)[codes[first]], known)
        return made | {c: x if rows.num_rows == len(ids) else x.take(pa.array(owner)) for c, x in named.items()}

    rows = counting.by_id(pairs, F.lower("text").alias("t"), F.lower("summary").alias("s"))
    more = "" if rows_of is None else ", at binary"
    return counting.mapped(rows, count, f"id {counting.key_type(pairs)}, t binary, t_sents binary, s binary, s_sents binary, words string{more}",
                           counting.CUT)


def is_coded(worded: DataFrame | None) -> bool:
    """Whether words are laid out by `word_codes`, not by `sentence_words`."""
    return worded is not None and "words" in worded.columns


def listed_words(column: pa.Array) -> pa.Array:
    """The words of each id by their numbers.  An id without words has one that no number stands for."""
    return pc.split_pattern(column, " ")


def of_words(rows: pa.RecordBatch, name: str, side: str) -> pa.Array:
    """What the words of an id have by their numbers, for every word of a side laid out by `word_codes`, end to end."""
    values, codes = rows.column(name), rows.column(side)
    if pa.types.is_string(values.type):
        values = listed_words(values)
    size = counting.lengths(values)
    base = np.cumsum(size) - size
    while pa.types.is_list(codes.type):
        base, codes = np.repeat(base, counting.lengths(codes)), codes.flatten()
    return values.flatten().take(pa.array(base + codes.to_numpy(zero_copy_only=False)))


def both_sides(pairs: DataFrame, split=text.words, worded: DataFrame | None = None) -> DataFrame:
    """(first, id, t, s): the tokens of both sides, of words those laid out by `sentence_words`, or their numbers by `word_codes`, if they are."""
    if is_coded(worded):
        return counting.by_id(worded, F.col("t"), F.col("s"))
    if worded is not None:
        return counting.by_id(worded, F.flatten("t").alias("t"), F.flatten("s").alias("s"))
    return counting.by_id(pairs, split(F.col("text")).alias("t"), split(F.col("summary")).alias("s"))


def token_counts(pairs: DataFrame, split=text.words, words: bool = True, worded: DataFrame | None = None) -> DataFrame:
    """(id, tok, c_text, c_summary, n_text, n_summary): counts of each token of a pair and of all its tokens.  A pair with a
    side without tokens has one row with a NULL token.  Without `words`, tokens with the same counts are one row, and
    `tokens` says how many they are."""
    def count(rows, owner, ids):
        g = counting.Grams(rows, owner, len(ids), 1, pad=False)
        if words:
            own, at, more = g.owner, slice(None), {"tok": g.strings_of(0)}
        else:
            alike = counting.ranked(g.owner, g.c_text, g.c_summary)
            times = np.bincount(alike)
            at = counting.first_of(alike, len(times))
            own, more = g.owner[at], {"tokens": pa.array(times)}
        return {"id": ids.take(pa.array(own)), **more, "c_text": pa.array(g.c_text[at]), "c_summary": pa.array(g.c_summary[at]),
                "n_text": pa.array(g.n_text[own]), "n_summary": pa.array(g.n_summary[own])}

    rows = both_sides(pairs, split, worded)
    what = "tok string" if words else "tokens long"
    return counting.mapped(rows, count, f"id {counting.key_type(pairs)}, {what}, c_text long, c_summary long, n_text long, n_summary long")


def padded(tokens, n: int):
    return F.concat(F.array_repeat(F.lit(START), n - 1), tokens)


def ngrams(pairs: DataFrame, n: int = 3) -> DataFrame:
    """n-grams of each side after n-1 start marks: (id, side, pos, w1..wn)."""
    sides = side_rows(pairs, text.words).withColumn("toks", padded(F.col("toks"), n))
    grams = sides.select("id", "side", F.posexplode(text.gram_structs(F.col("toks"), n)).alias("pos", "g"))
    return grams.select("id", "side", "pos", "g.*")


def side_counts(pairs: DataFrame, split=text.words) -> DataFrame:
    """(id, side, tok, n): how often each side has each of its tokens."""
    counts = token_counts(pairs, split).filter("tok is not null")
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col("tok"), F.col(c).alias("n")) for side, c in ((TEXT, "c_text"), (SUMMARY, "c_summary"))])
    return counts.select("id", F.inline(sides)).filter("n > 0")


def everygrams(pairs: DataFrame, n: int = 2, pad: str = "<unk>") -> DataFrame:
    """All orders 1..n per sentence of the text, padded on both sides: (id, n, gram, count)."""
    def count(rows, owner, ids):
        sents = rows.column("sents")
        size = counting.lengths(sents.flatten()) + 2 * (n - 1)
        own = owner[counting.within(counting.lengths(sents))[0]]
        (codes, mark), strings = counting.coded(sents.flatten().flatten(), pa.array([pad]))
        sent, pos = counting.within(size)
        inside = (pos >= n - 1) & (pos < size[sent] - (n - 1))
        line = np.full(len(sent), mark[0])
        line[inside] = codes
        made = []
        for k in range(1, n + 1):
            starts = np.flatnonzero(pos + k <= size[sent])
            words = [line[starts + i] for i in range(k)]
            gram = counting.ranked(own[sent[starts]], *words)
            times = np.bincount(gram)
            at = counting.first_of(gram, len(times))
            texts = [strings.take(pa.array(w[at])) for w in words]
            made.append((ids.take(pa.array(own[sent[starts]][at])), pa.array(np.full(len(times), k, "int32")),
                         pc.binary_join_element_wise(*texts, " "), pa.array(times, pa.int64())))
        return {c: pa.concat_arrays(x) for c, x in zip(("id", "n", "gram", "count"), zip(*made))}

    sents = F.transform(text.sentences(F.col("text")), lambda s: text.words(s))
    rows = counting.by_id(pairs, F.coalesce(sents, F.array().cast("array<array<string>>")).alias("sents"))
    grams = counting.mapped(rows, count, f"id {counting.key_type(pairs)}, n int, gram string, count long")
    return grams.select("id", "n", "gram", "count")


def stem_dictionary(pairs: DataFrame, split=text.rouge_tokens) -> DataFrame:
    """(tok, stem) for each distinct token of the corpus, stemmed once."""
    toks = pairs.select(F.explode(F.array_distinct(F.concat(split(F.col("text")), split(F.col("summary"))))).alias("tok"))
    return porter.stem_tokens(toks.distinct())
