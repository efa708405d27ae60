"""Conditional surprisal of a text given its summary, under an interpolated Kneser-Ney model.

The model is trained on the sentences of each text.  Model n-grams and the n-grams to be
scored are counted together, and with them every total the model needs inside the pair.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.operators import counting
from gistmeter.operators.tokens import is_coded, sentence_words

UNKNOWN = "<unk>"
DISCOUNT = 0.1


def _names(n: int) -> list[str]:
    return [f"w{i + 1}" for i in range(n)]


def _with_contexts(pairs: DataFrame, worded: DataFrame | None = None) -> DataFrame:
    """(first, id, t, s): the words of the text's sentences, and the summary's."""
    if is_coded(worded):
        return counting.by_id(worded, F.col("t"), F.col("t_sents"), F.col("s"))
    return counting.by_id(sentence_words(pairs) if worded is None else worded, F.col("t"), F.flatten("s").alias("s"))


def _contexts(codes: np.ndarray, size: np.ndarray, m: np.ndarray, summary: np.ndarray, n_summary: np.ndarray, unknown: int, n: int):
    """The last n-1 words of each row's summary, unknown where the text lacks them, and those before the last of its sentences; both
    are filled up on the left with the unknown mark.  Only these words of a context are ever read."""
    def tail(values, starts, ends):
        at = ends[:, None] + np.arange(1 - n, 0)
        inside = at >= starts[:, None]
        return np.where(inside, values[np.where(inside, at, 0)], unknown) if len(values) else np.full(at.shape, unknown)

    last = np.cumsum(n_summary)
    found = tail(summary, last - n_summary, last)
    sentence_ends = np.concatenate([[0], np.cumsum(size)])
    ends = np.cumsum(m)
    starts, stops = sentence_ends[ends - m], sentence_ends[ends]
    row = np.repeat(np.arange(len(m)), stops - starts)
    for j in range(n - 1):
        has = np.zeros(len(m), bool)
        has[row[codes == found[row, j]]] = True
        found[~has, j] = unknown
    return found, tail(codes, starts, sentence_ends[np.maximum(ends - 1, ends - m)])


def _sentence_grams(rows, owner: np.ndarray, n: int):
    """Every n-gram to count: (owner, words, kinds), and the strings of the codes.

    A summary in front of a sentence changes only the contexts of its first n-1 words.
    The rest is counted from the model's own rows.
    """
    sents = counting.by_sentence(rows, "t")
    m = counting.lengths(sents)
    size = counting.lengths(sents.flatten())
    row, place = counting.within(m)
    toks, summary = sents.flatten().flatten(), rows.column("s")
    if pa.types.is_integer(toks.type):
        ((codes, asked), strings), unknown = counting.coded(toks, summary.flatten()), -1
    else:
        (codes, asked, (unknown,)), strings = counting.coded(toks, summary.flatten(), pa.array([UNKNOWN]))
    contexts = _contexts(codes, size, m, asked, counting.lengths(summary), unknown, n)
    starts = np.cumsum(size) - size
    is_last = (place == m[row] - 1) & (m[row] > 1)

    def words(sent, pos, before=None):
        """The n codes that end at a position of a sentence, after a context."""
        out = []
        for k in range(n - 1, -1, -1):
            at = pos - k
            inside = (at >= 0) & (at < size[sent])
            found = np.where(inside, codes[np.where(inside, starts[sent] + at, 0)] if len(codes) else unknown, unknown)
            if before is not None:
                ahead = at < 0
                found[ahead] = before[row[sent[ahead]], n - 1 + at[ahead]]
            out.append(found)
        return out

    sent, pos = counting.within(size + n - 1)
    word = pos < size[sent]
    later = word & (pos >= n - 1)
    none = np.zeros(len(sent), bool)
    parts = [(row[sent], *words(sent, pos), ~none, word, later, later & is_last[sent])]
    heads = np.minimum(size, n - 1)
    for context, only, kind in ((contexts[0], slice(None), 6), (contexts[1], np.flatnonzero(is_last), 7)):
        which = np.arange(len(size))[only]
        sent, pos = counting.within(heads[which])
        sent = which[sent]
        marks = [np.full(len(sent), j == kind) for j in (4, 5, 6, 7)]
        parts.append((row[sent], *words(sent, pos, context), *marks))
    empty = np.flatnonzero(m == 0)
    parts.append((empty, *[np.full(len(empty), -2)] * n, *[np.zeros(len(empty), bool)] * 4))
    at, *columns = (np.concatenate(x) for x in zip(*parts))
    return owner[at], columns[:n], columns[n:], strings


def _model_totals(own: np.ndarray, words: list[np.ndarray], c_model: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """What the model needs at every order, for each of its distinct n-grams."""
    seen = np.flatnonzero(c_model > 0)
    marks = {n: (c_model > 0).astype("int64")}
    for j in range(2, n):
        # one n-gram for each distinct j-gram of the model
        last = counting.ranked(own[seen], *[w[seen] for w in words[n - j:]])
        marks[j] = np.zeros(len(own), "int64")
        marks[j][seen[counting.first_of(last, int(last.max(initial=-1)) + 1)]] = 1

    groups = {}

    def total(values, *places):
        if places not in groups:
            groups[places] = counting.ranked(own, *[words[i] for i in places])
        group = groups[places]
        return counting.sums(group, values, int(group.max(initial=-1)) + 1)[group]

    out = {"_cont1": total(marks[2], n - 1), "_tot1": total(marks[2])}
    for k in range(1, n):
        context = range(n - 1 - k, n - 1)
        out[f"_types{k + 1}"] = total(marks[k + 1], *context)
        if k == n - 1:
            out[f"_cont{k + 1}"], out[f"_tot{k + 1}"] = c_model, total(c_model, *context)
        else:
            out[f"_cont{k + 1}"], out[f"_tot{k + 1}"] = total(marks[k + 2], *context, n - 1), total(marks[k + 2], *context)
    return out


def _total_names(n: int) -> list[str]:
    return ["_cont1", "_tot1"] + [f"_{what}{k + 1}" for k in range(1, n) for what in ("types", "cont", "tot")]


def kn_counts(pairs: DataFrame, n: int = 2, words: bool = True, worded: DataFrame | None = None) -> DataFrame:
    """(id, w1..wn, c_model, e_alone, e_summary, e_earlier, totals): model and evaluation counts, and the model's totals
    over each n-gram's contexts.  Without `words`, the columns w1..wn are left out, and n-grams of an id that the model gives the same
    numbers are one row with their evaluation counts together."""
    names = _names(n) if words else []
    read = ["e_alone", "e_summary", "e_earlier"]
    numbers = ["c_model", *read, *_total_names(n)]

    def count(rows, owner, ids):
        own, codes, (model, word, summary, earlier), strings = _sentence_grams(rows, owner, n)
        gram = counting.ranked(own, *codes)
        size = int(gram.max(initial=-1)) + 1
        at = counting.first_of(gram, size)
        made = {c: np.bincount(gram[kind], minlength=size) for c, kind in zip(numbers, (model, word, summary, earlier))}
        own, codes = own[at], [w[at] for w in codes]
        made |= _model_totals(own, codes, made["c_model"], n)
        if not words:
            alike = counting.ranked(own, made["c_model"], *[made[c] for c in _total_names(n)])
            size = int(alike.max(initial=-1)) + 1
            at = counting.first_of(alike, size)
            made = {c: counting.sums(alike, x, size) if c in read else x[at] for c, x in made.items()}
            own = own[at]
        texts = {c: strings.take(pa.array(w, pa.int64(), mask=w < 0)) for c, w in zip(names, codes)}
        return {"id": ids.take(pa.array(own)), **texts, **{c: pa.array(made[c], pa.int64()) for c in numbers}}

    schema = [f"id {counting.key_type(pairs)}", *[f"{c} string" for c in names], *[f"{c} long" for c in numbers]]
    return counting.mapped(_with_contexts(pairs, worded), count, ", ".join(schema))


def kn_prob(counts: DataFrame, n: int = 2) -> DataFrame:
    """Add `prob` of the last word after the words before it, at every order down to 1."""
    prob = F.try_divide(F.col("_cont1").cast("double"), F.col("_tot1").cast("double"))
    for k in range(1, n):
        whole = F.col(f"_tot{k + 1}").cast("double")
        kept = F.try_divide(F.greatest(F.col(f"_cont{k + 1}") - F.lit(DISCOUNT), F.lit(0.0)), whole)
        spared = F.try_divide(F.lit(DISCOUNT) * F.col(f"_types{k + 1}"), whole)
        prob = F.when(F.col(f"_types{k + 1}") > 0, kept + spared * prob).otherwise(prob)
    return counts.withColumn("prob", prob)


def _totals(pairs: DataFrame, n: int, worded: DataFrame | None = None) -> DataFrame:
    """(id, i_d, i_ds, i_dd, gain).  The gain i_d - i_ds is summed from the n-grams whose
    counts differ, so rounding cannot leave a gain where nothing changed."""
    scored = kn_prob(kn_counts(pairs, n, False, worded), n)
    bits = F.greatest(-F.log2("prob"), F.lit(0.0))

    def total(count):
        return F.coalesce(F.sum(F.when(count != 0, count * bits)), F.lit(0.0))

    return scored.groupBy("id").agg(
        total(F.col("e_alone")).alias("i_d"), total(F.col("e_summary")).alias("i_ds"),
        total(F.col("e_earlier")).alias("i_dd"), total(F.col("e_alone") - F.col("e_summary")).alias("gain"))


def surprisal(pairs: DataFrame, n: int = 2) -> DataFrame:
    """(id, i_d, i_ds, i_dd): bits of the text alone, after the summary, and of its last
    sentence after the earlier ones."""
    return _totals(pairs, n).drop("gain")


def shannon_score(pairs: DataFrame, n: int = 4, worded: DataFrame | None = None) -> DataFrame:
    """(id, i_d, i_ds, i_dd, shannon_score); the study scores with n=2."""
    room = F.col("i_d") - F.col("i_dd")
    gain = F.greatest("gain", F.lit(0.0))
    score = F.when(room > 0, F.try_divide(gain, room)).otherwise(F.lit(0.0))
    return _totals(pairs, n, worded).select("id", "i_d", "i_ds", "i_dd", score.alias("shannon_score"))
