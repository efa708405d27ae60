"""Porter stemming (Porter 1980, with the usual later extensions) as column expressions.

A consonant y is written Y while the rules run, so one character class tells vowels
from consonants and every rule is a suffix test plus a pattern on the stem.

`stems` is for token lists: a batch's distinct tokens are stemmed once.  `stem_tokens` is for tables of distinct tokens.
"""

import functools
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Irregular words, vowel patterns and suffix rules of the algorithm.
IRREGULAR = {
    "sky": "sky", "skies": "sky",
    "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news",
    "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning",
    "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
MEASURE_1 = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
MEASURE_2 = "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]"
HAS_VOWEL = "[aeiouy]"
ENDS_CVC = "[^aeiouy][aeiouy][^aeiouywxY]$"
SHORT_VC = "^[aeiouy][^aeiouy]$"
DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|00|11|22|33|44|55|66|77|88|99)$"
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"), ("logi", "log"),
]
STEP_3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
]
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]
MIN_LENGTH = 4  # shorter tokens are kept as they are
UNTOUCHED = frozenset("abfhjkopqvwxz0123456789")  # no rule is for a token with such an end


def _cut(w: Column, suffix: str) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - F.lit(len(suffix)))


def _first_rule(w: Column, rules, shortest: int = 1) -> Column:
    """The first rule (suffix, condition on the stem, ending) whose suffix fits; a failed
    condition keeps the word.  Rules are looked up by last letter, and words under
    `shortest` letters, too short for any condition, are passed over."""
    by_letter: dict[str, list] = {}
    for rule in rules:
        by_letter.setdefault(rule[0][-1], []).append(rule)
    out = F.when(F.length(w) < shortest, w)
    for letter, group in by_letter.items():
        inner = None
        for suffix, holds, ending in group:
            stem = _cut(w, suffix)
            then = F.when(holds(stem), F.concat(stem, F.lit(ending))).otherwise(w)
            inner = F.when(w.endswith(suffix), then) if inner is None else inner.when(w.endswith(suffix), then)
        out = out.when(w.endswith(letter), inner.otherwise(w))
    return out.otherwise(w)


def _m1(stem: Column) -> Column:
    return stem.rlike(MEASURE_1)


def _m2(stem: Column) -> Column:
    return stem.rlike(MEASURE_2)


def _always(stem: Column) -> Column:
    return F.lit(True)


def _mark_y(w: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiou])y", "$1Y")
    return F.when(w.contains("y"), marked).otherwise(w)


def _plural(w: Column) -> Column:
    rules = [("sses", _always, "ss"), ("ies", _always, "i"), ("ss", _always, "ss"), ("s", _always, "")]
    short = w.endswith("ies") & (F.length(w) == 4)
    return F.when(short, _cut(w, "s")).otherwise(_first_rule(w, rules))


def _bare(w: Column) -> Column:
    """The stem before -ed or -ing if it has a vowel, else NULL."""
    ed = F.when(w.endswith("ied") | w.endswith("eed"), F.lit(None).cast("string")).when(
        w.endswith("ed") & _cut(w, "ed").rlike(HAS_VOWEL), _cut(w, "ed"))
    return F.when(w.endswith("d"), ed).when(w.endswith("ing") & _cut(w, "ing").rlike(HAS_VOWEL), _cut(w, "ing"))


def _past(w: Column, b: Column) -> Column:
    """Repair what -ed or -ing left over; -ied and -eed have endings of their own."""
    repaired = (F.when(b.rlike("(at|bl|iz)$"), F.concat(b, F.lit("e")))
                .when(b.rlike(DOUBLE), _cut(b, "x"))
                .when(b.rlike(MEASURE_1) & ~b.rlike(MEASURE_2) & (b.rlike(ENDS_CVC) | b.rlike(SHORT_VC)),
                      F.concat(b, F.lit("e")))
                .otherwise(b))
    return (F.when(b.isNotNull(), repaired)
            .when(~w.endswith("d"), w)
            .when(w.endswith("ied"), F.when(F.length(w) == 4, _cut(w, "d")).otherwise(_cut(w, "ed")))
            .when(w.endswith("eed") & _m1(_cut(w, "eed")), _cut(w, "d"))
            .otherwise(w))


def _final_y(w: Column) -> Column:
    return F.when(w.endswith("y") & w.rlike("^.+[^aeiouy]y$"), F.concat(_cut(w, "y"), F.lit("i"))).otherwise(w)


def _alli(w: Column) -> Column:
    """-alli becomes -al before the list it stands in is tried."""
    return F.when(w.endswith("alli") & _m1(_cut(w, "alli")), _cut(w, "li")).otherwise(w)


def _step2(w: Column) -> Column:
    rules = [(s, _m1, e) for s, e in STEP_2 if s != "logi"]
    logi = F.when(_m1(_cut(w, "ogi")), _cut(w, "i")).otherwise(w)
    return F.when(w.endswith("logi"), logi).otherwise(_first_rule(w, rules, 5))


def _step3(w: Column) -> Column:
    return _first_rule(w, [(s, _m1, e) for s, e in STEP_3], 5)


def _step4(w: Column) -> Column:
    return _first_rule(w, [(s, _m2_after_st if s == "ion" else _m2, "") for s in STEP_4], 6)


def _m2_after_st(stem: Column) -> Column:
    return _m2(stem) & stem.rlike("[st]$")


def _final_e(w: Column) -> Column:
    stem = _cut(w, "e")
    drop = _m2(stem) | (_m1(stem) & ~stem.rlike(ENDS_CVC) & ~stem.rlike(SHORT_VC))
    return F.when(w.endswith("e") & drop, stem).otherwise(w)


def _double_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & _m2(_cut(w, "l")), _cut(w, "l")).otherwise(w)


def _irregular(token: Column) -> Column:
    branch = None
    for word, stem in IRREGULAR.items():
        branch = F.when(token == word, stem) if branch is None else branch.when(token == word, stem)
    return F.when(token.isin(*IRREGULAR), branch)


def _on_word(step):
    return lambda s: F.struct(s["tok"].alias("tok"), F.when(s["w"].isNotNull(), step(s["w"])).alias("w"))


def stems_in_row(tokens: Column) -> Column:
    """The stems of a token array.  Each step is one pass over the array, so a step's many
    tests read a finished value and stay inside the row."""
    x = F.transform(tokens, lambda t: F.struct(
        t.alias("tok"), F.when(F.length(t) >= MIN_LENGTH, _mark_y(t)).alias("w")))
    x = F.transform(x, _on_word(_plural))
    x = F.transform(x, lambda s: F.struct(s["tok"].alias("tok"), s["w"].alias("w"), _bare(s["w"]).alias("b")))
    x = F.transform(x, lambda s: F.struct(s["tok"].alias("tok"), _past(s["w"], s["b"]).alias("w")))
    for step in (_final_y, _alli, _step2, _step3, _step4, _final_e, _double_l):
        x = F.transform(x, _on_word(step))
    return F.transform(x, lambda s: F.when(s["w"].isNull(), s["tok"]).otherwise(
        F.coalesce(_irregular(s["tok"]), F.lower(s["w"]))))


def stem_tokens(tokens: DataFrame, token: str = "tok", out: str = "stem") -> DataFrame:
    """Add the stem of each token of a table."""
    return tokens.withColumn(out, F.get(stems_in_row(F.array(token)), F.lit(0)))


_M1, _M2, _VOWEL, _CVC, _VC, _DOUBLED = (re.compile(p) for p in (MEASURE_1, MEASURE_2, HAS_VOWEL, ENDS_CVC, SHORT_VC, DOUBLE))


def _by_last(rules) -> dict[str, list]:
    """The rules by the last letter of their suffix, in their order."""
    out: dict[str, list] = {}
    for rule in rules:
        out.setdefault(rule[0][-1], []).append(rule)
    return out


def _ruled(w: str, rules: dict[str, list], shortest: int = 1) -> str:
    if len(w) >= shortest:
        for suffix, holds, ending in rules.get(w[-1:], ()):
            if w.endswith(suffix):
                stem = w[:len(w) - len(suffix)]
                return stem + ending if holds(stem) else w
    return w


_RULES_1 = _by_last([("sses", lambda x: True, "ss"), ("ies", lambda x: True, "i"), ("ss", lambda x: True, "ss"), ("s", lambda x: True, "")])
_RULES_2 = _by_last([(s, _M1.search, e) for s, e in STEP_2 if s != "logi"])
_RULES_3 = _by_last([(s, _M1.search, e) for s, e in STEP_3])
_RULES_4 = _by_last([(s, (lambda x: _M2.search(x) and x[-1:] in ("s", "t")) if s == "ion" else _M2.search, "") for s in STEP_4])
_MARKED_Y, _ENDS_Y = re.compile("([aeiou])y"), re.compile("^.+[^aeiouy]y$")


def _past_of(w: str) -> str:
    bare = None
    if w.endswith("d"):
        if not w.endswith(("ied", "eed")) and w.endswith("ed") and _VOWEL.search(w[:-2]):
            bare = w[:-2]
    elif w.endswith("ing") and _VOWEL.search(w[:-3]):
        bare = w[:-3]
    if bare is not None:
        if bare.endswith(("at", "bl", "iz")):
            return bare + "e"
        if _DOUBLED.search(bare):
            return bare[:-1]
        once = _M1.search(bare) and not _M2.search(bare)
        return bare + "e" if once and (_CVC.search(bare) or _VC.search(bare)) else bare
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    return w[:-1] if w.endswith("eed") and _M1.search(w[:-3]) else w


@functools.lru_cache(1 << 18)
def stem_of(token: str) -> str:
    """The stem of one token, by the rules that `stems_in_row` has."""
    if len(token) < MIN_LENGTH:
        return token
    if token[-1] in UNTOUCHED:
        return token.lower()
    if token in IRREGULAR:
        return IRREGULAR[token]
    w = token
    if "y" in w:
        w = _MARKED_Y.sub(r"\1Y", "Y" + w[1:] if w[0] == "y" else w)
    w = w[:-1] if w.endswith("ies") and len(w) == 4 else _ruled(w, _RULES_1)
    w = _past_of(w)
    if w.endswith("y") and _ENDS_Y.search(w):
        w = w[:-1] + "i"
    if w.endswith("alli") and _M1.search(w[:-4]):
        w = w[:-2]
    if w.endswith("logi"):
        w = w[:-1] if _M1.search(w[:-3]) else w
    else:
        w = _ruled(w, _RULES_2, 5)
    w = _ruled(_ruled(w, _RULES_3, 5), _RULES_4, 6)
    if w.endswith("e"):
        stem = w[:-1]
        if _M2.search(stem) or (_M1.search(stem) and not _CVC.search(stem) and not _VC.search(stem)):
            w = stem
    if w.endswith("ll") and _M2.search(w[:-1]):
        w = w[:-1]
    return w.lower()


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems(tokens: pa.Array) -> pa.Array:
    """The stems of token arrays."""
    coded = tokens.flatten().dictionary_encode()
    known = pa.array([None if t is None else stem_of(t) for t in coded.dictionary.to_pylist()], pa.string())
    offsets = pc.cumulative_sum(pa.concat_arrays([pa.array([0], pa.int64()), pc.fill_null(pc.list_value_length(tokens), 0).cast(pa.int64())]))
    return pa.ListArray.from_arrays(offsets.cast(pa.int32()), known.take(coded.indices), mask=tokens.is_null())
