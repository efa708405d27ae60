"""Column builders for splitting and cleaning text.  All of them stay in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define tokens and sentences.
WORD = r"[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"
LETTER = r"[\p{L}\p{N}]"
LETTER_RUN = r"[\p{L}\p{N}_]+"
ASCII_ONLY = r"^[A-Za-z]+$"
ROUGE_TOKEN = r"[a-z0-9]+"
SENTENCE_GAP = r"(?<=[.!?])\s+"
VOWEL_RUN = r"[aeiouy]+"
CAPITAL_RUN = r"\p{Lu}[\p{L}\p{N}]*(?: \p{Lu}[\p{L}\p{N}]*)*"
BLANKS = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
FIRST_WORD = r"^\s*\S+"


def _all_matches(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def sentences(x: Column, limit: int = -1) -> Column:
    """Sentences of a text, cut at blanks after . ! or ?; blank ones are left out.  With a
    limit the text is cut into at most so many pieces, the last of them uncut."""
    return F.filter(F.split(x, SENTENCE_GAP, limit), lambda s: s.rlike(r"\S"))


def words(x: Column) -> Column:
    """Lower-cased word and punctuation tokens."""
    return _all_matches(F.lower(x), WORD)


def cased_words(x: Column) -> Column:
    """Word and punctuation tokens, case kept."""
    return _all_matches(x, WORD)


def ascii_words(x: Column) -> Column:
    """Runs of ASCII letters that touch no other letter, digit or underscore."""
    return F.filter(_all_matches(x, LETTER_RUN), lambda w: w.rlike(ASCII_ONLY))


def ws_tokens(x: Column) -> Column:
    """Tokens between white space of any script, case kept."""
    return F.filter(F.split(x, BLANKS), lambda t: t != "")


def rouge_tokens(x: Column) -> Column:
    """Lower-cased runs of a-z and 0-9, not stemmed."""
    return _all_matches(F.lower(x), ROUGE_TOKEN)


def clean_mention(x: Column) -> Column:
    """An entity mention without outer blanks; NULL where nothing is left."""
    trimmed = F.trim(x)
    return F.when(trimmed != "", trimmed)


def clean_lemma(x: Column) -> Column:
    """A synonym lemma in lower case, with blanks for underscores."""
    return F.replace(F.lower(x), F.lit("_"), F.lit(" "))


def vowel_groups(word: Column) -> Column:
    """Syllables guessed from runs of vowels, at least one."""
    return F.greatest(F.lit(1), F.size(_all_matches(F.lower(word), VOWEL_RUN)))


def capital_runs(x: Column) -> Column:
    """Runs of capitalised words that do not open a sentence."""
    tails = F.transform(sentences(x), lambda s: F.regexp_replace(s, FIRST_WORD, ""))
    return F.flatten(F.transform(tails, lambda s: _all_matches(s, CAPITAL_RUN)))


def gram_structs(tokens: Column, n: int, names: list[str] | None = None) -> Column:
    """The n-grams of a token array, in order, as an array of structs w1..wn."""
    names = names or [f"w{i + 1}" for i in range(n)]
    length = F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0))
    shifted = [F.slice(tokens, F.lit(i + 1), length).alias(names[i]) for i in range(n)]
    return F.arrays_zip(*shifted)
