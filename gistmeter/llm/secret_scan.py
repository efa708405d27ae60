"""Secrets in texts: fixed patterns, and strings that a random model explains better than one of ordinary words.

SQL functions only.  Two character Markov models, one of random strings and one of ordinary identifiers, are
counted from labelled strings; a long string is a secret where its log-likelihood ratio reaches a threshold.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmeter.llm.shared import text_documents, written


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The patterns of the base kinds.
WORDS = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN = r"""(?:%s)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" % "|".join(_either_case(w) for w in WORDS)
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters or more; a shorter run holds no longer match
HEX = r"[0-9a-f]{24,}"
ASSIGNED_CHARS = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
RUN = r"[A-Za-z0-9+/_-]"
LONG = 16  # characters of a string that the models judge; shorter ones are too little evidence
SHORT = 4  # strings from here to LONG are samples of ordinary identifiers
SAMPLE_TEXTS = 20_000  # texts that ordinary identifiers are taken from, as expected by a hash of the id
THRESHOLD = 10_000  # thousandths of a nat: odds of e^10, some 22,000 to one
BACKOFF = 4
KINDS = ["assign", "access", "hex", "random"]
START = "^"


def _names(kind: int) -> tuple[str, str]:
    return f"gaps{kind}", f"found{kind}"


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, gaps and found for each kind): the matches of each pattern, and the code points between them."""
    texts = text_documents(docs)
    patterns = [ASSIGN, ACCESS, HEX, RUN + "{%d,}" % LONG]
    columns = []
    for kind, pattern in enumerate(patterns):
        gaps, found = _names(kind)
        columns += [F.transform(F.split("text", pattern, -1), F.char_length).alias(gaps),
                    F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias(found)]
    return texts.select("doc_id", *columns)


def running_sums(values: Column) -> Column:
    """Prefix sums of an array of ints, by doubling the distance: n log n steps, inside the row."""
    n = F.size(values)
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int"))

    def shifted(sums: Column, k: Column) -> Column:
        zeros = F.array_repeat(F.lit(0), F.pow(F.lit(2), k).cast("int"))
        return F.zip_with(sums, F.slice(F.concat(zeros, sums), F.lit(1), n), lambda a, b: a + b)

    return F.when(n > 0, F.aggregate(rounds, values, shifted)).otherwise(values)


def _assigned(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 1)


def _spans(kind: int) -> Column:
    gaps, found = _names(kind)
    steps = F.zip_with(F.slice(F.col(gaps), F.lit(1), F.size(found)), F.col(found), lambda g, m: g + F.char_length(m))
    return F.zip_with(running_sums(steps), F.col(found), lambda end, m: F.struct(
        (end - F.char_length(m)).alias("start"), F.lit(kind).alias("order"), end.alias("end"), m.alias("value")))


def labelled_strings(docs: DataFrame, scan: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """(value, random), each string once: what the base patterns found is random, shorter strings elsewhere are ordinary.

    Random ones come from all documents.  Ordinary ones come from whole texts whose id's hash lies below a share of
    all hashes, `sample_texts` texts as expected, or all where there are fewer.
    """
    known = scan.select(F.explode(F.concat(F.filter(F.transform("found0", _assigned), lambda v: F.char_length(v) >= ASSIGNED_CHARS),
                                           "found1", "found2")).alias("value"))
    texts = text_documents(docs)
    share = sample_texts / max(texts.count(), 1)
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double")
    apart = F.regexp_replace("text", ASSIGN, " ")
    words = texts.filter(place < F.lit(share * 2.0 ** 32)).select(F.explode(F.regexp_extract_all(apart, F.lit(RUN + "+"), F.lit(0))).alias("value"))
    words = words.filter(F.char_length("value").between(SHORT, LONG - 1))
    whole = known.filter(F.col("value").rlike(f"^{RUN}+$"))
    return whole.distinct().withColumn("random", F.lit(True)).unionByName(words.distinct().withColumn("random", F.lit(False)))


def _pairs(value: Column) -> Column:
    """Neighbouring characters, the first one with the start mark."""
    chars = F.split(value, "")
    return F.zip_with(F.concat(F.array(F.lit(START)), F.slice(chars, F.lit(1), F.size(chars) - 1)), chars, lambda a, b: F.concat(a, b))


@dataclass
class Ratio:
    """Thousandths of a nat for each pair of neighbouring characters; the alphabet fixes its size."""

    weights: list[int]

    def score(self, value: Column) -> Column:
        table = F.split(F.lit(",".join(map(str, self.weights))), ",").cast("array<int>")
        return F.aggregate(_pairs(value), F.lit(0).cast("long"), lambda total, pair: total + F.get(
            table, F.ascii(pair) * 128 + F.ascii(F.substring(pair, 2, 1))))


def train(labelled: DataFrame) -> Ratio:
    """Count both models over (value, random) and subtract their logarithms.

    After a character that a model knows little of, it falls back on how often the next one occurs at all: BACKOFF
    occurrences of that, each count one higher.  Values hold characters of ALPHABET only.  A model without samples is uniform.
    """
    counts = labelled.select("random", F.explode(_pairs(F.col("value"))).alias("pair")).groupBy("random", "pair").count()
    grid = labelled.sparkSession.range(1).select(F.explode(F.split(F.lit(START + ALPHABET), "")).alias("a")).select(
        "a", F.explode(F.split(F.lit(ALPHABET), "")).alias("b"))
    both = counts.groupBy("pair").agg(*[F.sum(F.when(F.col("random") == r, F.col("count")).otherwise(0)).alias(n)
                                        for r, n in ((True, "r"), (False, "o"))])
    cells = grid.join(both, F.concat("a", "b") == F.col("pair"), "left").na.fill(0, ["r", "o"])
    size = len(ALPHABET)
    by_first = cells.groupBy("a").agg(F.sum("r").alias("first_r"), F.sum("o").alias("first_o"))
    by_next = cells.groupBy("b").agg(F.sum("r").alias("next_r"), F.sum("o").alias("next_o"))
    every = cells.agg(F.sum("r").alias("all_r"), F.sum("o").alias("all_o")).first()

    def chance(m: str) -> Column:
        alone = (F.col(f"next_{m}") + 1) / F.lit(float(every[f"all_{m}"] + size))
        return (F.col(m) + BACKOFF * alone) / (F.col(f"first_{m}") + F.lit(float(BACKOFF)))

    scored = cells.join(by_first, "a").join(by_next, "b").select("a", "b", F.floor(F.log(chance("r") / chance("o")) * 1000).alias("weight"))
    weights = [0] * 128 * 128
    # a row for each pair of characters of the alphabet
    for row in scored.collect():
        weights[ord(row["a"]) * 128 + ord(row["b"])] = row["weight"]
    return Ratio(weights)


def secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: int = THRESHOLD, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """(doc_id, spans): each span (start, order, end, value), in code points, end exclusive, by start and kind (KINDS[order]).

    `assign`, `access` and `hex` are the fixed patterns, leftmost and without overlap within a kind.  `random`
    marks every maximal string of at least LONG characters of ALPHABET, not all digits, whose ratio reaches the
    threshold, also where a fixed pattern found it: the models speak for themselves.  `labelled` (value, random) replaces the
    strings that the corpus labels itself.

    A null or empty text has no spans.  Repeated rows and ids, null ones too, each have their own row.  Other
    columns are ignored.  An empty table gives an empty result.  Texts do not move: rows are scanned once, and only
    what was found is kept for the second look.
    """
    scan = written(scanned(docs), "secret-scan")
    model = train(labelled_strings(docs, scan, sample_texts) if labelled is None else labelled)
    kept = [F.filter(_spans(0), lambda s: F.char_length(_assigned(s["value"])) >= ASSIGNED_CHARS), _spans(1), _spans(2),
            F.filter(_spans(3), lambda s: ~s["value"].rlike("^[0-9]+$") & (model.score(s["value"]) >= threshold))]
    return scan.select("doc_id", F.array_sort(F.concat(*kept)).alias("spans"))


def described(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of the rows of `secrets`."""
    def number(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["order"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    base = F.filter("spans", lambda s: s["order"] < KINDS.index("random"))
    return found.select("doc_id", *[number(k) for k in range(len(KINDS))], F.sha2(F.encode(described(base), "UTF-8"), 256).alias("base_sha256"),
                        described(F.col("spans")).alias("spans"))
