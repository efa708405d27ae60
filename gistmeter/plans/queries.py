"""Every operator as a query over the given tables, next to the same query in SQL."""

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmeter.functions import text as X
from gistmeter.functions import transforms
from gistmeter.functions.vectors import cosine
from gistmeter.operators import (composite, distribution, entities, grammar, overlap, perplexity, pseudo_reference,
                                 ratings, readability, relational, similarity, stats, surprisal, tokens)
from gistmeter.operators.layout import Bucketed, fresh_path, materialise, parts_of
from gistmeter.plans import corpus, incremental, scoring, tables
from gistmeter.plans import oracle as S
from gistmeter.plans.oracle import r6
from gistmeter.sources import tables as sources

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

DOC, CONV = "pairs_doc", "pairs_conv"
LIGHT_WEIGHTS = [0.1, 0.3, -0.2, 0.1, -0.1, -0.1, 0.1]


def _round6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f"`{c}`", 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, sql: str | None = None, pairs: str | None = None, **extra: str):
    """Register a query; doubles are rounded to six digits on both sides."""
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: _round6(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = S.sql(sql, pairs, **extra)
        return fn
    return add


def on_pairs(name: str, source: str, sql: str | None, fn, **extra: str):
    """Register a query that needs nothing but a pair table."""
    build = corpus.pairs_doc if source == DOC else corpus.pairs_conv
    query(name, sql, source, **extra)(lambda spark, sf_dir: fn(build(spark, sf_dir)))


def with_vectors(name: str, source: str, sql: str | None, fn):
    build = corpus.pairs_doc if source == DOC else corpus.pairs_conv
    query(name, sql, source)(lambda spark, sf_dir: fn(build(spark, sf_dir), *corpus.token_vectors(spark, sf_dir)))


def cols(*plain: str, rounded: tuple[str, ...] = ()) -> str:
    return ", ".join([*(f'"{c}"' for c in plain), *(r6(f'"{c}"', c) for c in rounded)])


def scratch(spark: SparkSession) -> str:
    return fresh_path(spark, "written")


def triple(name: str) -> tuple[str, str, str]:
    return f"{name} F1", f"{name} Recall", f"{name} Precision"


# --- sources, sinks and plumbing


@query("q01_read_pairs_csv", "SELECT id::VARCHAR AS id, text, summary FROM pairs_conv")
def _(spark, sf_dir):
    path = scratch(spark)
    sources.write_scores(corpus.pairs_conv(spark, sf_dir), path, "csv")
    return sources.read_pairs_csv(spark, path)


def _round_trip(form: str):
    def run(spark, sf_dir):
        path = scratch(spark)
        scores = readability.flesch_score(corpus.pairs_doc(spark, sf_dir)).withColumn("id", F.col("id").cast("string"))
        sources.write_scores(scores, path, form)
        return (spark.read.schema(scores.schema).options(**sources.CSV_READ).csv(path) if form == "csv"
                else sources.read_scores(spark, path, scores.schema))
    return run


for _form in ("csv", "parquet"):
    query(f"q02_write_scores_{_form}", "SELECT id::VARCHAR AS id, n_words, n_syllables, "
          + r6("flesch_score", "flesch_score") + " FROM flesch", DOC)(_round_trip(_form))

on_pairs("q03_metric_extract", DOC, f"SELECT {cols('id', rounded=('flesch_score',))} FROM flesch",
         lambda p: relational.metric_extract(readability.flesch_score(p), "flesch_score"))

S.FRAGMENTS["responses"] = """
SELECT id, CASE WHEN id % 7 = 0 THEN head WHEN id % 11 = 0 THEN head || rest || ', "overall_score": 1.5}'
  WHEN id % 13 = 0 THEN head || rest || '}' WHEN id % 17 = 0 THEN head || rest || ', "overall_score": "0.5"}'
  WHEN id % 19 = 0 THEN head || rest || ', "overall_score": true}' WHEN id % 23 = 0 THEN head || rest || fin || ' Thank you.'
  ELSE ' ' || head || rest || fin || chr(10) END AS raw
FROM (SELECT id, '{"information_similarity": ' || printf('%.2f', ((id * 3) % 101) / 100.0::DOUBLE) ||
    ', "grammatical_correctness": ' || printf('%.2f', ((id * 5) % 101) / 100.0::DOUBLE) ||
    ', "cohesion": ' || printf('%.2f', ((id * 7) % 101) / 100.0::DOUBLE) AS head,
  ', "conciseness": ' || printf('%.2f', ((id * 11) % 101) / 100.0::DOUBLE) AS rest,
  ', "overall_score": ' || printf('%.2f', ((id * 13) % 101) / 100.0::DOUBLE) || '}' AS fin FROM p)"""
S.FRAGMENTS["flat"] = r"""
SELECT id, t, regexp_matches(t, '(?s)^\{.*\}$') AND json_valid(t) AS good
FROM (SELECT id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS t FROM responses)"""
_num = ("CASE WHEN good AND json_type(CASE WHEN good THEN t ELSE '{{}}' END, '$.{k}') IN ('DOUBLE', 'UBIGINT', 'BIGINT') "
        "THEN json_extract(CASE WHEN good THEN t ELSE '{{}}' END, '$.{k}')::DOUBLE END")
S.FRAGMENTS["numbers"] = "SELECT id, good, " + ", ".join(
    _num.format(k=k) + f" AS {k}" for k in ratings.RATING_KEYS) + " FROM flat"
_any_null = " OR ".join(f"{k} IS NULL" for k in ratings.RATING_KEYS)
_any_out = " OR ".join(f"{k} NOT BETWEEN 0 AND 1" for k in ratings.RATING_KEYS)
S.FRAGMENTS["parsed"] = (
    f"SELECT id, CASE WHEN NOT good THEN 'malformed' WHEN {_any_null} THEN 'missing key' "
    f"WHEN {_any_out} THEN 'out of range' ELSE 'valid' END AS reason, "
    + ", ".join(f"CASE WHEN good AND NOT ({_any_null}) AND NOT ({_any_out}) THEN {k} END AS {k}" for k in ratings.RATING_KEYS)
    + " FROM numbers")
_RENAMED = ", ".join(f"{a} AS {b}" for a, b in relational.MODEL_COLUMNS.items())


def _rated(spark, sf_dir):
    pairs = corpus.pairs_doc(spark, sf_dir)
    return ratings.attach_ratings(pairs, corpus.responses(pairs))


query("q04_canonical_columns", f"SELECT id, p.text, p.summary, reason = 'valid' AS rating_valid, {_RENAMED} "
      "FROM p JOIN parsed USING (id)", DOC)(lambda s, d: relational.canonical_columns(_rated(s, d)))
query("q05_drop_columns", f"SELECT id, reason = 'valid' AS rating_valid, {', '.join(ratings.RATING_KEYS)} FROM parsed",
      DOC)(lambda s, d: relational.drop_texts(_rated(s, d)))
query("q06_merge_labels", f"SELECT id, reason = 'valid' AS rating_valid, {_RENAMED}, p.text, p.summary, "
      "overall_score_human FROM parsed JOIN human USING (id) JOIN p USING (id)", DOC)(
    lambda s, d: relational.merge_labels(_rated(s, d), tables.human_side(s, d)))
query("q07_join_scores", f"SELECT id, {r6('flesch_score', 'score')}, overall_score_human FROM flesch JOIN human USING (id)", DOC)(
    lambda s, d: relational.join_scores(
        readability.flesch_score(corpus.pairs_doc(s, d)).select("id", F.col("flesch_score").alias("score")),
        corpus.human_scores(s, d)))
query("q08_duplicate_ids", "SELECT conv_id AS id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")(
    lambda s, d: relational.duplicate_ids(corpus.table(s, d, "conversations").select(F.col("conv_id").alias("id"))))
on_pairs("q09_first_n", DOC, "SELECT id, text, summary FROM p ORDER BY id LIMIT 500", lambda p: relational.first_n(p, 500))
query("q10_union_sources", "SELECT id, overall_score_human, NULL::VARCHAR AS text, NULL::VARCHAR AS summary FROM human "
      "UNION ALL SELECT id, NULL, text, summary FROM pairs_conv")(
    lambda s, d: relational.union_sources(corpus.human_scores(s, d), corpus.pairs_conv(s, d)))
query("q11_numeric_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
      "l_discount, l_tax FROM lineitem")(lambda s, d: relational.numeric_only(corpus.table(s, d, "lineitem")))
on_pairs("q12_select_metrics", DOC, f"SELECT {cols(rounded=('ROUGE-1 F1', 'ROUGE-1 Recall'))} FROM rouge1",
         lambda p: relational.select_metrics(overlap.rouge_n(p, 1), ["ROUGE-1 F1", "ROUGE-1 Recall"]))
S.FRAGMENTS["measures"] = """
SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS quantity, l_extendedprice AS price,
       l_extendedprice * l_discount AS rebate, 20.0::DOUBLE - l_extendedprice * l_discount / 100 AS remainder,
       CASE WHEN l_returnflag <> 'N' THEN l_tax END AS tax_if_closed FROM lineitem"""
query("q13_drop_missing", "SELECT id, tax_if_closed FROM measures WHERE tax_if_closed IS NOT NULL")(
    lambda s, d: relational.drop_missing(corpus.measures(s, d), "tax_if_closed").select("id", "tax_if_closed"))
IS_TEST = "('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT % 10 < 3"


@query("q14_train_test_split", f"SELECT id, {IS_TEST} AS is_test FROM human")
def _(spark, sf_dir):
    train, test = relational.train_test_split(corpus.human_scores(spark, sf_dir).select("id"))
    return train.withColumn("is_test", F.lit(False)).union(test.withColumn("is_test", F.lit(True)))


_ALL_PARTS = {"embed": ("embedding_similarity",), "flesch": ("flesch_score",), "grammar": ("grammar_score",),
              "perplexity": ("perplexity",), "sdc": ("sdc_unigram",), "shannon": ("shannon_score",),
              "supert": ("supert_score",), "bert": ("BERT Precision", "BERT Recall", "BERT F1"),
              "rouge1": triple("ROUGE-1"), "rouge2": triple("ROUGE-2"), "rougel": triple("ROUGE-L")}


def _joined(parts, keep="") -> str:
    names = [c for part in parts for c in _ALL_PARTS[part]]
    return (f"SELECT id{keep}, " + ", ".join(r6(f'"{c}"', c) for c in names) + " FROM p "
            + " ".join(f"LEFT JOIN {part} USING (id)" for part in parts))


with_vectors("q15_score_all", CONV, _joined(_ALL_PARTS, ", p.text, p.summary"), scoring.score_all)
query("q15_score_all_documents")(tables.document_scores)


def _light_scores(pairs: DataFrame) -> DataFrame:
    """Of pairs laid out by id."""
    parts = [perplexity.perplexity(pairs), distribution.sdc_unigram(pairs).select("id", "sdc_unigram"),
             readability.flesch_score(pairs).select("id", "flesch_score")]
    return functools.reduce(lambda a, b: a.join(b, "id", "left"), parts, pairs.select("id"))


@query("q15_score_incremental", _joined(("perplexity", "sdc", "flesch"), ", p.id % 100 = 7 AS rescored"), DOC)
def _(spark, sf_dir):
    """Scores of an earlier run, in which a few summaries were others, brought up to date; and which pairs that took."""
    parts = parts_of(corpus.table(spark, sf_dir, "documents")) or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Bucketed(corpus.pairs_doc(spark, sf_dir), buckets=parts, placed=True) as pairs:
        earlier = pairs.withColumn("summary", F.when(F.col("id") % 100 == 7, F.concat(F.lit("Once "), F.coalesce("summary", F.lit("")))).otherwise(F.col("summary")))
        table = incremental.ScoreTable(spark, scratch(spark), pairs.schema["id"].dataType, ["perplexity", "sdc_unigram", "flesch_score"],
                                       _light_scores, version="1", parts=parts)
        table.update(earlier)
        changed = materialise(table.missing(pairs).select("id", F.lit(True).alias("rescored")))
        table.update(pairs)
        return materialise(table.scores(pairs).join(changed, "id", "left").na.fill(False, ["rescored"]), "scores")


# --- text functions

on_pairs("q16_sentences", DOC, "SELECT id, side::INTEGER AS side, sp::INTEGER AS sent_pos, sent FROM sen", tokens.sentence_rows)
on_pairs("q17_words", DOC, "SELECT id, side::INTEGER AS side, (pos - 1)::INTEGER AS pos, tok FROM tok", tokens.token_rows)
on_pairs("q18_ascii_words", DOC, "SELECT id, word, count(*) AS n FROM aword GROUP BY ALL",
         lambda p: p.select("id", F.explode(X.ascii_words(F.col("summary"))).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n")))
S.FRAGMENTS["wtok"] = f"""
SELECT id, 0 AS side, unnest(list_filter(regexp_split_to_array(text, '{X.BLANKS}'), lambda t: t <> '')) AS tok FROM p
UNION ALL SELECT id, 1, unnest(list_filter(regexp_split_to_array(summary, '{X.BLANKS}'), lambda t: t <> '')) FROM p"""
on_pairs("q19_ws_tokens", DOC, "SELECT id, side::INTEGER AS side, tok, count(*) AS n FROM wtok GROUP BY ALL",
         lambda p: tokens.side_counts(p, X.ws_tokens))
on_pairs("q20_rouge_tokens", DOC, "SELECT id, side::INTEGER AS side, (pos - 1)::INTEGER AS pos, raw AS tok FROM raw_rtok",
         lambda p: tokens.token_rows(p, X.rouge_tokens))
on_pairs("q21_stem_dictionary", DOC, "SELECT tok, stem FROM stems", tokens.stem_dictionary)
on_pairs("q22_ngrams", DOC, "SELECT id, side::INTEGER AS side, (pos - 1)::INTEGER AS pos, w1, w2, w3 FROM tri", tokens.ngrams)
S.FRAGMENTS["every"] = """
SELECT id, 1 AS n, w AS gram FROM big UNION ALL
SELECT id, 1, '<unk>' FROM sen WHERE side = 0 UNION ALL SELECT id, 2, c || ' ' || w FROM big"""
on_pairs("q23_everygrams", DOC, 'SELECT id, n::INTEGER AS n, gram, count(*) AS "count" FROM every GROUP BY ALL', tokens.everygrams)
on_pairs("q24_clean_mentions", DOC, r"""SELECT id, trim(m) AS entity FROM (SELECT id, unnest(string_split(summary, ',')) AS m FROM p)
WHERE trim(m) <> ''""", lambda p: p.select("id", F.explode(F.split("summary", ",")).alias("m")).select(
    "id", X.clean_mention(F.col("m")).alias("entity")).filter("entity is not null"))
query("q25_clean_lemmas", "SELECT event_id AS id, replace(lower(event_type || '_' || props), '_', ' ') AS lemma FROM events")(
    lambda s, d: corpus.table(s, d, "events").select(
        F.col("event_id").alias("id"), X.clean_lemma(F.concat_ws("_", "event_type", "props")).alias("lemma")))

# --- metrics that need no gold summary

S.FRAGMENTS["nextvec"] = "SELECT vec_id, embedding, lead(embedding) OVER (ORDER BY vec_id) AS other FROM embeddings"


@query("q26_cosine", "SELECT a.vec_id AS vec_id, " + r6("list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", "cosine")
       + " FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", cosine(F.col("embedding"), F.col("other")).alias("cosine"))


with_vectors("q27_text_vectors", DOC, "SELECT id, side::INTEGER AS side, (k - 1)::INTEGER AS dim, " + r6("v", "v") + " FROM tvec",
             lambda p, v, k: similarity.text_vectors(p, v, k).select("id", "side", F.posexplode("vec").alias("dim", "v")))
with_vectors("q28_embedding_similarity", DOC, f"SELECT {cols('id', rounded=('embedding_similarity',))} FROM embed",
             similarity.embedding_similarity)
_LEX = "SELECT * FROM (VALUES " + ", ".join(f"('{w}', {n})" for w, n in corpus.LEXICON) + ") v(word, min_syllables)"
S.FRAGMENTS["lexicon"] = _LEX
S.FRAGMENTS["wsyl"] = """
SELECT id, a.word, count(*) AS n, coalesce(any_value(min_syllables), 0)::INTEGER AS syllables
FROM (SELECT id, lower(word) AS word FROM aword) a LEFT JOIN lexicon USING (word) GROUP BY id, a.word"""
query("q29_syllables", "SELECT id, word, n, syllables FROM wsyl", DOC)(
    lambda s, d: readability.syllables(readability.word_rows(corpus.pairs_doc(s, d)).filter("word is not null"), corpus.lexicon(s)))
on_pairs("q30_syllables_vowel_groups", DOC, """SELECT id, lower(word) AS word, count(*) AS n,
greatest(1, len(regexp_extract_all(lower(any_value(word)), '[aeiouy]+')))::INTEGER AS syllables FROM aword GROUP BY id, lower(word)""",
         lambda p: readability.syllables(readability.word_rows(p).filter("word is not null")))
on_pairs("q31_flesch_score", DOC, f"SELECT {cols('id', 'n_words', 'n_syllables', rounded=('flesch_score',))} FROM flesch",
         readability.flesch_score)
query("q31_flesch_dictionary", "SELECT id, n_words, n_syllables, " + r6(S.EASE.format(unit="n_syllables"), "flesch_score") + """
FROM (SELECT p.id, coalesce(sum(n), 0)::BIGINT AS n_words, coalesce(sum(n * syllables), 0)::BIGINT AS n_syllables
      FROM p LEFT JOIN wsyl USING (id) GROUP BY p.id)""", DOC)(
    lambda s, d: readability.flesch_score(corpus.pairs_doc(s, d), corpus.lexicon(s)))
on_pairs("q32_flesch_standard", DOC,
         "SELECT id, n_words, n_syllables, n_sentences::INTEGER AS n_sentences, " + r6("flesch_standard", "flesch_standard") + " FROM flesch_std",
         readability.flesch_standard)
on_pairs("q33_lint_findings", DOC, "SELECT id, rule, n::BIGINT AS n FROM findings", grammar.lint_findings)
on_pairs("q34_grammar_score", DOC, f"SELECT {cols('id', 'n_findings', rounded=('grammar_score',))} FROM grammar", grammar.grammar_score)
on_pairs("q35_ngram_model", DOC, """SELECT m.id, m.w1, m.w2, m.w3, m.c AS c_text, x.c AS c_context, v.v::INTEGER AS vocab
FROM trimodel m JOIN trictx x ON x.id = m.id AND x.w1 = m.w1 AND x.w2 = m.w2 JOIN vocab v ON v.id = m.id""",
         lambda p: perplexity.ngram_model(p).filter("c_text > 0").drop("c_summary"))
on_pairs("q36_laplace_prob", DOC, "SELECT id, w1, w2, w3, " + r6("any_value(p)", "prob") + " FROM triprob GROUP BY id, w1, w2, w3",
         lambda p: perplexity.laplace_prob(perplexity.ngram_model(p)).filter("c_summary > 0").select("id", "w1", "w2", "w3", "prob"))
on_pairs("q37_perplexity", DOC, f"SELECT {cols('id', rounded=('perplexity',))} FROM perplexity", perplexity.perplexity)
on_pairs("q38_unigram_probs", DOC, "SELECT id, tok, " + r6("x", "p") + " FROM xy WHERE cd > 0", distribution.unigram_probs)
on_pairs("q39_token_probs", DOC, "SELECT xy.id, xy.tok, uni.cs AS n, " + r6("CASE WHEN xy.cd > 0 THEN xy.x ELSE 1e-6::DOUBLE END", "p")
         + " FROM xy JOIN uni ON uni.id = xy.id AND uni.tok = xy.tok WHERE uni.cs > 0", distribution.token_probs)
on_pairs("q40_sdc_unigram", DOC, f"SELECT {cols('id', rounded=('sdc_shift', 'sdc_correlation', 'sdc_unigram'))} FROM sdc",
         distribution.sdc_unigram)
on_pairs("q41_kn_model", DOC, """SELECT b.id, b.c AS w1, b.w AS w2, b.n AS c_model, x.n AS c_context, x.types, q.preds, y.types AS all_types
FROM bigc b JOIN bctx x ON x.id = b.id AND x.c = b.c JOIN bpre q ON q.id = b.id AND q.w = b.w JOIN btyp y ON y.id = b.id""",
         lambda p: surprisal.kn_prob(surprisal.kn_counts(p)).filter("c_model > 0").selectExpr(
             "id", "w1", "w2", "c_model", "_tot2 c_context", "_types2 types", "_cont1 preds", "_tot1 all_types"))
on_pairs("q42_kn_prob", DOC, "SELECT id, c AS w1, w AS w2, " + r6("any_value(p)", "prob") + " FROM knp GROUP BY id, c, w",
         lambda p: surprisal.kn_prob(surprisal.kn_counts(p)).filter("e_alone + e_summary + e_earlier > 0").select("id", "w1", "w2", "prob"))
on_pairs("q43_surprisal", DOC, f"SELECT {cols('id', rounded=('i_d', 'i_ds', 'i_dd'))} FROM surprisal", surprisal.surprisal)
on_pairs("q44_shannon_score", DOC, f"SELECT {cols('id', rounded=('i_d', 'i_ds', 'i_dd', 'shannon_score'))} FROM shannon",
         lambda p: surprisal.shannon_score(p, 2))
on_pairs("q44_shannon_score_four_words", CONV, None, lambda p: surprisal.shannon_score(p, 4))
with_vectors("q45_pseudo_references", DOC, "SELECT id, cluster::BIGINT AS cluster, sent_pos::BIGINT AS sent_pos FROM refs",
             pseudo_reference.pseudo_references)
with_vectors("q46_supert_score", DOC, f"SELECT {cols('id', rounded=('supert_score',))} FROM supert", pseudo_reference.supert_score)

# --- entity overlap

_RUN = r"\p{Lu}[\p{L}\p{N}]*(?: \p{Lu}[\p{L}\p{N}]*)*"
def _readings(pairs: DataFrame) -> DataFrame:
    """(word, phones): two readings of every summary word, the second without its first letter."""
    rows = pairs.select(F.explode(X.ascii_words(F.col("summary"))).alias("word")).distinct()
    both = rows.select("word", F.explode(F.array("word", F.expr("substr(word, 2)"))).alias("said"))
    return both.select("word", F.transform(F.split("said", ""), lambda c: F.when(c.rlike("[aeiouyAEIOUY]"), F.concat(c, F.lit("1"))).otherwise(c)).alias("phones"))


S.FRAGMENTS["reading"] = r"""
SELECT lower(word) AS word, len(regexp_extract_all(lower(said), '[aeiouy]')) AS n
FROM (SELECT word, unnest([word, word[2:]]) AS said FROM aword)"""
on_pairs("q29_syllable_dictionary", DOC, "SELECT word, min(n) AS min_syllables FROM reading GROUP BY word",
         lambda p: readability.syllable_dictionary(_readings(p)))
S.FRAGMENTS["mention"] = rf"""
SELECT DISTINCT id, side::INTEGER AS side, entity FROM (
  SELECT id, side, trim(unnest(regexp_extract_all(regexp_replace(sent, '^\s*\S+', ''), '{_RUN}'))) AS entity FROM sen) WHERE entity <> ''"""
S.FRAGMENTS["alias1"] = """
SELECT entity, 'Q' || substr(md5(entity), 1, 6) AS qid FROM mention WHERE side = 0 GROUP BY entity HAVING count(DISTINCT id) >= 2"""
S.FRAGMENTS["links"] = "SELECT DISTINCT id, side, qid FROM mention JOIN alias1 USING (entity)"
S.FRAGMENTS["cached"] = f"""
SELECT entity, CASE WHEN h % 5 <> 0 THEN qid END AS qid, {corpus.NOW} - (h % 64) * 86400 AS last_updated
FROM (SELECT entity, qid, ('0x' || substr(md5(entity), 1, 4))::BIGINT AS h FROM alias1) WHERE h % 3 <> 0"""
S.FRAGMENTS["fresh"] = f"""
SELECT entity, qid, {corpus.NOW} - (h % 32) * 86400 AS last_updated
FROM (SELECT entity, qid, ('0x' || substr(md5(entity), 5, 4))::BIGINT AS h FROM alias1) WHERE h % 2 = 0"""
S.FRAGMENTS["kg"] = """
SELECT p.id, coalesce(t, 0)::BIGINT AS n_text, coalesce(b, 0)::BIGINT AS n_shared, coalesce(b, 0)::DOUBLE / greatest(coalesce(t, 0), 1) AS kg_score
FROM p LEFT JOIN (SELECT id, sum(s0) AS t, sum(s0 * s1) AS b FROM (
  SELECT id, qid, max((side = 0)::INT) AS s0, max((side = 1)::INT) AS s1 FROM links GROUP BY id, qid) GROUP BY id) USING (id)"""


def _aliases(p: DataFrame) -> DataFrame:
    """The alias table, written once: it is counted before it is joined."""
    return materialise(corpus.alias_table(p))


on_pairs("q47_entity_mentions", DOC, "SELECT id, side, entity FROM mention", entities.entity_mentions)
# names in texts: candidates by their first token, the longest at each place, then a reader's walk from the left
S.FRAGMENTS["ctext"] = f"""
SELECT id, 0 AS side, regexp_extract_all(text, '{S.WORD}') AS toks FROM p
UNION ALL SELECT id, 1, regexp_extract_all(summary, '{S.WORD}') FROM p"""
S.FRAGMENTS["ctok"] = "SELECT id, side, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM ctext"
S.FRAGMENTS["nkey"] = f"""
SELECT entity, l, len(l) AS n, array_to_string(l, chr(31)) AS key FROM (SELECT DISTINCT entity, regexp_extract_all(entity, '{S.WORD}') AS l FROM nam)
WHERE len(l) > 0"""
# no name here has more tokens than the windows
S.FRAGMENTS["cwin"] = ("SELECT id, side, pos, [" + ", ".join(["tok", *(f"lead(tok, {k}) OVER w" for k in range(1, 16))])
                       + "] AS win FROM ctok WINDOW w AS (PARTITION BY id, side ORDER BY pos)")
S.FRAGMENTS["opened"] = """
SELECT id, side, pos, n, array_to_string(win[1:n], chr(31)) AS run FROM cwin, (SELECT DISTINCT n FROM nkey) WHERE win[n] IS NOT NULL"""
S.FRAGMENTS["named"] = """
SELECT id, side, pos, o.n, key FROM opened o JOIN (SELECT DISTINCT key FROM nkey) ON key = run
UNION SELECT id, side, pos, o.n, key FROM opened o JOIN (SELECT DISTINCT key FROM nkey) ON key = lower(run)"""
S.FRAGMENTS["nlong"] = "SELECT id, side, pos, max(n) AS n FROM named GROUP BY id, side, pos"
S.FRAGMENTS["walk"] = """
SELECT id, side, unnest(list_reduce(list_transform(l, lambda s: [s]),
                                    lambda a, x: CASE WHEN a[-1].pos + a[-1].n <= x[1].pos THEN list_concat(a, x) ELSE a END)).pos AS pos
FROM (SELECT id, side, list({pos: pos, n: n} ORDER BY pos) AS l FROM nlong GROUP BY id, side)"""
S.FRAGMENTS["met"] = """
SELECT DISTINCT w.id, w.side, k.entity FROM walk w JOIN nlong l ON l.id = w.id AND l.side = w.side AND l.pos = w.pos
JOIN named m ON m.id = l.id AND m.side = l.side AND m.pos = l.pos AND m.n = l.n JOIN nkey k ON k.key = m.key"""
S.FRAGMENTS["phrase"] = f"""
SELECT g AS entity FROM (
  SELECT id, unnest(list_concat([{{g: tok || ' ' || a}}], CASE WHEN b IS NOT NULL THEN [{{g: tok || ' ' || a || ' ' || b}}] ELSE [] END)).g AS g
  FROM (SELECT id, tok, lead(tok) OVER w AS a, lead(tok, 2) OVER w AS b FROM tok WHERE side = 0 WINDOW w AS (PARTITION BY id ORDER BY pos))
  WHERE a IS NOT NULL)
GROUP BY g HAVING count(DISTINCT id) * {corpus.PHRASE_SHARE} >= (SELECT count(*) FROM p)"""
_MET = "SELECT id, side, entity FROM met"
on_pairs("q47_gazetteer_mentions", DOC, _MET, lambda p: entities.entity_mentions(p, _aliases(p)), nam="SELECT entity FROM alias1")
on_pairs("q47_gazetteer_phrases", DOC, _MET, lambda p: entities.entity_mentions(p, materialise(corpus.name_list(p))),
         nam="SELECT entity FROM alias1 UNION SELECT entity FROM phrase")
on_pairs("q48_link_entities", DOC, "SELECT id, side, qid FROM links",
         lambda p: entities.link_entities(entities.entity_mentions(p), _aliases(p)))


def _on_cache(name: str, sql: str, fn):
    on_pairs(name, DOC, sql, lambda p: fn(p, _aliases(p)))


def _requests(p):
    return entities.entity_mentions(p).select("entity").distinct()


_on_cache("q49_cache_lookup", "SELECT m.entity, c.qid, c.entity IS NOT NULL AS hit FROM (SELECT DISTINCT entity FROM mention) m "
          "LEFT JOIN cached c ON c.entity = m.entity",
          lambda p, a: entities.cache_lookup(_requests(p), corpus.cache_table(a)))
_on_cache("q49_cache_misses", "SELECT DISTINCT entity FROM mention WHERE entity NOT IN (SELECT entity FROM cached)",
          lambda p, a: entities.cache_misses(_requests(p), corpus.cache_table(a)))
_on_cache("q50_cache_upsert", """SELECT entity, qid, last_updated FROM (
  SELECT *, 0 AS f FROM cached UNION ALL SELECT *, 1 FROM fresh)
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY last_updated DESC, f DESC) = 1""",
          lambda p, a: entities.cache_upsert(corpus.cache_table(a), corpus.fresh_lookups(a)))


def _renewed(alias: DataFrame) -> DataFrame:
    """A third run: a few names again, now without a hit."""
    return alias.select("entity").distinct().filter(F.col("entity") < "C").select(
        "entity", F.lit(None).cast("string").alias("qid"), F.lit(corpus.NOW + entities.DAY).alias("last_updated"))


def _cache_versions(p: DataFrame, alias: DataFrame) -> DataFrame:
    """Every version of a cache that was filled, merged into twice, and cleared of old lookups, read back."""
    cache = entities.EntityCache(p.sparkSession, scratch(p.sparkSession))
    for rows in (corpus.cache_table(alias), corpus.fresh_lookups(alias), _renewed(alias)):
        cache.upsert(rows)
    cache.expire(corpus.NOW)
    versions = [cache.table.read(v).withColumn("version", F.lit(v)) for v in range(1, 5)]
    return functools.reduce(DataFrame.unionByName, versions)


def _merged_sql(old: str, new: str) -> str:
    return (f"SELECT entity, qid, last_updated FROM (SELECT *, 0 AS f FROM {old} UNION ALL SELECT *, 1 FROM {new}) "
            "QUALIFY row_number() OVER (PARTITION BY entity ORDER BY last_updated DESC, f DESC) = 1")


S.FRAGMENTS["renewed"] = (f"SELECT DISTINCT entity, NULL::VARCHAR AS qid, {corpus.NOW + entities.DAY}::BIGINT AS last_updated "
                          "FROM alias1 WHERE entity < 'C'")
S.FRAGMENTS["cache2"], S.FRAGMENTS["cache3"] = _merged_sql("cached", "fresh"), _merged_sql("cache2", "renewed")
_on_cache("q50_cache_versions", f"""SELECT 1 AS version, * FROM cached UNION ALL SELECT 2, * FROM cache2 UNION ALL SELECT 3, * FROM cache3
  UNION ALL SELECT 4, * FROM cache3 WHERE last_updated >= {corpus.NOW} - 30 * 86400""", _cache_versions)
_on_cache("q51_cache_stats", "SELECT count(*) AS total, count(qid) AS matches FROM cached",
          lambda p, a: entities.cache_stats(corpus.cache_table(a)))
_on_cache("q52_cache_expire", f"SELECT entity, qid, last_updated FROM cached WHERE last_updated >= {corpus.NOW} - 30 * 86400",
          lambda p, a: entities.cache_expire(corpus.cache_table(a), corpus.NOW))
on_pairs("q53_kg_score", DOC, f"SELECT {cols('id', 'n_text', 'n_shared', rounded=('kg_score',))} FROM kg",
         lambda p: entities.kg_score(p, _aliases(p)))
with_vectors("q54_kg_bertscore", DOC, "SELECT kg.id AS id, "
             + r6('0.7::DOUBLE * coalesce("BERT F1", 0) + (1 - 0.7::DOUBLE) * kg_score', "kg_bertscore")
             + " FROM kg LEFT JOIN bert ON bert.id = kg.id",
             lambda p, v, k: entities.kg_bertscore(p, _aliases(p), v, k))

# --- overlap baselines

for _n in (1, 2):
    on_pairs(f"q55_rouge_{_n}", DOC, f"SELECT {cols('id', rounded=triple(f'ROUGE-{_n}'))} FROM rouge{_n}",
             lambda p, n=_n: overlap.rouge_n(p, n))
on_pairs("q55_rouge_1_unstemmed", DOC, f"SELECT {cols('id', rounded=triple('ROUGE-1'))} FROM rouge1",
         lambda p: overlap.rouge_n(p, 1, stem=False), rtok="SELECT id, side, pos, raw AS tok FROM raw_rtok")
on_pairs("q56_rouge_l", CONV, f"SELECT {cols('id', 'lcs', rounded=triple('ROUGE-L'))} FROM rougel", overlap.rouge_l)
on_pairs("q56_rouge_l_documents", DOC, None, overlap.rouge_l)
_SYN = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in corpus.SYNONYMS) + ") v(word, synonym)"
S.FRAGMENTS["synonyms"] = _SYN
S.FRAGMENTS["listed"] = """
SELECT id, tok FROM wtok WHERE side = 0
UNION SELECT w.id, replace(lower(synonym), '_', ' ') FROM wtok w JOIN synonyms s ON s.word = w.tok WHERE side = 0"""
S.FRAGMENTS["ss"] = f"""
SELECT p.id, {S.prf('coalesce(h, 0)', 'coalesce(s, 0)', 'coalesce(t, 0)', 'ROUGE-SS')} FROM p
LEFT JOIN (SELECT id, count(*) AS h FROM (SELECT DISTINCT id, tok FROM wtok WHERE side = 1) JOIN listed USING (id, tok) GROUP BY id) USING (id)
LEFT JOIN (SELECT id, count(*) FILTER (side = 1) AS s, count(*) FILTER (side = 0) AS t FROM wtok GROUP BY id) USING (id)"""
query("q57_rouge_ss", f"SELECT {cols('id', rounded=triple('ROUGE-SS'))} FROM ss", DOC)(
    lambda s, d: overlap.rouge_ss(corpus.pairs_doc(s, d), corpus.synonyms(s)))
with_vectors("q58_bert_score", DOC, f"SELECT {cols('id', rounded=('BERT Precision', 'BERT Recall', 'BERT F1'))} FROM bert",
             similarity.bert_score)
_ALL_PARTS["ss"] = triple("ROUGE-SS")
query("q59_base_scores", _joined(["bert", "rouge1", "rouge2", "rougel", "ss"]), CONV)(
    lambda s, d: scoring.base_scores(corpus.pairs_conv(s, d), *corpus.token_vectors(s, d), synonyms=corpus.synonyms(s)))

# --- model ratings


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_USER = [_sql_text(x) for x in ratings.USER_MESSAGE]
on_pairs("q60_rating_requests", CONV, f"SELECT id, {_sql_text(ratings.SYSTEM_MESSAGE)} AS system, "
         f"{_USER[0]} || text || {_USER[1]} || summary || {_USER[2]} AS user FROM p", ratings.rating_requests)
on_pairs("q60_rating_messages", DOC, None, lambda p: ratings.rating_messages(ratings.rating_requests(p)))
on_pairs("q61_parse_ratings", DOC, f"SELECT id, {', '.join(ratings.RATING_KEYS)}, reason FROM parsed",
         lambda p: ratings.parse_ratings(corpus.responses(p)))
on_pairs("q62_attach_ratings", DOC, f"SELECT id, p.text, p.summary, {', '.join(ratings.RATING_KEYS)}, reason = 'valid' AS rating_valid "
         "FROM p JOIN parsed USING (id)", lambda p: ratings.attach_ratings(p, corpus.responses(p)))
on_pairs("q63_rating_reject_report", DOC, "SELECT reason, count(*) AS n FROM parsed GROUP BY reason",
         lambda p: ratings.rating_reject_report(corpus.responses(p)))

# --- column statistics

MEASURES = ["quantity", "price", "rebate", "remainder", "tax_if_closed"]
S.FRAGMENTS["evalue"] = "SELECT event_id AS id, value FROM events"


def _stack(template: str, names=MEASURES, source="measures") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS metric, " + template.format(c=c) + f" FROM {source}" for c in names)


query("q64_skew", _stack("count({c}) AS n, round(skewness({c}), 6) AS skew"))(lambda s, d: stats.skew(corpus.measures(s, d)))
_CLIP = "least(greatest({c}, (SELECT quantile_cont({c}, 0.01) FROM {t})), (SELECT quantile_cont({c}, 0.99) FROM {t}))"
query("q65_quantile_clip", "SELECT id, " + r6(_CLIP.format(c="value", t="evalue"), "value") + " FROM evalue")(
    lambda s, d: stats.quantile_clip(corpus.event_values(s, d)))


def _yj(x: str, lam: str) -> str:
    return (f"CASE WHEN {x} >= 0 THEN CASE WHEN {lam} = 0 THEN ln(1 + {x}) ELSE (pow({x} + 1, {lam}) - 1) / {lam} END "
            f"WHEN {lam} = 2 THEN -ln(1 - {x}) ELSE -(pow(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) END")


for _c in MEASURES:
    S.FRAGMENTS[f"bound_{_c}"] = f"SELECT quantile_cont({_c}, 0.01) AS lo, quantile_cont({_c}, 0.99) AS hi FROM measures"
    S.FRAGMENTS[f"clip_{_c}"] = f"SELECT id, least(greatest({_c}, lo), hi) AS x, lo, hi FROM measures, bound_{_c}"
S.FRAGMENTS["bound_value"] = "SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM evalue"
S.FRAGMENTS["clip_value"] = "SELECT id, least(greatest(value, lo), hi) AS x, lo, hi FROM evalue, bound_value"


EXPONENT_PASSES = [(4000, 400), (400, 40), (40, 4)]  # half width and step of each row of tries, in thousandths


def _lambda_fragments(name: str, x: str, source: str) -> str:
    """Three passes over a grid of exponents; returns the fragment that holds the best one."""
    centre = "0"
    for i, (half, step) in enumerate(EXPONENT_PASSES, 1):
        S.FRAGMENTS[f"try{i}_{name}"] = f"""
SELECT m, -count(*) / 2.0::DOUBLE * ln(nullif(var_pop({_yj('x', '(m / 1000.0::DOUBLE)')}), 0))
  + (m / 1000.0::DOUBLE - 1) * sum(CASE WHEN x >= 0 THEN ln(1 + x) ELSE -ln(1 - x) END) AS fit
FROM (SELECT {x} AS x, {centre} + g AS m FROM {source}, (SELECT unnest(generate_series({-half}, {half}, {step})) AS g)) WHERE x IS NOT NULL GROUP BY m"""
        S.FRAGMENTS[f"top{i}_{name}"] = f"SELECT m FROM try{i}_{name} ORDER BY fit DESC NULLS LAST, m LIMIT 1"
        centre = f"(SELECT m FROM top{i}_{name})"
    return f"top{len(EXPONENT_PASSES)}_{name}"


_top_raw = _lambda_fragments("raw", "remainder", "measures")
_top_clip = _lambda_fragments("clipped", "x", "clip_remainder")


def _scaled(x: str, lo: str, hi: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN coalesce((({x}) - ({lo})) / nullif(({hi}) - ({lo}), 0), 0) END"


def _log_scaled(c: str) -> str:
    return _scaled("ln(1 + x)", "ln(1 + lo)", "ln(1 + hi)")


_LAM = f"((SELECT m FROM {_top_clip}) / 1000.0::DOUBLE)"
_POWER = _scaled(_yj("x", _LAM), _yj("lo", _LAM), _yj("hi", _LAM))
query("q66_log1p_scale", f"SELECT id, {r6(_log_scaled('value'), 'value')} FROM clip_value")(
    lambda s, d: stats.log1p_scale(corpus.event_values(s, d), ["value"]))
query("q67_yeo_johnson", f"SELECT id, {r6(_yj('remainder', '0.5::DOUBLE'), 'half')}, {r6(_yj('remainder', '0.0::DOUBLE'), 'zero')}, "
      f"{r6(_yj('debt', '2.0::DOUBLE'), 'two')} FROM (SELECT id, remainder, -abs(remainder) AS debt FROM measures)")(
    lambda s, d: corpus.measures(s, d).withColumn("debt", -F.abs("remainder")).select("id", *[
        transforms.yeo_johnson(F.col(c), F.lit(lam)).alias(n)
        for c, n, lam in (("remainder", "half", 0.5), ("remainder", "zero", 0.0), ("debt", "two", 2.0))]))
query("q68_yeo_johnson_lambda", f'SELECT \'remainder\' AS metric, m / 1000.0::DOUBLE AS "lambda" FROM {_top_raw}')(
    lambda s, d: stats.yeo_johnson_lambda(corpus.measures(s, d), ["remainder"]))
query("q69_power_scale", f"SELECT id, {r6(_POWER, 'remainder')} FROM clip_remainder")(
    lambda s, d: stats.power_scale(corpus.measures(s, d), ["remainder"]).select("id", "remainder"))
query("q70_minmax_scale", "SELECT id, " + ", ".join(r6(_scaled(c, f"(SELECT min({c}) FROM measures)", f"(SELECT max({c}) FROM measures)"), c)
                                                     for c in MEASURES) + " FROM measures")(
    lambda s, d: stats.minmax_scale(corpus.measures(s, d)))

def _normalized(c: str) -> str:
    x = f"least(greatest({c}, b_{c}.lo), b_{c}.hi)"
    lo, hi = f"b_{c}.lo", f"b_{c}.hi"
    log = _scaled(f"ln(1 + {x})", f"ln(1 + {lo})", f"ln(1 + {hi})")
    power = _scaled(_yj(x, _LAM), _yj(lo, _LAM), _yj(hi, _LAM))
    skewness = f"(SELECT skewness({c}) FROM measures)"
    return (f"round(CASE WHEN {c} IS NULL THEN NULL WHEN {skewness} > 0.5 THEN {log} WHEN {skewness} < -0.5 THEN {power} "
            f"ELSE {_scaled(x, lo, hi)} END, 6) + 0.0 AS {c}")


query("q71_normalize", f"SELECT id, {', '.join(_normalized(c) for c in MEASURES)} FROM measures, "
      + ", ".join(f"bound_{c} AS b_{c}" for c in MEASURES))(lambda s, d: stats.normalize(corpus.measures(s, d)))
S.FRAGMENTS["longm"] = _stack("{c}::DOUBLE AS x")
S.FRAGMENTS["ends"] = "SELECT metric, min(x) AS lo, max(x) AS hi FROM longm WHERE x IS NOT NULL GROUP BY metric"
S.FRAGMENTS["hcount"] = """
SELECT metric, least(floor((x - lo) / (hi - lo) * 30), 29)::INTEGER AS bin, count(*) AS n FROM longm JOIN ends USING (metric)
WHERE x IS NOT NULL GROUP BY ALL"""
query("q72_histogram", "SELECT e.metric, e.bin::INTEGER AS bin, " + r6("lo + e.bin * ((hi - lo) / 30)", "low") + ", "
      + r6("lo + (e.bin + 1) * ((hi - lo) / 30)", "high") + ", coalesce(n, 0) AS n FROM (SELECT *, unnest(range(30)) AS bin FROM ends) e "
      "LEFT JOIN hcount h ON h.metric = e.metric AND h.bin = e.bin")(lambda s, d: stats.histogram(corpus.measures(s, d), MEASURES))


def _corr_sql(names: list[str], source: str) -> str:
    rows = []
    for a in names:
        for b in names:
            x, y = f'"{a}"', f'"{b}"'
            moves = (f"min({x}) FILTER ({y} IS NOT NULL) < max({x}) FILTER ({y} IS NOT NULL) AND "
                     f"min({y}) FILTER ({x} IS NOT NULL) < max({y}) FILTER ({x} IS NOT NULL)")
            rows.append(f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, round(CASE WHEN {moves} THEN corr({x}, {y}) END, 6) + 0.0 AS r, "
                        f"count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) AS n FROM {source}")
    return " UNION ALL ".join(rows)


query("q73_correlation_matrix", _corr_sql(MEASURES, "measures"))(lambda s, d: stats.correlation_matrix(corpus.measures(s, d)))

# --- weighting

_TABLE_PARTS = ["embed", "flesch", "grammar", "perplexity", "sdc", "shannon", "supert", "bert", "rouge1", "rouge2"]
S.FRAGMENTS["raw"] = (
    f"SELECT p.id, {', '.join(composite.METRICS)}, \"BERT F1\", \"ROUGE-1 F1\", \"ROUGE-2 F1\", {_RENAMED}, overall_score_human FROM p "
    + " ".join(f"LEFT JOIN {part} USING (id)" for part in _TABLE_PARTS) + " LEFT JOIN parsed USING (id) LEFT JOIN human USING (id)")


def _normalized_table(name: str, source: str) -> str:
    """Fragments that normalise the metrics of `source`, as `name`; the exponent is looked for in every column."""
    out, bounds = [], []
    for c in composite.METRICS:
        b = f"nb_{name}_{c}"
        S.FRAGMENTS[b] = f"SELECT quantile_cont({c}, 0.01) AS lo, quantile_cont({c}, 0.99) AS hi, skewness({c}) AS skew FROM {source}"
        S.FRAGMENTS[f"nc_{name}_{c}"] = f"SELECT least(greatest({c}, lo), hi) AS x FROM {source}, {b}"
        top = _lambda_fragments(f"{name}_{c}", "x", f"nc_{name}_{c}")
        lam, x = f"((SELECT m FROM {top}) / 1000.0::DOUBLE)", f"least(greatest({c}, {b}.lo), {b}.hi)"
        log = _scaled(f"ln(1 + {x})", f"ln(1 + {b}.lo)", f"ln(1 + {b}.hi)")
        power = _scaled(_yj(x, lam), _yj(f"{b}.lo", lam), _yj(f"{b}.hi", lam))
        plain = _scaled(x, f"{b}.lo", f"{b}.hi")
        out.append(f"CASE WHEN {c} IS NULL THEN NULL WHEN {b}.skew > 0.5 THEN {log} WHEN {b}.skew < -0.5 THEN {power} ELSE {plain} END AS {c}")
        bounds.append(b)
    S.FRAGMENTS[name] = f"SELECT * REPLACE ({', '.join(out)}) FROM {source}, " + ", ".join(
        f"(SELECT lo AS {b}_lo, hi AS {b}_hi, skew AS {b}_skew FROM {b})" for b in bounds)
    for b in bounds:
        S.FRAGMENTS[name] = S.FRAGMENTS[name].replace(f"{b}.", f"{b}_")
    S.FRAGMENTS[name] = S.FRAGMENTS[name].replace("SELECT * REPLACE", "SELECT " + f"{source}.* REPLACE")
    return name


_normalized_table("scores", "raw")
S.FRAGMENTS["even"], S.FRAGMENTS["odd"] = "SELECT * FROM raw WHERE id % 2 = 0", "SELECT * FROM raw WHERE id % 2 = 1"
_normalized_table("even_scores", "even")
_normalized_table("odd_scores", "odd")
S.FRAGMENTS["rated"] = "SELECT * FROM even_scores UNION ALL SELECT * FROM odd_scores"
S.FRAGMENTS["train"] = f"SELECT * FROM rated WHERE NOT ({IS_TEST})"
S.FRAGMENTS["test"] = f"SELECT * FROM rated WHERE {IS_TEST}"
# the study's own tables: scores, normalised, their histograms and correlations
query("q71_normalize_scores", f"SELECT id, {', '.join(r6(c, c) for c in composite.METRICS)} FROM scores", DOC)(
    lambda s, d: tables.score_table(s, d).select("id", *composite.METRICS))
S.FRAGMENTS["longs"] = " UNION ALL ".join(f"SELECT '{c}' AS metric, round({c}, 6) AS x FROM scores" for c in composite.METRICS)
S.FRAGMENTS["ends_s"] = ("SELECT metric, CASE WHEN a < b THEN a ELSE a - 0.5 END AS lo, CASE WHEN a < b THEN b ELSE b + 0.5 END AS hi "
                         "FROM (SELECT metric, min(x) AS a, max(x) AS b FROM longs WHERE x IS NOT NULL GROUP BY metric)")
S.FRAGMENTS["hcount_s"] = """
SELECT metric, least(floor((x - lo) / (hi - lo) * 16), 15)::INTEGER AS bin, count(*) AS n FROM longs JOIN ends_s USING (metric)
WHERE x IS NOT NULL GROUP BY ALL"""
query("q72_histogram_scores", "SELECT e.metric, e.bin::INTEGER AS bin, coalesce(n, 0) AS n FROM (SELECT *, unnest(range(16)) AS bin FROM ends_s) e "
      "LEFT JOIN hcount_s h ON h.metric = e.metric AND h.bin = e.bin", DOC)(
    lambda s, d: stats.histogram(_round6(tables.score_table(s, d)), composite.METRICS, bins=16).select("metric", "bin", "n"))
query("q73_correlation_scores", _corr_sql(composite.METRICS, "scores"), DOC)(
    lambda s, d: stats.correlation_matrix(tables.score_table(s, d), composite.METRICS))

_NAMES = composite.METRICS + [composite.HUMAN]
for _half in ("train", "test"):
    S.FRAGMENTS[f"whole_{_half}"] = f"SELECT * FROM {_half} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _NAMES)
    S.FRAGMENTS[f"mom_{_half}"] = "SELECT " + ", ".join(
        f"covar_pop({_NAMES[i]}, {_NAMES[j]}) AS v{i}_{j}" for i in range(8) for j in range(i, 8)) + f" FROM whole_{_half}"


def _r_sql(w: list[str], mom: str) -> str:
    shared = " + ".join(f"({w[i]}) * {mom}.v{i}_7" for i in range(7))
    spread = " + ".join(f"({w[i]}) * ({w[j]}) * {mom}.v{min(i, j)}_{max(i, j)}" for i in range(7) for j in range(7))
    return f"CASE WHEN ({spread}) * {mom}.v7_7 > 0 THEN ({shared}) / sqrt(({spread}) * {mom}.v7_7) END"


def _names_sql(mask: str) -> str:
    parts = ", ".join(f"CASE WHEN {mask} & {1 << i} <> 0 THEN '{c}' END" for i, c in enumerate(composite.METRICS))
    return f"concat_ws('+', {parts})"


_SCORE = " + ".join(f"({w}::DOUBLE) * {c}" for w, c in zip(LIGHT_WEIGHTS, composite.METRICS))
query("q74_composite_score", f"SELECT id, {r6(_SCORE, 'score')} FROM scores", DOC)(
    lambda s, d: composite.composite_score(tables.score_table(s, d), composite.METRICS, LIGHT_WEIGHTS))
query("q75_pearson_to_human", f"""SELECT count(*) FILTER (score IS NOT NULL) AS n, round(corr(score, h), 6) AS r
FROM (SELECT {_SCORE} AS score, overall_score_human AS h FROM scores) WHERE h IS NOT NULL""", DOC)(
    lambda s, d: composite.pearson_to_human(
        tables.score_table(s, d), corpus.human_scores(s, d).withColumnRenamed("overall_score_human", "human_score"),
        composite.METRICS, LIGHT_WEIGHTS))
query("q76_metric_moments", " UNION ALL ".join(
    f"SELECT '{_NAMES[i]}' AS metric_a, '{_NAMES[j]}' AS metric_b, count(*) AS n, {r6(f'avg({_NAMES[i]})', 'mean_a')}, "
    f"{r6(f'avg({_NAMES[j]})', 'mean_b')}, {r6(f'covar_pop({_NAMES[i]}, {_NAMES[j]})', 'cov')} FROM whole_train"
    for i in range(8) for j in range(i, 8)), DOC)(lambda s, d: composite.metric_moments(tables.split_scores(s, d)[0]))


def _moments(spark, sf_dir):
    train, test = tables.split_scores(spark, sf_dir)
    return composite.Moments(train), composite.Moments(test)


_UNIFORM = _r_sql([f"(mask & {1 << i} <> 0)::INT::DOUBLE / bit_count(mask)" for i in range(7)], "mom_train")
_GROUP_MASKS = [sum(1 << composite.METRICS.index(c) for c in (a, b, c_, d)) for a in composite.GROUPS[0] for b in composite.GROUPS[1]
                for c_ in composite.GROUPS[2] for d in composite.GROUPS[3]]
for _name, _masks, _sets in (
        ("q77_group_product", f"SELECT unnest({_GROUP_MASKS})::BIGINT AS mask", composite.group_product),
        ("q78_metric_subsets", "SELECT unnest(range(1, 128)) AS mask", composite.metric_subsets)):
    query(_name, f"SELECT mask, {_names_sql('mask')} AS metrics, {r6(f'coalesce({_UNIFORM}, 0)', 'r')} FROM sets, mom_train", DOC, sets=_masks)(
        lambda s, d, sets=_sets: composite.uniform_weights(sets(s), composite.Moments(tables.split_scores(s, d)[0])).drop("fallback"))
query("q82_uniform_fallback", f"SELECT mask, {r6(f'coalesce({_UNIFORM}, 0)', 'r')}, ({_UNIFORM}) IS NULL AS fallback FROM sets, mom_train", DOC,
      sets="SELECT unnest(range(1, 128)) AS mask")(
    lambda s, d: composite.uniform_weights(composite.metric_subsets(s), composite.Moments(tables.split_scores(s, d)[0])).drop("metrics"))


def _sweep_fragments(steps: int, signed: bool) -> dict[str, str]:
    low = -steps if signed else 0
    out = {"lat0": f"SELECT [unnest(range({low}, {steps + 1}))] AS u"}
    for i in range(1, 6):
        bound = "" if signed else f" WHERE list_sum(u) <= {steps}"
        out[f"lat{i}"] = f"SELECT u FROM (SELECT list_append(u, unnest(range({low}, {steps + 1}))) AS u FROM lat{i - 1}){bound}"
    cap = f"abs(w) <= {steps}" + ("" if signed else " AND w >= 0")
    mask = " + ".join(f"(u[{i + 1}] <> 0)::INT * {1 << i}" for i in range(7))
    out["lat"] = (f"SELECT u, ({mask})::BIGINT AS mask FROM (SELECT list_append(u, w) AS u FROM "
                  f"(SELECT u, {steps} - list_sum(u)::BIGINT AS w FROM lat5) WHERE {cap})")
    r = _r_sql([f"u[{i + 1}] / {steps}.0::DOUBLE" for i in range(7)], "mom_train")
    out["tried"] = f"SELECT u, mask, round({r}, {composite.TIE_DIGITS}) AS r FROM lat, mom_train WHERE ({r}) IS NOT NULL"
    out["own"] = "SELECT mask, r, u FROM tried QUALIFY row_number() OVER (PARTITION BY mask ORDER BY r DESC, u DESC) = 1"
    out["swept"] = ("SELECT w.m AS mask, coalesce(r, 0) AS r, u, r IS NULL AS fallback FROM (SELECT unnest(range(1, 128)) AS m) w "
                    "LEFT JOIN own ON w.m & own.mask = own.mask QUALIFY row_number() OVER (PARTITION BY w.m ORDER BY r DESC NULLS LAST, u DESC) = 1")
    return out


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("units", F.coalesce(F.concat_ws(",", "units"), F.lit(""))).drop("steps", "weights")


def _sweep(positive: bool):
    return lambda spark, sf_dir: _shown(composite.weight_sweep(composite.Moments(tables.split_scores(spark, sf_dir)[0]), spark, positive))


_SHOWN = "coalesce(array_to_string(u, ','), '') AS units, fallback"
for _name, _steps, _signed in (("q79_weight_sweep", 10, False), ("q79_weight_sweep_signed", 4, True)):
    query(_name, f"SELECT mask, {_names_sql('mask')} AS metrics, {_SHOWN}, {r6('r', 'r')} FROM swept",
          DOC, **_sweep_fragments(_steps, _signed))(_sweep(not _signed))


# --- closed-form weights in SQL: elimination on the covariances, a pivot at a time, for every set and every face at once

S.FRAGMENTS["gram"] = "SELECT [" + ", ".join(
    "[" + ", ".join(f"v{min(i, j)}_{max(i, j)}" for j in range(7)) + "]" for i in range(7)) + "]::DOUBLE[][] AS cov, [" + ", ".join(
    f"v{i}_7" for i in range(7)) + "]::DOUBLE[] AS sh, v7_7 AS own FROM mom_train"
_AXES = "[1, 2, 3, 4, 5, 6, 7]"


def _eliminated(name: str, start: str, singular: str = "NULL") -> dict[str, str]:
    """Fragments `name`0 to `name`7: rows of (m, ...), m a matrix with its right side, solved column by column.  Where a
    pivot is rounding beside its diagonal entry, its row becomes `singular`; NULL leaves no solution."""
    out = {f"{name}0": f"SELECT *, list_transform(m, lambda r, i: r[i]) AS diag, NULL::DOUBLE[] AS top FROM ({start})"}
    for p in range(1, 8):
        pivot = f"list_transform(m[{p}], lambda x: x / m[{p}][{p}])"
        rows = f"list_transform(m, lambda r, i: CASE WHEN i = {p} THEN top ELSE list_transform(r, lambda x, j: x - r[{p}] * top[j]) END)"
        out[f"{name}{p}"] = (
            f"SELECT * REPLACE (CASE WHEN len(m) < {p} THEN m WHEN top IS NOT NULL THEN {rows} END AS m) FROM (SELECT * REPLACE "
            f"(CASE WHEN len(m) >= {p} AND m[{p}][{p}] > 1e-12 * diag[{p}] THEN {pivot} WHEN len(m) >= {p} THEN {singular.format(p=p)} END AS top) FROM {name}{p - 1})")
    return out


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def _times_cov(w: str) -> str:
    return f"list_transform({_AXES}, lambda axis: {_dot('cov[axis]', w)})"


# each set of metrics: the fit scaled to absolute sum one
_FITTED = {
    "picked": f"SELECT mask, list_filter({_AXES}, lambda i: mask & (1 << (i - 1)) <> 0) AS used FROM (SELECT unnest(range(1, 128)) AS mask)",
    **_eliminated("fit", "SELECT mask, used, cov, sh, own, list_transform(used, lambda i: list_append(list_transform(used, lambda j: cov[i][j]), sh[i])) AS m "
                  "FROM picked, gram", "list_transform(m[{p}], lambda x: 0.0::DOUBLE)"),
    "fitw": f"SELECT *, list_transform({_AXES}, lambda i: coalesce(m[list_position(used, i)][len(used) + 1], 0)) AS raw FROM fit7",
    "fitted": f"""SELECT mask, cov, sh, own, CASE WHEN size > 0 THEN list_transform(raw, lambda x: x / size)
       ELSE list_transform({_AXES}, lambda i: (mask & (1 << (i - 1)) <> 0)::INT::DOUBLE / bit_count(mask)) END AS w
       FROM (SELECT *, list_sum(list_transform(raw, lambda x: abs(x))) AS size FROM fitw)""",
}
# each face of the box: a metric is absent (0), free (1), or fixed at 1 (2) or -1 (3)
_FACES = {
    "states": f"SELECT list_transform({_AXES}, lambda i: (code >> (2 * i - 2)) & 3) AS st FROM (SELECT unnest(range(1, 16384)) AS code)",
    "faces": f"""SELECT *, list_filter({_AXES}, lambda i: st[i] = 1) AS free,
       1 - len(list_filter(st, lambda x: x = 2)) + len(list_filter(st, lambda x: x = 3)) AS rest,
       list_sum(list_transform({_AXES}, lambda i: CASE WHEN st[i] <> 0 THEN 1 << (i - 1) ELSE 0 END))::BIGINT AS mask FROM states""",
    "points": f"""SELECT mask, free, list_transform({_AXES}, lambda i: CASE st[i] WHEN 2 THEN 1.0::DOUBLE WHEN 3 THEN -1.0::DOUBLE
       WHEN 1 THEN rest::DOUBLE / len(free) ELSE 0.0::DOUBLE END) AS w FROM faces WHERE abs(rest) <= len(free)""",
    "bases": f"""SELECT mask, cov, sh, list_concat([w], list_transform(range(1, len(free)), lambda j: list_transform({_AXES},
       lambda i: CASE WHEN i = free[j] THEN 1.0::DOUBLE WHEN i = free[len(free)] THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END))) AS b FROM points, gram""",
    "images": f"SELECT *, list_transform(b, lambda x: {_times_cov('x')}) AS cb FROM bases",
    **_eliminated("face", f"SELECT mask, cov, sh, b, list_transform(b, lambda x: list_append(list_transform(cb, lambda y: {_dot('x', 'y')}), "
                  f"{_dot('x', 'sh')})) AS m FROM images"),
    "solved": "SELECT mask, cov, sh, b, CASE WHEN len(b) = 1 THEN [1.0::DOUBLE] ELSE list_transform(m, lambda r: r[len(r)]) END AS y FROM face7",
    "corners": f"""SELECT mask, cov, sh, list_transform({_AXES}, lambda i: {_dot('list_transform(b, lambda x: x[i])', 'y')} / y[1]) AS w FROM solved
       WHERE y[1] > 1e-12 * list_max(list_transform(y, lambda x: abs(x)))""",
    "tops": f"""SELECT mask, w, {_dot('sh', 'w')} / sqrt(spread) AS ratio FROM
       (SELECT *, {_dot('w', _times_cov('w'))} AS spread, list_sum(list_transform({_AXES}, lambda i: abs(w[i]) * sqrt(cov[i][i]))) AS size FROM corners)
       WHERE spread > 1e-12 * size * size AND list_max(list_transform(w, lambda x: abs(x))) <= 1 + 1e-9
       QUALIFY row_number() OVER (PARTITION BY mask ORDER BY ratio DESC) = 1""",
    "bounded": f"""SELECT s.mask, own, ratio, ratio IS NULL OR own <= 0 AS fallback, list_transform({_AXES}, lambda i:
       CASE WHEN ratio IS NULL OR own <= 0 THEN (s.mask & (1 << (i - 1)) <> 0)::INT::DOUBLE / bit_count(s.mask)
            ELSE w[i] / list_sum(list_transform(w, lambda x: abs(x))) END) AS w
       FROM (SELECT unnest(range(1, 128)) AS mask) s LEFT JOIN tops USING (mask), gram""",
}
_WEIGHTS_SQL = ", ".join(r6(f"w[{i + 1}]", f"w_{c}") for i, c in enumerate(composite.METRICS))
_REACHABLE = "list_sum(w) > 0 AND list_max(list_transform(w, lambda x: abs(x))) <= list_sum(w) + 1e-12 AS reachable"
_TRAIN_R, _TEST_R = (_r_sql([f"w[{i + 1}]" for i in range(7)], f"mom_{half}") for half in ("train", "test"))


def _weight_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c != "weights"], *[F.col("weights")[i].alias(f"w_{c}") for i, c in enumerate(composite.METRICS)])


query("q80_fit_weights", f"SELECT unnest({composite.METRICS}) AS metric, {r6('unnest(w)', 'weight')}, reachable "
      f"FROM (SELECT *, {_REACHABLE} FROM fitted WHERE mask = 127)", DOC, **_FITTED)(
    lambda s, d: composite.fit_weights(tables.split_scores(s, d)[0]))


@query("q80_least_squares", f"SELECT mask, {_names_sql('mask')} AS metrics, {r6(f'coalesce({_TRAIN_R}, 0)', 'r')}, {_REACHABLE}, {r6(_TEST_R, 'test_r')}, {_WEIGHTS_SQL} "
       "FROM fitted, mom_train, mom_test", DOC, **_FITTED)
def _(spark, sf_dir):
    train, test = _moments(spark, sf_dir)
    return _weight_columns(composite.with_test_r(composite.least_squares(train, spark), test))


# q80_bounded: the best of every set, which the search below chooses from
_BOUNDED_SQL = (f"SELECT mask, {_names_sql('mask')} AS metrics, fallback, {r6('coalesce(ratio / sqrt(own), 0)', 'r')}, "
                f"{r6('t', 'test_r')}, {_WEIGHTS_SQL} FROM (SELECT *, {_TEST_R} AS t FROM bounded, mom_test)")


def _bounded(spark, sf_dir):
    train, test = _moments(spark, sf_dir)
    return composite.with_test_r(composite.bounded_weights(train, spark), test)


query("q80_bounded_weights", _BOUNDED_SQL, DOC, **_FACES)(lambda s, d: _weight_columns(_bounded(s, d)))
query("q81_select_best", f"{_BOUNDED_SQL} WHERE t > -1 ORDER BY round(t, {composite.TIE_DIGITS}) DESC, mask LIMIT 1", DOC, **_FACES)(
    lambda s, d: _weight_columns(composite.select_best(_bounded(s, d))))
_LATTICE_R = _r_sql([f"coalesce(u[{i + 1}] / 4.0::DOUBLE, (mask & {1 << i} <> 0)::INT::DOUBLE / bit_count(mask))" for i in range(7)], "mom_test")


@query("q81_select_best_lattice", f"SELECT mask, {_names_sql('mask')} AS metrics, {_SHOWN}, {r6('r', 'r')}, {r6('t', 'test_r')} "
       f"FROM (SELECT *, {_LATTICE_R} AS t FROM swept, mom_test) WHERE t > -1 ORDER BY round(t, {composite.TIE_DIGITS}) DESC, mask LIMIT 1",
       DOC, **_sweep_fragments(4, True))
def _(spark, sf_dir):
    train, test = _moments(spark, sf_dir)
    return _shown(composite.select_best(composite.with_test_r(composite.weight_sweep(train, spark, positive=False), test)))


_REPORT = [c for c in composite.REPORT if c != "ROUGE-L F1"]
S.FRAGMENTS["report"] = f"SELECT *, {_SCORE} AS composite_score, overall_score_human AS human_score FROM test"
query("q83_composite_report", _corr_sql(_REPORT, "report"), DOC)(
    lambda s, d: composite.composite_report(tables.split_scores(s, d)[1], composite.METRICS, LIGHT_WEIGHTS, _REPORT))
query("q83_composite_report_whole")(
    lambda s, d: composite.composite_report(tables.split_scores(s, d)[1], composite.METRICS, LIGHT_WEIGHTS))
