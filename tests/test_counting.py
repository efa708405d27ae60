"""Counting inside tasks: no token becomes a row, and the plans that remain for large tables give the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistmeter.functions import porter
from gistmeter.operators import distribution, gazetteer, grammar, layout, overlap, perplexity, pseudo_reference, similarity, surprisal, tokens
from gistmeter.plans import corpus, incremental

TEXTS = [(1, "The cat ran. The cat sat, running on.", "The cat. A dog ran."), (2, "", "a b"), (3, None, None), (None, "One cat. Two cats.", "cat"),
         (1, "The dog. The dog ran.", "cat cat")]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(TEXTS, "id long, text string, summary string")


@pytest.mark.parametrize("make", [perplexity.ngram_model, perplexity.perplexity, surprisal.kn_counts, surprisal.shannon_score, distribution.sdc_unigram,
                                  distribution.token_probs, tokens.everygrams])
def test_tokens_do_not_become_rows(odd, make):
    assert "Generate" not in plan(make(odd))


def test_rows_of_an_id_are_counted_together(odd):
    n = {(r["id"], r["tok"]): (r["c_text"], r["c_summary"], r["n_text"]) for r in tokens.token_counts(odd).collect()}
    assert n[1, "the"] == (4, 1, 18) and n[None, "cat"] == (1, 1, 6) and n[3, None] == (0, 0, 0) and n[2, None] == (0, 0, 0) and len({k[0] for k in n}) == 4


def test_stems_of_lists(spark):
    toks = "running flies dying agreed hopping nationally sky happy generalization skies tie probate controlling a 1ss eed ied ing".split()
    row = spark.createDataFrame([(toks,), ([],), (None,)], "t array<string>").select(porter.stems(F.col("t")).alias("a"), porter.stems_in_row(F.col("t")).alias("b"))
    assert all(r["a"] == r["b"] for r in row.collect())


def test_small_and_large_vector_tables(spark, odd, tmp_path, monkeypatch):
    rows = [(t, [float(i % 5 - 2), float(i * i % 7), 1.0]) for i, t in enumerate("the cat ran . sat , running on a dog one two cats".split())]
    spark.createDataFrame(rows, "key string, vec array<float>").write.parquet(f"{tmp_path}/v")
    vectors, known = spark.read.parquet(f"{tmp_path}/v"), odd.filter("id is not null")

    def results():
        return [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f(known, vectors).collect())
                for f in (similarity.bert_score, similarity.embedding_similarity, pseudo_reference.supert_score)]

    small = results()
    assert similarity.small_lookup(vectors) is not None and "best_matches" not in plan(similarity.bert_score(known, vectors))
    monkeypatch.setattr(similarity, "SMALL", 0)
    assert similarity.small_lookup(vectors) is None and results() == small


def test_held_and_joined_name_lists(spark, odd):
    names = spark.createDataFrame([("The cat",), ("the",), ("cat",), ("cat ran",), ("dog",), ("the dog ran",)], "entity string")
    held, joined = ({tuple(r) for r in gazetteer.name_mentions(odd, names, held_bytes=b).collect()} for b in (1 << 30, -1))
    assert held == joined and (1, 0, "The cat") in held and (None, 0, "cat") in held


ODD_WORDS = [(1, "A. b c.\tD!  ...  e? ΣΟΣ. Σ.", "x-y. 'z' \x1c. q ."), (2, " . ", ""), (3, None, "a"), (4, "it's.No gap. İ!", None)]


def test_words_by_sentence_are_the_words(spark):
    pairs = spark.createDataFrame(ODD_WORDS, "id long, text string, summary string")
    whole = {r["id"]: (r["t"], r["s"]) for r in tokens.both_sides(pairs).collect()}
    assert whole == {r["id"]: (r["t"], r["s"]) for r in tokens.both_sides(pairs, worded=tokens.sentence_words(pairs)).collect()}


def test_mapped_vectors_are_read_in_tasks(spark, odd, tmp_path, monkeypatch):
    rows = [(t, [float(i % 5 - 2), float(i * i % 7), 1.0]) for i, t in enumerate("the cat ran . sat , running on a dog one two cats".split())]
    spark.createDataFrame(rows, "key string, vec array<float>").repartition(3).write.parquet(f"{tmp_path}/v")
    spark.createDataFrame([*rows, rows[0]], "key string, vec array<float>").write.parquet(f"{tmp_path}/twice")
    vectors = spark.read.parquet(f"{tmp_path}/v")
    known = odd.filter("id is not null")

    def results(**more):
        return [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f(known, vectors, **more).collect())
                for f in (similarity.bert_score, similarity.embedding_similarity, pseudo_reference.supert_score)]

    small = results()
    monkeypatch.setattr(similarity, "SMALL", 0)
    held = similarity.held_lookup(vectors)
    assert held is not None and "best_matches" not in plan(similarity.bert_score(known, vectors)) and results() == small
    keyed = similarity.Keyed(similarity.token_keys(tokens.sentence_words(known)), held)
    assert results(keyed=keyed) == small
    assert similarity.held_lookup(spark.read.parquet(f"{tmp_path}/twice")) is None
    monkeypatch.setattr(similarity, "MAPPED", 0)
    assert similarity.held_lookup(vectors) is None and "best_matches" in plan(similarity.bert_score(known, vectors)) and results() == small


def test_parts_grow_with_the_files(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id as doc_id", "'en' as lang", "concat('One ', id, '. Two.') as text").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    few = sorted(map(tuple, corpus.pairs_from_documents(docs).collect()))
    assert layout.parts_of(docs) is None and layout.parts_of(spark.createDataFrame([(1,)], "a int")) is None
    monkeypatch.setattr(layout, "PART", 100)
    parts = layout.parts_of(docs)
    assert parts > 8 and corpus.pairs_from_documents(docs).rdd.getNumPartitions() == parts
    assert sorted(map(tuple, corpus.pairs_from_documents(docs).collect())) == few


def test_missing_pairs_are_found_without_moving_texts(spark, odd, tmp_path):
    def score(pairs):
        return pairs.select("id", F.length("text").cast("double").alias("n"))

    rows = [(k, "t" * k, "s") for k in range(1, 40)] + [(1, "other", "s"), (None, "t", "s")]
    with layout.Bucketed(spark.createDataFrame(rows, "id long, text string, summary string"), buckets=4) as pairs:
        table = incremental.ScoreTable(spark, f"{tmp_path}/scores", pairs.schema["id"].dataType, ["n"], score, "1", buckets=2, parts=4)
        assert table.update(pairs.filter("id > 9 or id is null")) == 30
        missing = table.missing(pairs)
        assert sorted((r["id"], r["text"]) for r in missing.collect()) == sorted([(1, "other"), *((k, "t" * k) for k in range(1, 10))])
        moved = missing._jdf.queryExecution().executedPlan().toString()
        assert "text" not in "".join(line for line in moved.splitlines() if "Exchange hashpartitioning" in line) and table.update(pairs) == 10


def test_rouge_codes_stand_for_stems_in_their_order(spark):
    pairs = spark.createDataFrame([(1, "Cats, catS runningÅ 7up", "A cat ran"), (1, "zoo cats", None), (2, "", "éé"), (3, None, "x-y x")],
                                  "id long, text string, summary string")
    words = {(r["id"], r["side"], tuple(r["toks"] or ()), r["toks"] is None) for r in overlap.rouge_tokens_by_side(pairs).collect()}
    codes = overlap.rouge_codes_by_side(pairs).collect()
    assert sorted((r["id"], r["side"], len(r["toks"] or ()), r["toks"] is None) for r in codes) == sorted((i, s, len(t), n) for i, s, t, n in words)
    for i in (1, 2, 3):
        known = sorted({t for j, _, toks, _ in words if j == i for t in toks})
        found = sorted({c for r in codes if r["id"] == i for c in r["toks"] or ()})
        assert len(known) == len(found)
        name = dict(zip(found, known))
        assert {(r["side"], tuple(name[c] for c in r["toks"] or ())) for r in codes if r["id"] == i} == {(s, t) for j, s, t, _ in words if j == i}


def test_keys_of_many_strings_are_those_of_the_column(spark):
    key = corpus.hash_key(97)
    worded = spark.createDataFrame([(1, [["a", "bé"], []], [["a"]]), (2, None, [])], "id long, t array<array<string>>, s array<array<string>>")
    rows = [similarity.token_keys(worded, k).orderBy("id").collect() for k in (key, lambda token: key(token))]
    assert rows[0] == rows[1] and len(rows[0]) == 2


def test_lexicon_of_words_is_that_of_texts(spark):
    pairs = spark.createDataFrame([(1, "Red fox. Blue fox.", "x"), (2, "blue hen, red", None), (3, None, ""), (3, "", "fox")], "id long, text string, summary string")
    found = [{r["tok"] for r in lexicon.collect()} for lexicon in (grammar.lexicon(pairs), grammar._lexicon_of_words(tokens.sentence_words(pairs)))]
    assert found[0] == found[1] == {"red", "blue"}


def test_texts_clustered_together_have_the_clusters_of_each():
    r = np.random.default_rng(7)
    for top in (3, 2000, 1 << 28):
        size = r.integers(1, 30, 200)
        points, starts, k = r.integers(-top, top, (size.sum(), 5)), np.cumsum(size) - size, np.minimum(size, r.integers(0, 20, 200))
        text, cluster, member = pseudo_reference._clusters_of(points, starts, size, k)
        for i in range(200):
            own = points[starts[i]:starts[i] + size[i]]
            want = list(pseudo_reference._clusters(int(k[i]), own)) if k[i] else []
            assert list(zip(cluster[text == i].tolist(), (member[text == i] - starts[i]).tolist())) == want


def test_only_the_summarys_grams_leave_a_task_for_perplexity(spark):
    pairs = spark.createDataFrame([(1, "a b c d e f", "a b"), (2, "a b c", None)], "id long, text string, summary string")
    assert perplexity._counted(pairs, 3, words=False).filter("c_summary > 0").count() == 2
    assert perplexity._counted(pairs, 3, words=False).count() <= 4 < perplexity._counted(pairs, 3, words=True).count()
    assert {r["id"]: r["perplexity"] is None for r in perplexity.perplexity(pairs).collect()} == {1: False, 2: True}
