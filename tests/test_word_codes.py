"""Words laid out as numbers: the same words, sentences and scores as from the texts, and less that leaves a task."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gistmeter.functions.digests import md5_heads
from gistmeter.operators import counting, distribution, grammar, layout, perplexity, pseudo_reference, similarity, surprisal, tokens
from gistmeter.operators.cutting import Cutter
from gistmeter.plans import corpus, scoring
from gistmeter.plans.queries import QUERIES

ODD = [(1, "A. b c.\tD!  ...  e? ΣΟΣ. Σ.", "x-y. 'z' \x1c. q ."), (2, " . ", ""), (3, None, "a"), (4, "it's.No gap. İ!", None), (5, "", ""), (6, None, None),
       (1, "c d. The-'cat' 9-9'a'.", "b b a"), (None, "𝒜𝟙 café's\xa0x. y ½-½ ǅ a--b -a- '' ٣'٤.\n\nZ", "x y"), (None, "x.", "Été là. 猫。猫"), (7, "a b. c d. a c", "c a d")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "id long, text string, summary string")


@pytest.fixture(scope="module")
def vectors(spark):
    words = "a b c d . x y z the-'cat' 猫 it's".split()
    return spark.createDataFrame([(w, [float(i % 5 - 2), float(i * i % 7), 0.5]) for i, w in enumerate(words)], "key string, vec array<float>").localCheckpoint()


@pytest.fixture(scope="module")
def known(spark, vectors):
    """A vector table with a size that its plan tells."""
    path = layout.fresh_path(spark, "v")
    vectors.write.parquet(path)
    return spark.read.parquet(path)


def rounded(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_numbers_stand_for_the_words_by_sentence(odd):
    def spelt(row, side):
        words = row["words"].split(" ")
        if row[side] is None:
            return None
        codes, ends = np.frombuffer(row[side], "int32"), np.cumsum(np.frombuffer(row[f"{side}_sents"], "int32"))
        return [[words[c] for c in part] for part in np.split(codes, ends)[:-1]]

    found = sorted(((r["id"], spelt(r, "t"), spelt(r, "s")) for r in tokens.word_codes(odd).collect()), key=repr)
    assert found == sorted(map(tuple, tokens.sentence_words(odd).collect()), key=repr)


def test_cut_at_every_boundary(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab1 .'-!\t\né猫\x1c\xa0"), rng.integers(0, 30))) for _ in range(3000)]
    pairs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "id long, text string, summary string")
    want = {r["id"]: r["t"] for r in tokens.sentence_words(pairs).collect()}
    cutter = Cutter(spark)
    for ascii_only in (False, True):
        some = [i for i, t in enumerate(texts) if t.isascii() or not ascii_only]
        column = pa.array(["zz", *[texts[i] for i in some], "zz"], pa.string()).slice(1, len(some))
        words, n_words, n_sentence, n_sentences = cutter(column)
        lists = iter(np.split(np.array(words.to_pylist(), object), np.cumsum(n_sentence))[:-1])
        assert [[list(next(lists)) for _ in range(n)] for n in n_sentences] == [want[i] for i in some]
        assert n_words.tolist() == [sum(map(len, want[i])) for i in some]


def test_scores_of_numbers_are_those_of_texts(spark, odd, known):
    def several(key):
        held = similarity.held_lookup(known)
        coded = similarity.coded_rows(odd, key, held).localCheckpoint()
        keyed = similarity.Keyed(coded, held)
        return [similarity.embedding_similarity(odd, known, key, keyed), similarity.bert_score(odd, known, key, keyed=keyed),
                pseudo_reference.supert_score(odd, known, key, keyed=keyed), pseudo_reference.supert_score(odd, known, key, 1, keyed),
                grammar.grammar_score(odd, worded=coded), perplexity.perplexity(odd, worded=coded), distribution.sdc_unigram(odd, coded),
                surprisal.shannon_score(odd, 2, coded), surprisal.shannon_score(odd, 3, coded), grammar._lexicon_of_words(coded)]

    want = [similarity.embedding_similarity(odd, known), similarity.bert_score(odd, known), pseudo_reference.supert_score(odd, known),
            pseudo_reference.supert_score(odd, known, long=1), grammar.grammar_score(odd), perplexity.perplexity(odd), distribution.sdc_unigram(odd),
            surprisal.shannon_score(odd, 2), surprisal.shannon_score(odd, 3), grammar.lexicon(odd)]
    want = [rounded(df) for df in want]
    for key in (similarity.own_key, lambda token: F.concat(token, F.lit(""))):
        assert [rounded(df) for df in several(key)] == want


def test_keys_of_words_are_hashed_in_tasks(spark):
    key = corpus.hash_key(97)
    toks = spark.createDataFrame([("a",), ("bé",), ("",), (None,)], "tok string")
    assert key.of_strings(pa.array(["a", "bé", "", None])).to_pylist() == [r[0] for r in toks.select(key(F.col("tok"))).collect()]


def test_digests_of_many_strings():
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(list("ab9é猫")) for _ in range(n)) for n in [*range(70), 119, 120, 300]] + [None]
    want = [int.from_bytes(hashlib.md5((t or "").encode()).digest()[:4]) for t in texts]
    column = pa.array(texts)
    assert md5_heads(column).tolist() == want and md5_heads(column.slice(3, 9)).tolist() == want[3:12] and len(md5_heads(column.slice(0, 0))) == 0


def test_small_pieces_give_the_same(spark, odd, monkeypatch):
    made = [surprisal.kn_counts, perplexity.ngram_model]
    want = [rounded(f(odd, 2)) for f in made]
    monkeypatch.setattr(counting.mapped, "__defaults__", (2,))
    assert [rounded(f(odd, 2)) for f in made] == want


def test_embedding_similarity_moves_no_vectors(spark, odd, known):
    held = similarity.held_lookup(known)
    with layout.Bucketed(odd, buckets=3) as texts, layout.Bucketed(similarity.coded_rows(texts, similarity.own_key, held), buckets=3, placed=True) as coded:
        made = similarity.embedding_similarity(texts, known, keyed=similarity.Keyed(coded, held))
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString() and made.count() > 0


def test_documents_are_laid_out_by_their_size(spark, tmp_path, monkeypatch):
    spark.range(60).selectExpr("id as doc_id", "'en' as lang", "concat('One ', id, '. Two.') as text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.sql("select 0L as vec_id, array(1f, 2f) as embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(layout, "PART", 100)
    asked = []
    monkeypatch.setattr(scoring, "scores_of", lambda pairs, vectors, key, buckets=None: asked.append(buckets) or pairs.select("id"))
    assert QUERIES["q15_score_all_documents"](spark, str(tmp_path)).count() == 60
    assert asked == [layout.parts_of(corpus.table(spark, str(tmp_path), "documents"))] and asked[0] > 8


def test_alike_ngrams_leave_a_task_as_one_row(spark):
    pairs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(500)), "w1 w2")], "id long, text string, summary string")
    assert surprisal.kn_counts(pairs, 2, words=True).count() > 500
    assert surprisal.kn_counts(pairs, 2, words=False).count() < 10


def test_numbers_of_keys_and_sums_of_rows():
    rng = np.random.default_rng(3)
    for top in (3, 10 ** 6, 1 << 50):
        for n in (0, 1, 7, 5000):
            a, b = rng.integers(0, top, n), rng.integers(-3, 3, n)
            assert counting.ranked(a, b).tolist() == np.unique(np.stack([a, b], 1), axis=0, return_inverse=True)[1].ravel().tolist()
    for big in (5, 1 << 40):
        table, size = rng.integers(-big, big, (50, 4)), np.concatenate([rng.integers(1, 30, 40), [9000]])
        at, starts = rng.integers(0, 50, size.sum()), np.cumsum(size) - size
        found = counting.gathered_sums(counting.narrow(table, int(size.max())), at, starts)
        assert (found == np.add.reduceat(table[at], starts, axis=0)).all() and found.dtype == np.int64
