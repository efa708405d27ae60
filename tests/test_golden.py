"""Hand cases computed apart from this code, and rows at the edges."""

import pytest

from gistmeter.operators import distribution, overlap, perplexity, readability, surprisal
from gistmeter.plans import scoring

GOLDEN = {
    "perplexity": [8.423206, 5.313293, 6.581416, 5.313293, 6.316360],
    "sdc_shift": [0.286325, 0.472222, 0.205882, 0.467532, 0.504202],
    "sdc_correlation": [0.981876, 0.861640, 0.990405, 0.933948, 0.963954],
    "sdc_unigram": [0.283730, 0.439554, 0.204895, 0.452092, 0.495114],
    "i_d": [12.791103, 5.499353, 5.785505, 6.722636, 10.498354],
    "i_ds": [33.621190, 21.487492, 30.340131, 6.646688, 10.458555],
    "i_dd": [9.403551, 9.131840, 10.038773, 0, 9.175346],
    "shannon_score": [0, 0, 0, 0.011297, 0.030082],
    "n_words": [6, 3, 4, 3, 3],
    "n_syllables": [6, 3, 4, 4, 4],
    "flesch_score": [121.22, 121.22, 121.22, 93.27375, 93.27375],
    "ROUGE-1 F1": [.571429, .222222, .307692, .181818, .153846],
    "ROUGE-1 Recall": [.4, .166667, .222222, .125, .1],
    "ROUGE-2 Precision": [.8, 0, .333333, 0, 0],
    "ROUGE-2 F1": [.421053, 0, .181818, 0, 0],
    "ROUGE-L F1": [.571429, .222222, .307692, .181818, .153846],
    "ROUGE-L Precision": [1, .333333, .5, .333333, .333333],
}
FUNCTIONS = [perplexity.perplexity, distribution.sdc_unigram, lambda p: surprisal.shannon_score(p, 2), readability.flesch_score,
             lambda p: overlap.rouge_n(p, 1, stem=False), lambda p: overlap.rouge_n(p, 2, stem=False),
             lambda p: overlap.rouge_l(p, stem=False)]


@pytest.mark.parametrize("function", FUNCTIONS)
def test_golden(pairs, function):
    rows = function(pairs).orderBy("id").collect()
    for column in set(GOLDEN) & set(rows[0].asDict()):
        assert [r[column] for r in rows] == pytest.approx(GOLDEN[column], abs=1e-6), column


def test_edges_keep_every_pair(edges, vectors):
    scored = {r["id"]: r for r in scoring.score_all(edges.repartition("id"), vectors).collect()}
    assert set(scored) == {"H1", "H2", "H3", "H4", "H5", "E1", "E2", "E3", "E4", "E5"}
    assert scored["E2"]["perplexity"] is None and scored["E2"]["sdc_unigram"] is None
    assert scored["E1"]["shannon_score"] == 0 and scored["E1"]["flesch_score"] == 0
    assert scored["E1"]["ROUGE-1 F1"] == scored["E4"]["ROUGE-L F1"] == 0
    assert scored["E5"]["flesch_score"] == 0


def test_text_against_itself(pairs, vectors):
    same = pairs.selectExpr("id", "text", "text summary")
    for r in overlap.rouge_n(same, 1).collect() + overlap.rouge_l(same).collect():
        assert {v for k, v in r.asDict().items() if k.startswith("ROUGE")} == {1.0}
    for r in scoring.base_scores(same, vectors).collect():
        assert r["BERT F1"] == pytest.approx(1) and r["ROUGE-2 F1"] == 1


@pytest.mark.parametrize("parts", [1, 16])
def test_layout_does_not_matter(pairs, parts):
    rows = perplexity.perplexity(pairs.repartition(parts)).orderBy("id").collect()
    assert [r["perplexity"] for r in rows] == pytest.approx(GOLDEN["perplexity"], abs=1e-6)
