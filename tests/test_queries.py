"""A sample of the registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ["q01_read_pairs_csv", "q06_merge_labels", "q16_sentences", "q33_lint_findings", "q37_perplexity", "q40_sdc_unigram",
          "q44_shannon_score", "q46_supert_score", "q47_gazetteer_phrases", "q50_cache_upsert", "q50_cache_versions", "q53_kg_score", "q55_rouge_2", "q57_rouge_ss",
          "q61_parse_ratings", "q71_normalize", "q72_histogram"]


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, db, name):
    assert compare(spark, db, name, SF)[0].startswith("ok")


def test_every_oracle_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
