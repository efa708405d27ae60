"""Names in texts, tables kept in versions, scores kept from run to run, sums over many columns."""

import os
import random
import re
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistmeter.functions import text as X
from gistmeter.operators import entities, gazetteer, pseudo_reference, stats
from gistmeter.plans import incremental
from gistmeter.sources.tables import CACHE
from gistmeter.sources.versions import VersionedTable

WORD = r"[^\W_]+(?:['-][^\W_]+)*|[^\w\s]|_"
NAMES = ["New York", "New York Times", "York Times", "big apple", "Apple", "times square", "O'Neil", "U.S.", "the", "a b", "b c d", "c", "", "  ", "New  York"]
TEXTS = [("The New York Times wrote on New York and the Big Apple.", "BIG APPLE, apple; Apple. New york"), ("a b c d a b c b c d", "b c d c"),
         ("Times Square in the U.S. of O'Neil", "times squares"), ("", None), (None, "the"), ("New York " * 3000, "new YORK Times")]


def plain_names(text, names):
    """A reader from the left who takes the longest name at each place."""
    split = {}
    for n in names:
        toks = tuple(re.findall(WORD, n))
        if toks:
            split.setdefault(toks, set()).add(n)
    toks, found, at, longest = re.findall(WORD, text or ""), set(), 0, max(map(len, split))
    while at < len(toks):
        for n in range(min(longest, len(toks) - at), 0, -1):
            run = tuple(toks[at:at + n])
            met = {name for form in (run, tuple(t.lower() for t in run)) if form in split for name in split[form]}
            if met:
                found |= met
                at += n - 1
                break
        at += 1
    return found


def test_names_of_a_list(spark):
    rnd = random.Random(2)
    texts = TEXTS + [(" ".join(rnd.choice("a b c d the The New York Times".split()) for _ in range(rnd.randint(0, 30))), "x") for _ in range(40)]
    pairs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(texts)], "id long, text string, summary string")
    names = spark.createDataFrame([(n, 1) for n in NAMES], "entity string, id int")
    want = {(i, side, name) for i, both in enumerate(texts) for side, t in enumerate(both) for name in plain_names(t, NAMES)}
    got = entities.entity_mentions(pairs, names)
    assert got.columns == entities.entity_mentions(pairs).columns == ["id", "side", "entity"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert gazetteer.name_mentions(pairs, names.limit(0)).count() == 0


def cache_rows(table, version=None):
    return {r["entity"]: (r["qid"], r["last_updated"]) for r in table.read(version).collect()}


def test_cache_in_versions(spark, tmp_path):
    cache = entities.EntityCache(spark, str(tmp_path / "cache"), buckets=4)
    assert cache.table.latest() == 0 and cache.table.read().count() == 0
    first = {f"e{k}": (f"Q{k}" if k % 3 else None, k * entities.DAY) for k in range(40)}
    frame = lambda rows: spark.createDataFrame([(e, q, t) for e, (q, t) in rows.items()], CACHE)
    assert cache.upsert(frame(first)) == 1
    fresh = {"e1": ("Q100", 0), "e2": (None, 50 * entities.DAY)}
    before = dict(cache.table.parts())
    touched = cache.table.buckets_of(frame(fresh))
    assert cache.upsert(frame(fresh)) == 2
    assert {b for b, p in cache.table.parts() if before[b] != p} == touched
    assert cache.expire(40 * entities.DAY) == 3 and cache.expire(40 * entities.DAY) == 3
    second = {**first, "e2": fresh["e2"]}
    assert cache_rows(cache.table, 1) == first and cache_rows(cache.table, 2) == second
    assert cache_rows(cache.table) == {e: v for e, v in second.items() if v[1] >= 10 * entities.DAY}
    asked = spark.createDataFrame([("e2",), ("e1",), ("zz",)], "entity string")
    assert {tuple(r) for r in cache.lookup(asked).collect()} == {("e2", None, True), ("e1", None, False), ("zz", None, False)}
    assert {r["hit"] for r in cache.lookup(asked, 1).filter("entity = 'e1'").collect()} == {True}
    with pytest.raises(ValueError):
        cache.table.read(9)
    cache.expire(10_000 * entities.DAY)
    assert cache.table.read().count() == 0 and cache_rows(cache.table, 1) == first
    assert cache.upsert(frame({"x": (None, 1)})) == 5 and cache_rows(cache.table) == {"x": (None, 1)}


def test_a_version_is_written_by_one_writer_alone(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "entity", CACHE)
    rows = spark.createDataFrame([("a", "Q", 1)], CACHE)
    table.write(rows)
    late = VersionedTable(spark, str(tmp_path / "t"), "entity", CACHE)
    late.latest = lambda: 0
    with pytest.raises(Exception, match="already exists"):
        late.write(rows)
    assert table.latest() == 1 and table.read().count() == 1


def test_only_changed_pairs_are_scored(spark, tmp_path):
    scored = []

    def score(pairs):
        rows = pairs.select("id", F.length("text").alias("long"), F.length("summary").cast("double").alias("short")).filter("id <> 'p3'")
        scored.append(pairs.count())
        return rows

    def table(version="1"):
        return incremental.ScoreTable(spark, str(tmp_path / "scores"), CACHE["entity"].dataType, ["long", "short"], score, version, buckets=3)

    def frame(rows):
        return spark.createDataFrame(rows, "id string, text string, summary string")

    rows = [(f"p{k}", "t" * k, "s" if k % 2 else None) for k in range(60)]
    want = lambda rows: {(i, None, None) if i == "p3" else (i, float(len(t)), None if s is None else float(len(s))) for i, t, s in rows}
    assert table().update(frame(rows)) == 60 and set(map(tuple, table().scores(frame(rows)).collect())) == want(rows)
    later = [*rows[:50], ("p50", "changed", "s"), ("p51", rows[51][1], ""), ("new", "", None)]
    assert table().update(frame(later)) == 3 and table().update(frame(later)) == 0
    assert set(map(tuple, table().scores(frame(later)).collect())) == want(later)
    # the earlier rows are still there, nothing is written again for them
    assert table().update(frame(rows)) == 0 and scored == [60, 3]
    assert table("2").update(frame(later[:5])) == 5
    merged = table().table.compact(parts=1)
    assert merged == 4 and set(map(tuple, table().scores(frame(later)).collect())) == want(later)


def plain_text(rnd, n):
    return " ".join(f"{rnd.choice('abcdefgh')} {rnd.choice('abcdefgh')}." for _ in range(n))


def letter_vectors(spark, width=6):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(c, list(map(float, rng.normal(size=width)))) for c in "abcdefgh."], "key string, vec array<double>")


def test_long_texts_are_clustered_in_blocks(spark):
    rnd = random.Random(6)
    rows = [(i, plain_text(rnd, rnd.randint(0, 40)), plain_text(rnd, rnd.randint(0, 7))) for i in range(12)] + [(90, None, "a b."), (91, "a. " * 30, None), (92, "? " * 30, "? a.")]
    pairs, vectors = spark.createDataFrame(rows, "id long, text string, summary string"), letter_vectors(spark)
    for operator in (pseudo_reference.pseudo_references, pseudo_reference.supert_score):
        whole, blocks = ({tuple(r) for r in operator(pairs, vectors, long=n).collect()} for n in (8192, 5))
        assert len(whole) > 10 and {r[:-1] + (round(r[-1], 9),) for r in whole} == {r[:-1] + (round(r[-1], 9),) for r in blocks}


def test_a_text_of_two_hundred_thousand_sentences(spark):
    rnd = random.Random(7)
    pairs = spark.createDataFrame([(1, plain_text(rnd, 200_000), plain_text(rnd, 3))], "id long, text string, summary string")
    refs = {tuple(r) for r in pseudo_reference.pseudo_references(pairs, letter_vectors(spark)).collect()}
    assert refs == {tuple(r) for r in pseudo_reference.pseudo_references(pairs, letter_vectors(spark), long=1_000_000).collect()} and len(refs) == 3


def test_sums_over_many_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 40)) + 1e6 * np.arange(40)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7], x[:, 8] = 0.1, np.nan
    names = [f"m {k}" for k in range(40)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"`{n}` double" for n in names)).repartition(3)
    got = {(r["metric_a"], r["metric_b"]): (r["r"], r["n"]) for r in stats.correlation_matrix(df, names).collect()}
    assert len(got) == 1600
    for i in range(40):
        for j in range(40):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            r, n = got[names[i], names[j]]
            assert n == both.sum()
            assert r is None if {7, 8} & {i, j} else r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-6)


def test_blanks_of_all_scripts(spark):
    text = "a\u00a0b\u2009c\u3000d\x1ce\x85f\u2028g \t\u1680h\u200bi"
    got = spark.createDataFrame([(text,)], "t string").select(X.ws_tokens(F.col("t"))).first()[0]
    assert got == text.split() == ["a", "b", "c", "d", "e", "f", "g", "h\u200bi"]


def test_the_rest_works_without_the_training_data_part(tmp_path):
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(home, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".*"))
    told = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"
    for extra in (False, True):
        if extra and not os.path.exists(f"{home}/corpus_pipeline.py"):
            continue
        if extra:
            shutil.copy(f"{home}/corpus_pipeline.py", tmp_path / "copy")
        said = subprocess.run([sys.executable, "-c", told], cwd=tmp_path / "copy", capture_output=True, text=True, check=True)
        assert said.stdout.split()[1:] == ["False", "False", "True"] and int(said.stdout.split()[0]) > 90
