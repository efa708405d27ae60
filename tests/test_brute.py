"""Operators against short plain calculations on small data."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gistmeter.functions import porter
from gistmeter.operators import composite, entities, grammar, overlap, pseudo_reference, ratings, relational, similarity, stats, surprisal
from gistmeter.operators.layout import Bucketed, lookup_join
from gistmeter.plans import corpus, scoring
from gistmeter.sources import tables

WORD = re.compile(r"[^\W_]+(?:['-][^\W_]+)*|[^\s\w]")


def sents(x):
    return [s for s in re.split(r"(?<=[.!?])\s+", x) if s.strip()]


def words(x):
    return WORD.findall(x.lower())


def kn_bits(text, summary, n):
    """Recursive interpolated model, one document at a time."""
    doc = [words(s) for s in sents(text)]
    vocab = {w for s in doc for w in s}
    counts = defaultdict(Counter)
    for s in doc:
        line = ["<unk>"] * (n - 1) + s + ["<unk>"] * (n - 1)
        for k in range(1, n + 1):
            for i in range(len(line) - k + 1):
                counts[tuple(line[i:i + k - 1])][line[i + k - 1]] += 1

    def continuation(word, context):
        wider = [c for ctx, c in counts.items() if len(ctx) == len(context) + 1 and ctx[1:] == context]
        return sum(c[word] > 0 for c in wider), sum(len(c) for c in wider)

    def prob(word, context):
        if not context:
            hit, total = continuation(word, ())
            return hit / total
        here = counts.get(context)
        if not here:
            return prob(word, context[1:])
        hit, total = (here[word], sum(here.values())) if len(context) == n - 1 else continuation(word, context)
        return max(hit - 0.1, 0) / total + 0.1 * len(here) / total * prob(word, context[1:])

    def bits(targets, before):
        total = 0.0
        for s in targets:
            for i, w in enumerate(s):
                context = (["<unk>"] * (n - 1) + before + s[:i])[-(n - 1):]
                total += max(0.0, -math.log2(prob(w, tuple(c if c in vocab else "<unk>" for c in context))))
        return total

    flat = [w for s in sents(summary) for w in words(s)]
    earlier = [w for s in doc[:-1] for w in s]
    return bits(doc, []), bits(doc, flat), bits(doc[-1:], earlier) if len(doc) > 1 else 0.0


@pytest.mark.parametrize("n", [2, 3, 4])
def test_surprisal(pairs, n):
    for r in surprisal.surprisal(pairs, n).join(pairs, "id").collect():
        assert (r["i_d"], r["i_ds"], r["i_dd"]) == pytest.approx(kn_bits(r["text"], r["summary"], n)), r["id"]


def test_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _lcs_row(row, x, b)
        assert overlap._lcs(a, b) == row[-1]


def _lcs_row(row, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
    return new


def test_clusters():
    rng = np.random.default_rng(3)
    for _ in range(30):
        points = rng.integers(-3, 4, size=(rng.integers(1, 12), 2)).astype("int64")
        k = int(rng.integers(1, len(points) + 1))
        centres = {i: tuple(points[i * len(points) // k]) for i in range(k)}
        before = None
        while before != centres:
            before = centres
            label = [min(centres, key=lambda c: (sum((p - centres[c]) ** 2), c)) for p in points]
            centres = {c: tuple(points[[x == c for x in label]].sum(axis=0) // label.count(c)) for c in set(label)}
        want = {c: min((i for i, x in enumerate(label) if x == c), key=lambda i: (sum((points[i] - centres[c]) ** 2), i)) for c in centres}
        assert dict(pseudo_reference._clusters(k, points)) == want


def test_stems(spark):
    known = {"caresses": "caress", "ponies": "poni", "ties": "tie", "feed": "feed", "agreed": "agre", "plastered": "plaster",
             "motoring": "motor", "sing": "sing", "sized": "size", "hopping": "hop", "falling": "fall", "filing": "file",
             "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam",
             "operator": "oper", "hopefulness": "hope", "electriciti": "electr", "adoption": "adopt", "rate": "rate",
             "cease": "ceas", "roll": "roll", "dying": "die", "geologi": "geolog", "yes": "yes", "saying": "say"}
    rows = spark.createDataFrame([(w,) for w in known], "tok string")
    assert {r["tok"]: r["stem"] for r in porter.stem_tokens(rows).collect()} == known


def test_lookup_join_salted_equals_broadcast(spark):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 7)).alias("tok"))
    table = spark.createDataFrame([("hot", 1), ("t0", 2), ("t3", 3)], "tok string, v int")
    for how in ("left", "inner", "left_anti", "left_semi"):
        small = lookup_join(facts, table, "tok", how)
        large = lookup_join(facts, table, "tok", how, broadcast_bytes=0, salt_rows=2)
        assert small.columns == large.columns
        small_plan, large_plan = (d._jdf.queryExecution().executedPlan().toString() for d in (small, large))
        assert "BroadcastHashJoin" in small_plan and "_salt" not in small_plan and "_salt" in large_plan
        assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_next_sentence_over_ranges(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("lang"),
                                  F.concat(F.lit("First "), F.col("id"), F.lit(". Second.")).alias("text")).filter("doc_id not between 20 and 33")
    whole = docs.withColumn("n", F.lead("text").over(Window.partitionBy("lang").orderBy("doc_id")))
    want = {r["doc_id"]: r["n"] and r["n"].split(". ")[0] + "." for r in whole.collect()}
    assert sum(v is None for v in want.values()) == 2
    assert corpus.pairs_from_documents(docs, 4).count() == docs.count()
    assert {r["doc_id"]: r["next_sent"] for r in corpus.next_first_sentence(docs, 4).collect()} == want


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_quantiles(spark, accuracy):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=1500), np.where(np.arange(1500) < 15, 1.0, 2.0)
    rows = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)], "a double, b double, c double")
    got = stats.quantiles(rows, ["a", "b", "c"], (0.01, 0.5, 0.99), accuracy=accuracy)
    assert got["a"] == pytest.approx(list(np.quantile(a, [0.01, 0.5, 0.99])))
    assert got["b"] == pytest.approx(list(np.quantile(b, [0.01, 0.5, 0.99])))
    assert got["c"] == [None] * 3


def test_normalize_and_histogram(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(-x), 3.0, float("nan") if i % 4 else 1.0 * i) for i, x in enumerate(rng.exponential(size=400))]
    df = spark.createDataFrame(rows, "id long, right double, left double, flat double, holes double")
    for r in stats.normalize(df).collect():
        assert 0 <= r["right"] <= 1 and 0 <= r["left"] <= 1 and r["flat"] == 0
    counts = stats.histogram(df, ["right", "flat", "holes"], 7).groupBy("metric").agg(F.sum("n"), F.count("*")).collect()
    assert {r[0]: (r[1], r[2]) for r in counts} == {"right": (400, 7), "flat": (400, 7), "holes": (100, 7)}
    square = {r["metric_a"]: r for r in stats.correlation_square(df, ["right", "left", "flat"]).collect()}
    assert square["right"]["left"] == pytest.approx(-1) and square["flat"]["left"] is None


def test_exponent_makes_lognormal_symmetric(spark):
    x = np.expm1(np.random.default_rng(4).normal(3, 0.4, 4000))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert abs(stats.exponents(df, ["x"])["x"]) < 0.1


def test_blocks_do_not_change_matching(pairs, vectors):
    whole = similarity.bert_score(pairs, vectors).orderBy("id").collect()
    for block in (1, 3):
        for a, b in zip(whole, similarity.bert_score(pairs, vectors, block=block).orderBy("id").collect()):
            assert tuple(a)[1:] == pytest.approx(tuple(b)[1:])


def test_supert_in_range(pairs, vectors):
    same = pairs.selectExpr("id", "text", "text summary")
    for r in pseudo_reference.supert_score(same, vectors).collect():
        assert r["supert_score"] == pytest.approx(1)


def test_findings(spark):
    p = spark.createDataFrame([(1, "we saw a cat and an owl", "we saw saw an cat , and a owl..  yes"), (2, "we saw a cat and an owl", "We saw.")],
                              "id long, text string, summary string")
    found = {(r["id"], r["rule"]): r["n"] for r in grammar.lint_findings(p).collect()}
    assert found == {(1, "doubled_word"): 1, (1, "article_mismatch"): 2, (1, "lower_case_start"): 2, (1, "blank_before_punctuation"): 1,
                     (1, "double_punctuation"): 1, (1, "double_blank"): 1, (1, "unknown_word"): 1}


def test_ratings(spark):
    good = '{"information_similarity": 1, "grammatical_correctness": 0.5, "cohesion": 0, "conciseness": 0.1, "overall_score": %s}'
    rows = [("a", " " + good % "0.3" + "\n"), ("b", good % "true"), ("c", good % '"0.3"'), ("d", good % "1.01"), ("e", good % "0.3" + " x"),
            ("f", "[]"), ("g", "{}"), ("h", None), ("i", (good % "0.3")[:-1]), ("j", good % '{"x": 1}'),
            ("k", good % '0.3, "why": {"a": "}"}'), ("l", good % "0.3" + " " + good % "0.3"), ("m", good % "0.3" + "," + good % "0.3")]
    got = {r["id"]: r["reason"] for r in ratings.parse_ratings(spark.createDataFrame(rows, "id string, raw string")).collect()}
    assert got == {"a": "valid", "b": "missing key", "c": "missing key", "d": "out of range", "e": "malformed", "f": "malformed",
                   "g": "missing key", "h": "malformed", "i": "malformed", "j": "missing key",
                   "k": "valid", "l": "malformed", "m": "malformed"}


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", 'He said "no",\nthen left.', "é, ü"), ("2", "", None), ("3", None, "a\\b")]
    df = spark.createDataFrame(rows, "id string, text string, summary string")
    tables.write_scores(df, str(tmp_path / "csv"), "csv")
    assert sorted(map(tuple, tables.read_pairs_csv(spark, str(tmp_path / "csv")).collect())) == rows


def test_cache(spark):
    old = spark.createDataFrame([("a", "Q1", 10), ("b", None, 20), ("c", "Q3", 30)], (schema := "entity string, qid string, last_updated long"))
    new = spark.createDataFrame([("a", None, 10), ("c", "Q9", 5), ("d", "Q4", 40)], schema)
    merged = {r["entity"]: (r["qid"], r["last_updated"]) for r in entities.cache_upsert(old, new).collect()}
    assert merged == {"a": (None, 10), "b": (None, 20), "c": ("Q3", 30), "d": ("Q4", 40)}
    asked = spark.createDataFrame([("b",), ("z",)], "entity string")
    assert {tuple(r) for r in entities.cache_lookup(asked, old).collect()} == {("b", None, True), ("z", None, False)}
    assert [r["entity"] for r in entities.cache_misses(asked, old).collect()] == ["z"]


def test_duplicates_are_reported(spark):
    with pytest.raises(ValueError):
        relational.assert_unique_id(spark.createDataFrame([(1,), (1,), (2,)], "id long"))


def test_weighting(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 3))
    y = 0.6 * x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=500)
    df = spark.createDataFrame([(i, *map(float, r), 0.0, float(h)) for i, (r, h) in enumerate(zip(x, y))],
                               "id long, a double, b double, c double, still double, overall_score_human double")
    names = ["a", "b", "c", "still"]
    m = composite.Moments(df, names)
    fitted = {r["mask"]: r for r in composite.least_squares(m, spark).collect()}
    swept = {r["mask"]: r for r in composite.weight_sweep(m, spark).collect()}
    assert set(swept) == set(range(1, 16)) and fitted[8]["r"] == 0
    assert swept[8]["fallback"] and swept[8]["r"] == 0 and swept[8]["weights"] == [0, 0, 0, 1] and swept[8]["units"] is None
    for mask, r in swept.items():
        if mask == 8:
            continue
        assert not r["fallback"]
        assert fitted[mask]["r"] >= r["r"] - 1e-9
        w = np.array(r["units"]) / 10
        assert w.sum() == pytest.approx(1) and r["r"] == pytest.approx(np.corrcoef(x @ w[:3], y)[0, 1])
    ml = [r["weight"] for r in composite.fit_weights(df, names).collect()]
    assert ml == pytest.approx(fitted[15]["weights"], abs=1e-6)
    signed = {r["mask"]: r["r"] for r in composite.weight_sweep(m, spark, positive=False).collect()}
    assert signed[15] <= fitted[15]["r"] + 1e-9 and len(signed) == 15
    assert all(f["reachable"] == (sum(f["weights"]) > 0 and max(map(abs, f["weights"])) <= sum(f["weights"]) + 1e-9) for f in fitted.values())


def test_bounded_weights_are_the_best(spark):
    """Optima off the quarter grid, at the bound, where only negative r can be had, and of singular covariances."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4))
    names = ["a", "b", "c", "d", "still", "twin"]
    for slopes in ([0.37, 0.11, 0.05, 0.23], [0.4, -0.9, 0.1, -0.3], [-0.5, -0.2, -0.4, -0.6]):
        y = x @ slopes + rng.normal(size=400)
        df = spark.createDataFrame([(i, *map(float, r), 0.0, float(r[0]), float(h)) for i, (r, h) in enumerate(zip(x, y))],
                                   "id long, a double, b double, c double, d double, still double, twin double, overall_score_human double")
        m = composite.Moments(df, names)
        found = {r["mask"]: r for r in composite.bounded_weights(m, spark).collect()}
        fitted = {r["mask"]: r for r in composite.least_squares(m, spark).collect()}
        swept = {r["mask"]: r for r in composite.weight_sweep(m, spark, positive=False).collect()}
        assert set(found) == set(range(1, 64)) and [k for k in found if found[k]["fallback"]] == [16]
        columns = np.column_stack([x, np.zeros(400), x[:, 0]])
        for mask, f in found.items():
            w, use = np.array(f["weights"]), [i for i in range(6) if mask >> i & 1]
            assert not w[[i for i in range(6) if i not in use]].any() and np.abs(w).sum() == pytest.approx(1)
            assert w.sum() > 0 and np.abs(w).max() <= w.sum() + 1e-8
            if mask == 16:
                continue
            assert f["r"] == pytest.approx(np.corrcoef(columns @ w, y)[0, 1], abs=1e-9)
            if fitted[mask]["reachable"]:
                assert f["r"] == pytest.approx(fitted[mask]["r"], abs=1e-9)
            assert f["r"] >= swept[mask]["r"] - 1e-9
            tried = rng.uniform(-1, 1, (4000, len(use)))
            tried[:, -1] = 1 - tried[:, :-1].sum(axis=1)
            tried = tried[np.abs(tried[:, -1]) <= 1]
            cov = m.cov[np.ix_(use, use)]
            spread = np.einsum("ij,jk,ik->i", tried, cov, tried)
            fine = spread > 1e-9
            assert (tried[fine] @ m.cov[use, 6] / np.sqrt(spread[fine] * m.cov[6, 6]) <= f["r"] + 1e-9).all()
        assert any(found[k]["r"] > swept[k]["r"] + 1e-4 for k in found)
    seven = composite.Moments(df.withColumn("still", F.lit(7.1)), names[3:5])
    assert [r["fallback"] for r in composite.bounded_weights(seven, spark).orderBy("mask").collect()] == [False, True, False]


def _fit(values, lam):
    """The likelihood of an exponent for positive values, in whole-number arithmetic of many digits."""
    from decimal import Decimal, localcontext
    with localcontext() as exact:
        exact.prec = 400
        powers = {v: ((Decimal(v) + 1).ln() * Decimal(lam)).exp() for v in set(values)}
        mean = sum(powers[v] for v in values) / len(values)
        spread = sum((powers[v] - mean) ** 2 for v in values) / len(values) / Decimal(lam) ** 2
        return float(-Decimal(len(values)) / 2 * spread.ln() + (Decimal(lam) - 1) * sum((Decimal(v) + 1).ln() for v in values))


def test_far_exponents_and_missed_fences(spark):
    rng = np.random.default_rng(8)
    lam = 9.0
    x = ((lam * rng.normal(20, 1, size=3000) + 1) ** (1 / lam) - 1)
    df = spark.createDataFrame([(float(v), float(v) + 1e6) for v in x], "a double, b double")
    assert abs(stats.exponents(df, ["a"])["a"]) > 4.5
    # nearly all at the top: the best exponent lies far beyond what powers can hold
    steep = spark.createDataFrame([(50.0,)] * 3000 + [(49.9,), (49.8,), (0.5,)], "c double")
    got = stats.exponents(steep, ["c"])["c"]
    tried = {lam: _fit([50.0] * 3000 + [49.9, 49.8, 0.5], lam) for lam in (got, got - 0.1, got + 0.1, got / 2, got * 2)}
    assert got > 100 and max(tried, key=tried.get) == got
    got = stats.quantiles(df, ["a", "b"], (0.01, 0.5, 0.99), accuracy=3)
    assert got["a"] == pytest.approx(list(np.quantile(x, [0.01, 0.5, 0.99])))


def test_scoring_keeps_stages_small(spark, pairs, vectors):
    """No task of the scoring job holds the sorts of more than one metric."""
    scored = scoring.scores_of(pairs, vectors)
    assert scored.count() == pairs.count()
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort ") <= 2 and "Join" not in plan


def test_bucketed_table_needs_no_shuffle(spark, pairs):
    table = Bucketed(pairs)
    counted = table.rows.groupBy("id").count()
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString() and counted.count() == pairs.count()
    table.close()
