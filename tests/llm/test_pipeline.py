"""The stages one after another against a brute-force version, each on its own input."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F

from gistmeter.llm import decontaminate, quality

from .test_operators import LOWER, BLANK, plain_components

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    inputs, stages = {}, dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = [tuple(r) for r in docs.collect()]
        if name != "byte_bpe":
            columns, docs = docs.columns, spark.createDataFrame([tuple(r) for r in stage(spark, docs, SMALL).collect()], docs.schema)
            assert docs.columns == columns
    # labels of the quality stage are met, but for few
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r[0] for r in inputs["line_dedup"]}
    known = [(d in kept) == bool(labels[d]) for d, *_ in inputs["quality"] if d in labels]
    assert sum(known) >= 0.9 * len(known)
    # lines
    holders = collections.defaultdict(set)
    key = lambda line: line.translate(LOWER).strip(BLANK)
    for d, text, *_ in inputs["line_dedup"]:
        for line in text.split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(d)
    want = {}
    for d, text, lang, source, _ in inputs["line_dedup"]:
        text = "\n".join(x for x in text.split("\n") if len(holders[key(x)]) < 2 or min(holders[key(x)]) == d)
        want[d] = (d, text, lang, source, len(text))
    assert {r[0]: r for r in inputs["near_dedup"]} == want
    # near duplicates
    stay = {r[0] for r in plain_components([r[:2] for r in inputs["near_dedup"]], corpus_pipeline.SHINGLE_WORDS) if r[3]}
    assert {r[0] for r in inputs["decontamination"]} == stay
    # benchmark passages stand in documents word for word here
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    fold = lambda t: decontaminate.folded(t.encode()).tobytes()
    assert {r[0] for r in inputs["byte_bpe"]} == {r[0] for r in inputs["decontamination"] if not any(fold(i) in fold(r[1]) for i in items)}
    last = stages["byte_bpe"](spark, docs, SMALL)
    sha = {r["doc_id"]: r["s"] for r in docs.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("s")).collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in last.collect()} == sha


def test_stages_on_edge_rows(spark, edge, nothing, tmp_path):
    """Columns named as operators name theirs, nulls, repeated rows, empty tables, no labels."""
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").write.parquet(f"{tmp_path}/some/{table}.parquet")
        spark.read.parquet(f"{SMALL}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{table}.parquet")
    rows = edge.withColumns({"predicted": F.lit("p"), "row": F.lit(9), "n_chars": F.length("text"), "n_dropped": F.lit("d"), "cluster": F.lit(0.5), "kept": F.lit(None)})
    whole = collections.Counter(map(str, rows.collect()))
    for name, stage in corpus_pipeline.STAGES:
        for folder in ("some", "none"):
            got = stage(spark, rows, f"{tmp_path}/{folder}")
            empty = stage(spark, nothing, f"{tmp_path}/{folder}")
            assert empty.count() == 0
            if name == "byte_bpe":
                assert got.count() == rows.count()
                continue
            assert got.columns == rows.columns and empty.columns == nothing.columns
            if name == "line_dedup":
                unchanged = ["doc_id", "source", "n_lines", "score", "rest", "count", "predicted", "row", "n_dropped", "cluster", "kept"]
                assert collections.Counter(map(str, got.select(unchanged).collect())) == collections.Counter(map(str, rows.select(unchanged).collect()))
                assert got.filter("text is null or n_chars <> length(text)").count() == 0
            else:
                kept = collections.Counter(map(str, got.collect()))
                assert kept <= whole
                if folder == "none" and name in ("quality", "decontamination"):
                    assert kept == whole


def test_run_gives_the_last_stage(spark):
    found = corpus_pipeline.run(spark, SMALL)
    assert found.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and found.count() > 0


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.held_out(F.col("doc_id"))
    weights = quality.train(docs, labels.select("doc_id", F.col("quality").alias("label")).filter(~out))
    right = (quality.scored(docs.filter(out), weights).join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0])
    assert right > 0.9
