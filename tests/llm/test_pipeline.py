"""The pipeline's stages against what they should keep, and as a whole."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def stage(spark, name, docs):
    return dict(pipeline.STAGES)[name](spark, docs, SF)


def test_stages_and_their_order():
    assert [n.split()[0] for n, _ in pipeline.STAGES] == ["toxicity", "language", "SimHash", "mixing", "best-fit"]


def test_near_copies_leave_one_of_each_group(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd_docs.drop("doc_id").selectExpr(
        "100000 + length(text) % 7 AS doc_id", "*"
    )).unionByName(odd_docs.where("doc_id is null"))
    rows = docs.collect()
    keys = [(r.doc_id is None, r.doc_id or 0) for r in rows]
    groups = {}
    for index, root in enumerate(_roots([(i, plain_fingerprint(r.text)) for i, r in enumerate(rows)])):
        groups.setdefault(root, []).append(index)
    got = stage(spark, "SimHash near-dedup", docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == len(set(kept)) == len(groups)
    least = sorted(min(keys[i] for i in g) for g in groups.values())
    assert sorted((d is None, d or 0) for d, _ in kept) == least


def _roots(rows):
    return plain_components(rows)


def test_unknown_languages_go(spark, make_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = make_docs([(10**6, "12345 67 -- !!", "en", "a"), (10**6 + 1, None, "en", "a"), (10**6 + 2, "", "de", "a")])
    got = stage(spark, "language ID", docs.unionByName(odd))
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()}


def test_a_language_left_out_goes(spark):
    """Texts of a language without any label are like none that was learned."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    told = docs.withColumn("lang", F.expr("nullif(lang, 'es')"))
    kept = stage(spark, "language ID", told).select("doc_id").withColumn("kept", F.lit(True))
    rows = docs.where("lang is not null").join(kept, "doc_id", "left").selectExpr("lang = 'es' AS unknown", "kept")
    share = {r.unknown: r.share for r in rows.groupBy("unknown").agg(F.avg(F.col("kept").isNotNull().cast("int")).alias("share")).collect()}
    assert share[True] <= 0.05 and share[False] >= 0.99, share


def test_toxic_texts_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = dict(pipeline.STAGES)["toxicity"](spark, docs, "/root/testdata/sf0.01")
    assert got.columns == docs.columns
    kept = {r.doc_id for r in got.collect()}
    clean = [d for d, t in labels.items() if not t]
    toxic = [d for d, t in labels.items() if t]
    assert sum(d in kept for d in clean) >= 0.98 * len(clean)
    assert sum(d not in kept for d in toxic) >= 0.7 * len(toxic)


def test_whole_run(spark):
    pieces = pipeline.run(spark, SF).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {p.doc_id for p in pieces} <= docs and pieces
    fill = {}
    for p in pieces:
        fill.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_extra_columns_and_empty_table(spark, odd_docs):
    names = ["toxic", "language", "first", "fp", "_n", "mix_source", "length", "sequence_id", "_row_id"]
    docs = odd_docs.selectExpr("*", *[f"'x' AS {n}" for n in names])
    for _, function in pipeline.STAGES:
        got = function(spark, docs, SF)
        if function is not pipeline.pack_sequences:
            assert got.columns == docs.columns
            assert set(got.collect()) <= set(docs.collect())
        assert function(spark, docs.limit(0), SF).count() == 0
