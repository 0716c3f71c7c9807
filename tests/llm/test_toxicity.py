"""The conditional random field against exhaustive sums, and held-out accuracy."""

import itertools

import numpy as np
import pytest

from archivelake.llm import queries, toxicity

NAME = "op4_toxic_spans_crf"


def plain_marginals(model, emission):
    """Marginals of tag 1 by summing over all taggings."""
    n = len(emission)
    total, ones = 0.0, np.zeros(n)
    for tags in itertools.product((0, 1), repeat=n):
        value = model.start[tags[0]] + sum(model.move[a, b] for a, b in itertools.pairwise(tags))
        value = np.exp(value + sum(model.bias + e for t, e in zip(tags, emission, strict=True) if t))
        total += value
        ones += value * np.array(tags)
    return ones / total


def test_marginals_equal_all_taggings():
    rng = np.random.default_rng(8)
    for _ in range(60):
        model = toxicity.Model({}, rng.normal(-1), rng.normal(size=2), rng.normal(size=(2, 2)), np.zeros(3))
        n = rng.integers(1, 10)
        emission = np.where(rng.random(n) < 0.5, rng.normal(size=n) * 3, 0.0)
        at = np.flatnonzero(emission)
        if len(at):
            got = model.marginals(at, emission[at], n)
            assert got == pytest.approx(plain_marginals(model, emission)[at], abs=1e-9)


def test_fit_raises_the_likelihood_of_its_tags():
    windows = [([[1], [], [2], []], [1, 0, 0, 0], 30), ([[], [1], [1], []], [0, 1, 1, 0], 20), ([[2], []], [0, 0], 50)]
    weights, bias, _, _ = toxicity.fit_chain(windows, 2)
    assert weights[0] == 0 and weights[1] + bias > 1 > -1 > weights[2] + bias and bias < -1


def test_features():
    assert toxicity.word_features('"Idiot!!"') == ["idiot$", "^idi", "^idio"]
    assert toxicity.word_features("...") == []


def test_held_out_accuracy_and_spans(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES[NAME](spark, folder).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert set(got) == set(docs)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    unseen = [d for d in labels if got[d].held_out]
    assert np.mean([got[d].predicted == labels[d] for d in unseen]) >= 0.93
    words = {docs[d].text[s.start:s.start + s.length].strip("*.,#$%&").lower() for d, r in got.items() for s in r.spans}
    assert {"idiot", "trash", "moron"} & words and "the" not in words


def test_labels_of_held_out_rows_are_not_read(spark, store):
    """Turning the labels of held-out rows around changes nothing."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id AS string)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    one = queries.QUERIES[NAME](spark, folder).select("doc_id", "score")
    two = queries.QUERIES[NAME](spark, store(documents=docs, labels=turned)).select("doc_id", "score")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


@pytest.mark.parametrize("kind", ["none", "all toxic", "all clean", "both"])
def test_odd_rows(odd_docs, store, spark, kind):
    toxic = {"none": [], "all toxic": [1, 1, 1], "all clean": [0, 0, 0], "both": [1, 0, None]}[kind]
    labels = spark.createDataFrame(
        [(d, t) for d, t in zip((1, 5, 8), toxic, strict=False)] + [(1, t) for t in toxic[:1]] + [(None, 1)], "doc_id long, toxic int"
    )
    folder = store(documents=odd_docs.selectExpr("*", "1 AS y", "2 AS score"), labels=labels)
    rows = queries.QUERIES[NAME](spark, folder).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    empty = store(documents=odd_docs.limit(0), labels=labels.limit(0))
    assert queries.QUERIES[NAME](spark, empty).collect() == []
