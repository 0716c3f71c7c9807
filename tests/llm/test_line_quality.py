"""Line counts and the field against plain sums, and held-out accuracy."""

import itertools
import zlib

import numpy as np
import pytest

from archivelake.llm import line_quality, queries, wordhash

NAME = "op12_line_quality_crf"


def plain_marginals(emission, start, move):
    """Marginals of tag 1 by summing over all taggings."""
    total, ones = 0.0, np.zeros(len(emission))
    for tags in itertools.product((0, 1), repeat=len(emission)):
        value = start[tags[0]] + sum(move[a, b] for a, b in itertools.pairwise(tags)) + emission @ np.array(tags)
        total += np.exp(value)
        ones += np.exp(value) * np.array(tags)
    return ones / total


def test_marginals_equal_all_taggings():
    rng = np.random.default_rng(4)
    for _ in range(20):
        length = rng.integers(1, 8, 5)
        width = int(length.max())
        emission = np.where(np.arange(width) < length[:, None], rng.normal(size=(5, width)) * 2, 0.0)
        start, move = rng.normal(size=2), rng.normal(size=(2, 2))
        got = line_quality.marginals(emission, length, start, move)[0]
        for row, n in enumerate(length):
            assert got[row, :n] == pytest.approx(plain_marginals(emission[row, :n], start, move), abs=1e-9)


def test_documents_do_not_touch_each_other():
    """Marginals of a text are the same whatever stands before or after it."""
    rng = np.random.default_rng(5)
    model = line_quality.Model(rng.normal(size=line_quality.N_FEATURES), 0.3, rng.normal(size=2), rng.normal(size=(2, 2)), np.zeros(2))
    texts = ["One.\nTwo two.\n\nFour", "", "A B C D", "x\n" * 40, "!!\n##"]

    def told(these):
        counts, doc, seen = line_quality.line_counts(these)
        return model.line_marginals(line_quality.line_features(counts, doc, seen)[0], doc, len(these))

    together = told(texts)
    assert together == pytest.approx(np.concatenate([told([t]) for t in texts]), abs=1e-9)


def plain_counts(text):
    rows, before = [], []
    for line in text.split("\n"):
        words = [w for w in "".join(" " if c in "\t\x0b\x0c\r" else c for c in line).split(" ") if w]
        rows.append((
            len(line), sum(c.isascii() and c.isalpha() or ord(c) >= 0xC0 for c in line),
            sum("A" <= c <= "Z" or "À" <= c <= "Þ" for c in line), sum(c in "#*$%&|<>^~=_+{}[]\\@" for c in line),
            sum(c in "!?" for c in line), sum("0" <= c <= "9" for c in line), len(words), len(set(words)),
            sum(a == b for a, b in itertools.pairwise(words)),
        ))
        before.append((sorted(words), bool(words) and sorted(words) in [b[0] for b in before]))
    return rows, [b[1] for b in before]


TEXTS = [
    "", "\n", "One two two.\nÉTÉ à 12 | # $!?\n\n  One two two.\n", "a\tb\x0bb\rc\x0c", "漢字 İΣ́ ﬁn\nx x x\nx x x",
    "tail\n", "Ünder_score {x} [y]\\@",
]


def check_counts(texts):
    counts, doc, seen = line_quality.line_counts(texts)
    want = [plain_counts(t) for t in texts]
    assert counts.tolist() == [list(r) for rows, _ in want for r in rows]
    assert seen.tolist() == [s for _, marks in want for s in marks]
    assert doc.tolist() == [k for k, (rows, _) in enumerate(want) for _ in rows]


def test_counts_equal_plain_counts():
    check_counts(TEXTS)


def test_counts_over_parts(monkeypatch):
    """Lines that are cut into parts have the same counts, but for words met in both."""
    monkeypatch.setattr(wordhash, "CHUNK", 64)
    monkeypatch.setattr(line_quality, "CHUNK", 64)
    wordhash._powers.cache_clear()
    texts = ["w%d x%d\n" % (k, k) * 3 for k in range(30)] + [" ".join(f"v{k}" for k in range(80)), "u" * 200 + " v\nu"]
    try:
        check_counts(texts)
    finally:
        wordhash._powers.cache_clear()


def test_fit_raises_the_likelihood_of_its_tags():
    texts = ["Fine words here.\nAnd more of them now."] * 5 + ["### $$$ %%%\n*** &&&"] * 5
    counts, doc, seen = line_quality.line_counts(texts)
    features, _ = line_quality.line_features(counts, doc, seen)
    grid = features.reshape(10, 2, -1)
    tags = np.array([[0, 0]] * 5 + [[1, 1]] * 5)
    weights, bias, start, move = line_quality.fit_chain(grid, np.full(10, 2), tags, np.ones(10))
    p = line_quality.marginals(weights[grid].sum(axis=2) + bias, np.full(10, 2), start, move)[0]
    assert (p[:5] < 0.05).all() and (p[5:] > 0.95).all()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.QUERIES[NAME](spark, folder).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert set(got) == set(docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    for quality, least in ((0, 0.95), (1, 0.99)):
        assert np.mean([got[d].predicted == quality for d in labels if got[d].held_out and labels[d] == quality]) >= least
    for d, r in got.items():
        lines = (docs[d] or "").split("\n")
        assert all(lines[k].strip() for k in r.bad_lines)


def test_labels_of_held_out_rows_are_not_read(spark, store):
    """Turning the labels of held-out rows around changes nothing."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    turned = labels.selectExpr("doc_id", "toxic", "if(crc32(cast(doc_id AS string)) % 3 = 1, 1 - quality, quality) AS quality")
    one = queries.QUERIES[NAME](spark, folder).select("doc_id", "score")
    two = queries.QUERIES[NAME](spark, store(documents=docs, labels=turned)).select("doc_id", "score")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


@pytest.mark.parametrize("kind", ["none", "all bad", "all good", "both"])
def test_odd_rows(odd_docs, store, spark, kind):
    quality = {"none": [], "all bad": [0, 0, 0], "all good": [1, 1, 1], "both": [1, 0, None]}[kind]
    labels = spark.createDataFrame(
        [(d, t) for d, t in zip((1, 5, 8), quality, strict=False)] + [(1, t) for t in quality[:1]] + [(None, 1)],
        "doc_id long, quality int",
    )
    folder = store(documents=odd_docs.selectExpr("*", "1 AS y", "2 AS quality_score"), labels=labels)
    rows = queries.QUERIES[NAME](spark, folder).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    if kind != "both":
        assert {r.predicted for r in rows} == {0 if kind == "all bad" else 1}
    empty = store(documents=odd_docs.limit(0), labels=labels.limit(0))
    assert queries.QUERIES[NAME](spark, empty).collect() == []
