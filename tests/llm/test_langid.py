"""Hyperdimensional language ID: exact bundles, held-out accuracy, odd rows."""

import zlib

import numpy as np

from archivelake.llm import langid, queries

NAME = "op3_hyperdimensional_language"


def plain_bundle(text):
    """Trigram vectors bound and added one by one."""
    pairs, letters = langid._vectors()
    table = langid._letter_of()
    codes = [0]
    for char in text:
        code = int(table[ord(char)])
        if code or codes[-1]:
            codes.append(code)
    if codes[-1]:
        codes.append(0)
    out = np.zeros(langid.DIMENSIONS)
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return out


def test_bundles_equal_plain_sums(monkeypatch):
    texts = ["Ein Haus, zwei  Häuser!", "", "123 --", "a", "漢字 и кириллица 9x9", "x" * 50, None]
    want = np.stack([plain_bundle(t or "") for t in texts])
    assert np.allclose(langid.bundles(texts), want, atol=1e-3)
    monkeypatch.setattr(langid, "_CHUNK", 3)
    monkeypatch.setattr(langid, "_CELLS", 5)
    assert np.allclose(langid.bundles(texts), want, atol=1e-3)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.QUERIES[NAME](spark, folder).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_held_out_rows_are_not_read(spark, store):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    turned = docs.selectExpr(
        "doc_id", "text", "if(crc32(cast(doc_id AS string)) % 5 = 0, 'xx', lang) AS lang", "source", "n_chars"
    )
    one = queries.QUERIES[NAME](spark, "/root/testdata/sf0.001").collect()
    two = queries.QUERIES[NAME](spark, store(documents=turned)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_odd_rows(odd_docs, store, spark):
    rows = queries.QUERIES[NAME](spark, store(documents=odd_docs.selectExpr("*", "1 AS language", "2 AS score"))).collect()
    assert len(rows) == odd_docs.count()
    text = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in rows:
        no_letter = not any(c.isalpha() for c in text[r.doc_id] or "")
        assert (r.lang_pred == "und" and r.score == 0) == no_letter
    unlabelled = odd_docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang")
    assert {r.lang_pred for r in queries.QUERIES[NAME](spark, store(documents=unlabelled)).collect()} == {"und"}
    assert queries.QUERIES[NAME](spark, store(documents=odd_docs.limit(0))).collect() == []


def test_least_likeness_scores_every_row(spark):
    """6,000 texts of a language, of which 150 long ones: a sample of 2,000 held too few of them."""
    low = "the house of the old man stands by the river "
    rows = [(i, low * (6 if i < 150 else 2) + str(i), "en") for i in range(6000)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, prototypes = langid.learn(texts)
    cuts = langid.least_likeness(texts, names, prototypes)
    assert [c[0] for c in sorted(cuts[:-1])] == [6, 8]
    scored = langid.predict(texts.where("doc_id < 150"), names, prototypes).agg({"language_score": "min"}).first()[0]
    assert dict((c[0], c[1]) for c in cuts)[8] == scored
