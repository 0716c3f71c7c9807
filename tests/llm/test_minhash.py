"""MinHash fingerprints, their likeness and verified links against brute force."""

import hashlib
import random

import numpy as np
import pytest

from archivelake.llm import minhash, queries

SF = "/root/testdata/sf0.001"
NAME = "op7_minhash_fingerprints"


def plain_shingles(text):
    words = text.encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def plain_rows(docs):
    """doc_id, n_chars, hash of the edited text, true likeness to it and to the next."""
    rows = sorted(
        ((r.doc_id, r.text or "") for r in docs),
        key=lambda r: (r[0] is None, -(r[0] or 0), [-ord(c) for c in r[1]] + [1]),
    )
    out = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        third = len(text) // 3
        edited = text[:len(text) - third] + following[:third]
        own, new, theirs = map(plain_shingles, (text, edited, following))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(),
                    jaccard(own, new), jaccard(own, theirs)))
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(got, docs):
    rows = got.collect()
    want = plain_rows(docs)
    key = lambda r: (repr(r[0]), r[1], r[2])
    rows.sort(key=key)
    want.sort(key=key)
    assert [tuple(r)[:3] for r in rows] == [w[:3] for w in want]
    for r, w in zip(rows, want, strict=True):
        assert r.near_edited == pytest.approx(w[3], abs=0.25) and r.near_next == pytest.approx(w[4], abs=0.25)
    by_text = {}
    for r in rows:
        assert 0 <= r.near_next <= 1 and len(r.fingerprint) == 512
        by_text.setdefault(r.doc_id, set()).add(r.fingerprint)
    return rows


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = check(queries.QUERIES[NAME](spark, SF), docs)
    text = {r.doc_id: r.text for r in docs}
    seen = {}
    for r in rows:
        assert seen.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    want = {w[0]: w[3] for w in plain_rows(docs)}
    miss = [r.near_edited - want[r.doc_id] for r in rows]
    assert abs(np.mean(miss)) < 0.01 and np.std(miss) < 0.06


def test_many_ranges(spark, make_docs, store):
    docs = make_docs([(i, f"text {i} of many words " * (i % 7)) for i in range(300)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(queries.QUERIES[NAME](spark, store(documents=docs)), docs.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_odd_rows(odd_docs, store, spark):
    check(queries.QUERIES[NAME](spark, store(documents=odd_docs)), odd_docs.collect())


def test_one_and_no_document(odd_docs, make_docs, store, spark):
    one = make_docs([(4, "alone in the world it stands")])
    check(queries.QUERIES[NAME](spark, store(documents=one)), one.collect())
    assert queries.QUERIES[NAME](spark, store(documents=odd_docs.limit(0))).collect() == []


def test_long_texts_hash_like_short_ones(monkeypatch):
    text = " ".join(random.Random(1).choices(["alpha", "Beta", "γάμμα", "x" * 30], k=4000))
    whole = minhash.shingle_hashes(text)
    monkeypatch.setattr(minhash.wordhash, "CHUNK", 500)
    minhash.wordhash._powers.cache_clear()
    assert (minhash.shingle_hashes(text) == whole).all()
    assert len(minhash.shingle_hashes("y" * 2000 + " " + "z" * 2000)) == 1
    minhash.wordhash._powers.cache_clear()


def test_links_equal_brute_force(spark, make_docs):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(15):
        words = rng.choices(vocabulary, k=120)
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(120)] = rng.choice(vocabulary)
            rows.append((n, " ".join(copy)))
            n += 1
    docs = make_docs([*rows, (900, rows[0][1]), (901, None), (902, "")])
    links, members = minhash.near_links(docs)
    text_of = {r.doc_id: r.text_id for r in members.collect()}
    assert text_of[900] == text_of[0] and text_of[901] == text_of[902]
    got = {(r.a, r.b): r.jaccard for r in links.collect()}
    want = {}
    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            j = jaccard(plain_shingles(s), plain_shingles(t))
            if s != t and j >= 0.8:
                want[tuple(sorted((text_of[a], text_of[b])))] = j
    assert got == pytest.approx(want)


def test_links_of_large_groups_equal_brute_force(spark, make_docs):
    """Hundreds of near copies of a page, of texts with much in common, and a chain of edits."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    page, common, walk = (rng.choices(vocabulary, k=120) for _ in range(3))
    texts = []
    for _ in range(300):
        copy = list(page)
        for at in rng.sample(range(120), rng.randrange(1, 4)):
            copy[at] = f"{rng.choice(vocabulary)}x"
        texts.append(" ".join(copy))
    for _ in range(150):
        texts.append(" ".join([*common[:90], *rng.choices(vocabulary, k=rng.randrange(12, 60))]))
    for _ in range(200):
        walk[rng.randrange(120)] = rng.choice(vocabulary)
        texts.append(" ".join(walk))
    texts = list(dict.fromkeys(texts))
    links, members = minhash.near_links(make_docs(list(enumerate(texts))))
    text_of = {r.doc_id: r.text_id for r in members.collect()}
    rows = [tuple(r) for r in links.collect()]
    got = {r[:2]: r[2] for r in rows}
    assert len(got) == len(rows)
    sets = [plain_shingles(t) for t in texts]
    want = {}
    for i, s in enumerate(sets):
        for k, t in enumerate(sets[:i]):
            if (j := jaccard(s, t)) >= 0.8:
                want[tuple(sorted((text_of[i], text_of[k])))] = j
    assert len(want) > 5000
    assert got == pytest.approx(want)
