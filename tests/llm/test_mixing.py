"""Raking against a plain numpy loop, and the sample it draws."""

import re
from collections import Counter

import numpy as np
import pytest

from archivelake.llm import mixing, queries

SF = "/root/testdata/sf0.001"
NAME = "op1_raked_mixing"
NAMES = ("source", "lang", "topic", "tokens", "probability", "sampled")


def plain_topic(text):
    for name, marks in mixing.TOPICS:
        if any(m in text for m in marks):
            return name
    return mixing.OTHER_TOPIC


def plain_rates(docs, mix):
    """Probability of every cell by the same rules, cell by cell."""
    cells = Counter()
    for r in docs:
        text = r.text or ""
        cells[r.source or "", r.lang or "", plain_topic(text)] += len(re.findall("[^\x20\x09-\x0d]+", text))
    keys = [k for k, n in cells.items() if n]
    if not keys:
        return dict.fromkeys(cells, 0.0)
    tokens = np.array([cells[k] for k in keys], float)
    share = tokens / tokens.sum()
    weight = share.copy()
    wanted = []
    for d, target in enumerate(mix.targets.values()):
        have = Counter()
        for k, n in zip(keys, tokens, strict=True):
            have[k[d]] += n
        if target.shares is None:
            raw = {v: n**target.exponent for v, n in have.items()}
        else:
            rest = sum(n for v, n in have.items() if v not in target.shares)
            raw = {v: target.shares.get(v, target.other * n / rest if rest else 0) for v, n in have.items()}
        wanted.append({v: x / sum(raw.values()) for v, x in raw.items()})
    for _ in range(mix.rounds):
        off = 0.0
        for d, want in enumerate(wanted):
            now = Counter()
            for k, w in zip(keys, weight, strict=True):
                now[k[d]] += w
            scale = np.array([want[k[d]] / now[k[d]] if now[k[d]] > 0 else 1.0 for k in keys])
            off = max(off, np.abs(scale - 1).max())
            weight = weight * scale
        weight = np.minimum(weight, mix.bound * share)
        if off <= mix.tolerance:
            break
    rate = weight / share
    return dict.fromkeys(cells, 0.0) | dict(zip(keys, rate / rate.max(), strict=True))


def check(got, docs, mix=None):
    if "mix_sampled" in got.columns:
        got = got.select("doc_id", *[got[f"mix_{n}"].alias(n) for n in NAMES])
    rows = got.collect()
    rates = plain_rates(docs, mix or mixing.Mix())
    assert len(rows) == len(docs)
    for r in rows:
        assert r.probability == pytest.approx(rates[r.source, r.lang, r.topic], abs=1e-6)
        assert r.sampled or r.probability < 1
        assert not (r.sampled and r.probability == 0)
    return rows


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = check(queries.QUERIES[NAME](spark, SF), docs)
    text = {d.doc_id: d.text for d in docs}
    assert all(r.tokens == len(re.findall("[^\x20\x09-\x0d]+", text[r.doc_id])) for r in rows)
    assert sum(r.sampled for r in rows) == pytest.approx(sum(r.probability for r in rows), rel=0.15)


def test_odd_rows(odd_docs, store, spark):
    clashing = odd_docs.selectExpr("*", "1 AS rate", "2 AS weight", "3 AS share", "4 AS tokens", "5 AS topic")
    check(queries.QUERIES[NAME](spark, store(documents=clashing)), odd_docs.collect())
    check(mixing.sample(clashing), odd_docs.collect())


def test_empty_and_wordless_tables(odd_docs, store, spark):
    assert queries.QUERIES[NAME](spark, store(documents=odd_docs.limit(0))).collect() == []
    rows = queries.QUERIES[NAME](spark, store(documents=odd_docs.where("text is null or text = ''"))).collect()
    assert {(r.probability, r.sampled) for r in rows} == {(0.0, False)}


def test_targets_are_met(spark, make_docs):
    """Without binding bounds the expected token shares are the targets."""
    docs = make_docs([
        (i, "word " * (1 + i % 9), "en" if i % 3 else "de", f"s{min(i % 7, 2)}") for i in range(2000)
    ])
    mix = mixing.Mix(targets={
        "source": mixing.Target(shares={"s0": 0.3, "s1": 0.3, "s2": 0.4}), "lang": mixing.Target(shares={"en": 0.5, "de": 0.5}),
        "topic": mixing.Target(),
    }, bound=10.0, tolerance=1e-9)
    rows = check(mixing.sample(docs, mix), docs.collect(), mix)
    for column, target in (("source", {"s0": 0.3, "s1": 0.3, "s2": 0.4}), ("lang", {"en": 0.5, "de": 0.5})):
        expected = Counter()
        for r in rows:
            expected[r[column]] += r.tokens * r.probability
        total = sum(expected.values())
        assert {v: n / total for v, n in expected.items()} == pytest.approx(target, abs=1e-6)


def test_many_cells_use_salted_joins(spark, make_docs):
    docs = make_docs([(i, f"some words {i} @", "en", f"s{i % 5}") for i in range(200)])
    mix = mixing.Mix(broadcast_rows=0, tolerance=0.0, rounds=4)
    check(mixing.sample(docs, mix), docs.collect(), mix)


def test_targets_out_of_reach_are_told(spark, make_docs):
    """A bound of the mean weight leaves no room to move: the rounds end with a warning."""
    docs = make_docs([(i, "some words here", "en", "a" if i % 10 else "b") for i in range(200)])
    mix = mixing.Mix(targets={
        "source": mixing.Target(shares={"a": 0.5, "b": 0.5}), "lang": mixing.Target(), "topic": mixing.Target(),
    }, bound=1.0, rounds=3)
    with pytest.warns(UserWarning, match="targets unmet after 3 rounds"):
        check(mixing.sample(docs, mix), docs.collect(), mix)
