"""Packing plans against exhaustive search, and packed pieces against plain encoding."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from archivelake.llm import packing, queries

SF = "/root/testdata/sf0.001"
NAME = "op9_best_fit_packing"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def fewest(items, capacity):
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                at = rooms.index(room)
                go(i + 1, [*rooms[:at], room - items[i], *rooms[at + 1:]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum_and_plans_hold_every_piece():
    rng = random.Random(5)
    for _ in range(600):
        capacity = rng.choice([10, 12, 20, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        counts = Counter(items)
        fixed, rest = packing.reduce_by_dominance(counts, capacity)
        left = [s for s, n in rest.items() for _ in range(n)]
        assert sum(n for n, _ in fixed) + fewest(left, capacity) == fewest(items, capacity)
        held = Counter()
        plan = packing.plan(counts, capacity)
        for n, contents in plan:
            assert n > 0 and sum(s * k for s, k in contents) <= capacity
            for s, k in contents:
                held[s] += n * k
        assert held == counts
        assert packing.lower_bound(counts, capacity) <= sum(n for n, _ in plan) <= fewest(items, capacity) + 1


def test_plans_are_close_to_the_bound():
    rng = random.Random(6)
    counts = {s: rng.randint(0, 3000) for s in range(1, 2049)}
    assert sum(n for n, _ in packing.plan(counts)) <= 1.01 * packing.lower_bound(counts, 2048)


def check(rows, docs, tokenizer, capacity=2048):
    want = Counter()
    for r in docs:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            want[r.doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_query_equals_brute_force(spark, tokenizer):
    rows = queries.QUERIES[NAME](spark, SF).collect()
    n = check(rows, spark.read.parquet(f"{SF}/documents.parquet").collect(), tokenizer)
    assert n <= 1.02 * packing.lower_bound(Counter(r.length for r in rows), 2048) + 1


def test_odd_rows(odd_docs, store, spark, tokenizer):
    clashing = odd_docs.selectExpr("*", "1 AS length", "2 AS _part")
    check(queries.QUERIES[NAME](spark, store(documents=clashing)).collect(), odd_docs.collect(), tokenizer)


def test_hot_lengths_are_numbered_in_parts(spark, odd_docs):
    pieces = spark.range(5000).selectExpr("id AS doc_id", "0 AS piece", "if(id % 3 = 0, 7, 30) AS length")
    rows = packing.pack(pieces, 100, piece_rows=100).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 5000
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    counts = Counter(r.length for r in rows)
    assert max(filled.values()) <= 100 and len(filled) <= 1.04 * packing.lower_bound(counts, 100)
    assert queries.QUERIES[NAME].__doc__


def test_empty_table(odd_docs, store, spark):
    assert queries.QUERIES[NAME](spark, store(documents=odd_docs.limit(0))).collect() == []
