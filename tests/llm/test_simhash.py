"""SimHash fingerprints, Golay keys and components against brute force."""

import random
import re

import numpy as np
import xxhash

from archivelake.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """{row index: least id reachable} by comparing all pairs."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if (a ^ b).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        root = find(i)
        if doc_id is not None:
            least[root] = min(least.get(root, doc_id), doc_id)
    return [least.get(find(i)) for i in range(len(rows))]


def expected(docs):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    return sorted(
        ((d, f"{f:016x}", c) for (d, f), c in zip(rows, plain_components(rows), strict=True)), key=repr
    )


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(3)
    fps = rng.integers(-(1 << 63), (1 << 63) - 1, 3000)
    near = fps.view(np.uint64).copy()
    for _ in range(2):
        near ^= np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64)
    keys = []
    for values in (fps, near.view(np.int64)):
        row, key = simhash.fuzzy_keys(values)
        found = [set() for _ in values]
        for r, k in zip(row.tolist(), key.tolist(), strict=True):
            found[r].add(k)
        keys.append(found)
    assert all(a & b for a, b in zip(*keys, strict=True))
    assert max(len(k) for k in keys[0]) <= 18


def test_every_word_is_three_bits_from_its_codeword():
    words = np.random.default_rng(4).integers(0, 1 << 23, 20000)
    errors = simhash._errors()[simhash._remainders(words)]
    assert max(int(e).bit_count() for e in errors) == 3
    assert not simhash._remainders(words ^ errors).any()


def test_query_equals_brute_force(spark):
    got = queries.QUERIES["op8_simhash_golay"](spark, SF)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(map(tuple, got.collect()), key=repr) == expected(docs)


def test_odd_rows(odd_docs, store, spark):
    got = queries.QUERIES["op8_simhash_golay"](spark, store(documents=odd_docs.withColumnRenamed("source", "fp")))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(odd_docs.collect())


def test_empty_table(odd_docs, store, spark):
    assert queries.QUERIES["op8_simhash_golay"](spark, store(documents=odd_docs.limit(0))).collect() == []


def test_large_key_groups_find_the_same_links(spark):
    """A cluster of many fingerprints: pairwise and by neighbouring words."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 150:  # chains of single flips around one fingerprint
        fps.add(rng.choice(sorted(fps)) ^ 1 << rng.randrange(64))
    fps |= {rng.getrandbits(64) for _ in range(50)}
    rows = [(int(np.uint64(f).astype(np.int64)),) for f in sorted(fps)]
    df = spark.createDataFrame(rows, "fp long")

    def parts(pairwise):
        parent = {r[0]: r[0] for r in rows}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in simhash.links(df, pairwise).collect():
            assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2
            parent[find(r.a)] = find(r.b)
        groups = {}
        for f in parent:
            groups.setdefault(find(f), set()).add(f)
        return sorted(map(sorted, groups.values()))

    want = {}
    values = [r[0] for r in rows]
    for f, c in zip(values, plain_components([(f, f & (1 << 64) - 1) for f in values]), strict=True):
        want.setdefault(c, set()).add(f)
    assert parts(64) == parts(3) == parts(1000) == sorted(map(sorted, want.values()))
