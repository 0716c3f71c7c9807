"""The dataset manifest against a plain tree, the registered SQL and awkward tables."""

import hashlib
import zlib

import duckdb
import pytest

from archivelake.llm import merkle, queries

NAME = "op13_merkle_manifest"


def digest(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def plain_leaf(row, text):
    fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)]
    return digest(*fields)


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_path(levels, pos):
    steps = []
    for level in levels[:-1]:
        low = pos // 8 * 8
        steps.append(("".join(level[low:pos]), "".join(level[pos + 1:low + 8])))
        pos //= 8
    return steps


def plain(rows):
    """The whole manifest with one tree per language in memory."""
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, plain_leaf(r, r.text), r))
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda g: g[:3])
        trees[lang] = plain_levels([g[2] for g in groups[lang]])
    top = plain_levels([trees[lang][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        for pos, (_, _, leaf, r) in enumerate(groups[lang]):
            path = plain_path(trees[lang], pos) + plain_path(top, place)
            text = r.text
            if r.doc_id is not None and text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = plain_leaf(r, text)
            for left, right in path:
                folded = digest(left, folded, right)
            out.append((r.doc_id, leaf, trees[lang][-1][0], top[-1][0], digest(*[a + b for a, b in path]),
                        folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def got(spark, folder):
    return sorted(map(tuple, queries.QUERIES[NAME](spark, folder).collect()), key=repr)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    found = got(spark, folder)
    assert found == plain(rows)
    changed = [r for r in found if not r[-1]]
    assert changed and all(zlib.crc32(str(r[0]).encode()) % 3 == 0 for r in changed)


def test_registered_sql(spark):
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert got(spark, folder) == sorted(connection.execute(queries.ORACLES[NAME]).fetchall(), key=repr)


@pytest.mark.parametrize("size", [1, 2, 8, 9, 64, 65, 512, 513, 4097, 4609])
def test_group_sizes(make_docs, store, spark, size):
    """Blocks that are full, just begun, and the last of several."""
    docs = make_docs([(k, f"T{k}", "en") for k in range(size)] + [(k, "x", None) for k in range(3)])
    assert got(spark, store(documents=docs)) == plain(docs.collect())


def test_many_languages(make_docs, store, spark):
    """More languages than a block holds, and bytewise order of their names."""
    docs = make_docs([(k, "Text", f"l{k % 600}") for k in range(1500)] + [(5, "Z", "Z"), (6, "é", "é"), (7, "𝄞", "𝄞"), (8, "～", "～")])
    assert got(spark, store(documents=docs)) == plain(docs.collect())


def test_odd_rows(odd_docs, store, spark):
    folder = store(documents=odd_docs.selectExpr("*", "1 AS pos", "2 AS size", "'x' AS leaf", "3 AS _row"))
    assert got(spark, folder) == plain(odd_docs.collect())
    empty = store(documents=odd_docs.limit(0))
    assert got(spark, empty) == []


def test_equal_rows_are_leaves_of_their_own(make_docs, store, spark):
    docs = make_docs([(None, None)] * 700 + [(4, "Same", "en", "a")] * 600)
    found = got(spark, store(documents=docs))
    assert found == plain(docs.collect()) and len(found) == 1300


def test_any_change_shows(make_docs, spark):
    rows = [(k, f"Row {k}", "en", "a") for k in range(40)]
    root = {r.root for r in merkle.manifest(make_docs(rows)).select("root").distinct().collect()}
    for other in (rows[:-1], [*rows[:-1], (39, "row 39", "en", "a")], [*rows[:-1], (39, "Row 39", "en", "b")]):
        assert {r.root for r in merkle.manifest(make_docs(other)).select("root").distinct().collect()} != root
