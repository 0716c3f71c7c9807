"""Packed token files: exact round trips, random access, and the word memory."""

import io
import zlib

import numpy as np
import pytest

from archivelake.llm import bitpack, queries, tokens
from tests.llm.test_packing import tokenizer  # noqa: F401

SF = "/root/testdata/sf0.001"
NAME = "op10_packed_token_files"


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 31, 32])
def test_round_trip_and_random_access(width):
    rng = np.random.default_rng(width)
    docs = [rng.integers(0, 1 << width, n, dtype=np.uint64).astype("<u4") for n in (0, 5, 1000, 1, 0, 777, 64)]
    sink = io.BytesIO()
    writer = bitpack.Writer(sink, width, block_ids=100)
    for i, ids in enumerate(docs):
        writer.add(None if i == 3 else i, ids)
    writer.finish()
    reader = bitpack.Reader(sink)
    whole = np.concatenate(docs)
    assert all((reader.document(k) == d).all() for k, d in enumerate(docs))
    for low, high in ((0, len(whole)), (99, 101), (100, 200), (1500, 1501), (7, 7)):
        assert (reader.ids(low, high) == whole[low:high]).all()
    assert reader.null.tolist() == [i == 3 for i in range(7)]
    packed = sum(int(b - a) for a, b in zip(reader.blocks, reader.blocks[1:], strict=False))
    assert packed <= -(-len(whole) * width // 8) + len(reader.blocks)


def test_width_is_the_least_one():
    assert [bitpack.bits_for(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_cut_file_is_refused():
    sink = io.BytesIO()
    writer = bitpack.Writer(sink, 16)
    writer.add(1, np.arange(10, dtype="<u4"))
    writer.finish()
    with pytest.raises(ValueError):
        bitpack.Reader(io.BytesIO(sink.getvalue()[:-1]))


def check(rows, docs, tokenizer):  # noqa: F811
    at = 0
    rows = sorted(rows, key=lambda r: r.start)
    encoded = {}
    for r in docs:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        encoded.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    last = None
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        encoded[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        assert last is None or (r.doc_id is not None and last <= r.doc_id)
        last = r.doc_id
    assert not any(encoded.values())


def test_query_equals_brute_force(spark, tokenizer):  # noqa: F811
    rows = queries.QUERIES[NAME](spark, SF).collect()
    check(rows, spark.read.parquet(f"{SF}/documents.parquet").collect(), tokenizer)


def test_odd_rows_in_many_files(odd_docs, store, spark, tokenizer):  # noqa: F811
    folder = store(documents=odd_docs.selectExpr("*", "1 AS file", "2 AS base"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(queries.QUERIES[NAME](spark, folder).collect(), odd_docs.collect(), tokenizer)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_table(odd_docs, store, spark):
    assert queries.QUERIES[NAME](spark, store(documents=odd_docs.limit(0))).collect() == []


ODD = [
    "<|endoftext|> it's DON'T\x1cstop naïve ﬁn 漢字 İΣ́ a b", "x́ ́y \x85z\xa0q ... ,, a.b, don't. 3,000. İstanbul. ΑΣ,",
    "()x() é. é. Ǆ ŉ. ß, \x1d", "", "a" * 3000, "1st 22nd, !! ??.", "　全角　スペース。", "ẞ. ǅ, ǅ.", "Å K. Å", "we're, I'll. 'd 's",
    "a<|startoftext|>b", "tab\tnew\nline\x0bvt\x0cff\rcr", "$$$ word### re*** (x)",
]


def test_ids_equal_the_library(tokenizer, monkeypatch):  # noqa: F811
    codec = tokens.encoder()
    plain = [tokenizer.encode(t, add_special_tokens=False).ids for t in ODD]
    assert [b.tolist() for b in codec.ids(ODD)] == plain
    # A memory of three words forgets all the time.
    monkeypatch.setattr(tokens, "MEMORY_WORDS", 3)
    small = tokens.WordEncoder(__import__("public_tokenizers").path(tokens.VOCABULARY))
    for _ in range(2):
        assert [small.ids([t])[0].tolist() for t in ODD] == plain
    # Texts and words longer than a chunk.
    monkeypatch.setattr(tokens.wordhash, "CHUNK", 20)
    tokens.wordhash._powers.cache_clear()
    assert [b.tolist() for b in codec.ids(ODD)] == plain
    tokens.wordhash._powers.cache_clear()
