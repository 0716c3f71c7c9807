"""Saved searches on text against a check of every search on every message."""

import random

import pytest
from pyspark.sql import functions as F

from archivelake.operators import predicates as p
from archivelake.streaming import saved
from archivelake.streaming.tables import read_table, stream_files

WORDS = ["alpha", "beta", "gamma", "delta", "eta"]
SCHEMA = "inbox string, num bigint, subject string, body string"


def holds(predicate, row):
    if isinstance(predicate, p.And):
        return all(holds(i, row) for i in predicate.items)
    if isinstance(predicate, p.Or):
        return any(holds(i, row) for i in predicate.items)
    if isinstance(predicate, p.Not):
        return not holds(predicate.item, row)
    text = ({"": row[3], "s": row[2]}.get(predicate.field) or "").lower().replace(",", " ").split()
    if isinstance(predicate, p.Term):
        return predicate.term in text
    n = len(predicate.words)
    return any(tuple(text[i:i + n]) == predicate.words for i in range(len(text)))


def random_search(rng, depth=3):
    kind = rng.choice(["term", "term", "phrase", "and", "or", "not"]) if depth else "term"
    if kind == "term":
        return p.Term(rng.choice(WORDS), rng.choice(["", "", "s", "nowhere"]))
    if kind == "phrase":
        return p.Phrase(tuple(rng.choices(WORDS, k=rng.choice([1, 2, 3]))), rng.choice(["", "s"]))
    if kind == "not":
        return p.Not(random_search(rng, depth - 1))
    return (p.And if kind == "and" else p.Or)([random_search(rng, depth - 1) for _ in range(2)])


def messages(rng, n):
    def said(k):
        return rng.choice([None, "", ", ".join(rng.choices(WORDS, k=k)).title()]) if rng.random() < 0.2 else " ".join(rng.choices(WORDS, k=k))

    return [(f"i{rng.randrange(3)}", k, said(2), said(rng.randrange(7))) for k in range(n)]


@pytest.mark.parametrize("known", [True, False])
def test_matches_equal_every_search_on_every_message(spark, known):
    rng = random.Random(7)
    searches = {f"q{k}": random_search(rng) for k in range(40)}
    rows = messages(rng, 60)
    counts = spark.createDataFrame([("alpha", 50), ("beta", 1), ("gamma", 9)], "term string, df bigint") if known else None
    table = saved.compile_searches(spark, searches, counts)
    got = saved.matches(
        spark.createDataFrame(rows, SCHEMA), table, {"": F.col("body"), "s": F.col("subject")}, ["inbox", "num"]
    ).collect()
    want = {(name, r[0], r[1]) for name, q in searches.items() for r in rows if holds(q, r)}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_rare_words_are_anchors_and_conditions_count(spark):
    counts = spark.createDataFrame([("the", 1000), ("alpha", 3)], "term string, df bigint")
    table = saved.compile_searches(spark, {
        "a": p.Term("the") & p.Term("alpha"), "b": p.Phrase(("the", "rest")), "c": p.Not(p.Term("the")) & p.between("num", 2, 3),
    }, counts)
    assert {r.search: r.anchor.split("\u0001")[-1] for r in table.clauses.collect()} == {"a": "alpha", "b": "rest", "c": ""}
    rows = [("i", k, None, "beta" if k != 3 else "the") for k in range(5)] + [(None, 2, None, None)]
    got = saved.matches(spark.createDataFrame(rows, SCHEMA), table, {"": F.col("body")}, ["inbox", "num"]).collect()
    assert {tuple(r) for r in got} == {("c", "i", 2), ("c", None, 2)}


def test_other_predicates_are_refused(spark):
    with pytest.raises(ValueError):
        saved.compile_searches(spark, {"x": p.Prefix("a")})


def test_positions_over_batches(spark, tmp_path):
    """Numbers seen before are not hits again; another search and inbox has its own position."""
    table = saved.compile_searches(spark, {"a": p.Term("alpha"), "b": p.Term("beta")})
    batches = [
        [("i", 1, None, "alpha"), ("i", 2, None, "beta"), ("j", 9, None, "alpha")],
        [("i", 1, None, "alpha"), ("i", 3, None, "alpha beta"), ("j", 9, None, "alpha beta")], [("i", 4, None, "eta")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stream_files(spark, f"{tmp_path}/in", SCHEMA)
        saved.follow(stream, table, {"": F.col("body")}, f"{tmp_path}/out", available_now=True).awaitTermination()
    got = read_table(spark, f"{tmp_path}/out/hits", saved.HITS).drop("batch").collect()
    assert sorted(map(tuple, got)) == [("a", "i", 1), ("a", "i", 3), ("a", "j", 9), ("b", "i", 2), ("b", "i", 3), ("b", "j", 9)]
