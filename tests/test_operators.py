"""Skew-safe building blocks, de-dup, search and streams on small inputs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from archivelake.operators import annotations as ann
from archivelake.operators import dedupe, lookup, merged, overview, patches, rank
from archivelake.operators import postings as post
from archivelake.operators import predicates as p
from archivelake.operators.ordered import neighbours, row_numbers
from archivelake.operators.skew import keep_first, salted_lookup, with_group_totals
from archivelake.sources import files
from archivelake.streaming import ingest
from archivelake.streaming.tables import read_table, stream_files


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds two thirds of the rows; one row has no key."""
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.randrange(50)) for i in range(600)]
    return spark.createDataFrame([*rows, (None, 600, 1)], "k string, n bigint, v bigint").cache()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_numbers_and_neighbours_equal_plain_windows(skewed):
    keyed = skewed.where("k is not null")
    w = Window.partitionBy("k").orderBy("n")
    got = neighbours(row_numbers(keyed, ["k"], "n", width=37), ["k"], "n", "v", width=37)
    want = keyed.select("*", F.row_number().over(w).alias("rn"), F.lag("v").over(w).alias("prev"),
                        F.lead("v").over(w).alias("next"))
    assert rows_of(got.select(*want.columns)) == rows_of(want)
    back = row_numbers(keyed, ["k"], "n", width=11, descending=True).where("rn = 1")
    assert rows_of(back.select("k", "n")) == rows_of(keyed.groupBy("k").agg(F.max("n")))


def test_totals_and_lookups_keep_every_row(spark, skewed):
    got = with_group_totals(skewed, ["k"], {"low": (F.col("v"), "min"), "all": (F.col("v"), "sum")}, "n", salts=5)
    w = Window.partitionBy("k")
    want = skewed.where("k is not null").select("*", F.min("v").over(w).alias("low"), F.sum("v").over(w).alias("all"))
    assert rows_of(got.where("k is not null")) == rows_of(want) and got.count() == 601
    dim = spark.createDataFrame([("hot", "H"), ("k0", "K")], "k string, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows_of(salted_lookup(skewed, dim, ["k"], "n", how, salts=5)) == rows_of(skewed.join(dim, "k", how).select(
            *skewed.columns, *(["name"] if how in ("inner", "left") else [])))
    first = keep_first(skewed.where("k is not null"), ["k"], ["v"], "n")
    assert first.count() == 8


def test_net_changes_match_a_replay(spark):
    rng = random.Random(9)
    log = [("i", s, rng.choice("mmd"), f"b{rng.randrange(6)}") for s in range(300)]
    pending, keep = {}, []
    for _, s, op, oid in reversed(log):
        if op == "d":
            pending[oid] = pending.get(oid, 0) + 1
        elif pending.get(oid, 0):
            pending[oid] -= 1
        else:
            keep.append(s)
    df = spark.createDataFrame(log, "inbox string, seq bigint, op string, oid string")
    from archivelake.operators.ordered import running_from_end

    step = F.when(F.col("op") == "d", 1).otherwise(-1)
    got = running_from_end(df, ["inbox", "oid"], "seq", step, width=13)
    assert sorted(r.seq for r in got.collect()) == sorted(keep)
    assert files.net_changes(df).count() == len(keep)


def test_arrivals_settle_like_one_by_one(spark):
    rows = [
        (1, ["a"], "h1"), (2, ["a"], "h1"), (3, ["a"], "h2"), (4, ["b", "c"], "h3"), (5, ["b", "d"], "h4"),
        (6, ["a"], "h2"), (7, ["e"], "old"), (8, ["f"], "new"), (9, ["b", "c"], "h5"),
    ]
    arriving = spark.createDataFrame([("i", s, m, h, 0) for s, m, h in rows],
                                     "inbox string, seq bigint, mids array<string>, content_hash string, ds bigint")
    stored = spark.createDataFrame([("i", "e", "old"), ("i", "f", "old")], "inbox string, mid string, content_hash string")
    got = {r.seq: (r.verdict, r.store_mid) for r in dedupe.settle_arrivals(arriving, stored).collect()}
    assert {s: v for s, (v, _) in got.items()} == {
        1: "new", 2: "duplicate", 3: "generated id", 4: "new", 5: "other id", 6: "duplicate", 7: "duplicate",
        8: "generated id", 9: "generated id",
    }
    assert got[5][1] == "d" and got[1][1] == "a"


def test_one_id_used_by_very_many(spark):
    rows = [("i", s, ["hot"], f"h{s % 40}", 0) for s in range(1, 401)]
    arriving = spark.createDataFrame(rows, "inbox string, seq bigint, mids array<string>, content_hash string, ds bigint")
    none = spark.createDataFrame([], "inbox string, mid string, content_hash string")
    got = dedupe.settle_arrivals(arriving, none).groupBy("verdict").count()
    assert rows_of(got) == [("duplicate", 360), ("generated id", 39), ("new", 1)]


def test_strategies(spark):
    rows = [(1, "o1", "m", "h1"), (2, "o1", "n", "h1"), (3, "o2", "m", "h2"), (4, "o3", "", "h2"), (5, "o3", "", "h3")]
    df = spark.createDataFrame([("i", *r) for r in rows], "inbox string, num bigint, oid string, mid string, content_hash string")
    want = {"none": [1, 2, 3, 4, 5], "oid": [1, 3, 4], "mid": [1, 2, 4], "content": [1, 3, 5]}
    for strategy, nums in want.items():
        assert sorted(r.num for r in dedupe.dedupe(df, strategy).collect()) == nums
    assert rows_of(dedupe.dedupe_against(df, df.limit(1)).select("num")) == [(3,), (5,)]
    with pytest.raises(ValueError):
        dedupe.dedupe(df, "other")


def test_article_numbers_repeat_across_inboxes(spark):
    rows = [("A", 5, "o1", "m1", "h1"), ("B", 5, "o2", "m2", "h2"), ("C", 4, "o2", "m2", "h2")]
    df = spark.createDataFrame(rows, "inbox string, num bigint, oid string, mid string, content_hash string")
    for strategy in ("content", "oid", "mid"):
        assert sorted((r.inbox, r.num) for r in dedupe.dedupe(df, strategy).collect()) == [("A", 5), ("C", 4)]


def test_differences_with_repeated_components(spark):
    schema = "group bigint, docid bigint, component string, value string"
    mine = spark.createDataFrame([(1, 2, "ref", "a"), (1, 2, "ref", "b"), (1, 2, "new", "x"), (1, 3, "ref", "a"), (9, 4, "ref", "a")], schema)
    base = spark.createDataFrame([(1, 1, "ref", "b"), (1, 1, "ref", "a"), (1, 1, "old", "y")], schema).drop("docid")
    got = {tuple(r) for r in dedupe.difference_report(mine, base).select("docid", "component", "difference").collect()}
    assert got == {(2, "new", "added"), (2, "old", "removed"), (3, "old", "removed"), (3, "ref", "changed")}


def test_merged_index_add_delete(spark):
    xref = spark.createDataFrame([(1, "x", 1, "o1"), (1, "y", 5, "o1"), (2, "x", 2, "o2")], "docid bigint, inbox string, xnum bigint, oid string")
    docs = spark.createDataFrame([(1, "m1", "h1"), (2, "m2", "h2")], "docid bigint, mid string, content_hash string")
    changes = spark.createDataFrame(
        [("d", "x", None, "o1", "m1", "h1", 1), ("d", "x", None, "o2", "m2", "h2", 2), ("m", "z", 9, "o1", "m1", "h1", 3),
         ("m", "z", 10, "o7", "m7", "h7", 4), ("m", "x", 11, "o7", "m7", "h7", 5)],
        "op string, inbox string, xnum bigint, oid string, mid string, content_hash string, seq bigint")
    out = merged.apply_changes(xref, docs, changes, 2)
    assert rows_of(out["xref"]) == [(1, "y", 5, "o1"), (1, "z", 9, "o1"), (3, "x", 11, "o7"), (3, "z", 10, "o7")]
    assert rows_of(out["removed"]) == [(2,)] and rows_of(out["reindex"]) == [(1,)]
    assert rows_of(out["documents"].select("docid")) == [(1,), (3,)]


GOLDEN = [
    (1, "Hello world", "alice@x.org", "the quick brown fox\n> quoted words here\nends", 100, 10),
    (2, "Re: Hello", "bob@x.org", "brown quick the\nfox", 200, 20),
    (3, "Other", "alice@y.org", "nothing of note, quick brown", 300, 30),
]


@pytest.fixture(scope="module")
def golden(spark):
    docs = spark.createDataFrame(GOLDEN, "docid bigint, subject string, from string, body string, ds bigint, ts bigint").cache()
    return post.build_postings(post.text_fields(docs)).cache(), docs


def test_golden_searches(golden):
    index, docs = golden
    cases = [
        (p.Term("hello", "s"), [1, 2]), (p.Term("hello"), [1, 2]), (p.Term("alice", "f"), [1, 3]),
        (p.Phrase(("quick", "brown"), "b"), [1, 3]), (p.Phrase(("words", "here"), "q"), [1]),
        (p.Phrase(("here", "ends"), "b"), []), (p.Phrase(("the", "quick", "brown", "fox")), [1]),
        (p.Term("quoted", "nq"), []), (p.Term("quoted", "q"), [1]), (p.Prefix("not"), [3]),
        (p.Term("fox") & ~p.Term("hello"), []), (~p.Term("hello"), [3]), (p.Term("other") | p.Term("world"), [1, 3]),
        (p.Term("brown") & p.between("ds", 150, None), [2, 3]), (p.between("ts", None, 20), [1, 2]),
        (p.And([p.Term("brown"), p.Or([p.Term("alice"), p.Term("bob")]), p.Not(p.Term("other"))]), [1, 2]),
    ]
    for predicate, want in cases:
        got = sorted(r.docid for r in p.search(index, docs, predicate).collect())
        assert got == want, predicate


def test_stemmed_search(spark, golden):
    from archivelake.functions.stem import with_stems

    index, docs = golden
    got = p.search(with_stems(index), docs, p.Stem("quotes", "q") | p.Stem("noted"))
    assert sorted(r.docid for r in got.collect()) == [1, 3]


def test_wildcards_and_many_conditions(spark, golden):
    index, docs = golden
    terms = [r.term for r in post.expand_prefix(index, "", ["nonquoted", "subject"]).collect()]
    assert len(terms) > 3 and len(set(terms)) == len(terms)
    found = p.search(index, docs, p.Prefix("")).count()
    either = p.Or([*[p.Term(f"nosuch{i}") for i in range(130)], p.Prefix("")])
    assert p.search(index, docs, either).count() == found > 0
    assert p.search(index, docs, p.And([p.Not(p.Term(f"nosuch{i}")) for i in range(130)])).count() == docs.count()


def test_scores_pages_and_quoted_weight(spark, golden):
    index, docs = golden
    scores = {r.docid: r.score for r in rank.bm25(index, ["brown"]).collect()}
    assert set(scores) == {1, 2, 3}
    assert {r.docid: r.score for r in rank.bm25(index, ["quoted"]).collect()} == {1: 0}
    hits = docs.withColumn("score", F.lit(1))
    order = rank.sort_order(0)
    assert [r.docid for r in rank.page(hits, order, 2).collect()] == [3, 2]
    assert [r.docid for r in rank.page(hits, order, 2, offset=-1).collect()] == [1, 2]
    assert [r.docid for r in rank.page(hits, rank.sort_order(-1), 1, 1).collect()] == [2]


def test_globs_and_groups(spark):
    names = spark.createDataFrame([("a.b",), ("a.c",), ("ab",), ("x/y",)], "inbox string")

    def kept(condition):
        return sorted(r.inbox for r in names.where(condition).collect())

    name = F.col("inbox")
    assert kept(overview.newsgroup_filter(name, "a.*!a.c")) == ["a.b"]
    assert kept(name.rlike(overview.glob_regex("a{.b,b}"))) == ["a.b", "ab"]
    assert kept(name.rlike(overview.glob_regex("*"))) == ["a.b", "a.c", "ab"]
    assert kept(name.rlike(overview.wildmat_regex("?[!.]*"))) == ["ab", "x/y"]


def test_lineage_with_loop_and_short_ids(spark):
    edges = spark.createDataFrame(
        [(1, 1, "0000000", "aaaaaaa1"), (2, 2, "aaaaaaa1f", "bbbbbbb2"), (3, 3, "bbbbbbb", "ccccccc3"),
         (4, 4, "fffffff9", "eeeeeee9"), (5, 5, "eeeeeee9", "fffffff9")],
        "docid bigint, ts bigint, pre string, post string")
    want = spark.createDataFrame([("ccccccc",), ("eeeeeee9aa",)], "oid string")
    got = rows_of(patches.lineage(edges, want).select("want", "step", "docid"))
    assert got == [("ccccccc", 0, 3), ("ccccccc", 1, 2), ("ccccccc", 2, 1), ("eeeeeee9aa", 0, 4), ("eeeeeee9aa", 1, 5)]


def test_annotation_rules(spark):
    def changed(old, new):
        array = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
        return spark.range(1).select(ann.keywords_changed(array(old), array(new)).alias("c")).first().c

    assert not changed(["seen", "forwarded"], ["seen"]) and not changed(["forwarded"], ["forwarded"])
    assert changed(["seen"], ["seen", "draft"])


RAW = "From: a@x.org\nSubject: n{0}\nMessage-ID: <{1}>\nDate: 1 Jan 2020 00:00:00 +0000\n\nbody {2}\n"


def test_ingest_in_two_runs_equals_one(spark, tmp_path):
    def put(name, rows):
        df = spark.createDataFrame([(i, s, RAW.format(s, m, b).encode()) for i, s, m, b in rows], "inbox string, seq bigint, raw binary")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run(source, base):
        stream = stream_files(spark, str(tmp_path / source), "inbox string, seq bigint, raw binary", max_files=1)
        ingest.ingest(stream, str(tmp_path / base), available_now=True).awaitTermination()
        return read_table(spark, str(tmp_path / base / "messages"), ingest.MESSAGES)

    put("in", [("x", 1, "a@z", "1"), ("y", 2, "a@z", "1"), ("x", 3, "b@z", "2")])
    assert run("in", "out").count() == 3
    assert run("in", "out").count() == 3  # nothing new
    put("in", [("x", 4, "b@z", "2"), ("x", 5, "c@z", "3")])
    got = run("in", "out")
    # Message 4 has a new subject, so it keeps its place under a made-up id.
    assert sorted((r.inbox, r.num, r.seq) for r in got.collect()) == [("x", 1, 1), ("x", 2, 3), ("x", 3, 4), ("x", 4, 5), ("y", 1, 2)]
    removals = got.where("seq = 1").select(F.lit(None).cast("string").alias("inbox"), "mid", "content_hash", F.lit(9).cast("bigint").alias("seq"))
    assert ingest.current_messages(got, removals).count() == 4


def _edges(spark, rows):
    return spark.createDataFrame(rows, "docid bigint, ts bigint, pre string, post string")


def test_lineage_keeps_blobs_apart_that_share_seven_digits(spark):
    from archivelake.operators import patches

    edges = _edges(spark, [
        (1, 1, "0000000", "aaaaaaa111"), (2, 2, "0000000", "aaaaaaa222"), (3, 3, "aaaaaaa111", "bbbbbbb333"),
        (4, 4, "aaaaaaa2", "ccccccc444"), (5, 5, "aaaaaaa", "ddddddd555"),
    ])
    wanted = spark.createDataFrame([("bbbbbbb",), ("ccccccc444",), ("ddddddd555",), ("aaaaaaa222",)], "oid string")
    got = {(r.want, r.step, r.docid, r.ambiguous) for r in patches.lineage(edges, wanted).collect()}
    assert got == {
        ("bbbbbbb", 0, 3, False), ("bbbbbbb", 1, 1, False), ("ccccccc444", 0, 4, False), ("ccccccc444", 1, 2, False),
        ("ddddddd555", 0, 5, True), ("aaaaaaa222", 0, 2, False),
    }


def test_lineage_tells_unclear_wanted_ids(spark):
    """A wanted id that fits two blobs, one too short to tell, and one that fits one."""
    from archivelake.operators import patches

    edges = _edges(spark, [(1, 1, "0000000", "aaaaaaa111"), (2, 2, "0000000", "aaaaaaa222"), (3, 3, "0000000", "bbbbbbb333")])
    wanted = spark.createDataFrame([("aaaaaaa",), ("aaaa",), ("bbbbbbb",), ("bbbbbbb",), (None,)], "oid string")
    got = sorted(tuple(r) for r in patches.lineage(edges, wanted).collect())
    assert got == [
        ("aaaa", 0, None, None, None, True), ("aaaaaaa", 0, None, None, None, True),
        ("bbbbbbb", 0, "bbbbbbb333", "0000000", 3, False),
    ]


def test_long_histories_and_loops_end(spark):
    from archivelake.operators import patches

    names = [f"{i:010x}" for i in range(1, 301)]
    rows = [(i, i, names[i - 1] if i else "0000000000", n) for i, n in enumerate(names)]
    rows += [(900, 900, "fffffff002", "fffffff001"), (901, 901, "fffffff001", "fffffff002")]
    wanted = spark.createDataFrame([(names[-1],), ("fffffff001",)], "oid string")
    got = patches.lineage(_edges(spark, rows), wanted).groupBy("want").count()
    assert {tuple(r) for r in got.collect()} == {(names[-1], 300), ("fffffff001", 2)}


def _rounds(monkeypatch):
    """Sizes that are counted from now on, one for each round and two besides."""
    sizes, count = [], patches.durable_count
    monkeypatch.setattr(patches, "durable_count", lambda *a: sizes.append(got := count(*a)) or got)
    return sizes


def test_lineage_follows_a_file_in_few_rounds(spark, monkeypatch):
    names = [f"{i:010x}" for i in range(1, 301)]
    rows = [(i, i, names[i - 1] if i else "0000000000", n, "a.txt", "a.txt") for i, n in enumerate(names)]
    edges = spark.createDataFrame(rows, "docid bigint, ts bigint, pre string, post string, path_a string, path_b string")
    wanted = spark.createDataFrame([(names[-1],)], "oid string")
    sizes = _rounds(monkeypatch)
    got = {(r.step, r.docid, r.pre) for r in patches.lineage(edges, wanted).collect()}
    assert got == {(299 - i, i, pre) for i, _, pre, *_ in rows}
    assert len(sizes) <= 4  # eleven when every patch is a step of its own


def test_lineage_to_a_known_blob_in_few_rounds(spark, monkeypatch):
    names = [f"{i:010x}" for i in range(1, 301)]
    rows = [(i, i, names[i - 1] if i else "0000000000", n, None, "a.txt") for i, n in enumerate(names)]
    edges = spark.createDataFrame(rows, "docid bigint, ts bigint, pre string, post string, path_a string, path_b string")
    wanted, known = (spark.createDataFrame([(x,)], "oid string") for x in (names[-1], names[100]))
    sizes = _rounds(monkeypatch)
    got = {(r.step, r.docid, r.pre) for r in patches.lineage(edges, wanted, known).collect()}
    assert got == {(299 - i, i, pre) for i, _, pre, *_ in rows[101:]}
    assert len(sizes) <= 4


def test_lineage_equals_a_plain_walk(spark, monkeypatch):
    """Branches, loops, patches out of order, blobs made again and files that go on in another one."""
    rng = random.Random(5)
    for width, known in ((3, None), (7, 2), (50_000, None)):
        monkeypatch.setattr(patches, "WIDTH", width, raising=False)
        names = [f"{i:08x}aa" for i in range(1, 41)]
        rows = [
            (len(names) * again + i, i if rng.random() < 0.7 else rng.randrange(40),
             names[i - 1] if i and rng.random() < 0.8 else rng.choice(["0000000000", *names]), post, None, f"f{rng.randrange(2) * (rng.random() < 0.3)}")
            for again in range(2) for i, post in enumerate(names) if not again or rng.random() < 0.3
        ]
        wants, stops = rng.sample(names, 8), rng.sample(names, known or 0)
        newest = {}
        for docid, ts, pre, post, *_ in rows:
            if pre != post and post not in stops:
                newest[post] = max(newest.get(post, (ts, docid, pre)), (ts, docid, pre))
        walked = []
        for want in wants:
            blob, seen = want, []
            while blob in newest and blob not in seen:
                walked.append((want, len(seen), blob, newest[blob][2], newest[blob][1], False))
                seen.append(blob)
                blob = newest[blob][2]
        edges = spark.createDataFrame(rows, "docid bigint, ts bigint, pre string, post string, path_a string, path_b string")
        oids = [spark.createDataFrame([(x,) for x in xs], "oid string") for xs in (wants, stops)]
        got = patches.lineage(edges, oids[0], oids[1] if known else None).collect()
        assert sorted(tuple(r) for r in got) == sorted(walked)


def test_peers_and_places_as_rows(spark):
    from archivelake.operators import annotations as ann
    from archivelake.operators import merged

    xref = spark.createDataFrame([(1, "a", 1), (1, "b", 7), (1, "c", 9), (2, "a", 2)], "docid bigint, inbox string, xnum bigint")
    got = merged.peers_of(xref.where("inbox = 'a'"), xref).select("docid", "peer_inbox", "peer_xnum")
    assert {tuple(r) for r in got.collect()} == {(1, "b", 7), (1, "c", 9)}
    places = spark.createDataFrame([("o", "f", 1, None), ("o", "f", 1, None), ("o", "g", None, "n"), ("p", "f", 2, None)],
                                   "oid string, folder string, uid bigint, name string")
    assert ann.blob_places(places).count() == 3
    assert ann.blob_places(places, places.where("oid = 'o'")).count() == 2


def test_stored_index_reads_touched_buckets_only(spark, golden, tmp_path):
    from archivelake.operators import term_store

    _, docs = golden
    fields = post.text_fields(docs)
    path = str(tmp_path / "index")
    first = docs.agg(F.min("docid")).first()[0]
    term_store.add_documents(fields.where(F.col("docid") == first), path, 0)
    for _ in range(2):  # a batch written again replaces itself
        term_store.add_documents(fields.where(F.col("docid") != first), path, 1)
    whole = post.build_postings(fields)
    assert rows_of(term_store.read_postings(spark, path).select("docid", "field", "term", "wdf")) == rows_of(
        whole.select("docid", "field", "term", "wdf"))
    assert rows_of(term_store.scores(spark, path, ["brown"])) == rows_of(rank.bm25(whole, ["brown"]))
    plan = term_store.read_postings(spark, path, ["brown"])._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters:")[1][:120]
    for predicate in (p.Term("brown"), p.Phrase(("quick", "brown")), ~p.Term("brown"), p.Prefix("bro")):
        assert rows_of(term_store.search(spark, path, docs, predicate).select("docid")) == rows_of(
            p.search(whole, docs, predicate).select("docid"))


def test_selections_of_many_notations(spark):
    cases = {
        "see <a@b> now": ("mid", "a@b", False), "https://x.org/l/a%2Bb@c/": ("mid", "a+b@c", False),
        "https://x.org/l/a@b/t.mbox.gz": ("mid", "a@b", True), "<https://x.org/l/a@b/T/>.": ("mid", "a@b", True),
        "https://x.org/l/plain/raw": ("mid", "plain", False), "http://x.org/l/": (None, None, False),
        "nntp://h/group/a@b": ("mid", "a@b", False), "news:a@b,": ("mid", "a@b", False), "id:a@b": ("mid", "a@b", False),
        "blob:0123abc": ("blob", "0123abc", False), "blob:xyz": (None, None, False), "IMAPS://h/INBOX": ("folder", "IMAPS://h/INBOX", False),
        "put in maildir:/a b/c": ("folder", "maildir:/a b/c", False), "": (None, None, False), "no words here": (None, None, False),
        "x: y id:q@z blob:1234567": ("mid", "q@z", False),
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "input string")
    got = {r.input: (r.kind, r.value, r.threads) for r in lookup.selections(df).collect()}
    assert got == {**cases, None: (None, None, False)}


def test_reader_without_a_mark_has_every_message(spark):
    msgs = spark.createDataFrame([("i", n, 10) for n in range(1, 6)], "inbox string, num bigint, bytes bigint")
    readers = spark.createDataFrame([("a", "i", None), ("b", "i", 3)], "user string, inbox string, last_del bigint")
    got = {r.user: r.messages for r in overview.maildrop_stat(msgs, readers).collect()}
    assert got == {"a": 5, "b": 2}


def _texts(spark, rows):
    return post.text_fields(spark.createDataFrame(rows, "docid bigint, body string"))


def test_stored_index_counts_committed_batches_and_newest_documents(spark, tmp_path):
    from archivelake.operators import term_store

    path = str(tmp_path)
    term_store.add_documents(_texts(spark, [(1, "red fox"), (2, "red hen")]), path, 0)
    term_store.add_documents(_texts(spark, [(2, "blue hen"), (3, "red cow")]), path, 1)

    def df():
        return {(r.term, r.df) for r in term_store.frequencies(spark, path).collect()}

    want = {("red", 2), ("fox", 1), ("blue", 1), ("hen", 1), ("cow", 1)}
    assert df() == want and {r.docid for r in term_store.read_lengths(spark, path).collect()} == {1, 2, 3}
    # A batch that was left without its mark does not count, and may be written again.
    (tmp_path / "_marks" / "1-again").unlink()
    assert df() == {("red", 2), ("fox", 1), ("hen", 1)}
    term_store.add_documents(_texts(spark, [(2, "blue hen"), (3, "red cow")]), path, 1)
    assert df() == want
    # Writing an older batch again leaves the newer document in place.
    term_store.add_documents(_texts(spark, [(1, "red fox"), (2, "red hen")]), path, 0)
    assert df() == want


def test_stored_dictionaries_for_wildcards_and_stems(spark, tmp_path):
    from archivelake.functions.stem import with_stems
    from archivelake.operators import term_store

    rng = random.Random(4)
    many = [f"ab{k:04d}" for k in range(1500)] + ["connect", "connected", "connecting", "connection", "other", "abacus"]
    rows = [(k, " ".join(rng.sample(many, 12))) for k in range(400)]
    docs = spark.createDataFrame(rows, "docid bigint, body string")
    path = str(tmp_path)
    for batch in (0, 1):
        term_store.add_documents(post.text_fields(docs.where(F.col("docid") % 2 == batch)), path, batch)
    whole = with_stems(post.build_postings(post.text_fields(docs)))

    def found(predicate):
        return {r.docid for r in term_store.search(spark, path, docs, predicate).collect()}

    for predicate in (p.Prefix("ab"), p.Prefix("ab07"), p.Stem("connections"), ~p.Stem("connect") & p.Prefix("ab1"),
                      p.Stem("nothing") | p.Prefix("zz"), p.Term("other") & ~p.Prefix("ab00")):
        assert found(predicate) == {r.docid for r in p.search(whole, docs, predicate).collect()}
    used = {w for _, body in rows for w in body.split()}
    got = {r.term for r in term_store.words_with_prefix(spark, path, "ab0").collect()}
    assert got == {w for w in used if w.startswith("ab0")} and len({w for w in used if w.startswith("ab")}) > 1000
    assert {r.term for r in term_store.words_with_stem(spark, path, "connects").collect()} == set(many[1500:1504])
    plan = term_store.words_with_prefix(spark, path, "ab07")._jdf.queryExecution().toString()
    assert "StringStartsWith(term,ab07)" in plan
    plan = term_store.read_postings(spark, path, [], ["ab07"])._jdf.queryExecution().toString()
    assert "StringStartsWith(term,ab07)" in plan and "PartitionFilters: [batch" in plan


def test_a_frequent_word_is_many_files(spark, tmp_path, monkeypatch):
    from archivelake.operators import term_store

    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    try:
        docs = spark.range(0, 20_000, 1, 8).selectExpr("id AS docid", "'the' AS body")
        term_store.add_documents(post.text_fields(docs), str(tmp_path), 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    bucket = term_store.buckets_of(["the"])[0]
    assert len(list(tmp_path.glob(f"postings/batch=0/bucket={bucket}/*.parquet"))) > 2
    assert term_store.frequencies(spark, str(tmp_path), ["the"]).first().df == 20_000


def test_whole_postings_equal_grouped_words(spark, monkeypatch):
    """Blocks of a document, repeated and null ids, texts without words, groups over several batches."""
    from archivelake import session

    monkeypatch.setattr(session, "BATCH_ROWS", 3)
    quoted = "a b a\n> a q\n> z\nb c a\n> q\n" * 7
    rows = [(1, quoted), (1, "a z"), (None, "a b"), (None, "q a"), (2, ""), (3, None), (4, "...")]
    rows += [(i, f"x y x {i}\n> y\n é É\nx") for i in range(5, 40)]
    fields = post.text_fields(spark.createDataFrame(rows, "docid long, body string").coalesce(1))
    plain, whole = post.build_postings(fields), post.build_postings(fields, whole=True)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, plain.collect()))
    # Words are neither shuffled nor gathered by an aggregate.
    assert "Aggregate" not in whole._jdf.queryExecution().executedPlan().toString()
    assert post.build_postings(fields, False, whole=True).columns == ["docid", "field", "term", "wdf"]
    session.short_batches(spark)


def test_stems_of_wanted_words_only(spark):
    from archivelake.functions.stem import with_stems

    rows = [(1, "noted notes is"), (2, "note Note island"), (3, "quotes 12"), (4, "")]
    index = post.build_postings(post.text_fields(spark.createDataFrame(rows, "docid long, body string")), False)
    few = with_stems(index, ["Notes", "is"])
    want = with_stems(index).where("stem in ('note', 'is')")
    assert few.columns == want.columns
    assert sorted(map(repr, few.collect())) == sorted(map(repr, want.collect()))
    assert "Join" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert with_stems(index, ["unseen"]).collect() == []


def test_diff_lines_get_short_batches(spark):
    from archivelake import session
    from archivelake.operators import patches

    for use in (patches.patch_terms, post.text_fields):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        use(spark.createDataFrame([(1, "x")], "docid long, body string"))
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(session.BATCH_ROWS)
