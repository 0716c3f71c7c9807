"""Threads and forests against sequential brute force on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from archivelake.operators import forest, threads
from archivelake.operators.topics import topics

SCHEMA = "docid bigint, mid string, mids array<string>, refs array<string>, ds bigint, subject string, from string"


def frame(spark, rows):
    """rows: (docid, mid, refs, ds)."""
    return spark.createDataFrame(
        [(n, mid, [mid], refs, ds, f"s {mid}", "a@x.org") for n, mid, refs, ds in rows], SCHEMA
    )


def brute_threads(rows):
    parts = []
    for n, mid, refs, _ in rows:
        ids, docs = {mid, *refs}, {n}
        rest = []
        for other_ids, other_docs in parts:
            if other_ids & ids:
                ids |= other_ids
                docs |= other_docs
            else:
                rest.append((other_ids, other_docs))
        parts = rest + [(ids, docs)]
    return {d: min(docs) for _, docs in parts for d in docs}


def brute_parents(rows):
    """Links tried one by one over all messages, oldest first."""
    holder, reused = {}, []
    for row in sorted(rows, key=lambda r: (r[3], r[0])):
        if row[1] in holder:
            reused.append(row)
        else:
            holder[row[1]] = row
    parent = {}

    def loops(child, node):
        seen = set()
        while node is not None and node not in seen:
            if node == child:
                return True
            seen.add(node)
            node = parent.get(node)
        return False

    nodes = set(holder)
    for _, mid, refs, _ in sorted(holder.values(), key=lambda r: (r[3], r[0])):
        refs = [r for r in refs if r != mid]
        nodes |= set(refs)
        for a, b in zip(refs, refs[1:]):
            if b not in parent and not loops(b, a):
                parent[b] = a
        if refs and not loops(mid, refs[-1]):
            parent[mid] = refs[-1]
    out = {n: parent.get(n) for n in nodes}
    for n, mid, _, _ in reused:
        out[f"{mid}\0{n}"] = mid
    return out


def check_forest(spark, rows):
    df = threads.assign_threads(frame(spark, rows))
    assert {r.docid: r.tid for r in df.select("docid", "tid").collect()} == brute_threads(rows)
    nodes = forest.parents(df)
    want = brute_parents(rows)
    assert {r.node: r.parent for r in nodes.collect()} == want
    walked = forest.preorder(nodes).collect()
    assert len(walked) == len(want)
    by_node = {r.node: r for r in walked}
    for node, up in want.items():
        r = by_node[node]
        if up is None:
            assert (r.depth, r.position, r.root) == (0, 0, node)
        else:
            assert r.depth == by_node[up].depth + 1 and r.root == by_node[up].root
            assert by_node[up].position < r.position < by_node[up].position + by_node[up].subtree
    for root in {r.root for r in walked}:
        tree = [r.position for r in walked if r.root == root]
        assert sorted(tree) == list(range(len(tree)))
    return df, by_node


def test_long_chain_in_any_order(spark):
    rows = [(i + 1, f"m{i}", [f"m{i - 1}"] if i else [], 1000 + i) for i in range(70)]
    random.Random(1).shuffle(rows)
    _, nodes = check_forest(spark, rows)
    assert nodes["m69"].depth == 69 and nodes["m69"].position == 69


def test_star_with_ghost_root(spark):
    rows = [(i + 1, f"m{i}", ["gone", "root"], 5000 - i * 7) for i in range(60)]
    _, nodes = check_forest(spark, rows)
    assert nodes["root"].parent == "gone" and nodes["gone"].subtree == 62
    order = sorted((n for n in nodes.values() if n.parent == "root"), key=lambda n: n.position)
    assert [n.ds for n in order] == sorted(n.ds for n in order)


def test_loops_and_late_clocks(spark):
    rows = [
        (1, "a", ["b"], 10), (2, "b", ["a"], 20), (3, "c", ["a", "b"], 5), (4, "d", ["c", "a"], 1),
        (5, "e", ["d", "x", "c"], 2), (6, "x", ["e"], 3), (7, "y", [], 4), (8, "z", ["y", "z"], 0),
    ]
    check_forest(spark, rows)


def test_reused_ids_hang_below_the_first_holder(spark):
    rows = [(1, "a", [], 10), (2, "b", ["a"], 11), (3, "a", ["b"], 30), (4, "c", ["a"], 12), (5, "a", [], 40)]
    _, nodes = check_forest(spark, rows)
    kids = sorted((n for n in nodes.values() if n.parent == "a"), key=lambda n: n.position)
    assert [k.node for k in kids] == ["a\0" + "3", "a\0" + "5", "b", "c"]


@pytest.mark.parametrize("seed", [3, 4])
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    names = [f"r{i}" for i in range(40)]
    rows = []
    for n in range(1, 46):
        mid = rng.choice(names)
        refs = list(dict.fromkeys(rng.sample(names, rng.choice([0, 0, 1, 1, 2, 3]))))
        rows.append((n, mid, [r for r in refs if r != mid], rng.randrange(100)))
    check_forest(spark, rows)


def brute_tangles(edges):
    """{node: tangle}: nodes that cycles reach and that reach cycles, by connection."""
    down, up = {}, {}
    for a, b in edges:
        down.setdefault(a, set()).add(b)
        up.setdefault(b, set()).add(a)
    nodes = set(down) | set(up)
    while True:
        thin = {n for n in nodes if not down.get(n, set()) & nodes or not up.get(n, set()) & nodes}
        if not thin:
            break
        nodes -= thin
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a in nodes and b in nodes:
                label[a] = label[b] = min(label[a], label[b])
    return label


SHAPES = [
    [(f"n{i}", f"n{i + 1}") for i in range(12)],
    [(f"n{i}", f"n{(i + 1) % 8}") for i in range(8)],
    [("a", "a"), ("a", "b")],
    [("a", "b"), ("b", "a"), *[(f"p{i}", f"p{i + 1}") for i in range(9)], ("b", "p0"), ("p9", "x"), ("x", "y"), ("y", "x"), ("y", "leaf")],
    [("hub", f"c{i}") for i in range(50)] + [("c7", "d"), ("d", "hub"), ("c9", "e")],
]


def test_tangles_of_shapes_and_random_graphs(spark):
    rng, shapes = random.Random(1), list(SHAPES)
    for n in (45, 70):
        shapes.append([(f"g{rng.randrange(60)}", f"g{rng.randrange(60)}") for _ in range(n)])
    edges = sorted({(f"{k}{a}", f"{k}{b}") for k, shape in enumerate(shapes) for a, b in shape})
    df = spark.createDataFrame(edges, "parent string, child string")
    got, want = {r.node: r.tangle for r in forest.tangles(df).collect()}, brute_tangles(edges)
    assert set(got) == set(want)
    assert len(set(got.values())) == len(set(want.values())) == len(set(zip(got.values(), (want[n] for n in got))))


def test_loops_of_a_thread_with_a_bad_clock_are_groups_of_their_own(spark, monkeypatch):
    """A late date puts the whole thread in one span; only messages that loop are left."""
    rows = [(1, "m0", [], 10)] + [(i + 1, f"m{i}", [f"m{i - 1}"], 10**7 if i == 3 else 1000 + i) for i in range(1, 30)]
    for k, at in enumerate((9, 22)):
        rows += [(1000 + 10 * k, f"a{at}", [f"m{at}", f"b{at}"], 500), (1001 + 10 * k, f"b{at}", [f"a{at}"], 900)]
    found = []
    whole = forest.tangles
    monkeypatch.setattr(forest, "tangles", lambda edges: found.append(whole(edges)) or found[0])
    nodes = forest.parents(threads.assign_threads(frame(spark, rows)))
    assert {r.node: r.parent for r in nodes.collect()} == brute_parents(rows)
    sizes = found[0].groupBy("tangle").count().collect()
    assert len(sizes) == 2 and all(r["count"] == 2 for r in sizes)


def test_merge_of_threads_by_late_message(spark):
    old = [(1, "a", [], 1), (2, "b", ["a"], 2), (3, "p", [], 3), (4, "q", ["p"], 4), (5, "solo", [], 5)]
    stored = threads.assign_threads(frame(spark, old))
    late = frame(spark, [(6, "k", ["b", "q"], 9), (7, "new", ["ghost"], 9)])
    moved = {r.docid: r.tid for r in threads.merge_threads(stored, late).collect()}
    assert moved == {3: 1, 4: 1, 6: 1, 7: 7}


def test_loose_matches_fill_the_room_left(spark):
    rows = [(i, f"m{i}", [], i) for i in range(1, 9)]
    df = threads.assign_threads(frame(spark, rows)).withColumn("sid", F.lit("same"))
    got = threads.loose_thread(df, "m3", limit=4).collect()
    assert [r.docid for r in got] == [3, 8, 7, 6] and got[0].total == 8
    none = threads.loose_thread(df.withColumn("sid", F.lit(None).cast("string")), "m3", limit=4)
    assert [r.docid for r in none.collect()] == [3]


def test_topics_skip_ghosts_without_replies(spark):
    rows = [(1, "a", ["ghost"], 10), (2, "b", ["ghost"], 20)]
    df, _ = check_forest(spark, rows)
    top, extra = topics(forest.preorder(forest.parents(df)), df)
    t = top.first()
    assert (t.root, t.latest, t.n, t.subject, t.mid) == ("ghost", 20, 2, "s a", "a")
    assert [(e.level, e.subject) for e in extra.collect()] == [(1, "s b")]


def test_loose_matches_are_not_cut(spark):
    df = spark.range(1500).selectExpr("id AS docid", "concat('m', id) AS mid", "array(concat('m', id)) AS mids", "id AS tid", "'same' AS sid", "id AS ds")
    got = threads.loose_thread(df, "m3").collect()
    assert len(got) == 1500 and got[0].docid == 3 and got[0].total == 1500
