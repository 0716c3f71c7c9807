"""Thread forests: parents, depth and pre-order position of every message.

Parents follow the rules of JWZ threading: the last reference is the parent,
other references are linked in the order given unless already linked, and no
link may close a loop. Messages are taken by sent time.

A link can only fail for closing a loop if it lies on a cycle of candidate
links. Candidate links are compared with the time order: a cycle needs a link
that runs backward in time, and its nodes lie in the time span of such links.
Inside the spans, nodes that no cycle goes through are stripped off (see
`tangles`), so a bad clock in a sound thread leaves nothing. Everything that is
not on a cycle, or between two, is settled by aggregations alone; what is left
is walked link by link, each tangle as a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivelake.operators.ordered import neighbours, running_latest
from archivelake.operators.skew import keep_first, salted_lookup
from archivelake.operators.threads import components
from archivelake.session import durable, durable_count, work_folder

HOUR = 3_600
_REAL = 1 << 40  # sorts a message after the ghosts first named at its time


def _holders(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First message of every id, and the later ones that reuse an id."""
    rows = messages.select("tid", "docid", "mid", "refs", "ds")
    first = keep_first(rows, ["mid"], ["ds"], "docid")
    reused = rows.join(first.select("docid"), "docid", "left_anti")
    return first, reused


def candidate_links(holders: DataFrame) -> DataFrame:
    """Links (tid, parent, child, own, ds, docid, pos) in the order they are tried."""
    refs = F.filter("refs", lambda r: r != F.col("mid"))
    path = F.concat(refs, F.array("mid"))
    links = F.transform(
        F.sequence(F.lit(1), F.size(path) - 1),
        lambda i: F.struct(
            F.get(path, i - 1).alias("parent"),
            F.get(path, i).alias("child"),
            (i == F.size(path) - 1).alias("own"),
            i.alias("pos"),
        ),
    )
    with_refs = holders.where(F.size(refs) > 0)
    return with_refs.select(
        "tid", "ds", "docid", F.explode(links).alias("l")
    ).select("tid", "ds", "docid", "l.*")


def _simple_parents(links: DataFrame) -> DataFrame:
    """(child, parent): the child's own link, else the first other link."""
    order = F.struct((~F.col("own")).alias("o"), "ds", "docid", "pos")
    return links.groupBy("child").agg(F.min_by("parent", order).alias("parent"))


def _rank(holders: DataFrame, links: DataFrame) -> DataFrame:
    """(node, rank): sent time, or for a ghost the first message naming it."""
    named = links.select(
        F.col("parent").alias("node"), F.struct("ds", F.col("pos").cast("int").alias("minor")).alias("rank")
    ).groupBy("node").agg(F.min("rank").alias("rank"))
    real = holders.select(
        F.col("mid").alias("node"), F.struct("ds", F.lit(_REAL).alias("minor")).alias("rank")
    )
    ghosts = named.join(real.select("node"), "node", "left_anti")
    return real.unionByName(ghosts)


def _backward(links: DataFrame, rank: DataFrame) -> DataFrame:
    """Links whose parent is not before the child in time."""
    edges = links.select("tid", "parent", "child").distinct()
    up = rank.select(F.col("node").alias("parent"), F.col("rank").alias("p_rank"))
    down = rank.select(F.col("node").alias("child"), F.col("rank").alias("c_rank"))
    ranked = salted_lookup(edges, up, ["parent"], spread_on="child").join(down, "child")
    return ranked.where("p_rank >= c_rank")


def _inner(back: DataFrame, links: DataFrame) -> DataFrame:
    """Backward links that could lie on a cycle: not into a leaf or out of a root."""
    ends = back.select(F.col("parent").alias("node")).union(back.select(F.col("child"))).distinct()
    near = links.select("parent", "child").distinct()
    has_children = near.select(F.col("parent").alias("node")).join(ends, "node", "left_semi").distinct()
    has_parents = near.select(F.col("child").alias("node")).join(ends, "node", "left_semi").distinct()
    return back.join(has_children.withColumnRenamed("node", "child"), "child", "left_semi").join(
        has_parents.withColumnRenamed("node", "parent"), "parent", "left_semi"
    )


def _hour(rank: str) -> Column:
    return F.floor(F.col(rank)["ds"] / HOUR).cast("long")


def _spans(back: DataFrame) -> DataFrame:
    """Merged, disjoint (tid, lo, hi) time spans of the backward links of each thread."""
    reach = running_latest(
        back, ["tid"], _hour("c_rank"), ["c_rank", "p_rank", "child"], F.col("p_rank"), "reach",
        largest=True, inclusive=False,
    )
    opens = F.col("reach").isNull() | (F.col("c_rank") > F.col("reach"))
    placed = running_latest(
        reach, ["tid"], _hour("c_rank"), ["c_rank", "p_rank", "child"], F.when(opens, F.col("c_rank")), "lo"
    )
    return placed.groupBy("tid", "lo").agg(F.max("p_rank").alias("hi"))


def _inside_spans(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """(child, span) of the nodes whose rank lies in a span of their thread.

    Spans are disjoint, so the last one opened at or before a node decides.
    """
    marks = spans.select(
        "tid", F.col("lo").alias("rank"), F.struct("lo", "hi").alias("_span"), F.lit(0).alias("_kind"),
        F.lit(None).cast("string").alias("child"),
    )
    rows = nodes.select(
        "tid", "rank", F.lit(None).cast(spans.select(F.struct("lo", "hi").alias("s")).schema["s"].dataType).alias("_span"),
        F.lit(1).alias("_kind"), "child",
    ).unionByName(marks)
    found = running_latest(rows, ["tid"], _hour("rank"), ["rank", "_kind", "child"], F.col("_span"), "span")
    return found.where("_kind = 1 and rank <= span.hi").select("child", F.col("span.lo").alias("span"))


def strip(edges: DataFrame, max_rounds: int = 100) -> tuple[DataFrame, list[DataFrame]]:
    """(core, bypassed) of a graph of distinct (parent, child) edges.

    Rounds take away the edges out of nodes that have no parent and into nodes that
    have no child, and bypass nodes with one parent and one child: their two edges
    become one. Of neighbours that could both be bypassed, the one of least hash is.
    Trees lose a fixed share of their nodes in a round, long chains too, so rounds grow
    with the logarithm of the graph. `core` holds the edges that remain, every node on
    a cycle or between cycles, and is empty if there is none. `bypassed` holds a table
    (node, up, down) per round: the neighbours a node had when it was bypassed.
    """
    edges, left = durable_count(edges.select("parent", "child"), F.lit(True))
    history: list[DataFrame] = []
    for _ in range(max_rounds):
        if not left:
            break
        ends = F.array(
            F.struct(F.col("parent").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
            F.struct(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        )
        degree = edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(
            F.sum("e.up").alias("up"), F.sum("e.down").alias("down")
        )
        above = degree.select(
            F.col("node").alias("parent"), F.col("up").alias("p_up"), ((F.col("up") == 1) & (F.col("down") == 1)).alias("p_thin")
        )
        below = degree.select(
            F.col("node").alias("child"), F.col("down").alias("c_down"), ((F.col("up") == 1) & (F.col("down") == 1)).alias("c_thin")
        )
        # A node may have very many children; it has few different parents.
        met = salted_lookup(edges, above, ["parent"], spread_on="child").join(below, "child")
        kept = durable(met.where("p_up > 0 and c_down > 0").select("parent", "child", "p_thin", "c_thin"))
        # Thin nodes have one edge each way, so neither side repeats a key.
        into = kept.where("c_thin and parent <> child").select(
            F.col("child").alias("node"), F.col("parent").alias("up"), F.col("p_thin").alias("up_thin")
        )
        out = kept.where("p_thin and parent <> child").select(
            F.col("parent").alias("node"), F.col("child").alias("down"), F.col("c_thin").alias("down_thin")
        )
        own = F.struct(F.xxhash64("node"), F.col("node"))
        first = (~F.col("up_thin") | (own < F.struct(F.xxhash64("up"), F.col("up")))) & (
            ~F.col("down_thin") | (own < F.struct(F.xxhash64("down"), F.col("down")))
        )
        chosen, any_chosen = durable_count(into.join(out, "node").where(first).select("node", "up", "down"), F.lit(True))
        if any_chosen:
            history.append(chosen)
        gone = chosen.select(F.col("node").alias("child"))
        stays = kept.where("not c_thin").unionByName(kept.where("c_thin").join(gone, "child", "left_anti"))
        stays = stays.where("not p_thin").unionByName(
            stays.where("p_thin").join(gone.withColumnRenamed("child", "parent"), "parent", "left_anti")
        )
        before = left
        edges, left = durable_count(
            stays.select("parent", "child").unionByName(
                chosen.select(F.col("up").alias("parent"), F.col("down").alias("child"))
            ).distinct(), F.lit(True),
        )
        if left == before:
            break
    else:
        raise RuntimeError(f"links were not stripped in {max_rounds} rounds")
    return edges, history


def tangles(edges: DataFrame) -> DataFrame:
    """(node, tangle) of the nodes on cycles of the (parent, child) edges, or between two.

    Nodes that are connected by such nodes share a tangle, named by one of them. The
    core that `strip` leaves is coloured by connected components; a bypassed node is in
    the tangle that both ends of its bypass are in, from the last round to the first.
    """
    core, bypassed = strip(edges.select("parent", "child").distinct())
    core, left = durable_count(core, F.lit(True))
    names = core.select(F.col("parent").alias("node")).union(core.select("child")).distinct()
    if not left:
        return names.select("node", F.col("node").alias("tangle"))
    pairs = core.where("parent <> child").select(
        F.greatest("parent", "child").alias("a"), F.least("parent", "child").alias("b")
    ).distinct()
    inside = durable(names.join(components(pairs), "node", "left").select(
        "node", F.coalesce("root", "node").alias("tangle")
    ))
    for chosen in reversed(bypassed):
        # A node's neighbours were bypassed in later rounds than itself, if ever.
        ends = inside.select(F.col("node").alias("up"), F.col("tangle"))
        under = inside.select(F.col("node").alias("down"), F.col("tangle").alias("other"))
        between = salted_lookup(
            salted_lookup(chosen, ends, ["up"], spread_on="node"), under, ["down"], spread_on="node"
        ).where("tangle = other").select("node", "tangle")
        # A written table: the optimizer would carry what a checkpoint's plan implied of
        # its columns from round to round, ever more of it.
        path = work_folder(inside.sparkSession, "tangles")
        inside.unionByName(between).write.parquet(path)
        inside = inside.sparkSession.read.schema("node string, tangle string").parquet(path)
    return inside


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Try the links of each tangle in order, refusing any that closes a loop.

    Rows come sorted by tangle and order, so only one tangle is held at a time.
    """
    at, parent, children = None, {}, {}
    for batch in batches:
        out: list[tuple[str, str | None]] = []
        for tangle, up, child, own in zip(batch.tangle, batch.parent, batch.child, batch.own):
            if tangle != at:
                out += [(c, parent.get(c)) for c in children]
                at, parent, children = tangle, {}, {}
            children[child] = None
            if not own and child in parent:
                continue
            node, seen = up, set()
            while node is not None and node != child and node not in seen:
                seen.add(node)
                node = parent.get(node)
            if node is None:
                parent[child] = up
        yield pd.DataFrame(out, columns=["child", "parent"])
    yield pd.DataFrame([(c, parent.get(c)) for c in children], columns=["child", "parent"])


def parents(messages: DataFrame) -> DataFrame:
    """(tid, node, parent, docid, ds, is_ghost, reused) of every thread node.

    `node` is the id for first holders and ghosts; a message reusing an id has
    the node name `<id>` NUL `<docid>` and hangs below the first holder.
    """
    holders, reused = _holders(messages)
    holders = durable(holders)
    links = durable(candidate_links(holders))
    simple = _simple_parents(links)
    rank = _rank(holders, links)
    back, found = durable_count(_backward(links, rank), F.lit(True))
    resolved = simple
    if found:
        back, found = durable_count(_inner(back, links), F.lit(True))
    if found:
        spans = _spans(back)
        nodes = links.select("tid", "child").distinct().join(
            rank.withColumnRenamed("node", "child"), "child"
        )
        inside = durable(_inside_spans(nodes, spans))
        near = inside.select(F.col("child").alias("parent"), F.col("span").alias("p_span"))
        edges = salted_lookup(
            links.select("parent", "child").distinct().join(inside, "child"), near, ["parent"], spread_on="child"
        ).where("span = p_span")
        knots = tangles(edges).withColumnRenamed("node", "child")
        tangled = salted_lookup(links, knots, ["child"], spread_on="docid")
        walked = durable(
            tangled.select("tangle", "parent", "child", "own", "ds", "docid", "pos")
            .repartition("tangle")
            .sortWithinPartitions("tangle", "ds", "docid", "pos")
            .mapInPandas(_walk, "child string, parent string")
        )
        resolved = (
            simple.join(walked.select("child"), "child", "left_anti")
            .unionByName(walked.where("parent is not null"))
        )
    named = links.select(F.col("tid"), F.col("parent").alias("node")).union(
        links.select("tid", F.col("child").alias("node"))
    ).groupBy("node").agg(F.min("tid").alias("tid"))
    real = holders.select("tid", F.col("mid").alias("node"), "docid", "ds")
    ghost = named.join(real.select("node"), "node", "left_anti").select(
        "tid", "node", F.lit(None).cast("bigint").alias("docid"), F.lit(None).cast("bigint").alias("ds")
    )
    base = real.unionByName(ghost).join(
        resolved.withColumnRenamed("child", "node"), "node", "left"
    )
    again = reused.select(
        "tid",
        F.concat("mid", F.lit("\u0000"), F.col("docid").cast("string")).alias("node"),
        "docid", "ds", F.col("mid").alias("parent"),
    )
    return (
        base.select("tid", "node", "docid", "ds", "parent")
        .unionByName(again)
        .withColumn("is_ghost", F.col("docid").isNull())
        .withColumn("reused", F.contains("node", F.lit("\u0000")))
    )


def _sort_times(nodes: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Add `key`: own sent time, or for a ghost the least one below it.

    Ghost chains are folded by doubling, so the rounds grow with the logarithm
    of the longest run of ghosts.
    """
    real = nodes.where(~F.col("is_ghost")).select("node", "parent", "ds")
    ghost = nodes.where("is_ghost").select("node", "parent")
    below = real.groupBy(F.col("parent").alias("node")).agg(F.min("ds").alias("key"))
    up = ghost.select(F.col("node").alias("jump"))
    state, left = durable_count(
        ghost.join(below, "node", "left").withColumnRenamed("parent", "jump").join(
            up.withColumn("_g", F.lit(True)), "jump", "left"
        ).select("node", "key", F.when(F.col("_g"), F.col("jump")).alias("jump")),
        F.col("jump").isNotNull(),
    )
    for _ in range(max_rounds):
        if not left:
            break
        lifted = state.where("jump is not null").groupBy(F.col("jump").alias("node")).agg(
            F.min("key").alias("low")
        )
        further = state.select(F.col("node").alias("jump"), F.col("jump").alias("next"))
        state, left = durable_count(
            state.join(lifted, "node", "left").join(further, "jump", "left").select(
                "node", F.least("key", "low").alias("key"), F.col("next").alias("jump")
            ),
            F.col("jump").isNotNull(),
        )
    if left:
        raise RuntimeError(f"runs of ghosts did not fold in {max_rounds} rounds")
    keyed = nodes.join(state.select("node", F.col("key").alias("_k")), "node", "left")
    return keyed.withColumn("key", F.coalesce("ds", "_k")).drop("_k")


def preorder(nodes: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Add root, depth, position and subtree size to `parents` rows.

    Position is the 0-based place in the pre-order walk of the tree. It comes
    from ranking the tour that enters and leaves every node, by pointer
    doubling: rounds grow with the logarithm of the tree size and every round is
    an equi-join on unique tour steps, whatever the shape of the tree.
    """
    keyed = durable(
        _sort_times(nodes)
        .withColumn("key", F.coalesce("key", F.lit(0)))
        .withColumn("_late", (~F.col("reused")).cast("int"))
        .repartition("node")
    )
    kids = keyed.where("parent is not null")
    # Reused ids come first below their holder, then children by time.
    order = kids.withColumn("_place", F.col("key"))
    order = neighbours(
        order.withColumn("_sib", F.concat(F.col("_late").cast("string"), F.lit("\u0000"), "parent")),
        ["_sib"], "_place", "node", ties=["docid", "node"], width=HOUR,
    )
    ends = kids.groupBy("parent").agg(
        F.min_by("node", F.struct("_late", "key", "docid", "node")).alias("first"),
        F.min_by(F.when(F.col("_late") == 1, F.col("node")),
                 F.when(F.col("_late") == 1, F.struct("key", "docid", "node"))).alias("first_late"),
    )
    # The last reused id is followed by the first ordinary child.
    after = salted_lookup(
        order.select("node", "parent", "next", "_late"),
        ends.select("parent", "first_late"), ["parent"], spread_on="node",
    ).select(
        "node",
        F.coalesce("next", F.when(F.col("_late") == 0, F.col("first_late"))).alias("next"),
    )
    shape = (
        keyed.select("node", "parent")
        .join(ends.select(F.col("parent").alias("node"), "first"), "node", "left")
        .join(after, "node", "left")
    )
    enter = shape.select(
        F.concat(F.lit("+"), "node").alias("arc"),
        F.coalesce(F.concat(F.lit("+"), "first"), F.concat(F.lit("-"), "node")).alias("to"),
        F.lit(1).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("d"),
    )
    leave = shape.select(
        F.concat(F.lit("-"), "node").alias("arc"),
        F.coalesce(F.concat(F.lit("+"), "next"), F.concat(F.lit("-"), "parent")).alias("to"),
        F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("d"),
    )
    going = F.col("to").isNotNull()
    state, left = durable_count(enter.unionByName(leave).withColumn("last", F.col("arc")), going)
    for _ in range(max_rounds):
        if not left:
            break
        target = state.select(
            F.col("arc").alias("to"), F.col("to").alias("to2"),
            F.col("n").alias("n2"), F.col("d").alias("d2"), F.col("last").alias("last2"),
        )
        # A step is the target of at most one moving step: keys are unique.
        jumped = state.where(going).join(target, "to").select(
            "arc", F.col("to2").alias("to"), (F.col("n") + F.col("n2")).alias("n"),
            (F.col("d") + F.col("d2")).alias("d"), F.col("last2").alias("last"),
        )
        # Without this the partitions of both sides would add up round by round.
        state, left = durable_count(
            jumped.unionByName(state.where(~going)).repartition("arc"), going
        )
    else:
        raise RuntimeError("a thread walk did not end; parents hold a loop")
    into = state.where(F.col("arc").startswith("+")).select(
        F.expr("substring(arc, 2)").alias("node"), F.expr("substring(last, 2)").alias("root"),
        (-F.col("d")).alias("depth"), F.col("n").alias("_left"),
    )
    out = state.where(F.col("arc").startswith("-")).select(
        F.expr("substring(arc, 2)").alias("node"), F.col("n").alias("_after")
    )
    placed = keyed.drop("_late").join(into, "node").join(out, "node")
    totals = placed.where("node = root").select("root", F.col("_left").alias("_all"))
    return (
        salted_lookup(placed, totals, ["root"], spread_on="node")
        .withColumn("position", F.col("_all") - F.col("_left"))
        .withColumn("subtree", F.col("_left") - F.col("_after"))
        .drop("_left", "_after", "_all")
    )


def visible(walked: DataFrame) -> DataFrame:
    """Drop ghost roots that have no children."""
    return walked.where(~(F.col("is_ghost") & (F.col("subtree") == 1) & F.col("parent").isNull()))


def skeleton(walked: DataFrame, messages: DataFrame) -> DataFrame:
    """Thread listing: roots by time, members in walk order, ghosts marked."""
    text = messages.select("docid", "subject", F.col("from").alias("author"))
    roots = walked.where("node = root").select("root", F.col("key").alias("root_key"))
    rows = salted_lookup(walked, roots, ["root"], spread_on="node").join(text, "docid", "left")
    return rows.select(
        "root", "root_key", "position", "depth", "node", "docid", "ds",
        F.when(F.col("is_ghost"), F.lit("[not found]")).otherwise(F.col("subject")).alias("subject"),
        "author",
    )


def family_counts(walked: DataFrame) -> DataFrame:
    """Per node: siblings, replies, and the nodes before and after it."""
    replies = walked.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.count("*").alias("replies")
    )
    of_parent = replies.select(F.col("node").alias("parent"), (F.col("replies") - 1).alias("siblings"))
    kids = salted_lookup(
        walked.where("parent is not null"), of_parent, ["parent"], spread_on="node"
    ).select("node", "siblings")
    beside = neighbours(
        walked.where("parent is not null"), ["parent"], "position", "node",
        previous="prev_sibling", following="next_sibling",
    ).select("node", "prev_sibling", "next_sibling")
    return (
        walked.select("root", "node", "depth", "position")
        .join(replies, "node", "left").join(kids, "node", "left").join(beside, "node", "left")
        .fillna(0, ["replies", "siblings"])
    )


def roots_for(walked: DataFrame, mid: str) -> DataFrame:
    """Roots with the wanted message's first, the others newest first."""
    wanted = walked.where(F.col("node") == mid).select("root").distinct()
    roots = walked.where("node = root").select("root", "key")
    # `wanted` is the root of one node: a single row.
    marked = roots.join(F.broadcast(wanted.withColumn("holds", F.lit(True))), "root", "left")
    return marked.withColumn("holds", F.coalesce("holds", F.lit(False))).orderBy(
        F.desc("holds"), F.desc("key"), "root"
    )
