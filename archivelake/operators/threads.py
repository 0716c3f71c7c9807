"""Thread ids: connected components over message and reference ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivelake.operators.skew import salted_lookup, with_group_totals
from archivelake.session import durable


def reference_edges(messages: DataFrame) -> DataFrame:
    """Distinct (a, b) pairs of ids that belong together, b < a.

    Every id of a message is tied to the least of `refs + mids`: this joins the
    same ids as all pairs would, with no more rows than ids.
    """
    chain = F.concat("refs", "mids")
    ids = messages.where(F.size(chain) > 1).select(
        F.explode(chain).alias("a"), F.array_min(chain).alias("b")
    )
    return ids.where("a <> b").distinct()


def _with_min(edges: DataFrame) -> DataFrame:
    """Rows (u, v) with `m`, the smallest of u and its neighbours."""
    return with_group_totals(
        edges, ["u"], {"m": (F.least("u", "v"), "min")}, spread_on="v"
    )


def _settled(edges: DataFrame) -> bool:
    """True when every node points at one root and no root points on."""
    ends = F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")),
    )
    nodes = edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(
        F.sum("e.out").alias("out"), F.max("e.into").alias("into")
    )
    open_nodes = nodes.where("out > 1 or (out > 0 and into > 0)")
    return open_nodes.agg(F.count("*").alias("n")).first().n == 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node but the roots; a root is its part's least id.

    Alternates the large-star and small-star steps of Kiveris et al. (2014).
    Both are a group minimum attached to the rows, salted so that a node with
    very many neighbours is spread over tasks. Rounds grow with the logarithm
    of the thread length; each is checkpointed.
    """
    current = durable(edges)
    for _ in range(max_rounds):
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            current.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        # No more rows than edges; duplicates fall together in the next step.
        large = _with_min(both).where("v > u and v <> m").select("v", "m")
        small = _with_min(large.select(F.col("v").alias("u"), F.col("m").alias("v")))
        links = F.array(
            F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("u").alias("a"), F.col("m").alias("b")),
        )
        current = durable(
            small.select(F.explode(links).alias("l")).select("l.*").where("a <> b").distinct()
        )
        if _settled(current):
            break
    else:
        raise RuntimeError(f"threads did not settle in {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def assign_threads(messages: DataFrame) -> DataFrame:
    """Add `tid`, the least docid of the messages an id path connects.

    `messages` needs docid, mids, refs. The result does not depend on arrival
    order.
    """
    labels = components(reference_edges(messages))
    # All ids of a message are in one component, so any of them will do.
    node = F.coalesce(F.get("mids", F.lit(0)), F.get("refs", F.lit(0)))
    rooted = messages.select("docid", node.alias("node")).join(labels, "node", "left").select(
        "docid", F.coalesce("root", "node", F.concat(F.lit("\u0000"), F.col("docid"))).alias("root")
    )
    with_tid = with_group_totals(
        rooted, ["root"], {"tid": (F.col("docid"), "min")}, spread_on="docid"
    )
    return messages.join(with_tid.select("docid", "tid"), "docid")


def ghosts(messages: DataFrame) -> DataFrame:
    """Referenced ids no message has, with the thread they belong to."""
    refs = (
        messages.select("tid", F.explode("refs").alias("mid")).groupBy("mid")
        .agg(F.min("tid").alias("tid"))
    )
    known = messages.select(F.explode("mids").alias("mid")).distinct()
    return refs.join(known, "mid", "left_anti")


def merge_threads(threaded: DataFrame, arrivals: DataFrame) -> DataFrame:
    """(old_tid, tid) for threads that new messages join, and tids of arrivals.

    The stored messages stand in as summary edges tid - mid, so the work grows
    with the ids the arrivals touch: only threads reached by an arriving id take
    part. Returns (docid, tid) of arrivals and of every stored message whose
    thread id changed.
    """
    touched = (
        arrivals.select(F.explode(F.concat("refs", "mids")).alias("mid")).distinct()
    )
    stored_ids = threaded.select(
        "tid", F.explode(F.array_distinct(F.concat("refs", "mids"))).alias("mid")
    )
    reached = salted_lookup(stored_ids, touched, ["mid"], spread_on="tid").distinct()
    tag = F.concat(F.lit("\u0001"), F.col("tid").cast("string"))
    summary = reached.select(
        F.greatest(tag, "mid").alias("a"), F.least(tag, "mid").alias("b")
    )
    labels = components(reference_edges(arrivals).union(summary).distinct())
    old = (
        reached.select("tid").distinct().withColumn("node", tag)
        .join(labels, "node", "left").select(F.coalesce("root", "node").alias("root"), "tid")
    )
    node = F.coalesce(F.get("mids", F.lit(0)), F.get("refs", F.lit(0)))
    new = (
        arrivals.select("docid", node.alias("node")).join(labels, "node", "left")
        .select("docid", F.coalesce("root", "node", F.concat(F.lit("\u0000"), F.col("docid"))).alias("root"))
    )
    best = (
        old.select("root", "tid").union(new.select("root", F.col("docid").alias("tid")))
        .groupBy("root").agg(F.min("tid").alias("new_tid"))
    )
    moved = old.join(best, "root").where("tid <> new_tid").select(
        F.col("tid").alias("old_tid"), F.col("new_tid").alias("tid")
    )
    changed = salted_lookup(
        threaded.select("docid", F.col("tid").alias("old_tid")), moved, ["old_tid"],
        spread_on="docid",
    ).select("docid", "tid")
    arrived = salted_lookup(
        new, best, ["root"], spread_on="docid"
    ).select("docid", F.col("new_tid").alias("tid"))
    return changed.union(arrived)


def strict_thread(threaded: DataFrame, mid: str) -> DataFrame:
    """Messages of the thread holding `mid`, by sent time."""
    wanted = (
        threaded.where(F.array_contains("mids", mid))
        .groupBy().agg(F.min_by("tid", "docid").alias("tid"))
    )
    return threaded.join(F.broadcast(wanted), "tid", "left_semi").orderBy("ds", "docid")


def expand_to_threads(hits: DataFrame, threaded: DataFrame) -> DataFrame:
    """All messages of the hits' threads; `is_hit` marks the hits themselves."""
    tids = hits.select("tid").distinct()
    flagged = hits.select("docid").distinct().withColumn("is_hit", F.lit(True))
    members = salted_lookup(threaded, tids, ["tid"], spread_on="docid")
    return members.join(flagged, "docid", "left").withColumn(
        "is_hit", F.coalesce("is_hit", F.lit(False))
    )


def loose_thread(threaded: DataFrame, mid: str, limit: int | None = None) -> DataFrame:
    """Strict matches by sent time, then same-subject ones newest first.

    `total` counts both kinds. A message without a subject has no loose matches. With a
    `limit` strict matches are never cut and loose ones fill up to it.
    """
    seed = (
        threaded.where(F.array_contains("mids", mid))
        .groupBy()
        .agg(F.min(F.struct("docid", "tid", "sid")).alias("s"))
        .select(F.col("s.tid").alias("tid"), F.col("s.sid").alias("sid"))
    )
    # One row, found by id: broadcast filters, not growing sides.
    strict = threaded.join(F.broadcast(seed.select("tid")), "tid").withColumn("loose", F.lit(False))
    same = threaded.join(F.broadcast(seed.select("sid", F.col("tid").alias("_tid"))), "sid").where("tid <> _tid")
    loose = same.drop("_tid").withColumn("loose", F.lit(True)).select(*strict.columns)
    found = strict.unionByName(loose)
    total = found.groupBy().agg(F.count("*").alias("total"))
    place = F.when(F.col("loose"), -F.col("ds")).otherwise(F.col("ds"))
    shown = found
    if limit is not None:
        room = max(0, limit - strict.count())
        shown = strict.unionByName(loose.orderBy(F.desc("ds"), "docid").limit(room))
    return shown.join(F.broadcast(total)).withColumn("place", place).orderBy("loose", "place", "docid")
