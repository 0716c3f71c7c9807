"""The merged index: cross references, upkeep, consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivelake.operators.dedupe import global_numbers
from archivelake.operators.ordered import neighbours
from archivelake.operators.skew import salted_lookup


def article_numbers(hits: DataFrame, xref: DataFrame, inbox: str) -> DataFrame:
    """Per-inbox article numbers of merged-index hits, in hit order."""
    mine = xref.where(F.col("inbox") == inbox).groupBy("docid").agg(F.min("xnum").alias("xnum"))
    return hits.join(mine, "docid").orderBy("rank")


def peer_counts(xref: DataFrame) -> DataFrame:
    """Per copy: how many copies other inboxes hold, and the first of them.

    Works from per-(docid, inbox) totals and the two best inboxes per docid, so
    copies are never paired with each other.
    """
    per_inbox = xref.groupBy("docid", "inbox").agg(
        F.count("*").alias("n"), F.min("xnum").alias("xnum")
    )
    total = xref.groupBy("docid").agg(F.count("*").alias("total"))
    first = per_inbox.groupBy("docid").agg(F.min(F.struct("inbox", "xnum")).alias("a"))
    second = (
        per_inbox.join(first, "docid").where("inbox <> a.inbox")
        .groupBy("docid").agg(F.min(F.struct("inbox", "xnum")).alias("b"))
    )
    best = first.join(second, "docid", "left").join(total, "docid")
    joined = salted_lookup(per_inbox, best, ["docid"], spread_on="inbox")
    other = F.when(F.col("inbox") == F.col("a.inbox"), F.col("b")).otherwise(F.col("a"))
    shown = joined.select(
        "docid", "inbox", (F.col("total") - F.col("n")).alias("peers"),
        other["inbox"].alias("peer_inbox"), other["xnum"].alias("peer_xnum"),
    )
    return salted_lookup(xref, shown, ["docid", "inbox"], spread_on="xnum")


def locations(xref: DataFrame, max_listed: int | None = None) -> DataFrame:
    """Distinct (docid, inbox, xnum) locations, one row each: all, or the first few."""
    rows = xref.select("docid", "inbox", "xnum").distinct()
    return rows if max_listed is None else rows.orderBy("docid", "inbox", "xnum").limit(max_listed)


def peers_of(wanted: DataFrame, xref: DataFrame) -> DataFrame:
    """Every copy that other inboxes hold of the wanted copies, one row each.

    `wanted` has (docid, inbox, xnum); rows add peer_inbox and peer_xnum. Meant for
    chosen copies: all copies of all documents at once would be paired with each other.
    """
    asked = wanted.select("docid", "inbox", "xnum").distinct()
    held = xref.select("docid", F.col("inbox").alias("peer_inbox"), F.col("xnum").alias("peer_xnum")).distinct()
    return asked.join(held, "docid").where("inbox <> peer_inbox")


def locations_of(message_ids: DataFrame, xref: DataFrame) -> DataFrame:
    """Every (mid, inbox, xnum) of message ids, sorted and unique."""
    wanted = message_ids.groupBy("docid").agg(F.min("mid").alias("mid"))
    return (
        salted_lookup(xref, wanted, ["docid"], spread_on=["inbox", "xnum"])
        .select("mid", "inbox", "xnum").distinct().orderBy("mid", "inbox", "xnum")
    )


def garbage(xref: DataFrame, over: DataFrame, queue: DataFrame) -> DataFrame:
    """Dangling rows of every table: (kind, docid)."""
    x, o, q = (d.select("docid").distinct() for d in (xref, over, queue))
    return (
        x.join(o, "docid", "left_anti").select(F.lit("xref without overview").alias("kind"), "docid")
        .union(o.join(x, "docid", "left_anti").select(F.lit("overview without xref"), "docid"))
        .union(q.join(o, "docid", "left_anti").select(F.lit("queue without overview"), "docid"))
    )


def compare_inbox(inbox_rows: DataFrame, xref: DataFrame) -> DataFrame:
    """Status of every (inbox, num): missing, stale, changed or ok.

    `missing` is in the inbox only, `stale` in the merged index only, `changed`
    has another blob.
    """
    mine = inbox_rows.select("inbox", "num", F.col("oid").alias("inbox_oid"))
    theirs = xref.select("inbox", F.col("xnum").alias("num"), F.col("oid").alias("merged_oid"))
    both = mine.join(theirs, ["inbox", "num"], "full_outer")
    status = (
        F.when(F.col("merged_oid").isNull(), "missing")
        .when(F.col("inbox_oid").isNull(), "stale")
        .when(F.col("inbox_oid") != F.col("merged_oid"), "changed")
        .otherwise("ok")
    )
    return both.withColumn("status", status)


def number_gaps(msgs: DataFrame) -> DataFrame:
    """Ranges of article numbers missing inside an inbox."""
    step = neighbours(msgs.select("inbox", "num"), ["inbox"], "num", "num", previous=None,
                      following="next_num")
    return step.where("next_num > num + 1").select(
        "inbox", (F.col("num") + 1).alias("first_missing"), (F.col("next_num") - 1).alias("last_missing")
    )


def number_documents(new: DataFrame, max_docid: int, order: str = "seq", ties: list[str] | None = None) -> DataFrame:
    """docids above `max_docid` in arrival order, without one global window."""
    return global_numbers(new, order, ties or []).withColumn(
        "docid", F.col("rn") + F.lit(max_docid)
    ).drop("rn")


def place_adds(adds: DataFrame, documents: DataFrame, max_docid: int) -> tuple[DataFrame, DataFrame]:
    """(adds with their docid, new documents) for added copies.

    A copy joins the document with equal id and content; else it opens one,
    numbered above `max_docid` by first arrival.
    """
    known = documents.groupBy("mid", "content_hash").agg(F.min("docid").alias("docid"))
    matched = salted_lookup(adds, known, ["mid", "content_hash"], spread_on="seq", how="left")
    unseen = matched.where("docid is null").groupBy("mid", "content_hash").agg(
        F.min("seq").alias("seq")
    )
    fresh = number_documents(unseen, max_docid, "seq", ["mid", "content_hash"])
    placed = salted_lookup(
        matched.withColumnRenamed("docid", "_old"),
        fresh.select("mid", "content_hash", "docid"), ["mid", "content_hash"], "seq", "left",
    )
    return placed.withColumn("docid", F.coalesce("_old", "docid")).drop("_old"), fresh


def apply_changes(
    xref: DataFrame, documents: DataFrame, changes: DataFrame, max_docid: int
) -> dict[str, DataFrame]:
    """Merge adds and deletes of many inboxes into the index.

    `documents` has (docid, mid, content_hash); `changes` has (op, inbox, xnum,
    oid, mid, content_hash, seq). A delete drops the inbox's xref rows of that
    blob. An add joins a document with equal id and content, or opens a new one.
    Documents without xref rows go; those that lost some are queued for reindex.
    """
    deletes = changes.where("op = 'd'").select("inbox", "oid").distinct()
    kept = xref.join(deletes, ["inbox", "oid"], "left_anti")
    new_rows, fresh = place_adds(changes.where("op = 'm'"), documents, max_docid)
    new_xref = kept.select("docid", "inbox", "xnum", "oid").union(
        new_rows.select("docid", "inbox", "xnum", "oid")
    ).distinct()
    new_docs = documents.select("docid", "mid", "content_hash").union(
        fresh.select("docid", "mid", "content_hash")
    )
    live = new_xref.select("docid").distinct()
    lost = (
        salted_lookup(xref, deletes.withColumn("_d", F.lit(True)), ["inbox", "oid"], "xnum")
        .select("docid").distinct()
    )
    return {
        "xref": new_xref,
        "documents": new_docs.join(live, "docid", "left_semi"),
        "reindex": lost.join(live, "docid", "left_semi"),
        "removed": new_docs.join(live, "docid", "left_anti").select("docid"),
    }


def remove_inboxes(xref: DataFrame, documents: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(xref, documents) after dropping every inbox that is not live."""
    kept = salted_lookup(xref, live.select("inbox").distinct(), ["inbox"], spread_on="docid", how="left_semi")
    return kept, documents.join(kept.select("docid").distinct(), "docid", "left_semi")


def remove_messages(tables: dict[str, DataFrame], documents: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the documents whose id and content are in `gone`."""
    dead = documents.join(
        gone.select("mid", "content_hash").distinct(), ["mid", "content_hash"], "left_semi"
    ).select("docid").distinct()
    return {name: t.join(dead, "docid", "left_anti") for name, t in tables.items()}


def replace_content(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """Put new content in place when ids and references are the same sets.

    `edits` has (mid, content_hash, new_raw, new_mids, new_refs). `edit_status` is
    `replaced`, `refused` or null.
    """
    joined = salted_lookup(messages, edits, ["mid", "content_hash"], spread_on="docid", how="left")
    same = (F.array_sort("mids") == F.array_sort("new_mids")) & (
        F.array_sort("refs") == F.array_sort("new_refs")
    )
    found = F.col("new_raw").isNotNull()
    return joined.withColumn("raw", F.when(found & same, F.col("new_raw")).otherwise(F.col("raw"))).withColumn(
        "edit_status", F.when(found, F.when(same, "replaced").otherwise("refused"))
    ).drop("new_raw", "new_mids", "new_refs")


def purge(messages: DataFrame, gone: DataFrame) -> DataFrame:
    """Messages without those whose (mid, content_hash) is listed."""
    return messages.join(
        gone.select("mid", "content_hash").distinct(), ["mid", "content_hash"], "left_anti"
    )


def queue_take(queue: DataFrame, done: DataFrame) -> DataFrame:
    """Reindex queue without processed ids."""
    return queue.join(done.select("docid").distinct(), "docid", "left_anti")


def queue_add(queue: DataFrame, docids: DataFrame) -> DataFrame:
    return queue.select("docid").union(docids.select("docid")).distinct()


def rewritten_log(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tombstones, inserts) that turn an old log into a rewritten one.

    Logs have (inbox, seq, oid, num). A blob added again gets its former number
    back when it was un-indexed.
    """
    gone = old.join(new, ["inbox", "seq", "oid"], "left_anti")
    fresh = new.select("inbox", "seq", "oid").join(old, ["inbox", "seq", "oid"], "left_anti")
    former = gone.groupBy("inbox", "oid").agg(F.min("num").alias("former_num"))
    return gone, salted_lookup(fresh, former, ["inbox", "oid"], spread_on="seq", how="left")


def import_altids(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """External numbers for ids; number or id clashes with earlier ones are ignored.

    `rows` has (prefix, num, mid, seq). First each number's and then each id's
    earliest claim is kept.
    """
    free = rows.join(existing.select("prefix", "num"), ["prefix", "num"], "left_anti").join(
        existing.select("prefix", "mid"), ["prefix", "mid"], "left_anti"
    )
    by_num = free.groupBy("prefix", "num").agg(F.min_by("mid", F.struct("seq", "mid")).alias("mid"),
                                               F.min("seq").alias("seq"))
    by_mid = by_num.groupBy("prefix", "mid").agg(F.min_by("num", F.struct("seq", "num")).alias("num"))
    return existing.select("prefix", "num", "mid").unionByName(by_mid.select("prefix", "num", "mid"))
