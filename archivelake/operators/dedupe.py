"""De-duplication by blob, id or content, and duplicate rules on arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivelake.functions import ids
from archivelake.operators.skew import keep_first, salted_lookup, with_group_totals


def dedupe_key(strategy: str) -> Column:
    """Key column of a strategy: oid, mid, content or none."""
    if strategy == "oid":
        return F.col("oid")
    if strategy == "mid":
        mid = F.when(F.col("mid") != "", F.concat(F.lit("m"), "mid"))
        return F.coalesce(
            mid, F.concat(F.lit("o"), "oid"), F.concat(F.lit("c"), "content_hash")
        )
    if strategy == "content":
        return F.col("content_hash")
    raise ValueError(f"no de-dup strategy named {strategy!r}")


def dedupe(
    messages: DataFrame, strategy: str = "content", order: str = "num",
    row_id: tuple[str, ...] = ("inbox", "num"),
) -> DataFrame:
    """First message of each key by arrival order; rows without a key stay.

    `row_id` names a row: article numbers are unique within an inbox only.
    """
    if strategy == "none":
        return messages
    keyed = messages.withColumn("_key", dedupe_key(strategy))
    first = keep_first(keyed.where("_key is not null"), ["_key"], [order], list(row_id))
    return first.unionByName(keyed.where("_key is null")).drop("_key")


def dedupe_against(
    new: DataFrame, existing: DataFrame, strategy: str = "content", order: str = "num",
    row_id: tuple[str, ...] = ("inbox", "num"),
) -> DataFrame:
    """New messages whose key neither an earlier one nor `existing` has."""
    if strategy == "none":
        return new
    seen = existing.select(dedupe_key(strategy).alias("_key")).where("_key is not null").distinct()
    keyed = dedupe(new, strategy, order, row_id).withColumn("_key", dedupe_key(strategy))
    return keyed.join(seen, "_key", "left_anti").drop("_key")


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Table plus the first new row of every key it does not hold yet."""
    first = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r")
    ).select("_r.*")
    return table.unionByName(first.join(table.select(*keys), keys, "left_anti"))


def insert_or_replace(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Table with the last new row of every key in place of the old one."""
    last = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r")
    ).select("_r.*")
    return table.join(last.select(*keys), keys, "left_anti").unionByName(last)


def reused_ids(messages: DataFrame) -> DataFrame:
    """Ids that map to more than one article: mid, n, first and last number."""
    return (
        messages.select("mid", "num").distinct().groupBy("mid")
        .agg(F.count("*").alias("n"), F.min("num").alias("first_num"), F.max("num").alias("last_num"))
        .where("n > 1")
    )


def unique_page(hits: DataFrame) -> DataFrame:
    """First hit of every mid on a result page, in rank order."""
    return keep_first(hits, ["mid"], ["rank"], "rank").orderBy("rank")


def arrival_verdicts(arriving: DataFrame, stored: DataFrame) -> DataFrame:
    """Verdict per arriving message: new, duplicate, other id or generated id.

    `arriving` has (inbox, seq, mids, content_hash, ds); `stored` has (inbox, mid,
    content_hash) with one row per id and content. A first id not yet taken keeps
    the message. Equal content under any of its ids drops it. Otherwise the last
    of its other ids that is free is used, else an id made from its content.

    Messages of one batch count as stored for the ones after them; a batch that
    reuses ids with new content several times over is settled round by round by
    running the rule again on what is left (see `settle_arrivals`).
    """
    each = arriving.select(
        "inbox", "seq", "content_hash", F.posexplode("mids").alias("pos", "mid")
    )
    taken = stored.select("inbox", "mid").distinct()
    same = stored.select("inbox", "mid", "content_hash").distinct()
    marked = (
        salted_lookup(each, taken.withColumn("_taken", F.lit(True)), ["inbox", "mid"], "seq", "left")
        .join(same.withColumn("_same", F.lit(True)), ["inbox", "mid", "content_hash"], "left")
    )
    free = F.col("_taken").isNull()
    facts = marked.groupBy("inbox", "seq").agg(
        F.max(F.when(F.col("pos") == 0, free)).alias("first_free"),
        F.max(F.coalesce("_same", F.lit(False))).alias("known_content"),
        F.max_by(F.when(free & (F.col("pos") > 0), F.col("mid")),
                 F.when(free & (F.col("pos") > 0), F.col("pos"))).alias("other"),
    )
    joined = arriving.join(facts, ["inbox", "seq"], "left")
    made = ids.generated_id(F.col("content_hash"), F.col("ds"))
    verdict = (
        F.when(F.col("first_free"), "new")
        .when(F.col("known_content"), "duplicate")
        .when(F.col("other").isNotNull(), "other id")
        .otherwise("generated id")
    )
    return joined.withColumn("verdict", verdict).withColumn(
        "store_mid",
        F.when(F.col("verdict") == "new", F.get("mids", F.lit(0)))
        .when(F.col("verdict") == "other id", F.col("other"))
        .when(F.col("verdict") == "generated id", made),
    ).drop("first_free", "known_content", "other")


def settle_arrivals(arriving: DataFrame, stored: DataFrame) -> DataFrame:
    """`arrival_verdicts` when messages of the same batch also compete.

    A message is decided once it is the earliest open one for all of its ids, or
    is a duplicate anyway. Messages with one id that is taken do not wait for
    each other: the first with its content gets a made-up id, the others are
    duplicates of it. So ids met once are settled in the first round and one id
    used by very many messages in the second; only messages with several ids
    may need more.
    """
    from archivelake.session import durable, durable_count

    stored = stored.select("inbox", "mid", "content_hash")
    open_rows, decided = durable(arriving), None
    while True:
        each = open_rows.select(
            "inbox", "seq", "content_hash", (F.size("mids") > 1).alias("several"), F.explode("mids").alias("mid")
        )
        turn = each.groupBy("inbox", "mid").agg(F.min("seq").alias("first_seq"))
        late = salted_lookup(each, turn, ["inbox", "mid"], spread_on="seq").where("seq > first_seq")
        waits = late.groupBy("inbox", "seq").agg(F.lit(True).alias("_waits"))
        same = each.groupBy("inbox", "mid", "content_hash").agg(
            F.min(F.when(~F.col("several"), F.col("seq"))).alias("_lead"),
            F.min(F.when(F.col("several"), F.col("seq"))).alias("_rival"),
        )
        verdicts = arrival_verdicts(open_rows, stored).join(waits, ["inbox", "seq"], "left")
        single = F.when(F.size("mids") == 1, F.get("mids", F.lit(0)))
        peers = salted_lookup(
            verdicts.withColumn("_id", single), same.withColumnRenamed("mid", "_id"),
            ["inbox", "_id", "content_hash"], spread_on="seq", how="left",
        )
        alone = (F.col("verdict") == "generated id") & F.col("_id").isNotNull() & (
            F.col("_rival").isNull() | (F.col("_rival") > F.col("seq"))
        )
        alone = F.coalesce(alone, F.lit(False))
        copy = alone & (F.col("_lead") < F.col("seq"))
        ready = F.col("_waits").isNull() | (F.col("verdict") == "duplicate") | alone
        marked, waiting = durable_count(
            peers.withColumn("_ready", ready).withColumn("_copy", copy), ~F.col("_ready")
        )
        done = marked.where("_ready").withColumn(
            "verdict", F.when(F.col("_copy"), "duplicate").otherwise(F.col("verdict"))
        ).withColumn("store_mid", F.when(~F.col("_copy"), F.col("store_mid")))
        done = done.select(*arriving.columns, "verdict", "store_mid")
        decided = done if decided is None else decided.unionByName(done)
        if not waiting:
            return decided
        kept = done.where("store_mid is not null")
        held = F.array_distinct(F.concat(F.array("store_mid"), F.col("mids")))
        stored = durable(stored.unionByName(kept.select("inbox", F.explode(held).alias("mid"), "content_hash")))
        open_rows = marked.where("not _ready").select(*arriving.columns)


def shared_docids(posts: DataFrame) -> DataFrame:
    """Add `docid`: the least number among messages with equal id and content."""
    return with_group_totals(
        posts, ["mid", "content_hash"], {"docid": (F.col("num"), "min")}, spread_on="num"
    )


def merge_duplicates(xref: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold docids with equal mid and content hash into the lowest one.

    Returns (moves, xref): `moves` has (docid, keep) of every docid to drop and is
    the dry-run report; the new xref has its rows moved and made distinct.
    """
    kept = with_group_totals(
        hashes.select("docid", "mid", "content_hash").distinct(),
        ["mid", "content_hash"], {"keep": (F.col("docid"), "min")}, spread_on="docid",
    )
    moves = kept.where("docid <> keep").select("docid", "keep")
    moved = salted_lookup(xref, moves, ["docid"], spread_on=["inbox", "xnum"], how="left")
    new = moved.withColumn("docid", F.coalesce("keep", "docid")).drop("keep").distinct()
    return moves, new


def split_documents(members: DataFrame, next_docid: int) -> DataFrame:
    """Give every further content hash of a docid a docid of its own.

    `members` has (docid, inbox, xnum, oid, content_hash, pos). The hash of the
    best-placed member (least pos, then xnum) keeps the docid.
    """
    place = F.struct("pos", "xnum", "inbox")
    groups = members.groupBy("docid", "content_hash").agg(F.min(place).alias("best"))
    lead = groups.groupBy("docid").agg(
        F.min_by("content_hash", "best").alias("keep_hash"), F.count("*").alias("n")
    )
    extra = groups.join(lead.where("n > 1"), "docid").where("content_hash <> keep_hash")
    numbered = global_numbers(extra.select("docid", "content_hash"), "docid", ["content_hash"])
    fresh = numbered.select(
        "docid", "content_hash", (F.col("rn") + F.lit(next_docid - 1)).alias("new_docid")
    )
    joined = salted_lookup(members, fresh, ["docid", "content_hash"], ["inbox", "xnum"], "left")
    return joined.withColumn("new_docid", F.coalesce("new_docid", "docid"))


def global_numbers(df: DataFrame, order: str, ties: list[str], width: int = 50_000) -> DataFrame:
    """1-based numbers over the whole table by a numeric order column.

    Rows are numbered inside ranges of `order`; one small row per range carries
    the offset, so no task sees the whole table.
    """
    from archivelake.operators.ordered import row_numbers

    return row_numbers(df.withColumn("_all", F.lit(0)), ["_all"], order, ties, width).drop("_all")


def difference_report(inputs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Components in which messages differ from their baseline.

    Both have (group, component, value); `inputs` also has `docid`. Rows say `changed`,
    `added` or `removed`. A component that comes more than once is compared as the set
    of its values; a message whose group has no baseline is left out.
    """

    def summed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        return rows.groupBy(*keys, "component").agg(F.array_sort(F.collect_set("value")).alias(name))

    base = summed(baseline, ["group"], "_base")
    mine = summed(inputs, ["group", "docid"], "_mine")
    members = inputs.select("group", "docid").distinct()
    # Groups may be large, so members meet the baseline's components by (group, salt).
    components = base.groupBy("group").agg(F.collect_list(F.struct("component", "_base")).alias("_all"))
    expected = salted_lookup(members, components, ["group"], spread_on="docid").select(
        "group", "docid", F.inline("_all")
    )
    known = baseline.select("group").distinct()
    found = salted_lookup(mine, known, ["group"], spread_on="docid", how="left_semi")
    both = expected.join(found, ["group", "docid", "component"], "full_outer")
    difference = (
        F.when(F.col("_base").isNull(), "added").when(F.col("_mine").isNull(), "removed")
        .when(F.col("_base") != F.col("_mine"), "changed")
    )
    return both.select("group", "docid", "component", difference.alias("difference")).where("difference is not null")
