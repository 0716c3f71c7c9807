"""Overview scans, projections, mailbox statistics and numbering."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivelake.functions import addresses, dates
from archivelake.operators.ordered import row_numbers, running_sum
from archivelake.operators.skew import keep_first, salted_lookup

SLICE = 50_000  # fixed value: article numbers per mailbox slice


def number_range(msgs: DataFrame, first: int, last: int, limit: int | None = None) -> DataFrame:
    """Messages of a number range in order: all, or the first `limit`."""
    found = msgs.where(F.col("num").between(first, last)).orderBy("num")
    return found if limit is None else found.limit(limit)


def after_number(msgs: DataFrame, num: int, limit: int | None = None) -> DataFrame:
    """What follows a number: all, or the next page of `limit` (keyset pagination)."""
    found = msgs.where(F.col("num") > num).orderBy("num")
    return found if limit is None else found.limit(limit)


def by_numbers(msgs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose number is listed in `wanted`."""
    return msgs.join(wanted.select("num").distinct(), "num", "left_semi")


def by_mids(msgs: DataFrame, message_ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """Messages holding any wanted id: ids, then numbers, then messages."""
    nums = message_ids.join(wanted.select("mid").distinct(), "mid", "left_semi")
    return msgs.join(nums.select("inbox", "num").distinct(), ["inbox", "num"], "left_semi")


def hits_in_order(hits: DataFrame, msgs: DataFrame) -> DataFrame:
    """Skeletons of search hits in hit order; hits without a row are dropped."""
    return hits.join(msgs, "docid").orderBy("rank")


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob with `*`, `?`, `[..]` and `{a,b}`."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + 1)) > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def wildmat_regex(pattern: str) -> str:
    """Regular expression of a news wildmat (`*`, `?`, `[..]`)."""
    return glob_regex(pattern).replace("[^/]", ".")


def newsgroup_filter(name: Column, pattern: str) -> Column:
    """Comma list of patterns, with an exclusion list after `!`."""
    keep, _, skip = pattern.partition("!")

    def any_of(text: str) -> str:
        return "^(?:" + "|".join(
            ".*".join(re.escape(p) for p in one.split("*")) for one in text.split(",")
        ) + ")$"

    chosen = name.rlike(any_of(keep)) if keep else F.lit(False)
    return chosen & ~name.rlike(any_of(skip)) if skip else chosen


def choose_sources(
    catalog: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None,
    only: list[str] | None = None,
) -> DataFrame:
    """Sources to search: globs over names, highest boost first, then by name."""
    name = F.col("inbox")

    def matches(globs: list[str]) -> Column:
        return name.rlike("|".join(glob_regex(g) for g in globs))

    if only:
        chosen = catalog.where(matches(only))
    else:
        keep = F.col("enabled") if "enabled" in catalog.columns else F.lit(True)
        if include:
            keep = keep | matches(include)
        if exclude:
            keep = keep & ~matches(exclude)
        chosen = catalog.where(keep)
    return chosen.orderBy(F.desc("boost"), "inbox")


def list_sources(
    catalog: DataFrame, pattern: str | None = None, fixed: str | None = None,
    basename: bool = False, invert: bool = False, kind: str | None = None,
) -> DataFrame:
    """Sources or folders by glob, fixed text or base name; local or remote."""
    name = F.col("inbox")
    remote = name.rlike(r"^[a-z0-9+]+://")
    rows = catalog
    if kind:
        rows = rows.where(remote if kind == "remote" else ~remote)
    shown = F.substring_index(F.regexp_replace(name, "/+$", ""), "/", -1) if basename else name
    if fixed is not None:
        match = F.contains(shown, F.lit(fixed))
    elif pattern is not None:
        match = shown.rlike(glob_regex(pattern))
    else:
        return rows
    return rows.where(~match if invert else match)


def overview_fields(msgs: DataFrame) -> DataFrame:
    """Newsgroup overview line as columns."""
    refs = F.when(
        F.size("refs") > 0, F.concat(F.lit("<"), F.array_join("refs", "> <"), F.lit(">"))
    ).otherwise("")
    return msgs.select(
        "inbox", "num",
        F.translate("subject", "\t\n", "  ").alias("subject"),
        F.translate("from", "\t\n", "  ").alias("from"),
        dates.mime_date(F.col("ds")).alias("date"),
        F.concat(F.lit("<"), "mid", F.lit(">")).alias("message_id"),
        refs.alias("references"), "bytes", "lines",
        F.concat(F.col("inbox"), F.lit(":"), F.col("num").cast("string")).alias("xref"),
    )


def header_column(msgs: DataFrame, name: str, first: int, last: int) -> DataFrame:
    """One overview column for a range of numbers."""
    return overview_fields(msgs).where(F.col("num").between(first, last)).select(
        "num", F.col(name).alias("value")
    )


def json_records(msgs: DataFrame, pct: Column | None = None) -> DataFrame:
    """One JSON text per message with the search-result field names."""
    def people(header: str) -> Column:
        return F.when(
            F.col(header).isNotNull() & (F.col(header) != ""),
            F.transform(addresses.pairs(F.col(header)), lambda p: F.array(p["name"], p["addr"])),
        )

    fields = [
        dates.iso8601(F.col("ts")).alias("rt"),
        dates.iso8601(F.col("ds")).alias("dt"),
        F.when(F.size("refs") > 0, F.col("refs")).alias("refs"),
        F.col("mid").alias("m"),
        people("from").alias("f"), people("to").alias("t"), people("cc").alias("c"),
        F.col("subject").alias("s"),
    ]
    if pct is not None:
        fields.insert(2, pct.alias("pct"))
    if "kw" in msgs.columns:
        fields.append(F.when(F.size("kw") > 0, F.col("kw")).alias("kw"))
    return msgs.select("mid", F.to_json(F.struct(*fields)).alias("json"))


def number_bounds(msgs: DataFrame) -> DataFrame:
    """Least and greatest number and the count per inbox."""
    return msgs.groupBy("inbox").agg(
        F.min("num").alias("min_num"), F.max("num").alias("max_num"), F.count("*").alias("n")
    )


def inbox_listing(msgs: DataFrame, meta: DataFrame) -> DataFrame:
    """Name, bounds, creation, address, description and last change per inbox."""
    seen = msgs.groupBy("inbox").agg(
        F.min("num").alias("min_num"), F.max("num").alias("max_num"), F.max("ts").alias("modified")
    )
    return meta.join(seen, "inbox", "left")


def mailbox_status(msgs: DataFrame, slice_size: int = SLICE) -> DataFrame:
    """Messages and next number of every slice of every inbox."""
    part = F.floor((F.col("num") - 1) / slice_size).cast("long")
    return msgs.groupBy("inbox", part.alias("slice")).agg(
        F.count("*").alias("messages"), (F.max("num") + 1).alias("uidnext")
    ).withColumn("uidvalidity", F.col("slice") + 1)


def maildrop_stat(msgs: DataFrame, reader_state: DataFrame) -> DataFrame:
    """Messages and bytes above each reader's highest deleted number.

    `reader_state` has (user, inbox, last_del). Readers' marks are put among the messages
    as rows that count nothing; sums run from the newest message down, and a mark's sums
    are its answer. No reader meets a message, however many there are of either.
    """
    messages = msgs.select(
        "inbox", (F.col("num") * 2).alias("_place"), F.lit(1).cast("long").alias("_one"),
        F.coalesce("bytes", F.lit(0)).cast("long").alias("_bytes"), F.lit(None).cast("string").alias("user"), F.lit(False).alias("_mark"),
    )
    # Just above the message of its own number, which counts as deleted.
    marks = reader_state.select(
        "inbox", (F.coalesce("last_del", F.lit(0)) * 2 + 1).alias("_place"), F.lit(0).cast("long").alias("_one"), F.lit(0).cast("long").alias("_bytes"),
        F.col("user").cast("string").alias("user"), F.lit(True).alias("_mark"),
    )
    counted = running_sum(
        messages.unionByName(marks), ["inbox"], "_place", F.col("_one"), width=2 * SLICE, descending=True, out="messages"
    )
    summed = running_sum(counted, ["inbox"], "_place", F.col("_bytes"), width=2 * SLICE, descending=True, out="bytes")
    return summed.where("_mark").select(
        "user", "inbox", F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("bytes", F.lit(0)).alias("bytes")
    )


def last_modified(msgs: DataFrame) -> DataFrame:
    return msgs.groupBy("inbox").agg(F.max("ts").alias("modified"))


def sequence_numbers(msgs: DataFrame, slice_size: int = SLICE) -> DataFrame:
    """Dense sequence number of every message within its slice."""
    from pyspark.sql import Window

    cut = msgs.withColumn("slice", F.floor((F.col("num") - 1) / slice_size).cast("long"))
    # A slice has at most `slice_size` numbers, so no group is larger than that.
    return cut.withColumn(
        "msn", F.row_number().over(Window.partitionBy("inbox", "slice").orderBy("num"))
    )


def adjacent_articles(msgs: DataFrame) -> DataFrame:
    """Whether the articles numbered one below and one above exist."""
    keys = msgs.select("inbox", "num")
    before = keys.select("inbox", (F.col("num") + 1).alias("num"), F.lit(True).alias("_p"))
    after = keys.select("inbox", (F.col("num") - 1).alias("num"), F.lit(True).alias("_n"))
    near = before.unionByName(after, allowMissingColumns=True).groupBy("inbox", "num").agg(
        F.max("_p").alias("_p"), F.max("_n").alias("_n")
    )
    joined = msgs.join(near, ["inbox", "num"], "left")
    return joined.select(
        *msgs.columns,
        F.when(F.col("_p"), F.col("num") - 1).alias("prev_num"),
        F.when(F.col("_n"), F.col("num") + 1).alias("next_num"),
    )


def assign_numbers(
    arriving: DataFrame, high_water: DataFrame, order: str = "seq", width: int = SLICE
) -> DataFrame:
    """Article numbers above each inbox's high-water mark, in arrival order."""
    numbered = row_numbers(arriving, ["inbox"], order, width=width)
    marks = high_water.select("inbox", "max_num")
    joined = salted_lookup(numbered, marks, ["inbox"], spread_on=order, how="left")
    return joined.withColumn(
        "num", F.coalesce("max_num", F.lit(0)) + F.col("rn")
    ).drop("rn", "max_num")


def new_since(msgs: DataFrame, since: int, pattern: str = "*") -> DataFrame:
    """Messages received since a time, in (inbox, number) order."""
    kept = msgs.where((F.col("ts") >= since) & newsgroup_filter(F.col("inbox"), pattern))
    return kept.orderBy("inbox", "num")


def new_inboxes(msgs: DataFrame, since: int) -> DataFrame:
    """Inboxes whose first message came after a time."""
    created = msgs.groupBy("inbox").agg(F.min("ts").alias("created"))
    return created.where(F.col("created") > since)


def epoch_manifest(messages: DataFrame, epoch_size: int) -> DataFrame:
    """Fingerprint, last change and size of every epoch of every inbox.

    The fingerprint adds up a hash of each (number, blob): order-free, so it
    needs no ordered gathering of a whole epoch.
    """
    epoch = F.floor(F.col("num") / epoch_size).cast("long")
    return messages.groupBy("inbox", epoch.alias("epoch")).agg(
        F.count("*").alias("n"),
        F.max("ts").alias("modified"),
        F.sum(
            F.conv(F.substring(F.sha1(F.concat_ws(":", F.col("num").cast("string"), "oid")), 1, 8), 16, 10)
            .cast("decimal(38,0)")
        ).cast("string").alias("fingerprint"),
    )


def first_of_each(msgs: DataFrame, keys: list[str], order: list[str], row_id: str) -> DataFrame:
    return keep_first(msgs, keys, order, row_id)
