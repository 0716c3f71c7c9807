"""Delivery checks, content policy and user filters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivelake.functions import addresses, dates, headers
from archivelake.operators.overview import wildmat_regex

# Default size limit, rejected file suffixes and content types.
DELIVERY_MAX = 500 * 1024
REJECT_SUFFIXES = ["exe", "bat", "cmd", "com", "pif", "scr", "vbs", "cpl", "zip", "swf", "swfl"]
REJECT_TYPES = {
    "text/html": "HTML", "text/xhtml": "HTML",
    "application/vnd.*": "vendor-specific formats",
    "image/*": "images", "video/*": "video", "audio/*": "audio",
}


def delivery_reasons(
    hdr: Column, raw: Column, our_addresses: list[str], max_bytes: int | None = DELIVERY_MAX
) -> Column:
    """Reasons to turn a message away; empty when it may be delivered.

    `max_bytes` is the largest message taken; None takes any size.
    """
    mids = headers.values(hdr, "message-id")
    mid = F.get(mids, F.lit(0))
    ours = [a.lower().split("@")[0].split("+")[0] + "@" + a.lower().split("@")[1] for a in our_addresses]
    people = F.flatten(
        F.transform(F.concat(headers.values(hdr, "cc"), headers.values(hdr, "to")), addresses.emails)
    )
    named = F.exists(people, lambda a: addresses.without_plus(a).isin(ours))
    checks = [
        ("message id", (F.size(mids) != 1) | (F.length(mid) < 5) | ~F.contains(mid, F.lit("@"))),
        ("from", F.length(F.coalesce(headers.first(hdr, "from"), F.lit(""))) < 3),
        ("subject", F.length(F.coalesce(headers.first(hdr, "subject"), F.lit(""))) < 2),
        ("date", dates.parse_date(headers.first(hdr, "date")).isNull()),
        ("size", F.lit(False) if max_bytes is None else F.octet_length(raw) > max_bytes),
        ("recipient", ~named),
    ]
    return F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(why)) for why, bad in checks])
    )


def content_reasons(parts: Column, suffixes: list[str] | None = None,
                    types: dict[str, str] | None = None) -> Column:
    """Sorted reasons to reject content types and file suffixes."""
    types = REJECT_TYPES if types is None else types
    suffixes = REJECT_SUFFIXES if suffixes is None else suffixes

    def of_type(glob: str) -> Column:
        pattern = r"(?i)\b" + wildmat_regex(glob).strip("^$") + ("" if glob.endswith("*") else r"\b")
        return F.exists(parts, lambda p: p["content_type"].rlike(pattern))

    bad_type = [F.when(of_type(glob), F.lit(f"no {what}")) for glob, what in types.items()]
    pattern = r"(?i)\.(" + "|".join(suffixes) + r")\s*$"
    found = F.array_sort(
        F.array_distinct(
            F.filter(
                F.transform(parts, lambda p: F.lower(F.regexp_extract(F.coalesce(p["filename"], F.lit("")), pattern, 1))),
                lambda s: s != "",
            )
        )
    )
    reasons = F.array_sort(F.array_distinct(F.array_compact(F.array(*bad_type))))
    suffix_text = F.concat(F.lit("suffixes: "), F.array_join(found, ", "))
    return F.when(F.size(found) > 0, F.concat(reasons, F.array(suffix_text))).otherwise(reasons)


def watched(hdr: Column, rules: list[tuple[str, str]]) -> Column:
    """True when any configured header matches; no rules admit everything."""
    if not rules:
        return F.lit(True)

    def matches(name: str, pattern: str) -> Column:
        return F.exists(headers.values(hdr, name), lambda v: v.rlike(pattern))

    return reduce(lambda a, b: a | b, [matches(h, p) for h, p in rules])


def watched_lists(hdr: Column, list_ids: list[str]) -> Column:
    return F.exists(
        headers.values(hdr, "list-id"),
        lambda v: addresses.list_id(v).isin([x.lower() for x in list_ids]),
    )


def mirror_reasons(hdr: Column, rules: list[tuple[str, str, str, str | None]]) -> Column:
    """Checks for mirrored lists, from (header, value, host glob, list address).

    The first Received header must come from the host and To or Cc must hold the
    list address.
    """
    import re

    received = F.split(F.coalesce(headers.first(hdr, "received"), F.lit("")), "\n", 2)[0]
    to_cc = F.concat_ws(", ", headers.values(hdr, "to"), headers.values(hdr, "cc"))
    out = []
    for name, value, host, address in rules:
        applies = F.array_contains(headers.values(hdr, name), value)
        host_re = "".join({"*": r"\S+", "?": "."}.get(c, re.escape(c)) for c in host)
        out.append(F.when(applies & ~received.rlike(r"(?i)^\s*from\s+" + host_re + r"(?:\s|$)"),
                          F.lit("received from another host")))
        if address:
            any_of = "|".join(re.escape(a) for a in address.split(","))
            out.append(F.when(applies & ~to_cc.rlike(r"(?i)\b(?:" + any_of + r")\b"),
                              F.lit("list address not named")))
    return F.array_distinct(F.array_compact(F.array(*out)))


Filter = Callable[[DataFrame], DataFrame]
FILTERS: dict[str, Filter] = {}


def register_filter(name: str, function: Filter) -> None:
    """Register a filter: it adds `verdict` (accept, reject, ignore) and `reason`."""
    FILTERS[name] = function


def accept_all(df: DataFrame) -> DataFrame:
    return df.withColumn("verdict", F.lit("accept")).withColumn("reason", F.lit(None).cast("string"))


def reject_content(df: DataFrame) -> DataFrame:
    reasons = content_reasons(F.col("parts"))
    return df.withColumn("reason", F.array_join(reasons, "\n")).withColumn(
        "verdict", F.when(F.size(reasons) > 0, "reject").otherwise("accept")
    )


register_filter("accept", accept_all)
register_filter("content", reject_content)


def apply_filters(df: DataFrame, by_inbox: dict[str, str], default: str = "accept") -> DataFrame:
    """Run each inbox's registered filter over its messages."""
    groups: dict[str, list[str]] = {}
    for inbox, name in by_inbox.items():
        groups.setdefault(name, []).append(inbox)
    outputs = [
        FILTERS[name](df.where(F.col("inbox").isin(inboxes))) for name, inboxes in groups.items()
    ]
    outputs.append(FILTERS[default](df.where(~F.col("inbox").isin(list(by_inbox)))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), outputs)


def spam_verdicts(df: DataFrame, checker: Callable, schema: str) -> DataFrame:
    """Run a spam checker over Arrow batches (`mapInPandas` hook)."""
    return df.mapInPandas(checker, schema)


def per_message(df: DataFrame, function: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a user function to the messages of any source."""
    return function(df)
