"""Header map columns. Header maps have lower-case names and value arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header names dropped on import and on delivery.
BOOKKEEPING = ["bytes", "lines", "content-length", "status", "x-status"]
DELIVERY_PRIVATE = [
    "delivered-to", "x-original-to", "approved", "approve", "x-approved",
    "x-approve", "urgent", "return-receipt-to", "disposition-notification-to",
    "x-confirm-reading-to", "x-pmrqc",
]
GMANE_DROPPED = ["approved", "x-from", "connect()"]


def values(headers: Column, name: str) -> Column:
    """All values of a header, unfolded and trimmed; empty when absent."""
    found = F.coalesce(
        F.try_element_at(headers, F.lit(name.lower())), F.array().cast("array<string>")
    )
    return F.transform(
        found, lambda v: F.trim(F.regexp_replace(v, r"\r?\n[ \t]+", " "))
    )


def first(headers: Column, name: str) -> Column:
    return F.try_element_at(values(headers, name), F.lit(1))


def joined(headers: Column, name: str) -> Column:
    """Repeated headers joined by `, `; CR dropped, NUL/TAB/LF made spaces."""
    text = F.array_join(values(headers, name), ", ")
    return F.translate(F.regexp_replace(text, "\r", ""), "\u0000\t\n", "   ")


def subset(headers: Column, names: list[str], keep: bool = True) -> Column:
    """Only the named headers, or every other one."""
    wanted = [n.lower() for n in names]
    return F.map_filter(
        headers, lambda k, v: k.isin(wanted) if keep else ~k.isin(wanted)
    )


def without_unwanted(headers: Column) -> Column:
    return subset(headers, BOOKKEEPING + DELIVERY_PRIVATE, keep=False)


def restore_gmane(headers: Column) -> Column:
    """Original-Received/-To take the place of Received/To; added ones go."""
    def others(h: Column, name: str) -> Column:
        return F.map_filter(h, lambda k, v: ~k.isin(name, "original-" + name))

    restored = headers
    for name in ("received", "to"):
        original = F.try_element_at(headers, F.lit("original-" + name))
        other = others(restored, name)
        restored = F.when(
            original.isNotNull(),
            F.map_concat(other, F.create_map(F.lit(name), original)),
        ).otherwise(restored)
    return F.map_filter(restored, lambda k, v: ~k.isin(GMANE_DROPPED))


def crlf_bytes(raw: Column) -> Column:
    """Size in bytes as if every line ended in CRLF."""
    text = F.decode(raw, "ISO-8859-1")
    lone = F.regexp_count(text, F.lit(r"(?<!\r)\n"))
    return (F.octet_length(raw) + lone).cast("long")


def line_count(body: Column) -> Column:
    return F.regexp_count(body, F.lit("\n")).cast("long")


def section(body: Column, offset: int, size: int) -> Column:
    """Byte range of a section."""
    return F.substring(body, offset + 1, size)


def envelope(headers: Column) -> Column:
    """Envelope projection; sender and reply-to fall back to from."""
    sender = first(headers, "from")
    return F.struct(
        first(headers, "date").alias("date"),
        first(headers, "subject").alias("subject"),
        sender.alias("from"),
        F.coalesce(first(headers, "sender"), sender).alias("sender"),
        F.coalesce(first(headers, "reply-to"), sender).alias("reply_to"),
        first(headers, "to").alias("to"),
        first(headers, "cc").alias("cc"),
        first(headers, "bcc").alias("bcc"),
        first(headers, "in-reply-to").alias("in_reply_to"),
        first(headers, "message-id").alias("message_id"),
    )


def body_structure(parts: Column) -> Column:
    """Type, subtype, encoding, size and text line count of every part."""

    def one(p: Column) -> Column:
        kind = F.lower(F.split_part(F.split_part(p["content_type"], F.lit(";"), F.lit(1)),
                                    F.lit("/"), F.lit(1)))
        sub = F.lower(F.split_part(F.split_part(p["content_type"], F.lit(";"), F.lit(1)),
                                   F.lit("/"), F.lit(2)))
        return F.struct(
            p["idx"].alias("idx"),
            F.trim(kind).alias("type"),
            F.trim(sub).alias("subtype"),
            F.coalesce(p["encoding"], F.lit("7bit")).alias("encoding"),
            F.octet_length(p["body"]).cast("long").alias("size"),
            F.when(
                F.trim(kind) == "text",
                F.regexp_count(F.decode(p["body"], "ISO-8859-1"), F.lit("\n")),
            ).cast("long").alias("lines"),
        )

    return F.transform(parts, one)


def part_at(parts: Column, idx: str) -> Column:
    """The part with this dotted index, or null."""
    return F.try_element_at(F.filter(parts, lambda p: p["idx"] == idx), F.lit(1))
