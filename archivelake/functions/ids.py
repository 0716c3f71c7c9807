"""Message-ID and reference columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Longest id left uncompressed, and words typed by mistake at an
# In-Reply-To prompt.
ID_MAX = 40
NOT_REFERENCES = ["y", "n"]

BRACKETED = r"<([^>]+)>"


def _unfolded(ids: Column) -> Column:
    return F.transform(ids, lambda x: F.translate(x, "\n\t\r", ""))


def bracketed(value: Column) -> Column:
    """Every `<...>` inner text of one header value, in order."""
    return F.regexp_extract_all(value, F.lit(BRACKETED), F.lit(1))


def message_ids(values: Column) -> Column:
    """Ids of a multi-valued id header: bracketed ones, else the bare value."""
    per_value = F.transform(
        values,
        lambda v: F.when(F.size(bracketed(v)) > 0, bracketed(v)).otherwise(F.array(v)),
    )
    return F.array_distinct(_unfolded(F.flatten(per_value)))


def references(references: Column, in_reply_to: Column, addresses: Column) -> Column:
    """References ids then In-Reply-To ids, without mail addresses."""
    found = F.flatten(F.transform(F.concat(references, in_reply_to), bracketed))
    banned = F.concat(addresses, F.array(*[F.lit(x) for x in NOT_REFERENCES]))
    return F.array_except(_unfolded(found), banned)


def clean_references(refs: Column, mids: Column, mid: Column) -> Column:
    """Add the other own ids when there are several, drop the message's own id."""
    extra = F.when(F.size(mids) > 1, mids).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(refs, extra), lambda r: r != mid))


def in_reply_to(refs: Column) -> Column:
    """The last reference, or null."""
    return F.try_element_at(refs, F.lit(-1))


def compress_id(value: Column) -> Column:
    """SHA-1 hex unless already short and made of safe characters."""
    unsafe = value.rlike(r"[^A-Za-z0-9_-]") | (F.length(value) > ID_MAX)
    return F.when(unsafe, F.sha1(value)).otherwise(value)


def urn_uuid(value: Column) -> Column:
    """`urn:uuid:` form of a SHA-1."""
    digest = F.sha1(value)
    starts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(
        F.lit("urn:uuid:"),
        F.concat_ws("-", *[F.substring(digest, a, n) for a, n in starts]),
    )


def generated_id(content_hash_hex: Column, epoch: Column) -> Column:
    """Id made from a content digest and date: `YYYYMMDDHHMMSS.<digest>@z`."""
    stamp = F.date_format(F.timestamp_seconds(epoch), "yyyyMMddHHmmss")
    digest = F.translate(F.base64(F.unhex(content_hash_hex)), "+/=", "-_")
    return F.concat(stamp, F.lit("."), digest, F.lit("@z"))


def blob_id(raw: Column) -> Column:
    """SHA-1 of `blob <length>\\0<bytes>` for a binary column."""
    head = F.encode(
        F.concat(F.lit("blob "), F.octet_length(raw).cast("string")), "UTF-8"
    )
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), raw))


def id_words(mid: Column) -> Column:
    """Words of at least three characters, for ids holding a long word."""
    words = F.regexp_extract_all(mid, F.lit(r"(\w{3,})"), F.lit(1))
    return F.when(mid.rlike(r"\w{12,}"), words).otherwise(
        F.array().cast("array<string>")
    )


def id_prefixes(oid: Column, shortest: int = 7) -> Column:
    """Every prefix of a blob id from full length down to `shortest`."""
    size = F.length(oid)
    return F.when(
        size >= shortest,
        F.transform(
            F.sequence(F.lit(shortest), size), lambda n: F.substring(oid, F.lit(1), n)
        ),
    ).otherwise(F.array(oid))
