"""Address list columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# One list entry: optional phrase, address, optional trailing comment. Only single
# character classes repeat, so long junk headers cost no stack.
ENTRY_PATTERN = (
    r"((?:\"[^\"]*\")?[^<>@,\"]*?)\s*<?\s*"
    r"([\w.+=?!#$%&'*/^`|{}~-]+@[\w.-]+)"
    r"\s*>?\s*(\([^)]*\))?\s*(?:,|$)"
)


def emails(header: Column) -> Column:
    """Addresses of one header value, in order."""
    return F.regexp_extract_all(header, F.lit(ENTRY_PATTERN), F.lit(2))


def _phrase(entry: Column) -> Column:
    text = F.regexp_extract(entry, ENTRY_PATTERN, 1)
    text = F.regexp_replace(text, r"[\r\n\t ]+", " ")
    return F.regexp_replace(text, r"^['\"\s]+|['\"\s]+$", "")


def _comment(entry: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(entry, ENTRY_PATTERN, 3), r"^\(|\)$", "")


def _entries(header: Column) -> Column:
    return F.regexp_extract_all(header, F.lit(ENTRY_PATTERN), F.lit(0))


def _nonblank(text: Column) -> Column:
    return F.when(text.rlike(r"\S"), text)


def names(header: Column) -> Column:
    """Display name of each entry: phrase, else comment, else the user part."""

    def one(entry: Column) -> Column:
        address = F.regexp_extract(entry, ENTRY_PATTERN, 2)
        return F.coalesce(
            _nonblank(_phrase(entry)),
            _nonblank(_comment(entry)),
            F.substring_index(address, "@", 1),
        )

    return F.transform(_entries(header), one)


def pairs(header: Column) -> Column:
    """(name, addr) structs; the name is null when nothing names the address."""

    def one(entry: Column) -> Column:
        return F.struct(
            F.coalesce(_nonblank(_phrase(entry)), _nonblank(_comment(entry))).alias("name"),
            F.regexp_extract(entry, ENTRY_PATTERN, 2).alias("addr"),
        )

    return F.transform(_entries(header), one)


def without_plus(address: Column) -> Column:
    """Lower-cased address without a plus tag."""
    return F.lower(F.regexp_replace(address, r"\+.*@", "@"))


def list_id(value: Column) -> Column:
    """Inner value of a List-Id header, lower-cased; null when there is none."""
    inner = F.regexp_extract(value, r"<([^>]+)>", 1)
    return F.when(inner != "", F.lower(inner))


def default_list_id(value: Column, address: Column) -> Column:
    """List-Id, or one made from the list address when the header is absent."""
    made = F.concat(F.lit("<"), F.translate(address, "@", "."), F.lit(">"))
    return F.coalesce(value, made)


def mask(
    text: Column,
    keep_addresses: list[str] | None = None,
    keep_domains: list[str] | None = None,
    dot: str = "•",
) -> Column:
    """Replace the first dot of each address's domain, unless allow-listed.

    Addresses inside a URL are left alone.
    """
    guard = ""
    if keep_addresses:
        whole = "|".join(re.escape(a) for a in keep_addresses)
        guard += r"(?!(?:" + whole + r")(?![\w.-]))"
    if keep_domains:
        ends = "|".join(re.escape(d) for d in keep_domains)
        guard += r"(?![\w.+=-]+@(?:[\w-]+\.)*(?:" + ends + r")(?![\w.-]))"
    pattern = (
        r"(?<![^\s])([^\s:]*(?::(?!//)[^\s:]*)*?(?<![\w.+=-]))"
        + guard + r"([\w.+=-]+@[\w-]+)\.([\w.-]+)"
    )
    return F.regexp_replace(text, pattern, "$1$2" + dot + "$3")
