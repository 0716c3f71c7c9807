"""Identity hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archivelake.functions import addresses, headers, ids

NUL = "\u0000"


def _lower_domains(text: Column) -> Column:
    """Lower the domain after every `@`: letters, digits, dots, hyphens (RFC 5321)."""

    def fix(piece: Column, i: Column) -> Column:
        domain = F.regexp_extract(piece, r"^[\p{L}\p{N}.-]*", 0)
        return F.when(i > 0, F.concat(F.lower(domain), F.substr(piece, F.length(domain) + 1))).otherwise(piece)

    return F.array_join(F.transform(F.split(text, "@"), fix), "@")


def address_text(value: Column) -> Column:
    """Address header as hashed: no quotes, spaces squeezed, domains lowered."""
    plain = F.regexp_replace(F.translate(value, '"', ""), r"[\r\n\t ]+", " ")
    return _lower_domains(plain)


def _field(value: Column) -> Column:
    """A value behind its UTF-8 length, so that no two lists of values look alike."""
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _fields(values: Column) -> Column:
    return F.array_join(F.transform(values, _field), "")


def hash_inputs(hdr: Column, parts: Column) -> Column:
    """(component, value) structs: what counts for a message's identity, by name.

    References without the message's own ids, author (or else sender), subject, date and
    recipients come first, then a component per leaf part with its place, names and body.
    """
    people = F.flatten(F.transform(F.concat(*[headers.values(hdr, h) for h in ("to", "from", "cc")]), addresses.emails))
    refs = ids.references(headers.values(hdr, "references"), headers.values(hdr, "in-reply-to"), people)
    others = F.array_except(refs, ids.message_ids(headers.values(hdr, "message-id")))

    def said(name: str) -> Column:
        return F.transform(headers.values(hdr, name), address_text)

    author = F.when(F.size(headers.values(hdr, "from")) > 0, _fields(said("from"))).otherwise(
        F.concat(F.lit("sender "), _fields(said("sender")))
    )
    whole = {
        "ref": _fields(others), "from": author, "subject": _fields(headers.values(hdr, "subject")),
        "date": _fields(headers.values(hdr, "date")), "to": _fields(said("to")), "cc": _fields(said("cc")),
    }
    named = F.array(*[F.struct(F.lit(n).alias("component"), F.encode(v, "UTF-8").alias("value")) for n, v in whole.items()])

    def part(p: Column) -> Column:
        place = F.concat(*[_field(c) for c in (p["depth"].cast("string"), p["idx"], p["filename"], p["description"])])
        text = F.rtrim(F.replace(p["text"], F.lit("\r\n"), F.lit("\n")), F.lit(" \t\r\n\x0b\x0c"))
        body = F.coalesce(F.encode(text, "UTF-8"), p["body"], F.encode(F.lit(""), "UTF-8"))
        return F.struct(
            F.concat(F.lit("part "), p["idx"]).alias("component"), F.concat(F.encode(place, "UTF-8"), body).alias("value")
        )

    return F.concat(named, F.transform(F.filter(parts, lambda p: ~p["is_container"]), part))


def content_hash(hdr: Column, parts: Column) -> Column:
    """SHA-256 hex of a listing of the components, each by its own SHA-256."""
    listing = F.transform(hash_inputs(hdr, parts), lambda c: F.concat(c["component"], F.lit("="), F.sha2(c["value"], 256)))
    return F.sha2(F.array_join(listing, "\n"), 256)


def skeleton_hash(
    from_: Column, to: Column, cc: Column, ds: Column, subject: Column,
    references: Column, mid: Column,
) -> Column:
    """SHA-256 hex of the overview fields, nulls taken as empty."""
    fields = [from_, to, cc, ds.cast("string"), subject, references, mid]
    return F.sha2(
        F.concat_ws(NUL, *[F.coalesce(f, F.lit("")) for f in fields]), 256
    )
