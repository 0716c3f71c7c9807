"""Mail date columns: epoch seconds and zone text, all in JVM expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and the obsolete zone names of RFC 2822.
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
OBSOLETE_ZONES = {
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
    "UT": "+0000", "GMT": "+0000", "Z": "+0000",
}
# ISO-like dates, the usual shape that is not RFC 822.
ISO_PATTERN = (
    r"^\s*([0-9]{4})-([0-9]{2})-([0-9]{2})[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?"
    r"(?:\.[0-9]+)?\s*(Z|[+-][0-9]{2}:?[0-9]{2})?\s*$"
)


def _constant_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def _month_number(name: Column) -> Column:
    table = {m: i + 1 for i, m in enumerate(MONTHS)}
    table.update({m[:3]: i + 1 for i, m in enumerate(MONTHS)})
    return F.try_element_at(_constant_map(table), F.lower(name))


def _int(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def _once(value: Column, function) -> Column:
    """Apply a function to a value computed once, not once per use."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _seconds(p: Column) -> Column:
    """Epoch seconds of struct(date, hour, minute, second) when all are valid."""
    fine = (p["hour"] < 24) & (p["minute"] < 60) & (p["second"] < 60)
    total = (
        F.unix_date(p["date"]).cast("long") * 86400
        + p["hour"] * 3600 + p["minute"] * 60 + p["second"]
    )
    return F.when(fine, total)


def _local(year, month, day, hour, minute, second) -> Column:
    parts = F.struct(
        F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date").alias("date"),
        hour.alias("hour"), minute.alias("minute"), second.alias("second"),
    )
    return _once(parts, _seconds)


def _finish(p: Column) -> Column:
    """struct(epoch, zone) from struct(local, sign, hours, minutes)."""
    size = p["hours"] * 3600 + p["minutes"] * 60
    number = p["hours"] * 100 + p["minutes"]
    sign = F.when(size == 0, F.lit("+")).otherwise(p["sign"])
    zone = F.when(number >= 1400, F.lit("+0000")).otherwise(
        F.concat(sign, F.lpad(number.cast("string"), 4, "0"))
    )
    return F.when(
        p["local"] >= 0,
        F.struct(
            (p["local"] - F.when(p["sign"] == "-", -size).otherwise(size)).cast("long").alias("epoch"),
            zone.alias("zone"),
        ),
    )


def _groups(text: Column, pattern: str, count: int) -> Column:
    """All groups of the first match as an array, or a one-element array."""
    marks = "\u0001".join(f"${i}" for i in range(1, count + 1))
    return F.split(F.regexp_replace(text, r"(?s)^.*?(?:" + pattern + r").*$", marks), "\u0001", -1)


def _words(text: Column) -> Column:
    """Words of a date-time: comments, folding and commas only part them (RFC 5322)."""
    bare = F.regexp_replace(text, r"\([^()]*\)", " ")
    return F.filter(F.split(bare, r"[\s,]+"), lambda w: w != "")


def _zone(word: Column) -> Column:
    """struct(sign, hours, minutes) of a zone word: an offset or an obsolete name.

    RFC 5322 takes a name without known meaning, or no zone, as UTC. Offsets may lack
    leading zeros; minutes are the last two digits.
    """
    offset = F.coalesce(F.try_element_at(_constant_map(OBSOLETE_ZONES), F.upper(word)), word)
    known = F.when(offset.rlike(r"^[+-]\d{1,4}$"), offset).otherwise(F.lit("+0000"))

    def parts(text: Column) -> Column:
        digits = F.substring(text, 2, 4)
        # One digit alone is a number of hours.
        number = (digits.cast("long") * F.when(F.length(digits) == 1, 100).otherwise(1))
        minutes = number % 100
        return F.struct(
            F.substring(text, 1, 1).alias("sign"), (F.floor(number / 100) + F.floor(minutes / 60)).alias("hours"),
            (minutes % 60).alias("minutes"),
        )

    return _once(known, parts)


def _rfc5322(words: Column) -> Column:
    """Date of the words [day-name] day month year time [zone].

    Years of two digits below 50 are 20xx, other years of two or three digits are
    counted from 1900 (RFC 5322, section 4.3).
    """
    named = F.get(words, F.lit(0)).rlike(r"^[A-Za-z]+\.?$")

    def read(own: Column) -> Column:
        day, month, years, time = [F.get(own, F.lit(i)) for i in range(4)]
        zone = F.coalesce(F.get(own, F.lit(4)), F.lit("+0000"))
        clock = F.split(time, "[:.]")
        year = _int(F.when(years.rlike(r"^\d{2,4}$"), years))
        full = F.when(F.length(years) > 3, year).otherwise(
            year + F.when((F.length(years) == 2) & (year < 50), 2000).otherwise(1900)
        )
        second = F.when(F.size(clock) == 2, F.lit(0)).otherwise(_int(F.get(clock, F.lit(2))))
        local = _local(full, _month_number(month), _int(day), _int(F.get(clock, F.lit(0))),
                       _int(F.get(clock, F.lit(1))), second)
        return _once(_zone(zone), lambda z: _once(F.struct(
            local.alias("local"), z["sign"].alias("sign"), z["hours"].alias("hours"), z["minutes"].alias("minutes")
        ), _finish))

    return _once(F.when(named, F.slice(words, 2, F.size(words))).otherwise(words), read)


def _iso(g: Column) -> Column:
    year, month, day, hour, minute, seconds, zone_text = [F.get(g, F.lit(i)) for i in range(7)]
    second = F.when(seconds == "", F.lit(0)).otherwise(_int(seconds))
    local = _local(_int(year), _int(month), _int(day), _int(hour), _int(minute), second)
    zone = F.when(zone_text.isin("", "Z"), F.lit("+0000")).otherwise(
        F.replace(zone_text, F.lit(":"), F.lit(""))
    )
    parts = _once(zone, lambda z: F.struct(
        local.alias("local"), F.substring(z, 1, 1).alias("sign"),
        F.substring(z, 2, 2).try_cast("long").alias("hours"),
        F.substring(z, 4, 2).try_cast("long").alias("minutes"),
    ))
    return F.when(F.size(g) == 7, _once(parts, _finish))


def parse_date(text: Column) -> Column:
    """`struct(epoch, zone)` of a Date header value, or null."""
    return F.coalesce(
        _once(_words(text), _rfc5322), _once(_groups(text, ISO_PATTERN, 7), _iso)
    )


def _first_parsed(values: Column, parse) -> Column:
    parsed = F.filter(F.transform(values, parse), lambda d: d.isNotNull())
    return F.try_element_at(parsed, F.lit(1))


def date_of(values: Column) -> Column:
    """First parsable Date header."""
    return _first_parsed(values, parse_date)


def received_of(values: Column) -> Column:
    """First parsable date of the Received headers: what stands after the last `;`."""
    return _first_parsed(
        values, lambda v: parse_date(F.when(F.contains(v, F.lit(";")), F.substring_index(v, ";", -1)))
    )


def sent_and_received(
    dates: Column, received: Column, sent_default: Column, received_default: Column
) -> tuple[Column, Column]:
    """(ds, ts) structs: Date first for sent time, Received first for arrival."""

    def default(epoch: Column) -> Column:
        return F.struct(
            epoch.cast("long").alias("epoch"), F.lit("+0000").alias("zone")
        )

    d, r = date_of(dates), received_of(received)
    return (
        F.coalesce(d, r, default(sent_default)),
        F.coalesce(r, d, default(received_default)),
    )


def mime_date(epoch: Column) -> Column:
    """`Tue, 14 Nov 2023 22:13:20 +0000` in UTC."""
    return F.concat(
        F.date_format(F.timestamp_seconds(epoch), "EEE, dd MMM yyyy HH:mm:ss"),
        F.lit(" +0000"),
    )


def internal_date(epoch: Column) -> Column:
    """`14-Nov-2023 22:13:20 +0000` in UTC."""
    return F.concat(
        F.date_format(
            F.timestamp_seconds(F.coalesce(epoch, F.lit(0))), "dd-MMM-yyyy HH:mm:ss"
        ),
        F.lit(" +0000"),
    )


def iso8601(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day_number(epoch: Column) -> Column:
    """`YYYYMMDD` as a number."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyyMMdd").cast("long")


def second_number(epoch: Column) -> Column:
    """`YYYYMMDDHHMMSS` as a number."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyyMMddHHmmss").cast("long")
