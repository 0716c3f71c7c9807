"""Temporal URL list join.

Dated list entries - a pattern is listed or taken off at some time, a listing may
expire - become validity intervals, and an as-of join judges every capture by the
entries that were active when it was fetched.

Time is cut into spans. Per pattern and span there is one row: the interval that began
last before the span, and those that begin inside it. A capture meets that row and
takes the last interval begun by its fetch time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivelake.operators.ordered import neighbours
from archivelake.operators.skew import salted_lookup
from archivelake.session import durable

#: Seconds of a span.
SPAN = 3600
#: Kinds of patterns, the most telling first: a whole address, a host, a domain with
#: all hosts below it.
KINDS = ("url", "host", "domain")


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL without user, port and final dot; else ''."""
    found = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.coalesce(F.lower(F.regexp_replace(found, "\\.$", "")), F.lit(""))


def address(url: Column) -> Column:
    """Host and all that follows it but the fragment, without the scheme; else ''."""
    rest = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(host(url) == "", "").otherwise(F.concat(host(url), rest))


def domains(name: Column) -> Column:
    """The host and the domains above it, down to two labels."""
    labels = F.split(name, "\\.")
    n = F.size(labels)
    tails = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(tails)


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, valid_from, valid_to) from (kind, pattern, at, action, expires).

    A listing ('add') holds from its time, in seconds, until the pattern's next entry or
    its expiry, the last one without end. Of entries of one second the last counts, and
    'remove' stands after 'add'. Entries without pattern, time or action are passed over.
    """
    known = entries.where("kind is not null and pattern <> '' and at is not null and action is not null").select(
        "kind", "pattern", F.col("at").cast("long").alias("at"), (F.col("action") == "remove").cast("int").alias("off"),
        F.col("expires").cast("long").alias("expires"),
    ).distinct()
    chained = neighbours(
        known, ["kind", "pattern"], "at", "at", ties=["off", "expires"], width=24 * SPAN, previous=None, following="next_at"
    )
    end = F.least(F.coalesce("next_at", F.lit(2**62)), F.coalesce("expires", F.lit(2**62)))
    return chained.where("off = 0").select(
        "kind", "pattern", F.col("at").alias("valid_from"), end.alias("valid_to")
    ).where("valid_from < valid_to")


_KEY = ["kind", "pattern", "span"]


def candidates(captures: DataFrame) -> DataFrame:
    """A row per capture and pattern that would match it: kind, pattern, span added."""
    name = host(F.col("url"))
    tried = F.concat(
        F.array(F.struct(F.lit("url").alias("kind"), address(F.col("url")).alias("pattern"))),
        F.array(F.struct(F.lit("host").alias("kind"), name.alias("pattern"))),
        F.transform(domains(name), lambda d: F.struct(F.lit("domain").alias("kind"), d.alias("pattern"))),
    )
    return captures.select("*", F.inline(tried)).withColumn("span", F.floor(F.col("fetched") / SPAN))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Verdict of every (capture_id, url, fetched), `fetched` in seconds.

    Returns capture_id, host, fetched, blocked, n_matches (active patterns), kind,
    pattern and valid_from of the most telling one: url before host before domain,
    longer before shorter. Repeated captures give one row. A URL without a host, or a
    capture without a time, matches nothing.
    """
    own = captures.select(
        F.col("capture_id").cast("long").alias("capture_id"), "url", F.col("fetched").cast("long").alias("fetched")
    )
    tried = candidates(own)
    valid = durable(intervals(entries)).withColumn("span", F.floor(F.col("valid_from") / SPAN))
    item = F.struct("valid_from", "valid_to")
    # Listings of one pattern that begin in one span: as many as the list has.
    begun = valid.groupBy(*_KEY).agg(F.sort_array(F.collect_list(item)).alias("begun"))
    asked = tried.select(*_KEY).distinct().join(valid.select("kind", "pattern").distinct(), ["kind", "pattern"], "left_semi")
    spans = asked.join(begun, _KEY, "full")
    earlier = Window.partitionBy("kind", "pattern").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    facts = spans.withColumn(
        "carried", F.last(F.try_element_at("begun", F.lit(-1)), ignorenulls=True).over(earlier)
    )
    met = salted_lookup(tried, facts, _KEY, spread_on=["capture_id", "fetched"], how="left")
    none = F.array().cast("array<struct<valid_from:bigint,valid_to:bigint>>")
    inside = F.filter(F.coalesce("begun", none), lambda i: i["valid_from"] <= F.col("fetched"))
    latest = F.coalesce(F.try_element_at(inside, F.lit(-1)), F.col("carried"))
    told = met.withColumn("latest", latest).withColumn("active", F.coalesce(
        F.col("latest.valid_to") > F.col("fetched"), F.lit(False)
    ))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    match = F.when(F.col("active"), F.struct(
        rank.alias("rank"), (-F.length("pattern")).alias("long"), "kind", "pattern", F.col("latest.valid_from").alias("valid_from")
    ))
    found = told.groupBy("capture_id", "url", "fetched").agg(
        F.countDistinct(F.when(F.col("active"), F.struct("kind", "pattern"))).alias("n_matches"), F.min(match).alias("best")
    )
    return found.select(
        "capture_id", host(F.col("url")).alias("host"), "fetched", (F.col("n_matches") > 0).alias("blocked"), "n_matches",
        "best.kind", "best.pattern", "best.valid_from",
    )
