"""Saved searches on text, run on a stream: messages look the searches up.

Searches become clauses, each a list of words, phrases and column conditions that all
hold or must not hold. The clauses lie in a table under one of their words, the rarest.
The distinct words of a micro-batch meet that table once, whatever the number of
searches, and only the clauses that are met are checked as a whole. A clause without
any word, such as a bare negation, is met by every message.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from archivelake.operators import predicates as p
from archivelake.operators.skew import salted_lookup
from archivelake.session import durable
from archivelake.streaming.tables import last_batch, read_table, write_batch

_TAG = "\u0001"
_PHRASE = "struct<field:string,text:string>"
_CLAUSE = (
    f"search string, clause int, words array<string>, phrases array<{_PHRASE}>, holds array<int>, "
    f"no_words array<string>, no_phrases array<{_PHRASE}>, fails array<int>"
)
HITS = "search string, inbox string, num bigint"
POSITIONS = "search string, inbox string, max_num bigint"


@dataclass(frozen=True)
class SavedSearches:
    """Clauses with their anchor word, the column conditions they number, and whether a
    clause has no anchor."""

    clauses: DataFrame
    conditions: list[Column]
    anchorless: bool


def _clauses(predicate: p.Predicate, negated: bool = False) -> list[list[tuple[p.Predicate, bool]]]:
    """The predicate as alternatives of (leaf, negated) lists."""
    if isinstance(predicate, p.Not):
        return _clauses(predicate.item, not negated)
    if isinstance(predicate, (p.And, p.Or)):
        parts = [_clauses(i, negated) for i in predicate.items]
        if isinstance(predicate, p.Or) != negated:
            return [c for part in parts for c in part]
        return [[leaf for c in chosen for leaf in c] for chosen in product(*parts)]
    if not isinstance(predicate, (p.Term, p.Phrase, p.Where)):
        raise ValueError(f"a saved search takes words, phrases and conditions, not {type(predicate).__name__}")
    return [[(predicate, negated)]]


def compile_searches(
    spark: SparkSession, searches: dict[str, p.Predicate], frequencies: DataFrame | None = None
) -> SavedSearches:
    """The table of the clauses of named searches.

    `frequencies` (term, df) tells which words are rare; a word it does not know is the
    rarest, and longer words come before shorter ones of the same frequency. Nested
    alternatives are multiplied out, so a search of n pairs of alternatives that all
    have to hold has 2^n clauses.
    """
    conditions: list[Column] = []
    rows, anchorless = [], False
    for name, predicate in searches.items():
        for k, clause in enumerate(_clauses(predicate)):
            words, phrases, places = ([], []), ([], []), ([], [])
            for leaf, negated in clause:
                side = int(negated)
                if isinstance(leaf, p.Term):
                    words[side].append(f"{leaf.field}{_TAG}{leaf.term}")
                elif isinstance(leaf, p.Phrase):
                    phrases[side].append((leaf.field, f" {' '.join(leaf.words)} "))
                    if not negated:
                        words[0].extend(f"{leaf.field}{_TAG}{w}" for w in leaf.words)
                else:
                    places[side].append(len(conditions))
                    conditions.append(leaf.condition)
            anchorless |= not words[0]
            rows.append((name, k, sorted(set(words[0])), phrases[0], places[0], sorted(set(words[1])), phrases[1], places[1]))
    table = spark.createDataFrame(rows, _CLAUSE)
    each = table.select("search", "clause", F.explode("words").alias("word")).withColumn(
        "term", F.substring_index("word", _TAG, -1)
    )
    if frequencies is not None:
        known = frequencies.groupBy("term").agg(F.max("df").alias("df"))
        each = each.join(known, "term", "left")
    else:
        each = each.withColumn("df", F.lit(None).cast("bigint"))
    rarity = F.struct(F.coalesce("df", F.lit(0)), -F.length("term"), F.col("word"))
    anchors = each.groupBy("search", "clause").agg(F.min_by("word", rarity).alias("anchor"))
    found = table.join(anchors, ["search", "clause"], "left").withColumn("anchor", F.coalesce("anchor", F.lit("")))
    return SavedSearches(durable(found), conditions, anchorless)


def tokens(text: Column) -> Column:
    """Lower-case words of a text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"))


def matches(messages: DataFrame, saved: SavedSearches, fields: dict[str, Column], keys: list[str]) -> DataFrame:
    """(search, *keys) of every message that a saved search finds, once each.

    `fields` gives the text of every search field, `''` being the default one; a search
    in any other field finds nothing. Rows of `messages` with the same keys are taken for
    one message, whose words are all of theirs.
    """
    said = {name: tokens(text) for name, text in fields.items()}

    def tagged(name: str) -> Column:
        return F.transform(said[name], lambda w: F.concat(F.lit(name + _TAG), w))

    words = F.concat(*[tagged(name) for name in said])
    texts = F.create_map(*[
        c for name, t in said.items() for c in (F.lit(name), F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")))
    ])
    holds = F.array(*[F.coalesce(c, F.lit(False)) for c in saved.conditions]).cast("array<boolean>")
    # Held for the rest of the batch: the text is read once.
    rows = durable(messages.select(*keys, F.array_distinct(words).alias("_words"), texts.alias("_texts"), holds.alias("_holds")))
    met = F.concat("_words", F.array(F.lit(""))) if saved.anchorless else F.col("_words")
    asked = rows.select(*keys, F.explode(met).alias("anchor"))
    names = [c for c in saved.clauses.columns if c != "anchor"]
    # A row per anchor, with the clauses under it: as many as searches share their rarest word.
    table = saved.clauses.groupBy("anchor").agg(F.collect_list(F.struct(*names)).alias("_clauses"))
    candidates = salted_lookup(asked, table, ["anchor"], spread_on=keys).groupBy(*keys).agg(
        F.flatten(F.collect_list("_clauses")).alias("_clauses")
    )

    def spoken(phrase: Column) -> Column:
        return F.coalesce(F.contains(F.try_element_at("_texts", phrase["field"]), phrase["text"]), F.lit(False))

    def true_at(place: Column) -> Column:
        return F.get("_holds", place)

    def fits(c: Column) -> Column:
        return (
            (F.size(F.array_except(c["words"], F.col("_words"))) == 0) & ~F.arrays_overlap(c["no_words"], F.col("_words"))
            & F.forall(c["phrases"], spoken) & ~F.exists(c["no_phrases"], spoken)
            & F.forall(c["holds"], true_at) & ~F.exists(c["fails"], true_at)
        )

    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    checked = rows.alias("l").join(candidates.alias("r"), same).select(
        *[F.col(f"l.{k}").alias(k) for k in keys], "_words", "_texts", "_holds", "_clauses"
    )
    found = checked.select(*keys, F.explode(F.transform(F.filter("_clauses", fits), lambda c: c["search"])).alias("search"))
    return found.select("search", *keys).distinct()


def follow(
    stream: DataFrame, saved: SavedSearches, fields: dict[str, Column], path: str, available_now: bool = False,
    every: str = "5 seconds",
) -> StreamingQuery:
    """Write the hits (search, inbox, num) of a stream's messages to `path`/hits.

    A search has a position per inbox, the highest number it found there: messages at or
    below it were seen before. Positions are one snapshot per micro-batch, and a batch
    that is run again reads the one before it and writes its own again.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        before = last_batch(spark, f"{path}/positions", number)
        old = read_table(spark, f"{path}/positions", POSITIONS).where(F.col("batch") == (-1 if before is None else before)).drop("batch")
        hits = matches(batch, saved, fields, ["inbox", "num"])
        fresh = hits.join(old, ["search", "inbox"], "left").where(F.col("num") > F.coalesce("max_num", F.lit(-(2**63))))
        write_batch(fresh.select("search", "inbox", "num"), f"{path}/hits", number)
        told = spark.read.parquet(f"{path}/hits/batch={number}").groupBy("search", "inbox").agg(F.max("num").alias("max_num"))
        write_batch(
            old.unionByName(told).groupBy("search", "inbox").agg(F.max("max_num").alias("max_num")), f"{path}/positions", number
        )

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/_checkpoints/saved")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
