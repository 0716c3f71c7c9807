"""Search predicates as objects that compile to one pass over the postings.

Every text leaf gets a bit. One scan of the postings, filtered to the terms the
query names, yields the bits of each document with a single partially
aggregated `bit_or`; the predicate tree is then an ordinary filter over those
bits and the document columns, so date, size and number bounds reach the scan of
the document table.
"""

from __future__ import annotations

from dataclasses import dataclass, field as _field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivelake.functions.stem import stem
from archivelake.operators.postings import FIELDS, expand_prefix


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And([self, other])

    def __or__(self, other: Predicate) -> Predicate:
        return Or([self, other])

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Term(Predicate):
    """A word in a search field; `field=''` is the default set of fields."""

    term: str
    field: str = ""


@dataclass(frozen=True)
class Stem(Predicate):
    """Any word with the same English stem; needs postings from `with_stems`."""

    word: str
    field: str = ""


@dataclass(frozen=True)
class Prefix(Predicate):
    prefix: str
    field: str = ""


@dataclass(frozen=True)
class Phrase(Predicate):
    """Words next to each other in one field."""

    words: tuple[str, ...]
    field: str = ""


@dataclass(frozen=True)
class Where(Predicate):
    """A condition over document columns."""

    condition: Column = _field(compare=False)


@dataclass(frozen=True)
class And(Predicate):
    items: list[Predicate]


@dataclass(frozen=True)
class Or(Predicate):
    items: list[Predicate]


@dataclass(frozen=True)
class Not(Predicate):
    item: Predicate


def between(column: str, low=None, high=None, exclusive_end: bool = False) -> Where:
    """Range with open ends; ends are inclusive unless asked otherwise."""
    c = F.col(column)
    condition = F.lit(True)
    if low is not None:
        condition = condition & (c >= low)
    if high is not None:
        condition = condition & ((c < high) if exclusive_end else (c <= high))
    return Where(condition)


def sent_on(day_start: int, strict: bool = False) -> Where:
    """Sent on a day given by its first second.

    The range is `[x, x + 86400]` with both ends in, so the first second of the
    next day also matches; `strict` leaves it out.
    """
    return between("ds", day_start, day_start + 86_400, exclusive_end=strict)


def since(day_start: int) -> Where:
    return between("ts", day_start)


def before(day_start: int, strict: bool = False) -> Where:
    """Received before a day; its first second is included unless strict."""
    return between("ts", None, day_start, exclusive_end=strict)


def on(day_start: int) -> Where:
    return between("ts", day_start, day_start + 86_399)


def sent_since(day_start: int) -> Where:
    return between("ds", day_start)


def sent_before(day_start: int, strict: bool = False) -> Where:
    return between("ds", None, day_start, exclusive_end=strict)


def sent_within(day_start: int) -> Where:
    return between("ds", day_start, day_start + 86_399)


def newer_than(interval: str, column: str = "ts") -> Where:
    """Relative date, as an SQL interval: `newer_than("2 days")`."""
    edge = F.unix_timestamp(F.current_timestamp() - F.expr(f"INTERVAL {interval}"))
    return Where(F.col(column) >= edge)


def larger(size: int) -> Where:
    return Where(F.col("bytes") > size)


def smaller(size: int) -> Where:
    return Where(F.col("bytes") < size)


def uid_set(spec: str) -> Where:
    """`1:5,9,20:*` over article numbers."""
    ranges = []
    for piece in spec.split(","):
        low, _, high = piece.partition(":")
        if not high:
            ranges.append(F.col("num") == int(low))
        elif high == "*":
            ranges.append(F.col("num") >= int(low))
        else:
            a, b = sorted((int(low), int(high)))
            ranges.append(F.col("num").between(a, b))
    return Where(reduce(or_, ranges))


def keyword(name: str) -> Where:
    return Where(F.array_contains("kw", name))


def label(name: str) -> Where:
    return Where(F.array_contains("labels", name))


#: Conditions per bit column.
BITS = 62


def _leaves(p: Predicate) -> list[Predicate]:
    if isinstance(p, (And, Or)):
        return [x for i in p.items for x in _leaves(i)]
    if isinstance(p, Not):
        return _leaves(p.item)
    return [] if isinstance(p, Where) else [p]


def _needs_text(p: Predicate) -> bool:
    """True when only a document with some bit set can match."""
    if isinstance(p, And):
        return any(_needs_text(i) for i in p.items)
    if isinstance(p, Or):
        return all(_needs_text(i) for i in p.items)
    return not isinstance(p, (Not, Where))


def _condition(p: Predicate, bits: dict[Predicate, int]) -> Column:
    if isinstance(p, Where):
        return F.coalesce(p.condition, F.lit(False))
    if isinstance(p, And):
        return reduce(and_, [_condition(i, bits) for i in p.items])
    if isinstance(p, Or):
        return reduce(or_, [_condition(i, bits) for i in p.items])
    if isinstance(p, Not):
        return ~_condition(p.item, bits)
    word, bit = divmod(bits[p], BITS)
    mask = F.coalesce(F.col(f"_bits{word}"), F.lit(0))
    return mask.bitwiseAND(F.lit(1 << bit)) != 0


def phrase_docs(postings: DataFrame, words: tuple[str, ...], fields: list[str]) -> DataFrame:
    """Documents where the words stand next to each other in one field.

    Each posting votes for the start positions it is compatible with, so one
    aggregation on (docid, field, start) finds phrases of any length.
    """
    offsets: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        offsets.setdefault(w, []).append(i)
    table = F.create_map(
        *[x for w, at in offsets.items() for x in (F.lit(w), F.array(*[F.lit(i) for i in at]))]
    )
    wanted = postings.where(F.col("field").isin(fields) & F.col("term").isin(list(offsets)))
    votes = wanted.select(
        "docid", "field", "positions", F.explode(table[F.col("term")]).alias("offset")
    ).select("docid", "field", "offset", F.explode("positions").alias("pos"))
    starts = votes.groupBy("docid", "field", (F.col("pos") - F.col("offset")).alias("start")).agg(
        F.count("*").alias("n")
    )
    return starts.where(F.col("n") == len(words)).select("docid").distinct()


def search(postings: DataFrame, docs: DataFrame, predicate: Predicate) -> DataFrame:
    """Documents that satisfy the predicate, with all their columns."""
    leaves = list(dict.fromkeys(_leaves(predicate)))
    if not leaves:
        return docs.where(_condition(predicate, {}))
    bits = {leaf: i for i, leaf in enumerate(leaves)}
    columns = [f"_bits{w}" for w in range(-(-len(leaves) // BITS))]

    def masks(set_when: list[tuple[Column, int]]) -> list[Column]:
        """One column per BITS conditions, with the bits of those that hold."""
        out = []
        for w, name in enumerate(columns):
            own = [F.when(t, F.lit(1 << i % BITS)).otherwise(F.lit(0)).cast("bigint") for t, i in set_when if i // BITS == w]
            out.append(reduce(lambda a, b: a + b, own, F.lit(0).cast("bigint")).alias(name))
        return out

    tests, sets = [], []
    for leaf, i in bits.items():
        fields = FIELDS.get(leaf.field, [leaf.field])
        here = F.col("field").isin(fields)
        if isinstance(leaf, Phrase):
            sets.append(phrase_docs(postings, leaf.words, fields).select("docid", *masks([(F.lit(True), i)])))
            continue
        if isinstance(leaf, Prefix):
            match = F.col("term").startswith(leaf.prefix)
        elif isinstance(leaf, Stem):
            match = F.col("stem") == stem(leaf.word.lower())
        else:
            match = F.col("term") == leaf.term
        tests.append((here & match, i))
    if tests:
        any_of = reduce(or_, [t for t, _ in tests])
        sets.insert(0, postings.where(any_of).select("docid", *masks(tests)))
    hits = reduce(DataFrame.unionByName, sets).groupBy("docid").agg(*[F.bit_or(c).alias(c) for c in columns])
    how = "inner" if _needs_text(predicate) else "left"
    return docs.join(hits, "docid", how).where(_condition(predicate, bits)).drop(*columns)


def in_inbox(docs: DataFrame, xref: DataFrame, inbox: str, low: int | None = None,
             high: int | None = None) -> DataFrame:
    """Documents of a merged index that one inbox holds, maybe in a number range."""
    rows = xref.where(F.col("inbox") == inbox)
    if low is not None:
        rows = rows.where(F.col("xnum") >= low)
    if high is not None:
        rows = rows.where(F.col("xnum") <= high)
    return docs.join(rows.select("docid").distinct(), "docid", "left_semi")


def by_altid(docs: DataFrame, altid: DataFrame, prefix: str, num: int) -> DataFrame:
    """Documents with an alternate serial number."""
    wanted = altid.where((F.col("prefix") == prefix) & (F.col("num") == num))
    return docs.join(wanted.select("mid").distinct(), "mid", "left_semi")
