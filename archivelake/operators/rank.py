"""Scores, sort orders, collapsing and paging of search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivelake.operators.postings import FIELDS, document_lengths
from archivelake.operators.skew import keep_first, salted_lookup

K1, B = 1.2, 0.75  # BM25 parameters


def bm25(postings: DataFrame, terms: list[str], field: str = "",
         lengths: DataFrame | None = None) -> DataFrame:
    """(docid, score) of the documents holding any of the terms.

    `lengths` has (docid, doclen), counted from the postings when not given.
    Each term's share is rounded to a millionth and added as an integer, so the
    score does not depend on the order of addition.
    """
    fields = FIELDS.get(field, [field])
    chosen = postings.where(F.col("field").isin(fields) & F.col("term").isin(terms))
    wanted = chosen.groupBy("docid", "term").agg(F.sum("wdf").alias("wdf"))
    if lengths is None:
        lengths = document_lengths(postings)
    corpus = lengths.agg(F.count("*").alias("_n"), F.avg("doclen").alias("_avg"))
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    # As many rows as query terms, and one row of corpus figures.
    scored = (
        wanted.join(F.broadcast(df), "term").join(lengths, "docid").join(F.broadcast(corpus))
    )
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("doclen") / F.col("_avg"))
    share = idf * (F.col("wdf") * (K1 + 1)) / (F.col("wdf") + norm)
    return scored.groupBy("docid").agg(F.sum(F.round(share * 1_000_000).cast("bigint")).alias("score"))


def percent(scored: DataFrame) -> DataFrame:
    """Add `pct`: share of the best score, at most 99."""
    best = scored.agg(F.max("score").alias("_best"))
    pct = F.least(F.lit(99), F.floor(100 * F.col("score") / F.col("_best"))).cast("int")
    return scored.join(F.broadcast(best)).withColumn("pct", pct).drop("_best")


def percent_bounds(page: DataFrame) -> DataFrame:
    return page.agg(F.min("pct").alias("min_pct"), F.max("pct").alias("max_pct"))


#: One sort column: name, and whether it ascends.
SortColumn = tuple[str, bool]


def sort_order(relevance: int = 0, ascending: bool = False) -> list[SortColumn]:
    """Sort columns: 0 received time, >0 score, -1 docid up, -2 docid down."""
    if relevance < 0:
        return [("docid", relevance == -1)]
    if relevance == 0:
        return [("ts", ascending), ("score", False), ("docid", True)]
    return [("score", False), ("ts", ascending), ("docid", True)]


def page(hits: DataFrame, order: list[SortColumn], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page; a negative offset pages from the other end. Nulls come last either way."""
    back = offset < 0
    columns = [F.col(n).asc_nulls_last() if up != back else F.col(n).desc_nulls_last() for n, up in order]
    return hits.orderBy(*columns).offset(-offset - 1 if back else offset).limit(limit)


def collapse_threads(hits: DataFrame) -> DataFrame:
    """Best hit of every thread (least `rank`); hits without a thread all stay."""
    key = F.coalesce(F.col("tid"), -F.col("docid"))
    return keep_first(hits.withColumn("_k", key), ["_k"], ["rank"], "docid").drop("_k")


def preferred_copies(xref: DataFrame, inboxes: DataFrame) -> DataFrame:
    """Copy shown for every docid: lowest inbox position, then lowest number."""
    placed = salted_lookup(xref, inboxes.select("inbox", "pos"), ["inbox"], spread_on="docid")
    return placed.groupBy("docid").agg(
        F.min(F.struct("pos", "xnum", "inbox", "oid")).alias("_b")
    ).select("docid", "_b.inbox", "_b.xnum", "_b.oid")


def estimated_matches(hits: DataFrame, exact: bool = True) -> DataFrame:
    counted = F.count("*") if exact else F.approx_count_distinct("docid")
    return hits.agg(counted.alias("matches"))
