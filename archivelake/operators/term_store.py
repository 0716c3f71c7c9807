"""A stored term index: postings in buckets by term, document lengths beside them.

The text is read once, when documents are added. A search reads only the buckets of
its words, and files are sorted by term, so that their bounds rule most of them out.
Two sorted dictionaries lead from the beginning of a word and from a stem to the words
there are. Documents are added in batches; a batch counts once its mark is set, so a
lost job leaves nothing half there, and one that is written again replaces itself. Of
a document that is added again the newest batch counts.
"""

from __future__ import annotations

import zlib
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivelake.functions.stem import stem, stems
from archivelake.operators import predicates as p
from archivelake.operators import rank
from archivelake.operators.postings import build_postings, document_frequency, document_lengths
from archivelake.session import durable
from archivelake.streaming.tables import file_system

BUCKETS = 256
#: A word that no document has.
_NO_WORD = "\u0000"


def term_bucket(term: Column) -> Column:
    return (F.crc32(F.encode(term, "UTF-8")) % BUCKETS).cast("int")


def buckets_of(terms: list[str]) -> list[int]:
    """Buckets that hold the postings of some terms."""
    return sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})


def live_batches(spark: SparkSession, path: str) -> dict[int, bool]:
    """Batches whose mark is set, and whether they hold documents added before."""
    store, where = file_system(spark, f"{path}/_marks")
    if not store.exists(where):
        return {}
    names = [s.getPath().getName().split("-") for s in store.listStatus(where)]
    return {int(n[0]): n[1] == "again" for n in names}


def _mark(spark: SparkSession, path: str, batch: int, again: bool | None) -> None:
    """Set the mark of a batch, or take it off (None)."""
    for kind in ("new", "again"):
        store, where = file_system(spark, f"{path}/_marks/{batch}-{kind}")
        if store.exists(where):
            store.delete(where, False)
    if again is not None:
        store, where = file_system(spark, f"{path}/_marks/{batch}-{'again' if again else 'new'}")
        store.create(where, True).close()


def add_documents(fields: DataFrame, path: str, batch: int, positions: bool = True) -> None:
    """Index text fields (docid, field, value, weight, at) of new documents as one batch.

    A frequent word's bucket is split into as many files as its size asks for. Only
    documents with a word count as added again.
    """
    spark = fields.sparkSession
    _mark(spark, path, batch, None)
    earlier = [b for b in live_batches(spark, path) if b < batch]
    later = [b for b in live_batches(spark, path) if b > batch]
    # A set number: merged partitions would leave too few to split a frequent word's bucket between.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = build_postings(fields, positions, whole=True, parts=parts).withColumn("bucket", term_bucket(F.col("term")))
    target = f"{path}/postings/batch={batch}"
    # Spark splits the large shuffle partitions of a rebalanced table, hot words included.
    dealt = postings.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "docid")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(target)
    # Lengths and words come from the stored postings, not from the text again.
    stored = spark.read.parquet(target)
    document_lengths(stored).write.mode("overwrite").parquet(f"{path}/lengths/batch={batch}")
    # Kept, since dealing out by range reads its input twice.
    words = durable(stored.select("term").distinct().withColumn("stem", stems(F.col("term"))))
    words.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms/batch={batch}")
    words = spark.read.parquet(f"{path}/terms/batch={batch}")
    words.repartitionByRange("stem", "term").sortWithinPartitions("stem", "term").write.mode("overwrite").parquet(
        f"{path}/stems/batch={batch}"
    )
    again = False
    if earlier or later:
        own = spark.read.parquet(f"{path}/lengths/batch={batch}").select("docid")
        others = spark.read.parquet(f"{path}/lengths").where(F.col("batch").isin(earlier + later)).select("docid")
        own.join(others.distinct(), "docid", "left_semi").write.mode("overwrite").parquet(f"{path}/again/batch={batch}")
        again = not spark.read.parquet(f"{path}/again/batch={batch}").isEmpty()
    _mark(spark, path, batch, again)


def _live(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of the batches that count, each document in its newest one."""
    marks = live_batches(spark, path)
    rows = spark.read.parquet(f"{path}/{table}").where(F.col("batch").isin(list(marks)))
    if any(marks.values()) and "docid" in rows.columns:
        lengths = spark.read.parquet(f"{path}/lengths").where(F.col("batch").isin(list(marks)))
        repeated = spark.read.parquet(f"{path}/again").where(F.col("batch").isin([b for b, again in marks.items() if again]))
        newest = lengths.join(repeated.select("docid").distinct(), "docid", "left_semi").groupBy("docid").agg(
            F.max("batch").alias("_newest")
        )
        rows = rows.join(newest, "docid", "left").where("_newest is null or batch = _newest").drop("_newest")
    return rows.drop("batch")


def read_postings(
    spark: SparkSession, path: str, terms: list[str] | None = None, prefixes: list[str] | None = None
) -> DataFrame:
    """All postings, or those of some terms and of all words with some beginnings."""
    df = _live(spark, path, "postings")
    if terms is not None or prefixes:
        buckets = set(buckets_of(terms or []))
        for prefix in prefixes or []:
            # At most BUCKETS rows, whatever the number of words.
            found = words_with_prefix(spark, path, prefix).select(term_bucket(F.col("term")).alias("b")).distinct()
            buckets |= {r.b for r in found.collect()}
        wanted = [F.col("term").isin(terms or [])] + [F.col("term").startswith(x) for x in prefixes or []]
        df = df.where(F.col("bucket").isin(sorted(buckets)) & reduce(or_, wanted))
    return df.drop("bucket")


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    return _live(spark, path, "lengths")


def words_with_prefix(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Distinct words that a trailing wildcard stands for, from the dictionary by term."""
    return _live(spark, path, "terms").where(F.col("term").startswith(prefix)).select("term").distinct()


def words_with_stem(spark: SparkSession, path: str, word: str) -> DataFrame:
    """Distinct words with the stem of a word, from the dictionary by stem."""
    return _live(spark, path, "stems").where(F.col("stem") == stem(word.lower())).select("term").distinct()


def frequencies(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """Documents and weighted occurrences of every (field, term), or of some terms."""
    return document_frequency(read_postings(spark, path, terms))


def in_words(spark: SparkSession, path: str, predicate: p.Predicate) -> p.Predicate:
    """The predicate with every stem put as the words that share it.

    The words of a stem are collected: they are the forms of one word.
    """
    if isinstance(predicate, (p.And, p.Or)):
        return type(predicate)([in_words(spark, path, i) for i in predicate.items])
    if isinstance(predicate, p.Not):
        return p.Not(in_words(spark, path, predicate.item))
    if isinstance(predicate, p.Stem):
        words = sorted(r.term for r in words_with_stem(spark, path, predicate.word).collect())
        return p.Or([p.Term(w, predicate.field) for w in words or [_NO_WORD]])
    return predicate


def search(spark: SparkSession, path: str, docs: DataFrame, predicate: p.Predicate) -> DataFrame:
    """Documents that satisfy a predicate, found with the stored index."""
    predicate = in_words(spark, path, predicate)
    terms, prefixes = [], []
    for leaf in p._leaves(predicate):
        if isinstance(leaf, p.Prefix):
            prefixes.append(leaf.prefix)
        else:
            terms.extend(leaf.words if isinstance(leaf, p.Phrase) else [leaf.term])
    return p.search(read_postings(spark, path, terms, prefixes), docs, predicate)


def scores(spark: SparkSession, path: str, terms: list[str], field: str = "") -> DataFrame:
    """(docid, score) of the documents with any of the terms, as `rank.bm25`."""
    return rank.bm25(read_postings(spark, path, terms), terms, field, read_lengths(spark, path))
