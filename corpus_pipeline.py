"""Corpus pipeline: from documents to packed training sequences.

Toxic texts go, then texts in no learned language, then all but one of every group of
near copies; sources are mixed to target weights and what is left is packed. A stage
gets its predecessor's documents and returns those it keeps, with all their columns;
the last one returns a row per piece of a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivelake.llm import langid, mixing, packing, simhash, toxicity
from archivelake.llm.base import free_name, prepare, read_table
from archivelake.session import work_folder

#: Language prototypes and linked components are iterative or learned: no SQL form.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the texts whose toxicity score is below 0.7; labels teach the model."""
    prepare(spark)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.learn(docs.select("doc_id", "text"), labels)
    toxic = free_name(docs, "toxic")
    return toxicity.score(docs, model, docs.columns, out=toxic).where(F.col(toxic) == 0).select(*docs.columns)


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the texts with letters that are like one of the languages of the table.

    A text has to be as like its language, and as much more than any other, as nearly all
    texts of that length of the learned languages; these are measured on held-out rows.
    """
    prepare(spark)
    labelled = docs.select("doc_id", "text", "lang")
    names, prototypes = langid.learn(labelled.where(~langid.held_out()))
    cuts = langid.least_likeness(labelled.where(langid.held_out()), names, prototypes)
    language = free_name(docs, "language")
    told = langid.predict(docs, names, prototypes, out=language)
    return told.where(langid.is_known(cuts, out=language)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of every group of near copies."""
    prepare(spark)
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep a sample whose token shares meet the targets."""
    prepare(spark)
    mix = free_name(docs, "mix")
    return mixing.sample(docs, out=mix).where(f"{mix}_sampled").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", drop_unknown_languages),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is stored before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = work_folder(spark, f"pipeline-{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
