"""Append-only tables written by streams, one folder per micro-batch.

A micro-batch that is run again writes the same folder again, so a lost driver
or executor leaves no double rows. Readers that must not see the batch being
written pass `before`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path: works for every store Spark reads."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def read_table(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of all batches, or of those before one; empty when no batch is there yet.

    Only a missing folder is an empty table: any other fault is raised.
    """
    store, where = file_system(spark, path)
    if not store.exists(where):
        return spark.createDataFrame([], schema + ", batch bigint")
    df = spark.read.schema(schema + ", batch bigint").parquet(path)
    return df if before is None else df.where(F.col("batch") < before)


def last_batch(spark: SparkSession, path: str, before: int) -> int | None:
    """Number of the last batch before one, by the names of the folders."""
    store, where = file_system(spark, path)
    if not store.exists(where):
        return None
    names = [s.getPath().getName() for s in store.listStatus(where)]
    found = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]
    return max((n for n in found if n < before), default=None)


def stream_table(spark: SparkSession, folder: str, name: str, schema: str, **options) -> DataFrame:
    """File stream of a Parquet table that is one file or a folder of part files."""
    store, where = file_system(spark, f"{folder}/{name}.parquet")
    if store.getFileStatus(where).isDirectory():
        return stream_files(spark, f"{folder}/{name}.parquet", schema, **options)
    return stream_files(spark, folder, schema, glob=f"{name}.parquet", **options)


def stream_files(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", glob: str | None = None,
    max_files: int | None = None, max_bytes: str | None = None,
) -> DataFrame:
    """File stream; micro-batches bounded by files or by bytes."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.load(path)
