"""What the modules of this package share: table access and plain columns."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivelake.session import ship_package

#: ASCII white space, the only characters that part words in this package.
SPACES = " \t\n\x0b\x0c\r"

#: Rows per Arrow batch. Texts may be long, so batches are kept short.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers and keep Arrow batches short."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the runs of other characters than ASCII white space; null: none."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.filter(parts, lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def unit_hash(*columns: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released(task: Task) -> Task:
    """The task, after which its worker gives unused memory back to the system.

    Workers live on and serve other stages, and an executor's memory is shared by all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return run


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as keep it from beginning a column's."""
    taken = [c.lower() for c in docs.columns]
    while any(c.startswith(name) for c in taken):
        name = "_" + name
    return name


class WordMemory:
    """What a worker has worked out about words, in bounded space.

    `learn(words)` gives the values of new words. Values are kept in two generations of
    `limit` words each; when the younger is full it becomes the older, and words that
    are met again move back, so frequent words stay.
    """

    def __init__(self, learn: Callable[[list[str]], dict[str, Any]], limit: int) -> None:
        self._learn, self._limit = learn, limit
        self._young: dict[str, Any] = {}
        self._old: dict[str, Any] = {}

    def values(self, texts: list[list[str]]) -> list[list[Any]]:
        """Values of the words of each text. No value may be None."""
        get = self._young.get
        found = [list(map(get, text)) for text in texts]
        missing = {
            w for text, values in zip(texts, found, strict=True) if None in values
            for w, v in zip(text, values, strict=True) if v is None
        }
        if not missing:
            return found
        old = self._old
        again = {w: old[w] for w in missing if w in old}
        new = self._learn([w for w in missing if w not in again])
        if len(self._young) + len(missing) > self._limit:
            self._old, self._young = self._young, {}
        self._young |= again
        self._young |= new
        return [
            values if None not in values else [
                v if v is not None else again[w] if w in again else new[w]
                for w, v in zip(text, values, strict=True)
            ]
            for text, values in zip(texts, found, strict=True)
        ]
