"""Token ids in files of fixed-width packed bits.

File layout, all numbers little-endian:

    "PKT1", width (u4), ids per block (u4)
    blocks: `ids per block` ids of `width` bits each, first bit lowest; the last
        block is shorter and filled up to a whole byte
    index: block offsets (u8 each), then per document its id (i8), whether that
        is null (u1) and the place of its first token (u8, one more at the end)
    number of blocks (u8), of documents (u8), place of the index (u8), "PKT1"

A block always starts at a whole byte, so the block offsets let a reader take
any token range without the tokens before it.
"""

from __future__ import annotations

import io
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivelake.llm import tokens
from archivelake.llm.base import prepare, released
from archivelake.session import durable, work_folder

MAGIC = b"PKT1"
BLOCK_IDS = 1 << 16
END_ID = 1


def bits_for(vocabulary: int) -> int:
    """Least number of bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """The ids in `width` bits each, first bit lowest, filled to a whole byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """The first n ids of packed bytes, as u4."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little")
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits.reshape(n, width)
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Streams documents into one file: holds one block and the index."""

    def __init__(self, sink: io.RawIOBase, width: int, block_ids: int = BLOCK_IDS) -> None:
        self.sink, self.width, self.block_ids = sink, width, block_ids
        sink.write(MAGIC + struct.pack("<II", width, block_ids))
        self.place = 12
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.blocks: list[int] = []
        self.doc_ids: list[int | None] = []
        self.starts = [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, "<u4")
        low = 0
        while len(ids) - low >= self.block_ids or (last and low < len(ids)):
            data = pack(ids[low:low + self.block_ids], self.width)
            self.blocks.append(self.place)
            self.sink.write(data)
            self.place += len(data)
            low += self.block_ids
        self.waiting = [ids[low:]]
        self.held = len(self.waiting[0])

    def finish(self) -> None:
        self._flush(last=True)
        known = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        for part in (np.array(self.blocks, "<u8"), known, null, np.array(self.starts, "<u8")):
            self.sink.write(part.tobytes())
        self.sink.write(struct.pack("<QQQ", len(self.blocks), len(self.doc_ids), self.place) + MAGIC)


class Reader:
    """Random access to a file: `ids(low, high)` reads only the blocks it needs."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.seek(0, 2)
        head, tail = self._at(0, 12), self._at(size - 28, 28)
        if head[:4] != MAGIC or tail[-4:] != MAGIC:
            raise ValueError("not a packed token file, or cut short")
        self.width, self.block_ids = struct.unpack("<II", head[4:])
        n_blocks, n_docs, place = struct.unpack("<QQQ", tail[:24])
        index = self._at(place, size - 28 - place)
        self.blocks = np.append(np.frombuffer(index, "<u8", n_blocks), np.uint64(place)).astype(np.int64)
        at = 8 * n_blocks
        self.doc_ids = np.frombuffer(index, "<i8", n_docs, at)
        self.null = np.frombuffer(index, np.uint8, n_docs, at + 8 * n_docs).astype(bool)
        self.starts = np.frombuffer(index, "<u8", n_docs + 1, at + 9 * n_docs).astype(np.int64)

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids `low` up to `high` of the file."""
        if high <= low:
            return np.empty(0, "<u4")
        first, last = low // self.block_ids, (high - 1) // self.block_ids
        data = self._at(int(self.blocks[first]), int(self.blocks[last + 1] - self.blocks[first]))
        total = int(self.starts[-1])
        out = []
        for b in range(first, last + 1):  # each block begins at a whole byte
            part = data[self.blocks[b] - self.blocks[first]:self.blocks[b + 1] - self.blocks[first]]
            out.append(unpack(part, self.width, min(self.block_ids, total - b * self.block_ids)))
        return np.concatenate(out)[low - first * self.block_ids:high - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        """Ids of the file's k-th document."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


@lru_cache(maxsize=4)
def _store(folder: str):
    """pyarrow's file system of a folder, by its URI, and the path below it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


MANIFEST = "file string, first_doc long, n_docs long, n_ids long"


def write_files(
    docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Encode `text` of (doc_id, text) and write packed files in ascending doc_id.

    Rows go to tasks by ranges of doc_id, so files hold ever higher ids, nulls
    before all; equal ids stand by text. Each task writes one file under a name of
    its own, and only files named in the returned manifest count: what a lost or
    repeated task left is never read. The manifest is checkpointed.
    """
    prepare(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokens.encoder(path)
        width = bits_for(codec.size)
        end = np.array([end_id], codec.dtype)
        writer = name = sink = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store, base = _store(folder)
                store.create_dir(base, recursive=True)
                name = f"tokens-{uuid.uuid4().hex}.pkt"
                sink = store.open_output_stream(posixpath.join(base, name))
                writer = Writer(sink, width, block_ids)
            found = codec.ids(batch.column("text").to_pylist())
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                writer.add(doc_id, np.concatenate([own, end]))
        if writer is not None:
            writer.finish()
            sink.close()
            yield pa.RecordBatch.from_pydict({
                "file": pa.array([name]), "first_doc": pa.array([writer.doc_ids[0]], pa.int64()),
                "n_docs": pa.array([len(writer.doc_ids)], pa.int64()),
                "n_ids": pa.array([writer.starts[-1]], pa.int64()),
            })

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    sorted_rows = ordered.sortWithinPartitions("doc_id", "text")
    return durable(sorted_rows.mapInArrow(released(task), MANIFEST))


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files.

    `start` counts the ids of all documents before, over all files. One task reads
    one file; only the manifest, a row per file, is put in order.
    """
    order = [F.col("first_doc").asc_nulls_first(), F.col("file")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    n_files = max(1, manifest.count())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(*[batch.column(c).to_pylist() for c in ("file", "base")], strict=True):
                store, below = _store(folder)
                with store.open_input_file(posixpath.join(below, name)) as source:
                    reader = Reader(source)
                    n = len(reader.doc_ids)
                    for low in range(0, n, 1000):
                        high = min(n, low + 1000)
                        sums = [zlib.crc32(reader.document(k).tobytes()) for k in range(low, high)]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(reader.doc_ids[low:high], mask=reader.null[low:high]),
                            "start": pa.array(reader.starts[low:high] + base),
                            "n_tokens": pa.array(np.diff(reader.starts[low:high + 1])),
                            "ids_crc32": pa.array(sums, pa.int64()),
                        })

    # A given number of partitions, or Spark would put all of these small rows in one.
    spread = placed.coalesce(1).repartition(n_files)
    return spread.mapInArrow(released(task), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_files(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, str]:
    """Write the packed files below the shared checkpoint folder: manifest, folder."""
    folder = work_folder(docs.sparkSession, "packed-tokens")
    return write_files(docs, folder, path, end_id), folder
