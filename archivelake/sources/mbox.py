"""Mailbox files as a Spark data source, split by byte range.

`spark.read.format("mailbox").option("variant", "mboxrd").load(paths)` gives one
row per message. Uncompressed mboxrd and mboxo files are cut into byte ranges
and every range reads the messages whose `From ` line starts inside it, so one
huge file is read by many tasks. The Content-Length variants and compressed
files can only be read from the start and take one task per file.
"""

from __future__ import annotations

import bz2
import glob
import gzip
import lzma
import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, offset bigint, raw binary"
VARIANTS = ("mboxrd", "mboxo", "mboxcl", "mboxcl2")
#: Separator line of RFC 4155: an address and an asctime date. A zone may stand before
#: or after the year, as some writers put it, and the seconds may be missing.
FROM_LINE = re.compile(
    rb"From [^ ]+ +(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +[0-9]{1,2} "
    rb"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?: [A-Z]{1,5}| [+-][0-9]{4})? [0-9]{4}(?: [A-Z]{1,5}| [+-][0-9]{4})?[ \t]*\r?\n"
)
ESCAPED = {
    "mboxrd": re.compile(rb"^>(>*From )", re.M),
    "mboxo": re.compile(rb"^>(From )", re.M),
    "mboxcl": re.compile(rb"^>(From )", re.M),
}
OPENERS = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}


def _open(path: str):
    opener = OPENERS.get(os.path.splitext(path)[1])
    return opener(path, "rb") if opener else open(path, "rb")


def _unescaped(raw: bytes, variant: str) -> bytes:
    rule = ESCAPED.get(variant)
    return rule.sub(rb"\1", raw) if rule else raw


def read_range(
    path: str, start: int, end: int | None, variant: str
) -> Iterator[tuple[str, int, bytes]]:
    """Messages whose separator line starts in [start, end)."""
    with _open(path) as stream:
        if start:
            stream.seek(start - 1)
            stream.readline()  # finish the line the previous range owns
        at = stream.tell()
        begun: int | None = None
        lines: list[bytes] = []
        for line in stream:
            if FROM_LINE.match(line):
                if begun is not None and b"".join(lines).strip():
                    yield path, begun, _finish(lines, variant)
                if end is not None and at >= end:
                    return
                begun, lines = at, []
            elif begun is not None:
                lines.append(line)
            at += len(line)
        if begun is not None and b"".join(lines).strip():
            yield path, begun, _finish(lines, variant)


def _finish(lines: list[bytes], variant: str) -> bytes:
    raw = b"".join(lines)
    for end in (b"\n\r\n", b"\n\n"):  # blank line before the next separator
        if raw.endswith(end):
            raw = raw[: len(raw) - len(end) + 1]
            break
    return _unescaped(raw, variant)


def read_counted(path: str, variant: str) -> Iterator[tuple[str, int, bytes]]:
    """Messages framed by exactly one numeric Content-Length."""
    with _open(path) as stream:
        at = 0
        while True:
            head: list[bytes] = []
            start = at
            for line in iter(stream.readline, b""):
                at += len(line)
                if not head and not line.strip(b"\r\n"):
                    continue
                head.append(line)
                if not line.strip(b"\r\n"):
                    break
            if not head:
                return
            if not head[0].startswith(b"From "):
                raise ValueError(f"{path}: no separator line at byte {start}")
            block = b"".join(head[1:])
            sizes = re.findall(rb"(?im)^content-length:[ \t]*(.*?)\r?$", block)
            if len(sizes) != 1 or not sizes[0].isdigit():
                raise ValueError(f"{path}: need one numeric Content-Length at {start}")
            body = stream.read(int(sizes[0]))
            at += len(body)
            if len(body) != int(sizes[0]):
                raise ValueError(f"{path}: message at byte {start} is cut short")
            yield path, start, block + _unescaped(body, variant)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        super().__init__(f"{path}:{start}")
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.variant = options.get("variant", "mboxrd")
        if self.variant not in VARIANTS:
            raise ValueError(f"unknown mailbox variant {self.variant!r}")
        self.width = int(options.get("splitBytes", str(128 << 20)))
        self.paths = sorted(
            p for pattern in options["path"].split(",") for p in glob.glob(pattern)
        )

    def partitions(self):
        out = []
        for path in self.paths:
            whole = os.path.splitext(path)[1] in OPENERS or self.variant.startswith("mboxcl")
            size = os.path.getsize(path)
            if whole or size == 0:
                out.append(_Range(path, 0, None))
                continue
            for start in range(0, size, self.width):
                out.append(_Range(path, start, min(start + self.width, size)))
        return out

    def read(self, partition):
        if self.variant.startswith("mboxcl"):
            yield from read_counted(partition.path, self.variant)
        else:
            yield from read_range(
                partition.path, partition.start, partition.end, self.variant
            )


class MailboxSource(DataSource):
    """Data source named `mailbox`; paths are on a file system every task sees."""

    @classmethod
    def name(cls):
        return "mailbox"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_mailbox(
    spark: SparkSession, path: str, variant: str = "mboxrd", split_bytes: int | None = None
) -> DataFrame:
    """Messages of mailbox files: `path, offset, raw`."""
    spark.dataSource.register(MailboxSource)
    reader = spark.read.format("mailbox").option("variant", variant)
    if split_bytes:
        reader = reader.option("splitBytes", str(split_bytes))
    return reader.option("path", path).load()


# Status letters and the keywords they stand for.
STATUS_KEYWORDS = {"F": "flagged", "A": "answered", "R": "seen", "T": "draft"}


def status_keywords(status: Column, x_status: Column) -> Column:
    """Sorted keywords of the Status and X-Status headers."""
    text = F.concat_ws("", x_status, status)
    found = [
        F.when(F.contains(text, F.lit(letter)), F.lit(word))
        for letter, word in STATUS_KEYWORDS.items()
    ]
    return F.array_sort(F.array_compact(F.array(*found)))
