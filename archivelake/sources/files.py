"""Other file sources: Maildir, single messages, news spools, logs."""

from __future__ import annotations

import glob
import os
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Maildir flag letters and the keywords they stand for.
MAILDIR_KEYWORDS = {
    "D": "draft", "F": "flagged", "P": "forwarded", "R": "answered", "S": "seen",
}
SEPARATOR_LINE = r"\A[\r\n]*From [^\r\n]*\r?\n"


def maildir_flags(name: Column) -> Column:
    """Flag letters of a file name, '' when it has none, null when invalid."""
    pieces = F.split(name, ":")
    flags = F.regexp_extract(pieces[1], r"^2,([A-Za-z]*)$", 1)
    valid = pieces[1].rlike(r"^2,[A-Za-z]*$")
    return (
        F.when((F.size(pieces) > 2) | name.startswith("."), None)
        .when(F.size(pieces) == 1, "")
        .when(valid, flags)
    )


def flag_keywords(flags: Column) -> Column:
    """Sorted keywords of a flag string."""
    found = [
        F.when(F.contains(flags, F.lit(letter)), F.lit(word))
        for letter, word in MAILDIR_KEYWORDS.items()
    ]
    return F.array_sort(F.array_compact(F.array(*found)))


def without_separator(raw: Column) -> Column:
    """Drop a leading `From ` line from binary message text."""
    text = F.decode(raw, "ISO-8859-1")
    return F.encode(F.regexp_replace(text, SEPARATOR_LINE, ""), "ISO-8859-1")


def maildir_entries(files: DataFrame) -> DataFrame:
    """Valid, untrashed Maildir entries with their keywords.

    `files` needs a `path` column; other columns are kept.
    """
    name = F.substring_index("path", "/", -1)
    place = F.substring_index(F.substring_index("path", "/", -2), "/", 1)
    entries = (
        files.withColumn("name", name)
        .withColumn("place", place)
        .where(F.col("place").isin("new", "cur"))
        .withColumn("flags", maildir_flags(F.col("name")))
        .where(F.col("flags").isNotNull() & ~F.contains("flags", F.lit("T")))
    )
    # Messages in new/ carry no keywords, and no flags either.
    return entries.where((F.col("place") == "cur") | (F.col("flags") == "")).withColumn(
        "kw", flag_keywords(F.col("flags"))
    )


class _Shard(InputPartition):
    def __init__(self, folder: str, shard: int, shards: int):
        super().__init__(f"{folder}:{shard}")
        self.folder, self.shard, self.shards = folder, shard, shards


class _MaildirReader(DataSourceReader):
    def __init__(self, options):
        self.folders = sorted(glob.glob(options["path"]))
        self.shards = int(options.get("shards", "8"))

    def partitions(self):
        return [
            _Shard(os.path.join(folder, place), i, self.shards)
            for folder in self.folders for place in ("new", "cur") for i in range(self.shards)
        ]

    def read(self, partition):
        if not os.path.isdir(partition.folder):
            return
        with os.scandir(partition.folder) as entries:
            for entry in entries:
                if zlib.crc32(entry.name.encode()) % partition.shards != partition.shard:
                    continue
                try:
                    with open(entry.path, "rb") as source:
                        yield entry.path, source.read()
                except FileNotFoundError:  # renamed since it was listed
                    continue


class MaildirSource(DataSource):
    """Data source named `maildir`; folders are on a file system every task sees.

    File names hold colons, which the built-in file source cannot open. Each
    task lists the folder itself and takes its share of the names.
    """

    @classmethod
    def name(cls):
        return "maildir"

    def schema(self):
        return "path string, raw binary"

    def reader(self, schema):
        return _MaildirReader(self.options)


def read_maildir(spark: SparkSession, path: str, shards: int = 8) -> DataFrame:
    """Messages of Maildir folders: path, name, place, flags, kw, raw."""
    spark.dataSource.register(MaildirSource)
    found = spark.read.format("maildir").option("shards", str(shards)).option("path", path).load()
    return maildir_entries(found)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Single-message files: path, raw without a leading separator line."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", without_separator(F.col("content")).alias("raw"))


def read_spool(spark: SparkSession, path: str, next_num: int = 1) -> DataFrame:
    """Numbered article files from `next_num` on: num, path, raw.

    Numbers come from the file names, so gaps of any size are fine.
    """
    files = spark.read.format("binaryFile").load(path)
    num = F.substring_index("path", "/", -1).try_cast("long")
    return (
        files.select(num.alias("num"), "path", F.col("content").alias("raw"))
        .where(F.col("num") >= next_num)
    )


def usable_blobs(messages: DataFrame, raw: str = "raw", max_bytes: int | None = None) -> DataFrame:
    """Drop purged (empty) blobs and, if asked, oversized ones."""
    size = F.octet_length(F.col(raw))
    kept = messages.where(size > 0)
    return kept.where(size <= max_bytes) if max_bytes is not None else kept


def read_changes(changes: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Change-log entries by commit time, to be replayed in `seq` order."""
    if since is not None:
        changes = changes.where(F.col("ct") >= since)
    if until is not None:
        changes = changes.where(F.col("ct") <= until)
    return changes


def net_changes(changes: DataFrame) -> DataFrame:
    """Adds that no later delete of the same blob cancels.

    Each delete cancels the blob's latest earlier add still standing. The
    balance runs from the newest entry back, like the log is read, and is
    split into short ranges of `seq` so one blob cannot fill one task.
    """
    from archivelake.operators.ordered import running_from_end

    step = F.when(F.col("op") == "d", 1).otherwise(-1)
    return running_from_end(changes, ["inbox", "oid"], "seq", step)


def pull_new(
    numbered: DataFrame, offsets: DataFrame, source: str = "source", uid: str = "uid"
) -> DataFrame:
    """Rows above the stored last id of their source, with a status column.

    `offsets` has (source, last_uid, epoch). A changed epoch, or a stored id
    above the source's own `max_uid`, marks the row as refused.
    """
    from archivelake.operators.skew import salted_lookup

    known = offsets.select(source, "last_uid", F.col("epoch").alias("known_epoch"))
    joined = salted_lookup(numbered, known, [source], spread_on=uid, how="left")
    status = (
        F.when(F.col("known_epoch").isNotNull() & (F.col("known_epoch") != F.col("epoch")),
               "epoch changed")
        .when(F.col("last_uid") > F.col("max_uid"), "local ahead of source")
        .otherwise("new")
    )
    fresh = F.col("last_uid").isNull() | (F.col(uid) > F.col("last_uid"))
    marked = joined.withColumn("status", status)
    return marked.where((F.col("status") != "new") | fresh).drop("known_epoch")
