"""Tables that a stream appends to, of a bounded number of files.

A micro-batch writes a folder, and a manifest names the folders that make up the table
at a version. When a level has `fan` folders they are merged into one of the next
level, so n batches leave about `fan` folders for each digit of n. The next manifest
makes a batch or a merge visible as a whole: a reader takes the folders of one version
and sees no row twice and none lost. Folders of past versions are kept for a while.
The manifest also holds the rows, the last batch and the greatest value of a column, so
those cost no scan.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivelake.streaming.tables import file_system

#: Folders of a level that are merged, and versions whose folders stay readable.
FAN, KEEP = 8, 8
#: Rows that a merged file holds at least, where there are as many.
FILE_ROWS = 1_000_000


@dataclass
class Manifest:
    """Folders of a version: name, level, rows, greatest value of the counted column."""

    version: int = 0
    batch: int = -1
    entries: list[dict] = field(default_factory=list)

    @property
    def top(self) -> int | None:
        return max((e["top"] for e in self.entries if e["top"] is not None), default=None)

    @property
    def rows(self) -> int:
        return sum(e["rows"] for e in self.entries)


class LogTable:
    """A table of rows with the number of their micro-batch in a column `batch`.

    There is one writer, as a stream has one driver. `top` names a number column whose
    greatest value the manifest keeps.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, top: str | None = None, fan: int = FAN, keep: int = KEEP):
        self.spark, self.path, self.schema, self.top_column = spark, path, f"{schema}, batch bigint", top
        self.fan, self.keep = fan, keep

    def _file(self, name: str):
        return file_system(self.spark, f"{self.path}/{name}")

    def versions(self) -> list[int]:
        store, where = self._file("_manifests")
        if not store.exists(where):
            return []
        names = [s.getPath().getName() for s in store.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version; an empty one before the first batch."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Manifest()
        store, where = self._file(f"_manifests/{version}.json")
        stream = store.open(where)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of the newest version, or of a given one that is still kept."""
        folders = [f"{self.path}/{e['folder']}" for e in self.manifest(version).entries]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _commit(self, found: Manifest) -> None:
        """Put a manifest in place by renaming a whole file."""
        text = json.dumps({"version": found.version, "batch": found.batch, "entries": found.entries})
        store, draft = self._file(f"_manifests/_{uuid.uuid4().hex}")
        out = store.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not store.rename(draft, self._file(f"_manifests/{found.version}.json")[1]):
            raise RuntimeError(f"{self.path}: version {found.version} is there already; a table has one writer")

    def _entry(self, folder: str, level: int) -> dict:
        """What the manifest says of a written folder."""
        value = F.max(self.top_column) if self.top_column else F.lit(None).cast("bigint")
        seen = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").agg(F.count("*").alias("n"), value.alias("top")).first()
        return {"folder": folder, "level": level, "rows": seen.n, "top": seen.top}

    def append(self, df: DataFrame, batch: int) -> None:
        """Add a micro-batch; one that is in the table already is passed over."""
        found = self.manifest()
        if batch <= found.batch:
            return
        folder = f"level=0/{batch}"
        df.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{self.path}/{folder}")
        found = Manifest(found.version + 1, batch, [*found.entries, self._entry(folder, 0)])
        self._commit(found)
        while (merged := self._merged(found)) is not None:
            found = merged
            self._commit(found)
        self._forget(found.version)

    def _merged(self, found: Manifest) -> Manifest | None:
        """The manifest after merging a full level's folders; None if none is full."""
        for level in sorted({e["level"] for e in found.entries}):
            own = [e for e in found.entries if e["level"] == level][:self.fan]
            if len(own) < self.fan:
                continue
            rows = sum(e["rows"] for e in own)
            folder = f"level={level + 1}/{own[0]['folder'].split('/')[1].split('-')[0]}-{own[-1]['folder'].split('/')[1].split('-')[-1]}"
            df = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{e['folder']}" for e in own])
            df.coalesce(max(1, rows // FILE_ROWS)).write.mode("overwrite").parquet(f"{self.path}/{folder}")
            entry = {"folder": folder, "level": level + 1, "rows": rows, "top": Manifest(entries=own).top}
            names = {e["folder"] for e in own}
            # Older rows stand first, so folders of a level are in the order of their batches.
            rest = [e for e in found.entries if e["folder"] not in names]
            at = sum(e["level"] > level for e in rest)
            return Manifest(found.version + 1, found.batch, [*rest[:at], entry, *rest[at:]])
        return None

    def _forget(self, newest: int) -> None:
        """Delete manifests past the kept versions, and folders that only those name."""
        versions = self.versions()
        old = [v for v in versions if v <= newest - self.keep]
        if not old:
            return
        kept = {e["folder"] for v in versions if v not in old for e in self.manifest(v).entries}
        gone = {e["folder"] for v in old for e in self.manifest(v).entries} - kept
        for name in [*gone, *[f"_manifests/{v}.json" for v in old]]:
            store, where = self._file(name)
            store.delete(where, True)
