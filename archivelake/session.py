"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Settings every job relies on. UTC keeps epoch arithmetic and date text equal
#: everywhere; the adaptive settings let Spark merge small shuffle partitions
#: and split large ones at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def build_session(
    app: str = "archivelake", master: str | None = None, **extra: str
) -> SparkSession:
    """A session with the library settings; `extra` overrides any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_dir_ready(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="archivelake-ckpt-"))
    else:
        raise RuntimeError(
            "spark.checkpoint.dir must name a shared folder on a cluster"
        )


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the cluster's shared folder."""
    _checkpoint_dir_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def durable_count(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """`durable`, and how many rows meet a condition, in the same job."""
    seen = Observation()
    kept = durable(df.observe(seen, F.count(F.when(condition, 1)).alias("n")))
    return kept, seen.get["n"]


#: Bounds of the Arrow batches that Python workers get. Rows may be whole messages.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def short_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session short, whatever the length of the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    import os
    import shutil

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="archivelake-py-"), "archivelake")
    archive = shutil.make_archive(
        base, "zip", os.path.dirname(package), os.path.basename(package)
    )
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for tables of one run."""
    import uuid

    _checkpoint_dir_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
