"""Saved searches, stateful de-dup, notifications and flag sync on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from archivelake.operators import annotations as ann
from archivelake.operators.skew import salted_lookup
from archivelake.streaming.tables import write_batch

OVERLAP = "48 hours"  # fixed value: how far back a refresh looks again


def new_hits(hits: DataFrame, saved: DataFrame, source: str = "inbox") -> DataFrame:
    """Hits above the stored highest number of their source."""
    joined = salted_lookup(hits, saved.select(source, "max_num"), [source], spread_on="num", how="left")
    return joined.where(F.col("num") > F.coalesce("max_num", F.lit(0))).drop("max_num")


def next_positions(hits: DataFrame, saved: DataFrame, source: str = "inbox") -> DataFrame:
    """Positions to store after a refresh; they never go back."""
    return (
        hits.groupBy(source).agg(F.max("num").alias("max_num"))
        .unionByName(saved.select(source, "max_num"))
        .groupBy(source).agg(F.max("max_num").alias("max_num"))
    )


def overlapping_hits(hits: DataFrame, last_run: int, seen: DataFrame, key: str = "oid",
                     overlap_seconds: int = 172_800) -> DataFrame:
    """Hits received since the last run less the overlap, without seen ones."""
    recent = hits.where(F.col("ts") >= last_run - overlap_seconds)
    return recent.join(seen.select(key).distinct(), key, "left_anti")


def stream_hits(stream: DataFrame, condition: Column) -> DataFrame:
    """Streaming form of a saved search over message columns."""
    return stream.where(condition)


def unique_stream(stream: DataFrame, keys: list[str], event_time: str | None = None,
                  overlap: str = OVERLAP) -> DataFrame:
    """First row of every key; with an event time, state is kept for the overlap only."""
    if event_time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(event_time, overlap).dropDuplicatesWithinWatermark(keys)


def notifications(stream: DataFrame) -> DataFrame:
    """Highest number and message count of every inbox, for update mode."""
    return stream.groupBy("inbox").agg(F.max("num").alias("max_num"), F.count("*").alias("n"))


def reader_positions(stream: DataFrame) -> DataFrame:
    """Highest deleted number and last visit per user and inbox."""
    return stream.groupBy("user", "inbox").agg(
        F.max("num").alias("last_del"), F.max("ts").alias("last_seen")
    )


def live_readers(state: DataFrame, now: int, ttl_seconds: int) -> DataFrame:
    """Reader state without readers that have not come back in time."""
    return state.where(F.col("last_seen") >= now - ttl_seconds)


def flag_updates(events: DataFrame, locations: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents whose keywords a folder's flags change.

    `events` has (folder, uid, kw) of entries seen before; `locations` gives the
    blob and `stored` has (oid, docid, kw). Works on a batch or inside
    `foreachBatch`.
    """
    found = salted_lookup(events, locations.select("folder", "uid", "oid").distinct(), ["folder", "uid"], "uid")
    old = stored.select("oid", "docid", F.col("kw").alias("old_kw"))
    joined = salted_lookup(found, old, ["oid"], spread_on="uid")
    return joined.where(ann.keywords_changed(F.col("old_kw"), F.col("kw"))).select("docid", "oid", "kw")


def route_events(events: DataFrame, folder_states: DataFrame) -> DataFrame:
    """What to do with each folder event, from the folder's state.

    `index-rw` imports, `index-ro` indexes, `tag-rw` and `tag-ro` only update
    keywords, `pause` drops the event; an unknown folder is left alone.
    """
    joined = salted_lookup(events, folder_states.select("folder", "state"), ["folder"], spread_on="uid", how="left")
    action = (
        F.when(F.col("state").startswith("import"), "import")
        .when(F.col("state").startswith("index"), "index")
        .when(F.col("state").startswith("tag"), "tag")
    )
    return joined.withColumn("action", action).where("action is not null")


def write_stream(df: DataFrame, path: str, name: str, mode: str = "append",
                 available_now: bool = False, every: str = "5 seconds") -> StreamingQuery:
    """Append a stream's micro-batches to a table, flushed at an interval."""
    writer = (
        df.writeStream.outputMode(mode)
        .foreachBatch(lambda batch, i: write_batch(batch, f"{path}/{name}", i))
        .option("checkpointLocation", f"{path}/_checkpoints/{name}")
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()
