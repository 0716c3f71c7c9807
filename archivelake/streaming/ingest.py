"""Continuous ingest, retraction and moderation of messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from archivelake.operators import dedupe, lookup, merged, normalize, overview, policy
from archivelake.operators.skew import salted_lookup
from archivelake.session import durable
from archivelake.sources.decode import decode
from archivelake.streaming.log_table import LogTable
from archivelake.streaming.tables import last_batch, read_table, write_batch

MESSAGES = (
    "inbox string, num bigint, seq bigint, mid string, content_hash string, subject string, "
    "ds bigint, ts bigint, bytes bigint, oid string, refs array<string>, mids array<string>, "
    "verdict string, raw binary"
)
REMOVALS = "inbox string, mid string, content_hash string, seq bigint"
DELETES = "inbox string, oid string"
#: Ids of stored messages, in buckets by hash, and the highest number of every inbox.
KNOWN_IDS = "inbox string, mid string, content_hash string, bucket int"
MARKS = "inbox string, max_num bigint"
ID_BUCKETS = 256
XREF = "docid bigint, inbox string, xnum bigint, oid string, mid string, content_hash string"


def store_arrivals(
    batch: DataFrame, batch_id: int, base: str,
    rules: list[tuple[str, str]] | None = None,
    filters: dict[str, str] | None = None,
    spam: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Decode, filter, settle duplicates, number and append one micro-batch.

    `batch` has (inbox, seq, raw). `spam` adds a `verdict` column, and only
    messages it accepts go on.
    """
    spark = batch.sparkSession
    decoded = decode(batch)
    watched = decoded.where(policy.watched(F.col("headers"), rules or []))
    passed = policy.apply_filters(watched, filters or {}).where("verdict = 'accept'").drop("verdict", "reason")
    if spam is not None:
        passed = spam(passed).where("verdict = 'accept'").drop("verdict")
    fresh = durable(normalize.to_messages(passed).drop("headers", "parts", "body"))
    # Only stored ids that arrive again matter: their buckets are read, no message.
    ids = fresh.select("inbox", F.explode("mids").alias("mid")).distinct().withColumn("bucket", id_bucket())
    touched = [r.bucket for r in ids.select("bucket").distinct().collect()]  # at most ID_BUCKETS
    stored = read_table(spark, f"{base}/known_ids", KNOWN_IDS, before=batch_id).where(F.col("bucket").isin(touched))
    known = stored.join(ids.select("inbox", "mid"), ["inbox", "mid"], "left_semi").select("inbox", "mid", "content_hash")
    settled = dedupe.settle_arrivals(fresh, known)
    kept = settled.where("store_mid is not null")
    previous = last_batch(spark, f"{base}/marks", batch_id)
    marks = (
        spark.createDataFrame([], MARKS) if previous is None
        else spark.read.schema(MARKS).parquet(f"{base}/marks/batch={previous}")
    )
    numbered = durable(overview.assign_numbers(kept, marks))
    out = numbered.withColumn("mid", F.col("store_mid")).withColumn(
        "mids", F.array_distinct(F.concat(F.array("store_mid"), F.col("mids")))
    )
    columns = [c.split(" ")[0] for c in MESSAGES.split(", ")]
    write_batch(out.select(*columns), f"{base}/messages", batch_id)
    new_ids = out.select("inbox", F.explode("mids").alias("mid"), "content_hash").withColumn("bucket", id_bucket())
    new_ids.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/known_ids/batch={batch_id}")
    highest = numbered.groupBy("inbox").agg(F.max("num").alias("max_num")).unionByName(marks)
    # All marks stand in the newest batch, a row per inbox.
    write_batch(highest.groupBy("inbox").agg(F.max("max_num").alias("max_num")), f"{base}/marks", batch_id)


def id_bucket() -> Column:
    return F.pmod(F.xxhash64("inbox", "mid"), F.lit(ID_BUCKETS)).cast("int")


def ingest(stream: DataFrame, base: str, available_now: bool = False, **options) -> StreamingQuery:
    """Run `store_arrivals` on every micro-batch; the checkpoint resumes exactly."""
    writer = stream.writeStream.foreachBatch(
        lambda df, i: store_arrivals(df, i, base, **options)
    ).option("checkpointLocation", f"{base}/_checkpoints/ingest")
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime="5 seconds").start()


def current_messages(messages: DataFrame, removals: DataFrame) -> DataFrame:
    """Stored messages less those removed later than they came.

    A removal without an inbox counts for every inbox.
    """
    everywhere = removals.where("inbox is null").groupBy("mid", "content_hash").agg(F.max("seq").alias("_all"))
    here = removals.where("inbox is not null").groupBy("inbox", "mid", "content_hash").agg(
        F.max("seq").alias("_one")
    )
    marked = messages.join(everywhere, ["mid", "content_hash"], "left").join(
        here, ["inbox", "mid", "content_hash"], "left"
    )
    gone = F.coalesce(F.greatest("_all", "_one") >= F.col("seq"), F.lit(False))
    return marked.where(~gone).drop("_all", "_one")


def retract(spam_batch: DataFrame, batch_id: int, base: str) -> None:
    """Messages seen in the spam folder are removed from every inbox."""
    found = normalize.to_messages(decode(spam_batch))
    rows = found.select(F.lit(None).cast("string").alias("inbox"), "mid", "content_hash", "seq")
    write_batch(rows, f"{base}/removals_spam", batch_id)


def moderation_plan(actions: DataFrame, inboxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(additions, removals) of moderated messages.

    `actions` has (action, seq, mid, content_hash, to, cc, list_ids). Spam leaves
    every inbox. `rm` leaves the addressed inboxes, or all when none is named.
    `ham` is added to the addressed inboxes. Each inbox comes once per message.
    """
    routes = lookup.route(actions.where("action in ('rm', 'ham')"), inboxes, ["seq"])
    routed = actions.select("action", "seq", "mid", "content_hash").join(routes, "seq")
    additions = routed.where("action = 'ham'").select("inbox", "seq", "mid", "content_hash")
    nowhere = actions.where("action = 'rm'").join(routes.select("seq").distinct(), "seq", "left_anti")
    everywhere = actions.where("action = 'spam'").select("seq", "mid", "content_hash").unionByName(
        nowhere.select("seq", "mid", "content_hash")
    )
    removals = routed.where("action = 'rm'").select("inbox", "seq", "mid", "content_hash").unionByName(
        everywhere.withColumn("inbox", F.lit(None).cast("string"))
    )
    return additions, removals


def moderate(stream: DataFrame, inboxes: DataFrame, base: str, available_now: bool = False) -> StreamingQuery:
    """Write the additions and removals of a moderation stream."""

    def run(batch: DataFrame, batch_id: int) -> None:
        additions, removals = moderation_plan(durable(batch), inboxes)
        write_batch(additions, f"{base}/additions", batch_id)
        write_batch(removals.select("inbox", "mid", "content_hash", "seq"), f"{base}/removals", batch_id)

    writer = stream.writeStream.foreachBatch(run).option(
        "checkpointLocation", f"{base}/_checkpoints/moderate"
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merge_log(stream: DataFrame, base: str, available_now: bool = False) -> StreamingQuery:
    """Incremental merged index: apply a stream of (op, inbox, xnum, oid, mid,
    content_hash, seq) changes.

    A micro-batch appends the copies it adds and the (inbox, blob) pairs it
    deletes. Of the stored copies only those with an id and content of the batch
    are looked at, and the highest document number stands in the manifest. Within a
    batch deletes come first; `merged_xref` reads the index.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        xref, gone = _merge_tables(batch.sparkSession, base)
        found = xref.manifest()
        if batch_id <= found.batch:
            return
        changes = durable(batch)
        adds = changes.where("op = 'm'")
        touched = adds.select("mid", "content_hash").distinct()
        near = xref.read(found.version).join(touched, ["mid", "content_hash"], "left_semi")
        gone.append(changes.where("op = 'd'").select("inbox", "oid").distinct(), batch_id)
        live = _live(near, gone.read())
        placed, _ = merged.place_adds(adds, live.select("docid", "mid", "content_hash").distinct(), found.top or 0)
        xref.append(placed.select("docid", "inbox", "xnum", "oid", "mid", "content_hash"), batch_id)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/_checkpoints/merge")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _live(xref: DataFrame, deletes: DataFrame) -> DataFrame:
    """Copies that no later batch has deleted."""
    last = deletes.groupBy("inbox", "oid").agg(F.max("batch").alias("_gone"))
    marked = salted_lookup(xref, last, ["inbox", "oid"], spread_on="xnum", how="left")
    return marked.where("_gone is null or _gone <= batch").drop("_gone")


def _merge_tables(spark: SparkSession, base: str) -> tuple[LogTable, LogTable]:
    """Copies and deletes of a merged index."""
    return LogTable(spark, f"{base}/xref", XREF, top="docid"), LogTable(spark, f"{base}/xref_deletes", DELETES)


def merged_xref(spark: SparkSession, base: str) -> DataFrame:
    """The merged index a `merge_log` stream has built so far."""
    xref, gone = _merge_tables(spark, base)
    copies = xref.read()  # first, so that no copy is read whose delete is not
    return _live(copies, gone.read()).drop("batch")
