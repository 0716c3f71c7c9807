"""Recent topics and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivelake.functions import ids, subjects
from archivelake.operators.skew import salted_lookup


def recent(
    messages: DataFrame, limit: int = 200, after: int | None = None, before: int | None = None
) -> DataFrame:
    """Newest messages by received time; with only `after`, the oldest ones."""
    if after is not None:
        messages = messages.where(F.col("ts") >= after)
    if before is not None:
        messages = messages.where(F.col("ts") <= before)
    if after is not None and before is None:
        return messages.orderBy(F.asc("ts"), F.asc("docid")).limit(limit)
    return messages.orderBy(F.desc("ts"), F.desc("docid")).limit(limit)


def page_of_recent(
    messages: DataFrame, limit: int = 200, after: int | None = None, before: int | None = None
) -> DataFrame:
    """`recent`, but a short page after a bound falls back to the newest rows."""
    page = recent(messages, limit, after, before)
    if after is None:
        return page
    size = page.groupBy().agg(F.count("*").alias("_n"))
    tagged = page.withColumn("_latest", F.lit(False)).unionByName(
        recent(messages, limit).withColumn("_latest", F.lit(True))
    )
    # One row: the size of the first page decides which of the two is kept.
    chosen = tagged.join(F.broadcast(size), (F.col("_n") < limit) == F.col("_latest"))
    return chosen.drop("_n", "_latest")


def page_links(page: DataFrame) -> DataFrame:
    """Newest and oldest received time of a page."""
    return page.groupBy().agg(
        F.max("ts").alias("newest"), F.min("ts").alias("oldest"), F.count("*").alias("n")
    )


def topics(walked: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics, extra): one row per root, and the further subjects below it.

    `walked` comes from `forest.preorder`. A topic has its newest sent time, its
    message count, its first subject and the newest message with that subject.
    Ghost roots without replies are dropped. `extra` has one row per other
    distinct subject with its level and its last message in walk order.
    """
    subject = subjects.normalized(F.col("subject"))
    shown = F.when(subject == "", F.lit("(no subject)")).otherwise(subject)
    rows = (
        walked.where(~F.col("is_ghost"))
        .join(messages.select("docid", "subject", "mid"), "docid")
        .select("root", "position", "depth", "ds", "mid", shown.alias("subject"))
    )
    per_subject = rows.groupBy("root", "subject").agg(
        F.min("position").alias("first_at"),
        F.min_by("depth", "position").alias("level"),
        F.max_by("mid", "position").alias("last_mid"),
        F.max("ds").alias("latest"),
        F.count("*").alias("n"),
    )
    topic = per_subject.groupBy("root").agg(
        F.max("latest").alias("latest"),
        F.sum("n").alias("n"),
        F.min_by("subject", "first_at").alias("subject"),
        F.min_by("last_mid", "first_at").alias("mid"),
        F.min("first_at").alias("first_at"),
    )
    first = topic.select("root", F.col("first_at").alias("top_at"))
    extra = salted_lookup(per_subject, first, ["root"], spread_on="subject").where(
        "first_at <> top_at"
    ).select("root", "first_at", "level", "subject", F.col("last_mid").alias("mid"))
    return topic.drop("first_at"), extra


def thread_topics(messages: DataFrame) -> DataFrame:
    """Topics when threads are known by `tid`: newest first, no walk needed."""
    subject = subjects.normalized(F.col("subject"))
    shown = F.when(subject == "", F.lit("(no subject)")).otherwise(subject)
    order = F.struct("ds", "docid")
    return messages.withColumn("_s", shown).groupBy("tid").agg(
        F.max("ds").alias("latest"),
        F.count("*").alias("n"),
        F.min_by("_s", order).alias("subject"),
        F.max_by("mid", order).alias("last_mid"),
    )


def feed(messages: DataFrame, limit: int = 25) -> DataFrame:
    """Feed entries, newest first: id, in-reply-to id, title, author, updated."""
    from archivelake.functions import addresses, dates

    newest = recent(messages, limit)
    irt = ids.in_reply_to(F.col("refs"))
    return newest.select(
        ids.urn_uuid(F.col("mid")).alias("id"),
        ids.urn_uuid(irt).alias("in_reply_to"),
        F.when(F.coalesce("subject", F.lit("")) == "", "(no subject)")
        .otherwise(F.col("subject")).alias("title"),
        F.array_join(addresses.names(F.col("from")), ", ").alias("author"),
        F.try_element_at(addresses.emails(F.col("from")), F.lit(1)).alias("email"),
        dates.iso8601(F.col("ts")).alias("updated"),
        "mid",
    )
