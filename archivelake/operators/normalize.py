"""Decoded messages to the canonical `messages` columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivelake.functions import addresses, dates, hashing, headers, ids, subjects


def to_messages(decoded: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ids, references, people, subject, dates, sizes and hashes.

    Needs `headers`, `parts`, `body` and the raw bytes. Columns `at` and `ct`, when
    present, stand in for missing sent and received times.
    """
    h = F.col("headers")
    at = F.col("at") if "at" in decoded.columns else F.lit(0)
    ct = F.col("ct") if "ct" in decoded.columns else F.lit(0)
    ds, ts = dates.sent_and_received(
        headers.values(h, "date"), headers.values(h, "received"), at, ct
    )
    people = F.flatten(
        F.transform(
            F.concat(*[headers.values(h, n) for n in ("to", "from", "cc")]), addresses.emails
        )
    )
    with_ids = decoded.withColumn(
        "mids", ids.message_ids(headers.values(h, "message-id"))
    ).withColumn(
        "all_mids",
        ids.message_ids(
            F.concat(headers.values(h, "message-id"), headers.values(h, "x-alt-message-id"))
        ),
    ).withColumn("mid", F.get("mids", F.lit(0))).withColumn(
        "_refs",
        ids.references(headers.values(h, "references"), headers.values(h, "in-reply-to"), people),
    ).withColumn("_ds", ds).withColumn("_ts", ts).withColumn(
        "subject", headers.joined(h, "subject")
    )
    return with_ids.withColumns(
        {
            "refs": ids.clean_references(F.col("_refs"), F.col("all_mids"), F.coalesce("mid", F.lit(""))),
            "from": headers.joined(h, "from"),
            "to": headers.joined(h, "to"),
            "cc": headers.joined(h, "cc"),
            "subject_norm": subjects.normalized(F.col("subject")),
            "sid": subjects.subject_key(F.col("subject")),
            "list_ids": F.array_compact(F.transform(headers.values(h, "list-id"), addresses.list_id)),
            "ds": F.col("_ds.epoch"), "ds_zone": F.col("_ds.zone"),
            "ts": F.col("_ts.epoch"), "ts_zone": F.col("_ts.zone"),
            "bytes": headers.crlf_bytes(F.col(raw)),
            "lines": headers.line_count(F.decode(F.col("body"), "ISO-8859-1")),
            "oid": ids.blob_id(F.col(raw)),
            "content_hash": hashing.content_hash(h, F.col("parts")),
        }
    ).withColumn("in_reply_to", ids.in_reply_to(F.col("refs"))).drop("_refs", "_ds", "_ts")
