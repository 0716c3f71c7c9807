"""Mail and JSON outputs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from archivelake.functions import text
from archivelake.operators.annotations import flags_text
from archivelake.operators.dedupe import dedupe_against
from archivelake.operators.overview import json_records

# Keywords and the status headers and letters they become, and
# headers a mailbox writer replaces.
STATUS_LETTERS = {"seen": "R"}
X_STATUS_LETTERS = {"answered": "A", "draft": "T", "flagged": "F"}
REPLACED_HEADERS = r"(?imd)^(?:Lines|Bytes|Content-Length|Status|X-Status):[^\n]*\n(?:[ \t][^\n]*\n)*"


def _letters(kw: Column, table: dict[str, str]) -> Column:
    found = [F.when(F.array_contains(kw, word), F.lit(letter)) for word, letter in sorted(table.items(), key=lambda x: x[1])]
    return F.array_join(F.array_compact(F.array(*found)), "")


def mailbox_text(
    raw: Column, kw: Column, variant: str = "mboxrd", ident: Column | None = None, recent: bool = False
) -> Column:
    """One message as mailbox text, without the last line end.

    `ident` goes into the separator line (blob id, maybe with `=pct`). The message is
    handled byte by byte, so any charset and either line end stay as they are; the result
    holds the message's own bytes, whether or not they are UTF-8.
    """
    full = F.decode(raw, "ISO-8859-1")
    break_at = F.regexp_instr(full, F.lit(r"\r?\n\r?\n"))
    # Headers end with their last line end, the body begins after the empty line.
    blank = F.regexp_extract(full, r"(?s)^.*?(\r?\n\r?\n)", 1)
    has_body = break_at > 0
    line_end = F.when(F.startswith(blank, F.lit("\r\n")), F.lit("\r\n")).otherwise(F.lit("\n"))
    head = F.when(has_body, F.concat(F.left(full, break_at - 1), line_end)).otherwise(full)
    body = F.when(has_body, F.substr(full, break_at + F.length(blank))).otherwise("")
    head = F.regexp_replace(F.regexp_replace(head, r"\A[\r\n]*From [^\r\n]*\r?\n", ""), REPLACED_HEADERS, "")
    status = F.concat(_letters(kw, STATUS_LETTERS), F.lit("" if recent else "O"))
    x_status = _letters(kw, X_STATUS_LETTERS)
    body = text.escape_from(body, variant)
    head = F.concat(
        head,
        F.when(status != "", F.concat(F.lit("Status: "), status, line_end)).otherwise(""),
        F.when(x_status != "", F.concat(F.lit("X-Status: "), x_status, line_end)).otherwise(""),
    )
    if variant.startswith("mboxcl"):
        # One character is one byte here.
        head = F.concat(
            head, F.lit("Content-Length: "), F.length(body).cast("string"), line_end,
            F.lit("Lines: "), F.regexp_count(body, F.lit("\n")).cast("string"), line_end,
        )
    name = F.lit("archive") if ident is None else ident
    record = F.concat(
        F.lit("From "), name, F.lit(f"@{variant} Thu Jan  1 00:00:00 1970\n"), head, line_end, body
    )
    return F.encode(record, "ISO-8859-1").cast("string")


def write_mailbox(messages: DataFrame, path: str, variant: str = "mboxrd", compression: str | None = None,
                  mode: str = "errorifexists") -> None:
    """Mailbox files, one per partition; the writer adds each record's line end."""
    ident = F.col("oid") if "oid" in messages.columns else None
    kw = F.col("kw") if "kw" in messages.columns else F.array().cast("array<string>")
    rows = messages.select(mailbox_text(F.col("raw"), kw, variant, ident).alias("value"))
    writer = rows.write.mode(mode)
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)


def maildir_name(oid: Column, kw: Column, pct: Column | None = None) -> Column:
    """`<blob>[=pct]:2,<flags>`."""
    base = oid if pct is None else F.concat(oid, F.lit("="), pct.cast("string"))
    return F.concat(base, F.lit(":2,"), flags_text(kw))


def write_maildir(messages: DataFrame, path: str, augment: bool = False) -> None:
    """One file per message below a folder, by its path or the URI of a shared store.

    Names come from the blob, and from the docid where there is one, so that copies of
    a blob do not replace each other and a task that runs twice writes the same file.
    Each file appears by a rename from a name of its own. New mail goes to `new/` when
    adding to an existing folder.
    """
    from pyarrow import fs

    def store() -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    kw = F.col("kw") if "kw" in messages.columns else F.array().cast("array<string>")
    base = F.concat("oid", F.lit("."), F.col("docid").cast("string")) if "docid" in messages.columns else F.col("oid")
    rows = messages.select(maildir_name(base, kw).alias("name"), "raw")
    place = "new" if augment else "cur"
    target, root = store()
    for name in ("tmp", "new", "cur"):
        target.create_dir(f"{root}/{name}", recursive=True)

    def write(part: Iterator[Row]) -> None:
        files, folder = store()
        for row in part:
            temporary = f"{folder}/tmp/{uuid.uuid4().hex}"
            with files.open_output_stream(temporary) as out:
                out.write(bytes(row.raw))
            files.move(temporary, f"{folder}/{place}/{row.name}")

    rows.foreachPartition(write)


def write_json(messages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Newline JSON with the search-result field names."""
    json_records(messages).select(F.col("json").alias("value")).write.mode(mode).text(path)


def json_array(messages: DataFrame) -> DataFrame:
    """Lines of one JSON array text, in order: the opening, each record, the end."""
    rows = json_records(messages).select(F.lit(1).alias("part"), "mid", F.concat("json", F.lit(",")).alias("value"))
    spark = messages.sparkSession
    ends = spark.createDataFrame([(0, "", "["), (2, "", "null]")], "part int, mid string, value string")
    return rows.unionByName(ends).orderBy("part", "mid").select("value")


def write_archive(messages: DataFrame, path: str) -> None:
    """Append to another archive's raw messages."""
    messages.select("inbox", "seq", "raw").write.mode("append").partitionBy("inbox").parquet(path)


def write_output(messages: DataFrame, existing: DataFrame | None, strategy: str = "content") -> DataFrame:
    """Rows to write: all of them, or those an augmented output lacks."""
    return messages if existing is None else dedupe_against(messages, existing, strategy)


def write_altids(altid: DataFrame, path: str, mode: str = "errorifexists") -> None:
    altid.select("prefix", "num", "mid").write.mode(mode).option("header", True).csv(path)


def with_progress(hits: DataFrame, observation) -> DataFrame:
    """Count matches and duplicates while the hits are written."""
    return hits.observe(
        observation, F.count("*").alias("matches"),
        F.count(F.when(F.col("duplicate"), 1)).alias("duplicates"),
    )
