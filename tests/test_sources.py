"""File sources, decoding and sinks, by round trips."""

import bz2
import gzip
import lzma

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from archivelake.operators import normalize, policy
from archivelake.operators.postings import build_postings, part_fields
from archivelake.operators.predicates import Term, search
from archivelake.sources import files, mbox, sinks
from archivelake.sources.decode import decode, decode_one, explode_parts

FROM = "From me@x Thu Jan  1 00:00:00 1970\n"


def message(i, body):
    return f"From: a@x.org\nSubject: n{i}\nMessage-ID: <m{i}@x>\n\n{body}"


BODIES = ["one\n", "two\nFrom here on\n>From there\n", "\n\nthree\n", "four\nFrom a bad line\n"]


def written(variant):
    out = ""
    for i, body in enumerate(BODIES):
        escaped = body
        if variant == "mboxrd":
            escaped = "".join((">" + ln if ln.lstrip(">").startswith("From ") else ln) for ln in body.splitlines(True))
        elif variant in ("mboxo", "mboxcl"):
            escaped = body.replace("\nFrom ", "\n>From ")
        text = message(i, escaped)
        if variant.startswith("mboxcl"):
            text = text.replace("\n\n", f"\nContent-Length: {len(escaped.encode())}\n\n", 1)
        out += FROM + text + "\n"
    return out


@pytest.mark.parametrize("variant", mbox.VARIANTS)
def test_mailbox_variants(spark, tmp_path, variant):
    (tmp_path / "box").write_text(written(variant))
    rows = mbox.read_mailbox(spark, str(tmp_path / "box"), variant).orderBy("offset").collect()
    bodies = [bytes(r.raw).decode().split("\n\n", 1)[1] for r in rows]
    want = list(BODIES)
    if variant in ("mboxo", "mboxcl"):  # these two cannot tell an escape from a quote
        want[1] = "two\nFrom here on\nFrom there\n"
    assert bodies == want


@pytest.mark.parametrize("width", [1, 37, 64, 1000])
def test_splits_lose_and_repeat_nothing(spark, tmp_path, width):
    text = "".join(FROM + message(i, f"body {i}\n" * (i % 7)) + "\n" for i in range(40))
    (tmp_path / "box").write_text(text)
    whole = [r[2] for r in mbox.read_range(str(tmp_path / "box"), 0, None, "mboxrd")]
    size = len(text)
    parts = []
    for start in range(0, size, width):
        parts += [r[2] for r in mbox.read_range(str(tmp_path / "box"), start, min(start + width, size), "mboxrd")]
    assert parts == whole and len(whole) == 40
    if width == 64:
        rows = mbox.read_mailbox(spark, str(tmp_path / "box"), split_bytes=width)
        assert sorted(bytes(r.raw) for r in rows.collect()) == sorted(whole)


@pytest.mark.parametrize("suffix, opener", [(".gz", gzip.open), (".bz2", bz2.open), (".xz", lzma.open)])
def test_compressed_mailboxes(spark, tmp_path, suffix, opener):
    with opener(tmp_path / ("box" + suffix), "wt") as out:
        out.write(written("mboxrd"))
    assert mbox.read_mailbox(spark, str(tmp_path / ("box" + suffix))).count() == len(BODIES)


def test_bad_content_length(tmp_path):
    (tmp_path / "box").write_text(FROM + "Subject: x\n\nbody\n")
    with pytest.raises(ValueError):
        list(mbox.read_counted(str(tmp_path / "box"), "mboxcl2"))


@pytest.mark.parametrize("variant", mbox.VARIANTS)
def test_write_and_read_back(spark, tmp_path, variant):
    rows = [(f"o{i}", message(i, b).encode(), ["seen", "flagged"] if i % 2 else []) for i, b in enumerate(BODIES)]
    df = spark.createDataFrame(rows, "oid string, raw binary, kw array<string>")
    sinks.write_mailbox(df.coalesce(1), str(tmp_path / "out"), variant)
    back = decode(mbox.read_mailbox(spark, str(tmp_path / "out" / "part-*"), variant))
    h = F.col("headers")
    got = {
        r.s: (r.b, r.kw) for r in back.select(
            h["subject"][0].alias("s"), F.decode("body", "UTF-8").alias("b"),
            mbox.status_keywords(h["status"][0], F.try_element_at(h, F.lit("x-status"))[0]).alias("kw"),
        ).collect()
    }
    for i, body in enumerate(BODIES):
        want = body.replace(">From there", "From there") if variant in ("mboxo", "mboxcl") else body
        assert got[f"n{i}"] == (want, ["flagged", "seen"] if i % 2 else [])


def test_maildir_round_trip(spark, tmp_path):
    rows = [(f"{i:040x}", message(i, b).encode(), ["seen", "draft"] if i == 1 else []) for i, b in enumerate(BODIES)]
    df = spark.createDataFrame(rows, "oid string, raw binary, kw array<string>")
    sinks.write_maildir(df, str(tmp_path / "md"))
    sinks.write_maildir(df, str(tmp_path / "md"))  # again: same files
    (tmp_path / "md" / "cur" / "gone:2,T").write_text("x")
    (tmp_path / "md" / "cur" / "odd:3,S").write_text("x")
    (tmp_path / "md" / "new" / "fresh").write_text(message(9, "new\n"))
    got = {r.name: sorted(r.kw) for r in files.read_maildir(spark, str(tmp_path / "md")).collect()}
    assert got == {
        **{f"{i:040x}:2," + ("DS" if i == 1 else ""): (["draft", "seen"] if i == 1 else []) for i in range(4)},
        "fresh": [],
    }


def test_single_messages_and_spool(spark, tmp_path):
    (tmp_path / "a.eml").write_text(FROM + message(1, "x\n"))
    raw = bytes(files.read_messages(spark, str(tmp_path / "a.eml")).first().raw)
    assert raw.decode() == message(1, "x\n")
    spool = tmp_path / "spool"
    spool.mkdir()
    for n in (3, 7, 150000):
        (spool / str(n)).write_text(message(n, "x\n"))
    (spool / ".overview").write_text("x")
    assert sorted(r.num for r in files.read_spool(spark, str(spool), 5).collect()) == [7, 150000]


NESTED = b"""From: a@x.org
Subject: =?utf-8?q?caf=C3=A9?=
Message-ID: <outer@x>
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary="B"

--B
Content-Type: text/plain; charset=bogus

plain \xc3\xa9
--B
Content-Type: text/html

<b>no</b>
--B
Content-Type: application/octet-stream; name=notes.exe
Content-Disposition: attachment; filename=notes.exe

readable notes
--B
Content-Type: message/rfc822

From: inner@x.org
Subject: inside
Message-ID: <inner@x>

inner words
--B--
"""


def test_decode_tree():
    got = decode_one(NESTED)
    assert got["headers"]["subject"] == ["café"]
    shape = [(p["idx"], p["depth"], p["is_container"], p["is_submsg"]) for p in got["parts"]]
    assert shape == [("1", 0, True, False), ("1", 1, False, False), ("2", 1, False, False), ("3", 1, False, False),
                     ("4", 1, True, False), ("4.1", 2, False, True)]
    texts = [p["text"] for p in got["parts"]]
    assert texts[1].startswith("plain é") and texts[2] is None and texts[3] == "readable notes"
    assert decode_one(b"")["decode_error"] is None
    long = decode_one(b"X: " + b"y" * 200000 + b"\n\nb")
    assert long["decode_error"] is None and len(long["headers"]["x"][0]) == 200000


def test_attached_parts_are_searchable(spark):
    df = spark.createDataFrame([(1, NESTED), (2, message(2, "other\n").encode())], "docid bigint, raw binary")
    decoded = decode(df)
    index = build_postings(part_fields(explode_parts(decoded)))
    docs = df.select("docid")

    def found(term, field):
        return sorted(r.docid for r in search(index, docs, Term(term, field)).collect())

    assert found("notes", "n") == [1]
    assert found("inner", "b") == [1] and found("other", "b") == [2]
    reasons = decoded.where("docid = 1").select(policy.content_reasons(F.col("parts")).alias("r")).first().r
    assert reasons == ["no HTML", "suffixes: exe"]
    table = normalize.to_messages(decoded)
    assert {r.mid for r in table.select("mid").collect()} == {"outer@x", "m2@x"}


def test_json_outputs_and_progress(spark, tmp_path):
    rows = [("a@x", ["r@x"], "A <a@x.org>", "b@x.org", None, "s", 10, 20), ("b@x", [], "a@x.org", "", None, "t", 11, 21)]
    df = spark.createDataFrame(
        rows, "mid string, refs array<string>, from string, to string, cc string, subject string, ds bigint, ts bigint")
    sinks.write_json(df, str(tmp_path / "j"))
    back = spark.read.json(str(tmp_path / "j"))
    assert {(r.m, r.s, r.rt) for r in back.collect()} == {("a@x", "s", "1970-01-01T00:00:20Z"), ("b@x", "t", "1970-01-01T00:00:21Z")}
    import json

    text = "\n".join(r.value for r in sinks.json_array(df).collect())
    assert [x and x["m"] for x in json.loads(text)] == ["a@x", "b@x", None]
    seen = Observation()
    sinks.with_progress(df.withColumn("duplicate", F.col("mid") == "b@x"), seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"matches": 2, "duplicates": 1}


def test_long_walks_keep_every_part():
    from email.mime.multipart import MIMEMultipart
    from email.mime.text import MIMEText

    from archivelake.sources.decode import decode_one

    wide = MIMEMultipart()
    for i in range(1500):
        wide.attach(MIMEText(f"part {i}"))
    got = decode_one(wide.as_bytes())
    assert len(got["parts"]) == 1501 and got["decode_error"] is None
    deep = MIMEText("core")
    for _ in range(30):
        outer = MIMEMultipart()
        outer.attach(deep)
        deep = outer
    deep.attach(MIMEText("shallow, after the deep one"))
    texts = [p["text"] for p in decode_one(deep.as_bytes())["parts"] if not p["is_container"]]
    assert texts == ["core", "shallow, after the deep one"]


def test_mailbox_text_keeps_line_ends_and_charsets(spark):
    raw = "Subject: caf\u00e9\r\nStatus: RO\r\n\r\nStatus: in the body\r\nFrom here\r\n".encode("latin-1")
    df = spark.createDataFrame([(bytearray(raw),)], "raw binary")
    kw = F.array(F.lit("seen"))
    record = df.select(F.encode(F.decode(sinks.mailbox_text(F.col("raw"), kw).cast("binary"), "ISO-8859-1"), "ISO-8859-1").alias("r"))
    head, body = bytes(record.first().r).split(b"\r\n\r\n")
    assert body == b"Status: in the body\r\n>From here\r\n"
    assert head.split(b"\n", 1)[1] == b"Subject: caf\xe9\r\nStatus: RO"


def test_one_latin1_message_does_not_end_the_job(spark, tmp_path):
    rows = [(bytearray("Subject: a\n\ncaf\u00e9\n".encode("latin-1")),), (bytearray("Subject: b\n\ncaf\u00e9\n".encode()),)]
    sinks.write_mailbox(spark.createDataFrame(rows, "raw binary").coalesce(1), str(tmp_path / "m"))
    data = b"".join(p.read_bytes() for p in (tmp_path / "m").glob("part-*"))
    assert b"caf\xe9\n" in data and "caf\u00e9\n".encode() in data


def test_copies_of_a_blob_are_files_of_their_own(spark, tmp_path):
    rows = [(1, "same", bytearray(b"x")), (2, "same", bytearray(b"x"))]
    sinks.write_maildir(spark.createDataFrame(rows, "docid bigint, oid string, raw binary"), str(tmp_path / "d"))
    assert len(list((tmp_path / "d/cur").iterdir())) == 2 and not list((tmp_path / "d/tmp").iterdir())


def test_missing_tables_are_empty_and_other_faults_raise(spark, tmp_path):
    from archivelake.streaming.tables import read_table

    assert read_table(spark, f"{tmp_path}/none", "a bigint").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/batch=0").mkdir()
    (tmp_path / "bad/batch=0/part.parquet").write_text("not parquet")
    with pytest.raises(Exception):  # noqa: B017
        read_table(spark, f"{tmp_path}/bad", "a bigint").count()


@pytest.mark.parametrize("name", [
    "stream_notifications", "stream_saved_search", "stream_unique", "stream_reader_positions", "stream_ingest", "stream_merge_log",
])
def test_streams_read_folders_of_part_files(spark, tmp_path, name):
    import __spark_entry__ as entry_points

    source = "/root/testdata/sf0.001"
    for table in ("events", "documents"):
        spark.read.parquet(f"{source}/{table}.parquet").repartitionByRange(3, spark.read.parquet(f"{source}/{table}.parquet").columns[0]).write.parquet(f"{tmp_path}/{table}.parquet")
    run = entry_points.queries()[name]
    rows = {k: sorted(map(tuple, run(spark, d).collect()), key=repr) for k, d in (("file", source), ("folder", str(tmp_path)))}
    if name in ("stream_notifications", "stream_reader_positions", "stream_saved_search", "stream_unique"):
        assert rows["folder"] == rows["file"]
    assert len(rows["folder"]) == len(rows["file"]) > 0


def test_ingest_in_several_batches_equals_one(spark, tmp_path):
    from archivelake.streaming import ingest
    from archivelake.streaming.tables import read_table

    def raw(n, mid):
        return bytearray(f"From: a@x.org\nSubject: s\nDate: Tue, 14 Nov 2023 22:13:20 +0000\nMessage-ID: <{mid}@z>\n\nbody {mid}\n".encode())

    rows = [("i" if n % 2 else "j", n, raw(n, n % 7)) for n in range(20)]
    schema = "inbox string, seq bigint, raw binary"
    ingest.store_arrivals(spark.createDataFrame(rows, schema), 0, f"{tmp_path}/one")
    for batch in range(4):
        part = spark.createDataFrame(rows[batch * 5:batch * 5 + 5], schema)
        ingest.store_arrivals(part, batch, f"{tmp_path}/many")
        if batch == 2:  # a batch that runs again changes nothing
            ingest.store_arrivals(part, batch, f"{tmp_path}/many")

    def stored(base):
        return sorted(map(tuple, read_table(spark, f"{base}/messages", ingest.MESSAGES).select("inbox", "seq", "num", "mid").collect()))

    assert stored(f"{tmp_path}/many") == stored(f"{tmp_path}/one") != []


@pytest.mark.parametrize("line, ends", [
    (b"From me@x Thu Jan  1 00:00:00 1970\n", True), (b"From me@x  Thu Jan 11 00:00 1970\r\n", True),
    (b"From a Mon Dec 31 23:59:59 GMT 2001\n", True), (b"From a Mon Dec 31 23:59:59 2001 +0200\n", True),
    (b"From here on Thu Jan 1 00:00:00 1970\n", False), (b"From me Thursday Jan 1 00:00:00 1970\n", False),
    (b"From me@x a b c 1:2:3 d\n", False), (b">From me@x Thu Jan  1 00:00:00 1970\n", False), (b"From me@x\n", False),
])
def test_separator_lines(line, ends):
    assert bool(mbox.FROM_LINE.match(line)) == ends


def test_decode_holds_few_messages_at_once(spark):
    """Whatever the number and length of messages, a worker's batches and slices are short."""
    import pandas as pd

    from archivelake.sources.decode import SLICE_BYTES, SLICE_ROWS, slices

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [len(batch)]})

    one = spark.range(0, 1200, 1, 1).selectExpr("id", "encode(concat('Subject: ', id, '\n\nbody ', id), 'UTF-8') AS raw")
    decoded = decode(one)
    assert max(r.n for r in decoded.select("raw").mapInPandas(sizes, "n int").collect()) <= 500
    got = decoded.selectExpr("id", "headers['subject'][0] AS s", "parts[0].text AS t").collect()
    assert sorted((r.id, r.s, r.t) for r in got) == [(i, str(i), f"body {i}") for i in range(1200)]
    assert list(slices([])) == []
    assert list(slices([1] * (SLICE_ROWS + 1))) == [(0, SLICE_ROWS), (SLICE_ROWS, SLICE_ROWS + 1)]
    assert list(slices([5, 2 * SLICE_BYTES, SLICE_BYTES - 5, 5, 1])) == [(0, 1), (1, 2), (2, 4), (4, 5)]
