"""Queries: decoding, normalisation, identity and text sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivelake.functions import addresses, dates, diffs, hashing, headers, ids, subjects, text
from archivelake.operators import normalize
from archivelake.plans.registry import query
from archivelake.session import short_batches
from archivelake.sources import files, mbox, views
from archivelake.sources.decode import decode, explode_parts


def _messages(spark, d):
    return normalize.to_messages(decode(views.raw_mail(spark, d)))


@query("decode_messages", """
    SELECT seq, mid, strlen(raw) AS raw_bytes, body AS part_text, 0 AS errors,
      CASE WHEN turn > 0 THEN 1 ELSE 0 END AS has_cc FROM raw_mail""", "raw_mail")
def decode_messages(spark, d):
    out = decode(views.raw_mail(spark, d))
    return out.select(
        "seq", headers.first(F.col("headers"), "message-id").substr(F.lit(2), F.length("mid")).alias("mid"),
        F.octet_length("raw").alias("raw_bytes"), F.col("parts")[0]["text"].alias("part_text"),
        F.when(F.col("decode_error").isNull(), 0).otherwise(1).alias("errors"),
        F.size(headers.values(F.col("headers"), "cc")).alias("has_cc"),
    )


@query("part_rows", """
    SELECT seq, 0 AS part_pos, '1' AS idx, 0 AS depth, strlen(body) AS size,
      length(body) - length(replace(body, chr(10), '')) AS text_lines, 'text' AS kind, 'plain' AS subtype
    FROM raw_mail""", "raw_mail")
def part_rows(spark, d):
    decoded = decode(views.raw_mail(spark, d))
    parts = explode_parts(decoded.withColumn("shape", headers.body_structure(F.col("parts"))))
    return parts.select(
        "seq", "part_pos", "idx", "depth", F.col("shape")[0]["size"].alias("size"),
        F.col("shape")[0]["lines"].alias("text_lines"), F.col("shape")[0]["type"].alias("kind"),
        F.col("shape")[0]["subtype"].alias("subtype"),
    )


@query("message_table", """
    SELECT m.num AS seq, m.mid, m.parent AS in_reply_to, len(m.refs) AS n_refs, m."from" AS author,
      m.subject, m.ds, '+0000' AS ds_zone, m.ts, lower(m.inbox || '.Lists.example.org') AS list_id,
      strlen(r.raw) + length(r.raw) - length(replace(r.raw, chr(10), '')) AS bytes,
      length(r.body) - length(replace(r.body, chr(10), '')) AS lines,
      sha1(encode('blob ' || strlen(r.raw)) || '\\x00'::BLOB || encode(r.raw)) AS oid
    FROM conv_msgs m JOIN raw_mail r ON m.num = r.seq""", "raw_mail")
def message_table(spark, d):
    return _messages(spark, d).select(
        "seq", "mid", "in_reply_to", F.size("refs").alias("n_refs"), F.col("from").alias("author"),
        "subject", "ds", "ds_zone", "ts", F.col("list_ids")[0].alias("list_id"), "bytes", "lines", "oid",
    )


@query("content_hashes", """
    WITH v AS (SELECT m.num AS seq, array_to_string([strlen(x) || ':' || x FOR x IN m.refs], '') AS refs,
        replace(m."from", '@Example.org', '@example.org') AS author, m.subject, m."to" AS target, replace(m.cc, '"', '') AS cc,
        strftime(make_timestamp(m.ds * 1000000), '%a, %d %b %Y %H:%M:%S') || ' +0000' AS date,
        rtrim(r.body, ' ' || chr(10) || chr(9) || chr(13)) AS body
      FROM conv_msgs m JOIN raw_mail r ON m.num = r.seq)
    SELECT seq, sha256(array_to_string([
        'ref=' || sha256(refs), 'from=' || sha256(strlen(author) || ':' || author), 'subject=' || sha256(strlen(subject) || ':' || subject),
        'date=' || sha256(strlen(date) || ':' || date), 'to=' || sha256(strlen(target) || ':' || target),
        'cc=' || sha256(coalesce(strlen(cc) || ':' || cc, '')), 'part 1=' || sha256('1:01:1--' || body)], chr(10))) AS content_hash
    FROM v""", "raw_mail")
def content_hashes(spark, d):
    return _messages(spark, d).select("seq", "content_hash")


@query("hash_components", """
    SELECT component, count(*) AS n FROM raw_mail
    CROSS JOIN (SELECT unnest(['ref', 'from', 'subject', 'date', 'to', 'cc', 'part 1']) AS component)
    GROUP BY component""", "raw_mail")
def hash_components(spark, d):
    decoded = decode(views.raw_mail(spark, d))
    parts = decoded.select(F.explode(hashing.hash_inputs(F.col("headers"), F.col("parts"))).alias("c"))
    return parts.groupBy("c.component").agg(F.count("*").alias("n"))


@query("envelopes", """
    SELECT num AS seq, "from" AS sender, "from" AS reply_to, "to" AS recipient, '<' || mid || '>' AS message_id,
      CASE WHEN parent IS NOT NULL THEN '<' || parent || '>' END AS in_reply_to FROM conv_msgs""", "conv_msgs")
def envelopes(spark, d):
    e = decode(views.raw_mail(spark, d)).select("seq", headers.envelope(F.col("headers")).alias("e"))
    return e.select("seq", "e.sender", "e.reply_to", F.col("e.to").alias("recipient"), "e.message_id", "e.in_reply_to")


@query("header_subsets", """
    SELECT num AS seq, 2 AS kept, 10 + CASE WHEN turn > 0 THEN 3 ELSE 0 END
      + CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END - 2 AS dropped,
      9 + CASE WHEN turn > 0 THEN 3 ELSE 0 END AS wanted FROM conv_msgs""", "conv_msgs")
def header_subsets(spark, d):
    h = F.col("headers")
    names = ["From", "Subject"]
    return decode(views.raw_mail(spark, d)).select(
        "seq", F.size(headers.subset(h, names)).alias("kept"),
        F.size(headers.subset(h, names, keep=False)).alias("dropped"),
        F.size(headers.without_unwanted(h)).alias("wanted"),
    )


@query("body_sections", """
    SELECT seq, substr(hex(encode(body)), 21, 40) AS piece FROM raw_mail""", "raw_mail")
def body_sections(spark, d):
    out = decode(views.raw_mail(spark, d))
    return out.select("seq", F.hex(headers.section(F.col("body"), 10, 20)).alias("piece"))


@query("picked_parts", """
    SELECT seq, body AS first_part, 0 AS has_second FROM raw_mail""", "raw_mail")
def picked_parts(spark, d):
    out = decode(views.raw_mail(spark, d))
    return out.select(
        "seq", headers.part_at(F.col("parts"), "1")["text"].alias("first_part"),
        headers.part_at(F.col("parts"), "2").isNotNull().cast("int").alias("has_second"),
    )


@query("id_columns", """
    SELECT num, list_extract([mid], 1) AS first_id, 2 AS n_ids, len(refs) + 1 AS n_refs,
      sha1(mid) AS compressed, 'urn:uuid:' || substr(sha1(mid), 1, 8) || '-' || substr(sha1(mid), 9, 4) || '-'
      || substr(sha1(mid), 13, 4) || '-' || substr(sha1(mid), 17, 4) || '-' || substr(sha1(mid), 21, 12) AS uuid
    FROM conv_msgs""", "conv_msgs")
def id_columns(spark, d):
    m = views.conv_msgs(spark, d)
    value = F.concat(F.lit("<"), "mid", F.lit("> junk <"), "mid", F.lit("> <alt\t"), "mid", F.lit(">"))
    refs = F.concat(F.lit("<"), F.array_join("refs", "> <"), F.lit("> <extra@z> <y> <solo@example.com>"))
    refs = F.when(F.size("refs") == 0, F.lit("<extra@z> <y> <solo@example.com>")).otherwise(refs)
    found = ids.message_ids(F.array(value))
    cleaned = ids.references(F.array(refs), F.array(F.lit("<n> <extra@z>")),
                             addresses.emails(F.lit("Solo <solo@example.com>")))
    return m.select(
        "num", found[0].alias("first_id"), F.size(found).alias("n_ids"),
        F.size(ids.clean_references(cleaned, F.col("mids"), F.col("mid"))).alias("n_refs"),
        ids.compress_id(F.col("mid")).alias("compressed"), ids.urn_uuid(F.col("mid")).alias("uuid"),
    )


@query("generated_ids", """
    SELECT num, strftime(make_timestamp(ds * 1000000), '%Y%m%d%H%M%S') || '.'
      || translate(replace(to_base64(unhex(content_hash)), '=', ''), '+/', '-_') || '@z' AS generated
    FROM doc_posts""", "doc_posts")
def generated_ids(spark, d):
    return views.doc_posts(spark, d).select(
        "num", ids.generated_id(F.col("content_hash"), F.col("ds")).alias("generated")
    )


@query("subject_columns", """
    WITH s AS (SELECT num, subject, regexp_replace(regexp_replace(regexp_replace(regexp_replace(subject,
        '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '\\.+$', ''), '^[rR][eE]:\\s+', '') AS norm FROM conv_msgs)
    SELECT num, norm, CASE WHEN subject = '' THEN NULL ELSE
      CASE WHEN regexp_matches(lower(regexp_replace(norm, '[^\\p{L}\\p{M}\\p{N}_.~/-]+', '_', 'g')), '[^A-Za-z0-9_-]')
        OR length(regexp_replace(norm, '[^\\p{L}\\p{M}\\p{N}_.~/-]+', '_', 'g')) > 40
        THEN sha1(lower(regexp_replace(norm, '[^\\p{L}\\p{M}\\p{N}_.~/-]+', '_', 'g')))
        ELSE lower(regexp_replace(norm, '[^\\p{L}\\p{M}\\p{N}_.~/-]+', '_', 'g')) END END AS sid,
      nullif(regexp_replace(regexp_replace(regexp_replace(subject, '[^A-Za-z0-9_.]+', '-', 'g'), '[.-]+$', ''),
        '^[.-]+', ''), '') AS file_name,
      CASE WHEN subject LIKE 'Re: Topic%' THEN 'Re: ' || substr(subject, 11) WHEN subject LIKE 'Topic %' THEN substr(subject, 7)
        ELSE subject END AS untagged
    FROM s""", "conv_msgs")
def subject_columns(spark, d):
    s = F.col("subject")
    return views.conv_msgs(spark, d).select(
        "num", subjects.normalized(s).alias("norm"), subjects.subject_key(s).alias("sid"),
        subjects.file_name(s).alias("file_name"), subjects.without_tag(s, "Topic").alias("untagged"),
    )


@query("parsed_dates", """
    SELECT num, ts - (((num % 49) - 24) * 1800) AS epoch,
      CASE WHEN (num % 49) - 24 < 0 THEN '-' ELSE '+' END
        || lpad(CAST(abs((num % 49) - 24) * 30 // 60 AS VARCHAR), 2, '0')
        || lpad(CAST(abs((num % 49) - 24) * 30 % 60 AS VARCHAR), 2, '0') AS zone,
      strftime(make_timestamp(ts * 1000000), '%a, %d %b %Y %H:%M:%S') || ' +0000' AS mime,
      strftime(make_timestamp(ts * 1000000), '%d-%b-%Y %H:%M:%S') || ' +0000' AS internal,
      CAST(strftime(make_timestamp(ts * 1000000), '%Y%m%d') AS BIGINT) AS day,
      CAST(strftime(make_timestamp(ts * 1000000), '%Y%m%d%H%M%S') AS BIGINT) AS second
    FROM arrivals""", "arrivals")
def parsed_dates(spark, d):
    m = views.arrivals(spark, d)
    step = (F.col("num") % 49) - 24
    zone = F.concat(
        F.when(step < 0, "-").otherwise("+"),
        F.format_string("%02d%02d", F.floor(F.abs(step) * 30 / 60), F.abs(step) * 30 % 60),
    )
    stamp = F.date_format(F.timestamp_seconds("ts"), "EEE, d MMM yyyy HH:mm:ss")
    parsed = dates.parse_date(F.concat(stamp, F.lit(" "), zone, F.lit(" (comment)")))
    return m.withColumn("p", parsed).select(
        "num", "p.epoch", "p.zone", dates.mime_date(F.col("ts")).alias("mime"),
        dates.internal_date(F.col("ts")).alias("internal"), dates.day_number(F.col("ts")).alias("day"),
        dates.second_number(F.col("ts")).alias("second"),
    )


@query("address_columns", """
    SELECT num, role || (conv_id % 5) || '@Example.org' AS from_addr, role || ' Person' AS from_name,
      CASE WHEN turn > 0 THEN 'crew' || (turn % 3) || '@example.net|solo@example.com' ELSE '' END AS cc_addrs,
      CASE WHEN turn > 0 THEN 'Crew, Deck|Solo Sailor' ELSE '' END AS cc_names FROM conv_msgs""", "conv_msgs")
def address_columns(spark, d):
    cc = F.coalesce("cc", F.lit(""))
    pairs = addresses.pairs(F.col("from"))
    return views.conv_msgs(spark, d).select(
        "num", pairs[0]["addr"].alias("from_addr"), pairs[0]["name"].alias("from_name"),
        F.array_join(addresses.emails(cc), "|").alias("cc_addrs"),
        F.array_join(addresses.names(cc), "|").alias("cc_names"),
    )


@query("list_ids", """
    SELECT num, inbox || '.lists.example.org' AS list_id, '<' || inbox || '.lists.example.org>' AS made
    FROM conv_msgs""", "conv_msgs")
def list_ids(spark, d):
    value = F.concat(F.lit("A list <"), "inbox", F.lit(".Lists.Example.org>"))
    return views.conv_msgs(spark, d).select(
        "num", addresses.list_id(value).alias("list_id"),
        addresses.default_list_id(F.lit(None).cast("string"), F.col("to")).alias("made"),
    )


@query("skeleton_hashes", """
    SELECT num, sha256(encode("from" || chr(0) || "to" || chr(0) || '' || chr(0) || ds || chr(0) || subject
      || chr(0) || '' || chr(0) || mid)) AS h FROM doc_posts""", "doc_posts")
def skeleton_hashes(spark, d):
    h = hashing.skeleton_hash(F.col("from"), F.col("to"), F.col("cc"), F.col("ds"), F.col("subject"),
                              F.lit(None).cast("string"), F.col("mid"))
    return views.doc_posts(spark, d).select("num", h.alias("h"))


@query("status_keywords", """
    SELECT seq, CASE WHEN turn % 3 = 0 AND turn % 2 = 0 THEN 'answered,flagged,seen' WHEN turn % 3 = 0 THEN
      'answered,flagged' WHEN turn % 2 = 0 THEN 'seen' ELSE '' END AS kw FROM raw_mail""", "raw_mail")
def status_keywords(spark, d):
    h = F.col("headers")
    kw = mbox.status_keywords(headers.first(h, "status"), headers.first(h, "x-status"))
    return decode(views.raw_mail(spark, d)).select("seq", F.array_join(kw, ",").alias("kw"))


@query("quote_split", """
    SELECT conv_id, turn, CASE WHEN quoted IS NULL THEN 1 ELSE 2 END AS blocks,
      CASE WHEN quoted IS NULL THEN 0 ELSE 1 + length(quoted) - length(replace(quoted, chr(10), '')) END AS quoted_lines,
      1 + length(text) - length(replace(text, chr(10), '')) AS plain_lines FROM bodies""", "bodies")
def quote_split(spark, d):
    b = views.quoted_bodies(spark, d).withColumn("blocks", text.quote_blocks(F.col("body")))

    def lines(want):
        picked = F.filter("blocks", lambda x: x["quoted"] == want)
        return F.aggregate(picked, F.lit(0), lambda acc, x: acc + F.regexp_count(x["text"], F.lit("\n")))

    return b.select("conv_id", "turn", F.size("blocks").alias("blocks"),
                    lines(True).alias("quoted_lines"), lines(False).alias("plain_lines"))


@query("page_links", "SELECT page_id, url AS link, 6 AS n FROM pages")
def page_links(spark, d):
    pages = views.table(spark, d, "pages")
    body = F.concat(
        F.lit("See "), "url", F.lit(", and ("), "url", F.lit("). ("), "url", F.lit(".) <"), "url", F.lit("> '"), "url",
        F.lit("'; ["), "url", F.lit("]!\n"), "html",
    )
    return pages.select("page_id", F.explode(text.links(body)).alias("link")).groupBy("page_id", "link").agg(
        F.count("*").alias("n")
    )


@query("masked_addresses", """
    SELECT doc_id, regexp_replace(text, '([\\w.+=-]+@[\\w-]+)\\.([\\w.-]+)', '\\1•\\2', 'g') AS masked FROM documents""")
def masked_addresses(spark, d):
    return views.table(spark, d, "documents").select("doc_id", addresses.mask(F.col("text")).alias("masked"))


@query("trailers_removed", "SELECT doc_id, text || chr(10) AS body FROM documents")
def trailers_removed(spark, d):
    trailer = (
        "--\nTo unsubscribe from this list: send the line \"unsubscribe linux-list\" in\n"
        "the body of a message to majordomo@vger.kernel.org\n"
        "More majordomo info at  http://vger.kernel.org/majordomo-info.html\n"
    )
    docs = views.table(spark, d, "documents")
    return docs.select(
        "doc_id", text.without_trailer(F.concat("text", F.lit("\n" + trailer))).alias("body")
    )


@query("restored_headers", """
    SELECT num AS seq, 'original' AS received, 10 + CASE WHEN turn > 0 THEN 3 ELSE 0 END
      + CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END AS n FROM conv_msgs""", "conv_msgs")
def restored_headers(spark, d):
    out = decode(views.raw_mail(spark, d))
    added = F.map_concat("headers", F.create_map(
        F.lit("original-received"), F.array(F.lit("original")), F.lit("approved"), F.array(F.lit("news@x")),
    ))
    h = headers.restore_gmane(added)
    return out.select("seq", h["received"][0].alias("received"), F.size(h).alias("n"))


@query("diff_line_kinds", """
    SELECT docid, 3 AS dfn_plain, 1 + length(text) - length(replace(text, chr(10), '')) AS added_lines, 1 AS removed_lines,
      1 AS context_lines, pre, post, 'src/file' || hist || '.txt' AS file FROM patch_mail""", "patch_mail")
def diff_line_kinds(spark, d):
    short_batches(spark)
    lines = views.patch_mail(spark, d).select(
        "docid", F.explode(diffs.diff_lines(F.col("body"))).alias("l")
    ).select("docid", "l.*")

    def count(kind):
        return F.count(F.when(F.col("kind") == kind, 1))

    def value(kind):
        return F.max(F.when(F.col("kind") == kind, F.col("value")))

    plain = F.count(F.when((F.col("kind") == "plain") & ~F.col("value").rlike("^(?: |2\\.)"), 1))
    return lines.groupBy("docid").agg(
        plain.alias("dfn_plain"), count("added").alias("added_lines"), count("removed").alias("removed_lines"),
        count("context").alias("context_lines"), value("pre").alias("pre"), value("post").alias("post"),
        value("file").alias("file"),
    )


@query("maildir_scan", """
    WITH f AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'new' ELSE 'cur' END AS place,
      CASE WHEN event_id % 4 = 0 THEN '' ELSE CASE WHEN event_id % 2 = 0 THEN 'F' ELSE '' END
        || CASE WHEN event_id % 3 = 0 THEN 'S' ELSE '' END || CASE WHEN event_id % 7 = 0 THEN 'T' ELSE '' END END
      AS flags FROM events)
    SELECT event_id, place, flags, CASE flags WHEN 'FS' THEN 'flagged,seen' WHEN 'F' THEN 'flagged'
      WHEN 'S' THEN 'seen' ELSE '' END AS kw
    FROM f WHERE flags NOT LIKE '%T%' AND event_id % 11 <> 3""")
def maildir_scan(spark, d):
    e = views.table(spark, d, "events")
    n = F.col("event_id")
    flags = F.concat_ws("", F.when(n % 2 == 0, "F"), F.when(n % 3 == 0, "S"), F.when(n % 7 == 0, "T"))
    name = F.concat(F.when(n % 11 == 3, ".").otherwise(""), n.cast("string"))
    path = F.when(n % 4 == 0, F.concat(F.lit("/mail/new/"), name)).otherwise(
        F.concat(F.lit("/mail/cur/"), name, F.lit(":2,"), flags)
    )
    return files.maildir_entries(e.select("event_id", path.alias("path"))).select(
        "event_id", "place", "flags", F.array_join("kw", ",").alias("kw")
    )


@query("mailbox_records", """
    SELECT seq, 'From m@mboxrd Thu Jan  1 00:00:00 1970' || chr(10) || regexp_replace(regexp_replace(split_part(raw, chr(10) || chr(10), 1),
      '\\nStatus: [A-Z]+', ''), '\\nX-Status: [A-Z]+', '') || chr(10) || 'Status: RO' || chr(10) || 'X-Status: F' || chr(10) || chr(10)
      || regexp_replace(substr(raw, instr(raw, chr(10) || chr(10)) + 2), '(?m)^(>*From )', '>\\1', 'g') AS record FROM raw_mail""", "raw_mail")
def mailbox_records(spark, d):
    from archivelake.sources import sinks

    kw = F.array(F.lit("seen"), F.lit("flagged"))
    return views.raw_mail(spark, d).select(
        "seq", sinks.mailbox_text(F.col("raw"), kw, "mboxrd", F.lit("m")).alias("record")
    )


@query("maildir_names", """
    SELECT docid, sha1(docid::VARCHAR) || '=' || (docid % 99) || ':2,' || CASE WHEN list_contains(kw, 'flagged') THEN 'F' ELSE '' END AS name
    FROM annotations""", "annotations")
def maildir_names(spark, d):
    from archivelake.sources import sinks

    a = views.annotations(spark, d)
    name = sinks.maildir_name(F.sha1(F.col("docid").cast("string")), F.col("kw"), F.col("docid") % 99)
    return a.select("docid", name.alias("name"))


@query("from_line_escapes", """
    SELECT doc_id, regexp_replace('x' || chr(10) || 'From ' || text || chr(10) || '>From x', '(?m)^(>*From )', '>\\1', 'g') AS escaped,
      'x' || chr(10) || 'From ' || text || chr(10) || '>From x' AS restored FROM documents""")
def from_line_escapes(spark, d):
    body = F.concat(F.lit("x\nFrom "), "text", F.lit("\n>From x"))
    escaped = text.escape_from(body, "mboxrd")
    docs = views.table(spark, d, "documents")
    return docs.select("doc_id", escaped.alias("escaped"), text.unescape_from(escaped, "mboxrd").alias("restored"))
