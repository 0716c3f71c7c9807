"""Queries: overview scans, statistics, numbering, projections, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivelake.functions import subjects
from archivelake.operators import lookup, overview, predicates, rank, topics
from archivelake.plans.registry import query
from archivelake.sources import files, views

NEW_SINCE = 1_705_000_000  # a time inside the event stream


def _readers(spark, d):
    """Reader state: each user's last deleted number is that of its last purchase."""
    return (
        views.arrivals(spark, d).where("kind = 'purchase'").groupBy("inbox")
        .agg(F.max("num").alias("last_del")).select(F.concat(F.lit("r-"), "inbox").alias("user"), "inbox", "last_del")
    )


def _inbox_meta(spark, d):
    """One record per document source, made from its documents."""
    p = views.doc_posts(spark, d)
    return p.groupBy("inbox").agg(
        F.max("ts").alias("modified"), F.min("ts").alias("created"),
        F.concat(F.lit("posts in "), F.min("lang"), F.lit(" for "), F.first("inbox")).alias("description"),
    ).select(
        "inbox", F.col("inbox").alias("name"), "modified", "created", "description",
        F.concat("inbox", F.lit("@lists.example.org")).alias("address"),
        F.concat("inbox", F.lit(".lists.example.org")).alias("list_id"),
        F.concat(F.lit("https://example.org/"), "inbox", F.lit("/")).alias("url"),
        F.when(F.col("inbox").endswith("3"), F.array(F.lit("www"))).otherwise(
            F.array().cast("array<string>")).alias("hide"),
    )


_META = """meta AS (SELECT inbox, inbox AS name, max(ts) AS modified, min(ts) AS created,
  'posts in ' || min(lang) || ' for ' || inbox AS description, inbox || '@lists.example.org' AS address
  FROM doc_posts GROUP BY inbox)"""


@query("overview_range", """
    SELECT inbox, num, subject, "from", strftime(make_timestamp(ds * 1000000), '%a, %d %b %Y %H:%M:%S') || ' +0000' AS date,
      '<' || mid || '>' AS message_id, CASE WHEN len(refs) > 0 THEN '<' || array_to_string(refs, '> <') || '>' ELSE '' END
      AS "references", bytes, lines, inbox || ':' || num AS xref
    FROM conv_msgs WHERE num BETWEEN 1000000 AND 60000000""", "conv_msgs")
def overview_range(spark, d):
    return overview.overview_fields(overview.number_range(views.conv_msgs(spark, d), 1_000_000, 60_000_000))


@query("overview_all", """
    SELECT num, subject, '<' || mid || '>' AS message_id, bytes, lines FROM conv_msgs""", "conv_msgs")
def overview_all(spark, d):
    return overview.overview_fields(views.conv_msgs(spark, d)).select("num", "subject", "message_id", "bytes", "lines")


@query("messages_by_number", """
    SELECT num, mid, subject FROM doc_posts WHERE num IN (SELECT doc_id * 2 + 1 FROM labels)""", "doc_posts")
def messages_by_number(spark, d):
    wanted = views.table(spark, d, "labels").select((F.col("doc_id") * 2 + 1).alias("num"))
    return overview.by_numbers(views.doc_posts(spark, d), wanted).select("num", "mid", "subject")


@query("messages_by_id", """
    SELECT num, mid, subject FROM conv_msgs WHERE mid IN (SELECT unnest(refs) FROM conv_msgs) ORDER BY num""", "conv_msgs")
def messages_by_id(spark, d):
    m = views.conv_msgs(spark, d)
    ids_table = m.select("inbox", "num", F.explode("mids").alias("mid"))
    wanted = m.select(F.explode("refs").alias("mid"))
    return overview.by_mids(m, ids_table, wanted).select("num", "mid", "subject").orderBy("num")


@query("page_after_number", "SELECT num, mid FROM arrivals WHERE num > 300 ORDER BY num LIMIT 1000", "arrivals")
def page_after_number(spark, d):
    return overview.after_number(views.arrivals(spark, d), 300, limit=1000).select("num", "mid")


@query("header_column", """
    SELECT num, subject AS value FROM doc_posts WHERE num BETWEEN 10 AND 150""", "doc_posts")
def header_column(spark, d):
    msgs = views.doc_posts(spark, d).withColumn("refs", F.array().cast("array<string>")).withColumn("lines", F.lit(0))
    return overview.header_column(msgs, "subject", 10, 150)


@query("json_records", """
    SELECT mid, strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS rt,
      strftime(make_timestamp(ds * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS dt, subject AS s,
      role || ' Person' AS from_name, len(refs) AS n_refs FROM conv_msgs""", "conv_msgs")
def json_records(spark, d):
    j = overview.json_records(views.conv_msgs(spark, d))
    parsed = F.from_json("json", "rt string, dt string, s string, f array<array<string>>, refs array<string>, m string")
    return j.select(parsed.alias("p")).select(
        F.col("p.m").alias("mid"), "p.rt", "p.dt", "p.s", F.col("p.f")[0][0].alias("from_name"),
        F.coalesce(F.size("p.refs"), F.lit(0)).alias("n_refs"),
    ).withColumn("n_refs", F.greatest("n_refs", F.lit(0)))


@query("number_bounds", """
    SELECT inbox, min(num) AS min_num, max(num) AS max_num, count(*) AS n FROM arrivals GROUP BY inbox""", "arrivals")
def number_bounds(spark, d):
    return overview.number_bounds(views.arrivals(spark, d))


@query("inbox_listing", f"""
    WITH {_META} SELECT m.inbox, created, description, address, min(num) AS min_num, max(num) AS max_num
    FROM meta m JOIN doc_posts p ON p.inbox = m.inbox GROUP BY ALL""", "doc_posts")
def inbox_listing(spark, d):
    out = overview.inbox_listing(views.doc_posts(spark, d), _inbox_meta(spark, d).drop("modified"))
    return out.select("inbox", "created", "description", "address", "min_num", "max_num")


@query("new_inboxes", """
    SELECT inbox, min(ts) AS created FROM arrivals GROUP BY inbox HAVING min(ts) > 1704100000""", "arrivals")
def new_inboxes(spark, d):
    return overview.new_inboxes(views.arrivals(spark, d), 1_704_100_000)


@query("mailbox_status", """
    SELECT inbox, (num - 1) // 500 AS slice, count(*) AS messages, max(num) + 1 AS uidnext, (num - 1) // 500 + 1 AS uidvalidity
    FROM arrivals GROUP BY ALL""", "arrivals")
def mailbox_status(spark, d):
    return overview.mailbox_status(views.arrivals(spark, d), slice_size=500)


@query("sequence_numbers", """
    SELECT inbox, num, row_number() OVER (PARTITION BY inbox, (num - 1) // 500 ORDER BY num) AS msn FROM arrivals""", "arrivals")
def sequence_numbers(spark, d):
    return overview.sequence_numbers(views.arrivals(spark, d), 500).select("inbox", "num", "msn")


@query("maildrop_stat", """
    WITH r AS (SELECT inbox, max(num) AS last_del FROM arrivals WHERE kind = 'purchase' GROUP BY inbox)
    SELECT 'r-' || r.inbox AS "user", r.inbox, count(a.num) AS messages, coalesce(sum(a.bytes), 0)::BIGINT AS bytes
    FROM r LEFT JOIN arrivals a ON a.inbox = r.inbox AND a.num > r.last_del GROUP BY r.inbox""", "arrivals")
def maildrop_stat(spark, d):
    return overview.maildrop_stat(views.arrivals(spark, d), _readers(spark, d))


@query("reader_positions", """
    SELECT 'r-' || inbox AS "user", inbox, max(num) AS last_del FROM arrivals WHERE kind = 'purchase' GROUP BY inbox""", "arrivals")
def reader_positions(spark, d):
    return _readers(spark, d)


@query("last_modified", "SELECT inbox, max(ts) AS modified FROM doc_posts GROUP BY inbox", "doc_posts")
def last_modified(spark, d):
    return overview.last_modified(views.doc_posts(spark, d))


@query("adjacent_articles", """
    SELECT a.inbox, a.num, p.num AS prev_num, n.num AS next_num FROM arrivals a
    LEFT JOIN arrivals p ON p.inbox = a.inbox AND p.num = a.num - 1
    LEFT JOIN arrivals n ON n.inbox = a.inbox AND n.num = a.num + 1""", "arrivals")
def adjacent_articles(spark, d):
    return overview.adjacent_articles(views.arrivals(spark, d)).select("inbox", "num", "prev_num", "next_num")


@query("assigned_numbers", """
    SELECT inbox, seq, row_number() OVER (PARTITION BY inbox ORDER BY seq) + length(inbox) * 100 AS num FROM changes
    WHERE op = 'm'""", "changes")
def assigned_numbers(spark, d):
    c = views.changes(spark, d)
    marks = c.select("inbox").distinct().withColumn("max_num", F.length("inbox") * 100)
    return overview.assign_numbers(c.where("op = 'm'"), marks, width=200).select("inbox", "seq", "num")


@query("new_since", f"""
    SELECT inbox, num, mid FROM arrivals WHERE ts >= {NEW_SINCE} AND inbox LIKE 'u1%' AND inbox NOT LIKE 'u1%0'""", "arrivals")
def new_since(spark, d):
    return overview.new_since(views.arrivals(spark, d), NEW_SINCE, "u1*!u1*0").select("inbox", "num", "mid")


@query("recent_messages", "SELECT docid, mid, ts FROM conv_msgs ORDER BY ts DESC, docid DESC LIMIT 200", "conv_msgs")
def recent_messages(spark, d):
    return topics.recent(views.conv_msgs(spark, d)).select("docid", "mid", "ts")


@query("recent_after", """
    SELECT docid, mid, ts FROM conv_msgs WHERE ts >= 1700020000 ORDER BY ts, docid LIMIT 25""", "conv_msgs")
def recent_after(spark, d):
    return topics.recent(views.conv_msgs(spark, d), 25, after=1_700_020_000).select("docid", "mid", "ts")


@query("recent_page_fallback", """
    SELECT docid, ts FROM conv_msgs ORDER BY ts DESC, docid DESC LIMIT 20""", "conv_msgs")
def recent_page_fallback(spark, d):
    # Nothing is this new, so the page falls back to the newest messages.
    return topics.page_of_recent(views.conv_msgs(spark, d), 20, after=1_900_000_000).select("docid", "ts")


@query("page_links_bounds", """
    SELECT max(ts) AS newest, min(ts) AS oldest, count(*) AS n FROM
      (SELECT ts FROM conv_msgs WHERE ts <= 1700050000 ORDER BY ts DESC, docid DESC LIMIT 50)""", "conv_msgs")
def page_links_bounds(spark, d):
    return topics.page_links(topics.recent(views.conv_msgs(spark, d), 50, before=1_700_050_000))


@query("feed_entries", """
    SELECT 'urn:uuid:' || substr(sha1(mid), 1, 8) || '-' || substr(sha1(mid), 9, 4) || '-' || substr(sha1(mid), 13, 4)
      || '-' || substr(sha1(mid), 17, 4) || '-' || substr(sha1(mid), 21, 12) AS id,
      CASE WHEN subject = '' THEN '(no subject)' ELSE subject END AS title, role || ' Person' AS author,
      strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS updated
    FROM conv_msgs ORDER BY ts DESC, docid DESC LIMIT 25""", "conv_msgs")
def feed_entries(spark, d):
    return topics.feed(views.conv_msgs(spark, d)).select("id", "title", "author", "updated")


@query("epoch_manifest", """
    SELECT inbox, num // 40 AS epoch, count(*) AS n, max(ts) AS modified,
      CAST(sum(CAST('0x' || substr(sha1(num || ':' || oid), 1, 8) AS BIGINT)) AS VARCHAR) AS fingerprint
    FROM doc_posts GROUP BY ALL""", "doc_posts")
def epoch_manifest(spark, d):
    return overview.epoch_manifest(views.doc_posts(spark, d), 40)


@query("source_choice", """
    SELECT inbox, CAST(replace(inbox, 'src', '') AS BIGINT) % 3 AS boost FROM doc_posts
    WHERE inbox LIKE 'src1%' AND inbox <> 'src13' GROUP BY inbox""", "doc_posts")
def source_choice(spark, d):
    catalog = views.doc_posts(spark, d).select("inbox").distinct().withColumn(
        "boost", F.replace("inbox", F.lit("src"), F.lit("")).cast("bigint") % 3
    ).withColumn("enabled", F.col("inbox").startswith("src1"))
    return overview.choose_sources(catalog, exclude=["src1[3]"]).select("inbox", "boost")


@query("source_list", """
    SELECT DISTINCT inbox FROM arrivals WHERE NOT regexp_matches(inbox, '^u[12][^/]*$')""", "arrivals")
def source_list(spark, d):
    catalog = views.arrivals(spark, d).select("inbox").distinct()
    return overview.list_sources(catalog, pattern="u{1,2}*", invert=True, kind="local")


@query("inbox_search", f"""
    WITH {_META} SELECT inbox, description, modified FROM meta WHERE list_contains(
      regexp_extract_all(lower(description || ' ' || address || ' ' || name), '[\\p{{L}}\\p{{N}}_]+'), 'src7')""", "doc_posts")
def inbox_search(spark, d):
    return lookup.search_inboxes(_inbox_meta(spark, d), "src7").select("inbox", "description", "modified")


@query("public_listing", """
    SELECT DISTINCT inbox FROM doc_posts WHERE inbox NOT LIKE '%3' AND inbox LIKE 'src1%'""", "doc_posts")
def public_listing(spark, d):
    return lookup.listing(_inbox_meta(spark, d), r"example\.org/src1").select("inbox")


@query("saved_search_list", """
    SELECT DISTINCT 'out/' || source AS output FROM documents WHERE source LIKE 'src1%'""")
def saved_search_list(spark, d):
    saved = views.table(spark, d, "documents").select(F.concat(F.lit("out/"), "source").alias("output")).distinct()
    return lookup.saved_searches(saved, "out/src1")


@query("net_of_deletes", """
    WITH s AS (SELECT *, sum(CASE WHEN op = 'd' THEN 1 ELSE -1 END) OVER (PARTITION BY inbox, oid ORDER BY seq DESC) AS bal
      FROM changes), l AS (SELECT *, coalesce(min(bal) OVER (PARTITION BY inbox, oid ORDER BY seq DESC
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM s)
    SELECT inbox, seq, op, oid FROM l WHERE op = 'm' AND bal < least(low, 0)""", "changes")
def net_of_deletes(spark, d):
    return files.net_changes(views.changes(spark, d)).select("inbox", "seq", "op", "oid")


@query("change_log_window", """
    SELECT inbox, seq, op, oid FROM changes WHERE ct >= 1704500000 AND ct <= 1705500000""", "changes")
def change_log_window(spark, d):
    return files.read_changes(views.changes(spark, d), 1_704_500_000, 1_705_500_000).select("inbox", "seq", "op", "oid")


@query("incremental_pull", """
    WITH o AS (SELECT inbox, max(num) FILTER (num % 3 = 0) AS last_uid FROM arrivals GROUP BY inbox)
    SELECT a.inbox, a.num, CASE WHEN a.inbox LIKE '%9' THEN 'epoch changed' ELSE 'new' END AS status
    FROM arrivals a JOIN o USING (inbox) WHERE a.inbox LIKE '%9' OR last_uid IS NULL OR num > last_uid""", "arrivals")
def incremental_pull(spark, d):
    a = views.arrivals(spark, d).withColumn("epoch", F.lit(1)).withColumn("max_uid", F.lit(10**12))
    offsets = a.groupBy("inbox").agg(
        F.max(F.when(F.col("num") % 3 == 0, F.col("num"))).alias("last_uid"),
        F.first(F.when(F.col("inbox").endswith("9"), 2).otherwise(1)).alias("epoch"),
    )
    return files.pull_new(a, offsets, source="inbox", uid="num").select("inbox", "num", "status")


@query("usable_blobs", "SELECT doc_id FROM documents WHERE strlen(text) > 0 AND strlen(text) <= 4000")
def usable_blobs(spark, d):
    docs = views.table(spark, d, "documents").withColumn("raw", F.encode("text", "UTF-8"))
    return files.usable_blobs(docs, max_bytes=4000).select("doc_id")


@query("unwrapped_messages", "SELECT doc_id, 'Subject: x' || chr(10) || chr(10) || text AS body FROM documents")
def unwrapped_messages(spark, d):
    raw = F.encode(F.concat(F.lit("\nFrom me@x Mon Jan 1\nSubject: x\n\n"), "text"), "UTF-8")
    docs = views.table(spark, d, "documents")
    return docs.select("doc_id", F.decode(files.without_separator(raw), "UTF-8").alias("body"))


@query("date_predicates", """
    SELECT num, CASE WHEN ts >= 1705190400 THEN 1 ELSE 0 END AS since_day, CASE WHEN ts <= 1705190400 THEN 1 ELSE 0 END AS before_day,
      CASE WHEN ts BETWEEN 1705190400 AND 1705276799 THEN 1 ELSE 0 END AS on_day,
      CASE WHEN ts BETWEEN 1705190400 AND 1705276800 THEN 1 ELSE 0 END AS sent_on_day,
      CASE WHEN bytes > 5000 THEN 1 ELSE 0 END AS larger, CASE WHEN bytes < 500 THEN 1 ELSE 0 END AS smaller,
      CASE WHEN num BETWEEN 5 AND 9 OR num = 40 OR num >= 900 THEN 1 ELSE 0 END AS in_set FROM arrivals""", "arrivals")
def date_predicates(spark, d):
    day = 1_705_190_400
    a = views.arrivals(spark, d).withColumn("ds", F.col("ts"))
    tests = {
        "since_day": predicates.since(day), "before_day": predicates.before(day), "on_day": predicates.on(day),
        "sent_on_day": predicates.sent_on(day), "larger": predicates.larger(5000), "smaller": predicates.smaller(500),
        "in_set": predicates.uid_set("5:9,40,900:*"),
    }
    return a.select("num", *[p.condition.cast("int").alias(n) for n, p in tests.items()])


@query("subject_elision", """
    SELECT num, CASE WHEN prev IS NULL THEN norm WHEN prev = norm THEN ' "' ELSE norm END AS shown
    FROM (SELECT num, norm, CASE WHEN prev_num = num - 1 THEN prev END AS prev FROM (
      SELECT num, regexp_replace(regexp_replace(regexp_replace(subject, '\\s+', ' ', 'g'), '\\.+$', ''), '^Re: ', '') AS norm,
        lag(regexp_replace(regexp_replace(regexp_replace(subject, '\\s+', ' ', 'g'), '\\.+$', ''), '^Re: ', '')) OVER (ORDER BY num) AS prev,
        lag(num) OVER (ORDER BY num) AS prev_num FROM conv_msgs))""", "conv_msgs")
def subject_elision(spark, d):
    m = views.conv_msgs(spark, d).select(
        "num", subjects.normalized(F.col("subject")).alias("norm")
    )
    before = m.select((F.col("num") + 1).alias("num"), F.col("norm").alias("prev"))
    return m.join(before, "num", "left").select("num", subjects.elide_against(F.col("prev"), F.col("norm")).alias("shown"))


@query("hits_with_skeletons", """
    SELECT rank, docid, subject FROM (SELECT doc_id + 1 AS docid, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM labels)
    JOIN doc_posts USING (docid)""", "doc_posts")
def hits_with_skeletons(spark, d):
    from archivelake.operators.ordered import row_numbers

    hits = row_numbers(
        views.table(spark, d, "labels").select((F.col("doc_id") + 1).alias("docid"), F.lit(0).alias("k")),
        ["k"], "docid", descending=True, out="rank", width=1000,
    ).drop("k")
    return overview.hits_in_order(hits, views.doc_posts(spark, d)).select("rank", "docid", "subject")


@query("reverse_page", "SELECT docid, ts FROM conv_msgs ORDER BY ts, docid DESC LIMIT 20 OFFSET 4", "conv_msgs")
def reverse_page(spark, d):
    m = views.conv_msgs(spark, d)
    return rank.page(m, [("ts", False), ("docid", True)], limit=20, offset=-5).select("docid", "ts")
