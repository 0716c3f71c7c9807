"""Queries: streams replayed from the test tables, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivelake.operators import predicates as p
from archivelake.plans.registry import query
from archivelake.session import work_folder
from archivelake.sources import views
from archivelake.streaming import ingest, saved, searches
from archivelake.streaming.tables import read_table, stream_files, stream_table, write_batch

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _arrivals(spark, d):
    e = stream_table(spark, d, "events", EVENTS)
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("inbox"), (F.col("event_id") + 1).alias("num"),
        F.col("ts").alias("time"), F.unix_seconds("ts").alias("ts"), F.col("event_type").alias("kind"), "user_id",
    )


def _replayed(df, spark, name, schema, mode="append"):
    base = work_folder(spark, name)
    searches.write_stream(df, base, "out", mode, available_now=True).awaitTermination()
    return read_table(spark, f"{base}/out", schema).drop("batch")


@query("stream_notifications", "SELECT inbox, max(num) AS max_num, count(*) AS n FROM arrivals GROUP BY inbox", "arrivals")
def stream_notifications(spark, d):
    out = _replayed(searches.notifications(_arrivals(spark, d)), spark, "notify",
                    "inbox string, max_num bigint, n bigint", "update")
    return out.groupBy("inbox").agg(F.max("max_num").alias("max_num"), F.max("n").alias("n"))


@query("stream_saved_search", "SELECT inbox, num FROM arrivals WHERE kind = 'error' AND num > 100", "arrivals")
def stream_saved_search(spark, d):
    hits = searches.stream_hits(_arrivals(spark, d), (F.col("kind") == "error") & (F.col("num") > 100))
    return _replayed(hits.select("inbox", "num"), spark, "saved", "inbox string, num bigint")


def _text_searches():
    """Saved searches that between them hold every kind of predicate."""
    return {
        "both": p.Term("that") & p.Term("for"),
        "either": (p.Term("trash") | p.Term("idiot") | p.Term("moron")) & ~(p.Term("the") & p.Term("of")),
        "phrase": p.Phrase(("of", "the")) & ~p.Phrase(("the", "and")),
        "none": ~(p.Term("the") | p.Term("de") | p.Term("der")) & p.between("num", 10),
        "subject": p.Term("src0", "s"),
    }


@query("stream_text_searches", r"""
    WITH w AS (SELECT source AS inbox, doc_id + 1 AS num, coalesce(source, '') AS subject,
        ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), ' ') || ' ' AS t FROM documents)
    SELECT 'both' AS search, inbox, num FROM w WHERE contains(t, ' that ') AND contains(t, ' for ')
    UNION ALL SELECT 'either', inbox, num FROM w WHERE (contains(t, ' trash ') OR contains(t, ' idiot ') OR contains(t, ' moron '))
      AND NOT (contains(t, ' the ') AND contains(t, ' of '))
    UNION ALL SELECT 'phrase', inbox, num FROM w WHERE contains(t, ' of the ') AND NOT contains(t, ' the and ')
    UNION ALL SELECT 'none', inbox, num FROM w WHERE NOT (contains(t, ' the ') OR contains(t, ' de ') OR contains(t, ' der ')) AND num >= 10
    UNION ALL SELECT 'subject', inbox, num FROM w WHERE subject = 'src0'""")
def stream_text_searches(spark, d):
    docs = stream_table(spark, d, "documents", DOCUMENTS)
    messages = docs.select(F.col("source").alias("inbox"), (F.col("doc_id") + 1).alias("num"), "text")
    searches_table = saved.compile_searches(spark, _text_searches())
    base = work_folder(spark, "saved-text")
    fields = {"": F.col("text"), "s": F.col("inbox")}
    saved.follow(messages, searches_table, fields, base, available_now=True).awaitTermination()
    return read_table(spark, f"{base}/hits", saved.HITS).drop("batch")


@query("stream_unique", "SELECT DISTINCT inbox, kind FROM arrivals", "arrivals")
def stream_unique(spark, d):
    once = searches.unique_stream(_arrivals(spark, d), ["inbox", "kind"], "time", "60 days")
    return _replayed(once.select("inbox", "kind"), spark, "unique", "inbox string, kind string")


@query("stream_reader_positions", """
    SELECT 'r-' || inbox AS "user", inbox, max(num) AS last_del FROM arrivals WHERE kind = 'purchase' GROUP BY inbox
    HAVING max(ts) >= 1704067200 + 86400""", "arrivals")
def stream_reader_positions(spark, d):
    seen = _arrivals(spark, d).where("kind = 'purchase'").withColumn("user", F.concat(F.lit("r-"), "inbox"))
    out = _replayed(searches.reader_positions(seen), spark, "readers",
                    "user string, inbox string, last_del bigint, last_seen bigint", "update")
    state = out.groupBy("user", "inbox").agg(F.max("last_del").alias("last_del"), F.max("last_seen").alias("last_seen"))
    return searches.live_readers(state, 1_704_067_200 + 2 * 86_400, 86_400).select("user", "inbox", "last_del")


@query("stream_ingest", """
    SELECT source AS inbox, min(doc_id) AS seq, row_number() OVER (PARTITION BY source ORDER BY min(doc_id)) AS num FROM documents
    GROUP BY source, text""")
def stream_ingest(spark, d):
    docs = stream_table(spark, d, "documents", DOCUMENTS)
    head = F.concat(
        F.lit("From: a@example.org\nTo: list@example.org\nSubject: post\nDate: Tue, 14 Nov 2023 22:13:20 +0000\nMessage-ID: <"),
        F.sha1("text"), F.lit("@z>\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "text",
    )
    raw = docs.select(F.col("source").alias("inbox"), F.col("doc_id").alias("seq"), F.encode(head, "UTF-8").alias("raw"))
    base = work_folder(spark, "ingest")
    ingest.ingest(raw, base, available_now=True).awaitTermination()
    return read_table(spark, f"{base}/messages", ingest.MESSAGES).select("inbox", "seq", "num")


@query("stream_merge_log", """
    WITH adds AS (SELECT inbox, num AS xnum, oid, content_hash FROM doc_posts)
    SELECT dense_rank() OVER (ORDER BY first_num) AS docid, inbox, xnum FROM (SELECT inbox, xnum,
      min(xnum) OVER (PARTITION BY content_hash) AS first_num FROM adds)""", "doc_posts")
def stream_merge_log(spark, d):
    docs = stream_table(spark, d, "documents", DOCUMENTS)
    changes = docs.select(
        F.lit("m").alias("op"), F.col("source").alias("inbox"), (F.col("doc_id") + 1).alias("xnum"),
        F.sha1(F.concat_ws("\n", "source", "text")).alias("oid"), F.lit("m").alias("mid"),
        F.sha2("text", 256).alias("content_hash"), (F.col("doc_id") + 1).alias("seq"),
    )
    base = work_folder(spark, "merge")
    ingest.merge_log(changes, base, available_now=True).awaitTermination()
    return ingest.merged_xref(spark, base).select("docid", "inbox", "xnum")


@query("stream_moderation", """
    SELECT 'added' AS kind, inbox, num AS seq FROM conv_msgs WHERE turn % 4 = 0
    UNION ALL SELECT 'removed', inbox, num FROM conv_msgs WHERE turn % 4 = 1
    UNION ALL SELECT 'removed', NULL, num FROM conv_msgs WHERE turn % 4 >= 2""", "conv_msgs")
def stream_moderation(spark, d):
    m = views.conv_msgs(spark, d)
    t = F.col("turn") % 4
    actions = m.select(
        F.when(t == 0, "ham").when(t == 2, "spam").otherwise("rm").alias("action"), F.col("num").alias("seq"), "mid",
        F.sha2("body", 256).alias("content_hash"),
        F.when(t == 3, "nobody@x.org").otherwise(F.col("to")).alias("to"), "cc",
        F.array().cast("array<string>").alias("list_ids"),
    )
    base = work_folder(spark, "moderate")
    write_batch(actions, f"{base}/in", 0)
    inboxes = m.select("inbox").distinct().select(
        "inbox", F.concat("inbox", F.lit("@lists.example.org")).alias("address"), F.col("inbox").alias("list_id"))
    schema = "action string, seq bigint, mid string, content_hash string, to string, cc string, list_ids array<string>"
    ingest.moderate(stream_files(spark, f"{base}/in", schema), inboxes, base, available_now=True).awaitTermination()
    added = read_table(spark, f"{base}/additions", ingest.REMOVALS).select(F.lit("added").alias("kind"), "inbox", "seq")
    removed = read_table(spark, f"{base}/removals", ingest.REMOVALS).select(F.lit("removed").alias("kind"), "inbox", "seq")
    return added.union(removed)


@query("spam_retraction", """
    SELECT num FROM doc_posts WHERE content_hash NOT IN (SELECT content_hash FROM doc_posts p JOIN labels l ON l.doc_id + 1 = p.num
      WHERE l.toxic = 1)""", "doc_posts")
def spam_retraction(spark, d):
    posts = views.doc_posts(spark, d).select("inbox", "num", F.lit("m").alias("mid"), "content_hash", F.col("num").alias("seq"))
    toxic = views.table(spark, d, "labels").where("toxic = 1").select((F.col("doc_id") + 1).alias("num"))
    removals = posts.join(toxic, "num", "left_semi").select(
        F.lit(None).cast("string").alias("inbox"), "mid", "content_hash", F.lit(10**15).alias("seq"))
    return ingest.current_messages(posts, removals).select("num")


@query("saved_search_refresh", """
    SELECT inbox, num FROM arrivals a JOIN (SELECT inbox, max(num) AS m FROM arrivals WHERE num <= 400 GROUP BY inbox) s USING (inbox)
    WHERE num > m AND kind = 'view' UNION ALL SELECT inbox, num FROM arrivals WHERE kind = 'view' AND inbox NOT IN
      (SELECT inbox FROM arrivals WHERE num <= 400)""", "arrivals")
def saved_search_refresh(spark, d):
    a = views.arrivals(spark, d)
    saved = searches.next_positions(a.where("num <= 400"), a.where("false").select("inbox", F.col("num").alias("max_num")))
    return searches.new_hits(a.where("kind = 'view'"), saved).select("inbox", "num")


@query("overlap_refresh", """
    SELECT num FROM arrivals WHERE ts >= 1705363200 - 172800 AND num % 2 = 1""", "arrivals")
def overlap_refresh(spark, d):
    a = views.arrivals(spark, d)
    return searches.overlapping_hits(a, 1_705_363_200, a.where("num % 2 = 0"), key="num").select("num")


@query("flag_updates", """
    SELECT num AS docid FROM doc_posts JOIN annotations a ON a.docid = num WHERE array_to_string(list_sort(kw), ',') <> 'flagged'""",
       "doc_posts annotations")
def flag_updates(spark, d):
    posts = views.doc_posts(spark, d)
    oid = F.concat(F.lit("o"), F.col("docid").cast("string"))
    stored = views.annotations(spark, d).select(oid.alias("oid"), "docid", "kw")
    locations = posts.select(F.col("inbox").alias("folder"), F.col("num").alias("uid"), oid.alias("oid"))
    events = locations.select("folder", "uid", F.array(F.lit("flagged")).alias("kw"))
    return searches.flag_updates(events, locations, stored).select("docid")


@query("folder_event_routes", """
    SELECT num AS uid, CASE CAST(replace(inbox, 'u', '') AS BIGINT) % 4 WHEN 0 THEN 'import' WHEN 1 THEN 'index' ELSE 'tag' END AS action
    FROM arrivals WHERE CAST(replace(inbox, 'u', '') AS BIGINT) % 4 <> 3""", "arrivals")
def folder_event_routes(spark, d):
    a = views.arrivals(spark, d).select(F.col("inbox").alias("folder"), F.col("num").alias("uid"))
    n = F.replace("folder", F.lit("u"), F.lit("")).cast("bigint") % 4
    states = a.select("folder").distinct().withColumn(
        "state", F.when(n == 0, "import-rw").when(n == 1, "index-ro").when(n == 2, "tag-rw").otherwise("pause"))
    return searches.route_events(a, states).select("uid", "action")
