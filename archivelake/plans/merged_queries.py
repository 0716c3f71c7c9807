"""Queries: de-duplication, the merged index, annotations, routing, policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivelake.functions import hashing
from archivelake.operators import annotations as ann
from archivelake.operators import dedupe, lookup, merged, policy, rank
from archivelake.plans.registry import query
from archivelake.sources import views
from archivelake.sources.decode import decode


def _xref(spark, d):
    return views.xposts(spark, d)


@query("dedupe_content", """
    SELECT num, inbox FROM doc_posts WHERE num IN (SELECT min(num) FROM doc_posts GROUP BY content_hash)""", "doc_posts")
def dedupe_content(spark, d):
    return dedupe.dedupe(views.doc_posts(spark, d), "content").select("num", "inbox")


@query("dedupe_blob", """
    SELECT num, inbox FROM doc_posts WHERE num IN (SELECT min(num) FROM doc_posts GROUP BY oid)""", "doc_posts")
def dedupe_blob(spark, d):
    return dedupe.dedupe(views.doc_posts(spark, d), "oid").select("num", "inbox")


@query("dedupe_id", """
    SELECT num, inbox FROM doc_posts WHERE num IN (SELECT min(num) FROM doc_posts
      GROUP BY CASE WHEN num % 5 = 0 THEN 'o' || oid ELSE 'm' || num % 301 END)""", "doc_posts")
def dedupe_id(spark, d):
    posts = views.doc_posts(spark, d).withColumn(
        "mid", F.when(F.col("num") % 5 == 0, "").otherwise((F.col("num") % 301).cast("string"))
    )
    return dedupe.dedupe(posts, "mid").select("num", "inbox")


@query("dedupe_none", "SELECT num, inbox FROM doc_posts", "doc_posts")
def dedupe_none(spark, d):
    return dedupe.dedupe(views.doc_posts(spark, d), "none").select("num", "inbox")


@query("dedupe_against_output", """
    SELECT num FROM doc_posts WHERE num % 2 = 0 AND content_hash NOT IN (SELECT content_hash FROM doc_posts WHERE num % 2 = 1)
      AND num IN (SELECT min(num) FROM doc_posts WHERE num % 2 = 0 GROUP BY content_hash)""", "doc_posts")
def dedupe_against_output(spark, d):
    p = views.doc_posts(spark, d)
    return dedupe.dedupe_against(p.where("num % 2 = 0"), p.where("num % 2 = 1")).select("num")


@query("reused_ids", """
    SELECT kind || (num % 400) AS mid, count(*) AS n, min(num) AS first_num, max(num) AS last_num FROM arrivals
    GROUP BY ALL HAVING count(*) > 1""", "arrivals")
def reused_ids(spark, d):
    a = views.arrivals(spark, d).withColumn("mid", F.concat("kind", (F.col("num") % 400).cast("string")))
    return dedupe.reused_ids(a)


@query("unique_hits", """
    SELECT rank, m FROM (SELECT num AS rank, kind || (num % 90) AS m, row_number() OVER (PARTITION BY kind || (num % 90)
      ORDER BY num) AS rn FROM arrivals) WHERE rn = 1""", "arrivals")
def unique_hits(spark, d):
    hits = views.arrivals(spark, d).select(
        F.col("num").alias("rank"), F.concat("kind", (F.col("num") % 90).cast("string")).alias("mid")
    )
    return dedupe.unique_page(hits).select("rank", F.col("mid").alias("m"))


@query("insert_or_ignore", """
    SELECT k, v FROM (SELECT num % 100 AS k, num AS v, row_number() OVER (PARTITION BY num % 100 ORDER BY num) AS rn
      FROM arrivals WHERE num % 100 >= 50) WHERE rn = 1
    UNION ALL SELECT DISTINCT num % 100, -1 FROM arrivals WHERE num % 100 < 50""", "arrivals")
def insert_or_ignore(spark, d):
    rows = views.arrivals(spark, d).select((F.col("num") % 100).alias("k"), F.col("num").alias("v"))
    table = rows.where("k < 50").select("k", F.lit(-1).cast("bigint").alias("v")).distinct()
    return dedupe.insert_or_ignore(table, rows, ["k"], ["v"])


@query("insert_or_replace", """
    SELECT num % 100 AS k, max(num) AS v FROM arrivals WHERE num % 100 >= 25 GROUP BY ALL
    UNION ALL SELECT DISTINCT num % 100, -1 FROM arrivals WHERE num % 100 < 25""", "arrivals")
def insert_or_replace(spark, d):
    rows = views.arrivals(spark, d).select((F.col("num") % 100).alias("k"), F.col("num").alias("v"))
    table = rows.where("k < 50").select("k", F.lit(-1).cast("bigint").alias("v")).distinct()
    return dedupe.insert_or_replace(table, rows.where("k >= 25"), ["k"], ["v"])


@query("arrival_verdicts", """
    WITH a AS (SELECT num AS seq, content_hash, ds, 'k' || (num % 37) AS m1, 'alt' || num AS m2, num % 2 AS two FROM doc_posts
        WHERE num % 3 = 0),
      s AS (SELECT DISTINCT 'k' || (num % 20) AS mid, content_hash FROM doc_posts WHERE num % 3 <> 0),
      t AS (SELECT DISTINCT mid FROM s), v AS (SELECT a.*, CASE WHEN t.mid IS NULL THEN 'new' WHEN s.mid IS NOT NULL THEN 'duplicate'
        WHEN two = 1 THEN 'other id' ELSE 'generated id' END AS verdict FROM a LEFT JOIN t ON t.mid = m1
        LEFT JOIN s ON s.mid = m1 AND s.content_hash = a.content_hash)
    SELECT seq, verdict, CASE verdict WHEN 'new' THEN m1 WHEN 'other id' THEN m2 WHEN 'generated id' THEN
      strftime(make_timestamp(ds * 1000000), '%Y%m%d%H%M%S') || '.'
      || translate(replace(to_base64(unhex(content_hash)), '=', ''), '+/', '-_') || '@z' END AS store_mid FROM v""", "doc_posts")
def arrival_verdicts(spark, d):
    p = views.doc_posts(spark, d).withColumn("inbox", F.lit("one")).withColumn(
        "k", F.concat(F.lit("k"), (F.col("num") % 37).cast("string"))
    )
    alt = F.concat(F.lit("alt"), F.col("num").cast("string"))
    arriving = p.where("num % 3 = 0").select(
        "inbox", F.col("num").alias("seq"), "content_hash", "ds",
        F.when(F.col("num") % 2 == 1, F.array("k", alt)).otherwise(F.array("k")).alias("mids"),
    )
    stored = p.where("num % 3 <> 0").select(
        "inbox", F.concat(F.lit("k"), (F.col("num") % 20).cast("string")).alias("mid"), "content_hash"
    )
    return dedupe.arrival_verdicts(arriving, stored).select("seq", "verdict", "store_mid")


@query("xref_merge", """
    WITH h AS (SELECT xnum AS docid, content_hash FROM xposts), k AS (SELECT docid, min(docid) OVER (PARTITION BY content_hash)
      AS keep FROM h) SELECT k.keep AS docid, inbox, xnum, oid FROM xposts JOIN k ON k.docid = xposts.xnum""", "xposts")
def xref_merge(spark, d):
    x = _xref(spark, d).withColumn("docid", F.col("xnum"))
    hashes = x.select("docid", F.lit("m").alias("mid"), "content_hash")
    _, merged_rows = dedupe.merge_duplicates(x.select("docid", "inbox", "xnum", "oid"), hashes)
    return merged_rows


@query("xref_merge_dry_run", """
    SELECT xnum AS docid, docid AS keep FROM xposts WHERE xnum <> docid""", "xposts")
def xref_merge_dry_run(spark, d):
    x = _xref(spark, d)
    hashes = x.select(F.col("xnum").alias("docid"), F.lit("m").alias("mid"), "content_hash")
    moves, _ = dedupe.merge_duplicates(x, hashes)
    return moves


@query("split_documents", """
    WITH m AS (SELECT (xnum - 1) // 3 + 1 AS docid, inbox, xnum, content_hash, xnum AS pos FROM xposts),
      g AS (SELECT docid, content_hash, min(pos) AS best FROM m GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY docid ORDER BY best) AS place FROM g),
      n AS (SELECT docid, content_hash, row_number() OVER (ORDER BY docid, content_hash) + 99999 AS new_docid FROM r WHERE place > 1)
    SELECT m.docid, m.xnum, coalesce(n.new_docid, m.docid) AS new_docid FROM m LEFT JOIN n
      ON n.docid = m.docid AND n.content_hash = m.content_hash""", "xposts")
def split_documents(spark, d):
    members = _xref(spark, d).select(
        (F.floor((F.col("xnum") - 1) / 3) + 1).alias("docid"), "inbox", "xnum", "oid", "content_hash",
        F.col("xnum").alias("pos"),
    )
    return dedupe.split_documents(members, 100_000).select("docid", "xnum", "new_docid")


@query("xref_peer_rows", """
    SELECT a.docid, a.inbox, a.xnum, b.inbox AS peer_inbox, b.xnum AS peer_xnum FROM xposts a JOIN xposts b USING (docid)
    WHERE a.xnum = a.docid AND a.inbox <> b.inbox""", "xposts")
def xref_peer_rows(spark, d):
    """Every peer of the first copy of each message."""
    x = _xref(spark, d).select("docid", "inbox", "xnum")
    return merged.peers_of(x.where("xnum = docid"), x)


@query("xref_peers", """
    WITH p AS (SELECT docid, inbox, count(*) AS n, min(xnum) AS xnum FROM xposts GROUP BY ALL),
      t AS (SELECT docid, count(*) AS total FROM xposts GROUP BY docid),
      o AS (SELECT a.docid, a.inbox, min_by(b.inbox, b.inbox) AS peer_inbox, min_by(b.xnum, b.inbox) AS peer_xnum FROM p a
        JOIN p b ON a.docid = b.docid AND a.inbox <> b.inbox GROUP BY ALL)
    SELECT x.docid, x.inbox, x.xnum, t.total - p.n AS peers, o.peer_inbox, o.peer_xnum FROM xposts x JOIN p USING (docid, inbox)
      JOIN t USING (docid) LEFT JOIN o USING (docid, inbox)""".replace("x.xnum, t.total", "x.xnum AS xnum, t.total"), "xposts")
def xref_peers(spark, d):
    return merged.peer_counts(_xref(spark, d).select("docid", "inbox", "xnum")).select(
        "docid", "inbox", "xnum", "peers", "peer_inbox", "peer_xnum"
    )


@query("preferred_copies", """
    SELECT docid, inbox, xnum FROM (SELECT x.*, row_number() OVER (PARTITION BY docid ORDER BY
      CAST(replace(inbox, 'src', '') AS BIGINT) * 7 % 20, xnum) AS rn FROM xposts x) WHERE rn = 1""", "xposts")
def preferred_copies(spark, d):
    x = _xref(spark, d)
    inboxes = x.select("inbox").distinct().withColumn(
        "pos", F.replace("inbox", F.lit("src"), F.lit("")).cast("bigint") * 7 % 20
    )
    return rank.preferred_copies(x, inboxes).select("docid", "inbox", "xnum")


@query("inbox_article_numbers", """
    SELECT docid, min(xnum) AS xnum FROM xposts WHERE inbox = 'src3' GROUP BY docid""", "xposts")
def inbox_article_numbers(spark, d):
    x = _xref(spark, d)
    hits = x.select("docid").distinct().withColumn("rank", F.col("docid"))
    return merged.article_numbers(hits, x, "src3").select("docid", "xnum")


@query("id_locations", """
    SELECT DISTINCT 'd' || (docid - 1) || '@z' AS mid, inbox, xnum FROM xposts""", "xposts")
def id_locations(spark, d):
    x = _xref(spark, d)
    ids = x.select("docid", F.concat(F.lit("d"), (F.col("docid") - 1).cast("string"), F.lit("@z")).alias("mid"))
    return merged.locations_of(ids, x)


@query("gc_anti", """
    WITH o AS (SELECT docid FROM xposts WHERE docid % 7 <> 0 UNION SELECT docid + 500000 FROM xposts WHERE docid % 11 = 0),
      q AS (SELECT docid * 2 AS docid FROM xposts)
    SELECT 'xref without overview' AS kind, docid FROM (SELECT DISTINCT docid FROM xposts) WHERE docid NOT IN (SELECT docid FROM o)
    UNION ALL SELECT 'overview without xref', docid FROM o WHERE docid NOT IN (SELECT docid FROM xposts)
    UNION ALL SELECT DISTINCT 'queue without overview', docid FROM q WHERE docid NOT IN (SELECT docid FROM o)""", "xposts")
def gc_anti(spark, d):
    x = _xref(spark, d).select("docid")
    over = x.where("docid % 7 <> 0").union(x.where("docid % 11 = 0").select(F.col("docid") + 500_000))
    return merged.garbage(x, over, x.select((F.col("docid") * 2).alias("docid")))


@query("stale_compare", """
    SELECT coalesce(a.inbox, b.inbox) AS inbox, coalesce(a.num, b.num) AS num, CASE WHEN b.o IS NULL THEN 'missing'
      WHEN a.o IS NULL THEN 'stale' WHEN a.o <> b.o THEN 'changed' ELSE 'ok' END AS status
    FROM (SELECT inbox, num, oid AS o FROM doc_posts WHERE num % 5 <> 0) a FULL JOIN
      (SELECT inbox, num, CASE WHEN num % 7 = 0 THEN 'other' ELSE oid END AS o FROM doc_posts WHERE num % 6 <> 0) b
      ON a.inbox = b.inbox AND a.num = b.num""", "doc_posts")
def stale_compare(spark, d):
    p = views.doc_posts(spark, d).select("inbox", "num", "oid")
    x = p.where("num % 6 <> 0").select(
        "inbox", F.col("num").alias("xnum"), F.when(F.col("num") % 7 == 0, "other").otherwise(F.col("oid")).alias("oid")
    )
    return merged.compare_inbox(p.where("num % 5 <> 0"), x).select("inbox", "num", "status")


@query("gap_scan", """
    SELECT inbox, num + 1 AS first_missing, nxt - 1 AS last_missing FROM (SELECT inbox, num,
      lead(num) OVER (PARTITION BY inbox ORDER BY num) AS nxt FROM arrivals) WHERE nxt > num + 1""", "arrivals")
def gap_scan(spark, d):
    return merged.number_gaps(views.arrivals(spark, d))


@query("merged_index_build", """
    SELECT docid, min(xnum) AS first_num, count(*) AS copies, count(DISTINCT inbox) AS inboxes FROM xposts GROUP BY docid""", "xposts")
def merged_index_build(spark, d):
    return _xref(spark, d).groupBy("docid").agg(
        F.min("xnum").alias("first_num"), F.count("*").alias("copies"), F.countDistinct("inbox").alias("inboxes")
    )


@query("numbered_documents", """
    SELECT seq, 1000 + row_number() OVER (ORDER BY seq) AS docid FROM changes WHERE op = 'm'""", "changes")
def numbered_documents(spark, d):
    adds = views.changes(spark, d).where("op = 'm'")
    return merged.number_documents(adds, 1000).select("seq", "docid")


_APPLY = """
    d AS (SELECT docid, content_hash FROM xposts WHERE xnum = docid AND docid % 2 = 0),
    x0 AS (SELECT x.docid, inbox, xnum, oid FROM xposts x JOIN d USING (docid)),
    dl AS (SELECT DISTINCT inbox, oid FROM x0 WHERE xnum % 3 = 0),
    ad AS (SELECT inbox, xnum + 1000000 AS xnum, oid, content_hash, xnum AS seq FROM xposts WHERE xnum % 5 = 0),
    kept AS (SELECT x0.* FROM x0 LEFT JOIN dl ON dl.inbox = x0.inbox AND dl.oid = x0.oid WHERE dl.oid IS NULL),
    fresh AS (SELECT content_hash, 5000000 + row_number() OVER (ORDER BY s, content_hash) AS docid FROM (SELECT content_hash, min(seq) AS s
      FROM ad WHERE content_hash NOT IN (SELECT content_hash FROM d) GROUP BY content_hash)),
    nx AS (SELECT docid, inbox, xnum, oid FROM kept UNION SELECT coalesce(d.docid, fresh.docid), inbox, xnum, oid FROM ad
      LEFT JOIN d ON d.content_hash = ad.content_hash LEFT JOIN fresh ON fresh.content_hash = ad.content_hash)"""


def _applied(spark, d):
    x = _xref(spark, d)
    docs = x.where("xnum = docid and docid % 2 = 0").select("docid", F.lit("m").alias("mid"), "content_hash")
    have = x.join(docs.select("docid"), "docid", "left_semi")
    deletes = have.where("xnum % 3 = 0").select(
        F.lit("d").alias("op"), "inbox", "xnum", "oid", F.lit("m").alias("mid"), "content_hash", F.lit(0).cast("bigint").alias("seq"))
    adds = x.where("xnum % 5 = 0").select(
        F.lit("m").alias("op"), "inbox", (F.col("xnum") + 1_000_000).alias("xnum"), "oid", F.lit("m").alias("mid"),
        "content_hash", F.col("xnum").alias("seq"))
    return merged.apply_changes(have.select("docid", "inbox", "xnum", "oid"), docs, deletes.union(adds), 5_000_000)


@query("merged_apply_xref", f"WITH {_APPLY} SELECT * FROM nx", "xposts")
def merged_apply_xref(spark, d):
    return _applied(spark, d)["xref"]


@query("merged_apply_queue", f"""WITH {_APPLY} SELECT DISTINCT x0.docid FROM x0 JOIN dl ON dl.inbox = x0.inbox AND dl.oid = x0.oid
    WHERE x0.docid IN (SELECT docid FROM nx)""", "xposts")
def merged_apply_queue(spark, d):
    return _applied(spark, d)["reindex"]


@query("inboxes_removed", """
    SELECT docid, count(*) AS copies FROM xposts WHERE inbox LIKE 'src1%' GROUP BY docid""", "xposts")
def inboxes_removed(spark, d):
    x = _xref(spark, d)
    live = x.select("inbox").distinct().where("inbox like 'src1%'")
    kept, docs = merged.remove_inboxes(x, x.select("docid").distinct(), live)
    return docs.join(kept, "docid").groupBy("docid").agg(F.count("*").alias("copies"))


@query("messages_removed", """
    SELECT docid, inbox, xnum FROM xposts WHERE docid NOT IN (SELECT x.docid FROM xposts x JOIN labels l ON l.doc_id + 1 = x.docid
      WHERE toxic = 1)""", "xposts")
def messages_removed(spark, d):
    x = _xref(spark, d)
    docs = x.where("xnum = docid").select("docid", F.lit("m").alias("mid"), "content_hash")
    toxic = views.table(spark, d, "labels").where("toxic = 1").select((F.col("doc_id") + 1).alias("docid"))
    gone = docs.join(toxic, "docid", "left_semi").select("mid", "content_hash")
    return merged.remove_messages({"xref": x}, docs, gone)["xref"].select("docid", "inbox", "xnum")


@query("content_replaced", """
    SELECT num, CASE WHEN num % 6 = 0 AND num % 4 = 0 THEN 'new text' ELSE body END AS raw,
      CASE WHEN num % 6 = 0 THEN CASE WHEN num % 4 = 0 THEN 'replaced' ELSE 'refused' END END AS edit_status FROM doc_posts""", "doc_posts")
def content_replaced(spark, d):
    p = views.doc_posts(spark, d).select(
        "num", "docid", "mid", "content_hash", F.col("body").alias("raw"), F.array("mid", F.lit("b")).alias("mids"),
        F.array(F.lit("r1"), F.lit("r2")).alias("refs"),
    )
    edits = p.where("num % 6 = 0").select(
        "mid", "content_hash", F.lit("new text").alias("new_raw"), F.array(F.lit("b"), "mid").alias("new_mids"),
        F.when(F.col("num") % 4 == 0, F.array(F.lit("r2"), F.lit("r1"))).otherwise(F.array(F.lit("r2"))).alias("new_refs"),
    )
    return merged.replace_content(p, edits).select("num", "raw", "edit_status")


@query("purged", """
    SELECT num FROM doc_posts WHERE num NOT IN (SELECT doc_id + 1 FROM labels WHERE quality = 0)""", "doc_posts")
def purged(spark, d):
    p = views.doc_posts(spark, d)
    bad = views.table(spark, d, "labels").where("quality = 0").select((F.col("doc_id") + 1).alias("num"))
    return merged.purge(p, p.join(bad, "num", "left_semi")).select("num")


@query("reindex_queue", """
    SELECT DISTINCT docid FROM (SELECT docid FROM xposts UNION SELECT doc_id + 1 FROM labels)
    WHERE docid NOT IN (SELECT doc_id + 1 FROM labels WHERE toxic = 1)""", "xposts")
def reindex_queue(spark, d):
    marked = views.table(spark, d, "labels").select((F.col("doc_id") + 1).alias("docid"), "toxic")
    queue = merged.queue_add(_xref(spark, d), marked)
    return merged.queue_take(queue, marked.where("toxic = 1"))


@query("rewritten_log", """
    WITH o AS (SELECT inbox, seq, oid, seq * 10 AS num FROM changes WHERE op = 'm'),
      n AS (SELECT inbox, CASE WHEN seq >= 600 THEN seq + 1 ELSE seq END AS seq, oid FROM changes WHERE op = 'm'),
      g AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.inbox = o.inbox AND n.seq = o.seq AND n.oid = o.oid)),
      f AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.inbox = o.inbox AND n.seq = o.seq AND n.oid = o.oid))
    SELECT 'gone' AS kind, inbox, seq, num AS former_num FROM g UNION ALL SELECT 'added', f.inbox, f.seq, k.num FROM f LEFT JOIN
      (SELECT inbox, oid, min(num) AS num FROM g GROUP BY ALL) k ON k.inbox = f.inbox AND k.oid = f.oid""", "changes")
def rewritten_log(spark, d):
    old = views.changes(spark, d).where("op = 'm'").select("inbox", "seq", "oid", (F.col("seq") * 10).alias("num"))
    new = old.select("inbox", F.when(F.col("seq") >= 600, F.col("seq") + 1).otherwise(F.col("seq")).alias("seq"), "oid")
    gone, added = merged.rewritten_log(old, new)
    return gone.select(F.lit("gone").alias("kind"), "inbox", "seq", F.col("num").alias("former_num")).union(
        added.select(F.lit("added"), "inbox", "seq", "former_num")
    )


@query("altid_import", """
    WITH r AS (SELECT num % 150 AS n, min(num) AS seq, 'm' || (min(num) % 60) AS mid FROM arrivals GROUP BY 1)
    SELECT min_by(n, seq) AS num, mid FROM r GROUP BY mid""", "arrivals")
def altid_import(spark, d):
    rows = views.arrivals(spark, d).select(
        F.lit("gm").alias("prefix"), (F.col("num") % 150).alias("num"),
        F.concat(F.lit("m"), (F.col("num") % 60).cast("string")).alias("mid"), F.col("num").alias("seq"),
    )
    return merged.import_altids(rows.where("false"), rows).select("num", "mid")


@query("annotations_modified", """
    WITH c AS (SELECT DISTINCT doc_id + 1 AS docid FROM documents WHERE doc_id % 2 = 0),
      b AS (SELECT coalesce(a.docid, c.docid) AS docid, a.kw, a.labels, c.docid AS touched FROM annotations a FULL JOIN c ON a.docid = c.docid)
    SELECT docid, array_to_string(list_sort(CASE WHEN touched IS NULL THEN kw ELSE list_distinct(list_concat(
        [x FOR x IN coalesce(kw, []) IF x <> 'junk'], ['seen'])) END), ',') AS kw,
      array_to_string(list_sort(CASE WHEN touched IS NULL THEN labels ELSE list_distinct(list_concat(coalesce(labels, []), ['inbox'])) END), ',')
      AS labels FROM b""", "annotations")
def annotations_modified(spark, d):
    changes = views.table(spark, d, "documents").where("doc_id % 2 = 0").select(
        (F.col("doc_id") + 1).alias("docid"), F.array(F.lit("seen"), F.lit("bogus")).alias("add_kw"),
        F.array(F.lit("junk")).alias("del_kw"), F.array(F.lit("inbox"), F.lit("Bad Label")).alias("add_labels"),
        F.array().cast("array<string>").alias("del_labels"),
    )
    out = ann.modify_annotations(views.annotations(spark, d), changes)
    return out.select("docid", F.array_join("kw", ",").alias("kw"), F.array_join("labels", ",").alias("labels"))


@query("annotations_set", """
    SELECT docid, array_to_string(list_sort(CASE WHEN docid % 3 = 0 THEN ['seen'] ELSE kw END), ',') AS kw,
      array_to_string(list_sort(labels), ',') AS labels FROM annotations""", "annotations")
def annotations_set(spark, d):
    a = views.annotations(spark, d)
    changes = a.where("docid % 3 = 0").select(
        "docid", F.array(F.lit("seen")).alias("kw"), F.lit(None).cast("array<string>").alias("labels"))
    out = ann.set_annotations(a, changes)
    return out.select("docid", F.array_join("kw", ",").alias("kw"), F.array_join("labels", ",").alias("labels"))


@query("annotations_merged", """
    SELECT docid, array_to_string(list_sort(list_distinct(list_concat(kw, ['draft']))), ',') AS kw FROM annotations""", "annotations")
def annotations_merged(spark, d):
    a = views.annotations(spark, d)
    new = a.select("docid", F.array(F.lit("draft")).alias("kw"), F.array().cast("array<string>").alias("labels"))
    return ann.merge_annotations(a, new).select("docid", F.array_join("kw", ",").alias("kw"))


@query("keyword_changes", """
    SELECT docid, CASE WHEN array_to_string(list_sort(kw), ',') <> 'flagged' THEN 1 ELSE 0 END AS changed,
      0 AS changed_forwarded FROM annotations""", "annotations")
def keyword_changes(spark, d):
    kw = F.col("kw")
    return views.annotations(spark, d).select(
        "docid", ann.keywords_changed(kw, F.array(F.lit("flagged"))).cast("int").alias("changed"),
        ann.keywords_changed(F.array_append(kw, F.lit("forwarded")), kw).cast("int").alias("changed_forwarded"),
    )


@query("annotated_messages", """
    SELECT p.num, coalesce(array_to_string(list_sort(kw), ','), '') AS kw FROM doc_posts p LEFT JOIN
      (SELECT q.oid, list_distinct(flatten(list(a.kw))) AS kw FROM annotations a JOIN doc_posts q ON q.docid = a.docid GROUP BY q.oid) t
      ON t.oid = p.oid""", "doc_posts annotations")
def annotated_messages(spark, d):
    p = views.doc_posts(spark, d)
    by_blob = views.annotations(spark, d).join(p.select("docid", "oid"), "docid")
    return ann.with_annotations(p.select("num", "docid", "oid"), by_blob).select("num", F.array_join("kw", ",").alias("kw"))


@query("label_list", "SELECT DISTINCT unnest(labels) AS label FROM annotations", "annotations")
def label_list(spark, d):
    return views.annotations(spark, d).select(F.explode("labels").alias("label")).distinct().orderBy("label")


@query("external_records", """
    SELECT coalesce(a.oid, p.oid) AS oid, coalesce(p.bytes, 0) AS bytes, CASE WHEN p.oid IS NULL THEN 0 ELSE 1 END AS imported
    FROM (SELECT 'x' || docid AS oid FROM annotations) a FULL JOIN (SELECT 'x' || min(num) AS oid, min_by(bytes, num) AS bytes
      FROM doc_posts WHERE num % 2 = 0 GROUP BY content_hash) p ON a.oid = p.oid""", "doc_posts annotations")
def external_records(spark, d):
    a = views.annotations(spark, d).withColumn("oid", F.concat(F.lit("x"), F.col("docid").cast("string")))
    p = dedupe.dedupe(views.doc_posts(spark, d).where("num % 2 = 0"), "content", row_id=("num",)).withColumn(
        "oid", F.concat(F.lit("x"), F.col("num").cast("string")))
    return ann.external_only(a, p).select("oid", "bytes", F.col("imported").cast("int").alias("imported"))


_LOC = """loc AS (SELECT 'o' || (event_id % 211) AS oid, 'f' || (user_id % 6) AS folder, event_id AS uid,
  CASE WHEN event_type = 'view' THEN 'n' || event_id || ':2,' || CASE WHEN event_id % 2 = 0 THEN 'FX' ELSE '' END END AS name FROM events)"""


def _locations(spark, d):
    n = F.col("event_id")
    return views.table(spark, d, "events").select(
        F.concat(F.lit("o"), (n % 211).cast("string")).alias("oid"),
        F.concat(F.lit("f"), (F.col("user_id") % 6).cast("string")).alias("folder"), n.alias("uid"),
        F.when(F.col("event_type") == "view", F.concat(
            F.lit("n"), n.cast("string"), F.lit(":2,"), F.when(n % 2 == 0, "FX").otherwise(""))).alias("name"),
    )


@query("blob_folders", f"WITH {_LOC} SELECT oid, folder, count(*) AS places, min(uid) AS min_uid, min(name) AS first_name FROM loc GROUP BY ALL")
def blob_folders(spark, d):
    return ann.blob_folders(_locations(spark, d))


@query("blob_places", f"WITH {_LOC} SELECT DISTINCT oid, folder, uid, name FROM loc")
def blob_places(spark, d):
    return ann.blob_places(_locations(spark, d))


@query("blob_names", f"""WITH {_LOC} SELECT oid, name, folder, CASE WHEN folder <> 'f3' THEN '/mail/' || folder END AS location
    FROM loc WHERE name IS NOT NULL""")
def blob_names(spark, d):
    loc = _locations(spark, d)
    folders = loc.select("folder").distinct().where("folder <> 'f3'").withColumn("location", F.concat(F.lit("/mail/"), "folder"))
    return ann.blob_names(loc, folders).select("oid", "name", "folder", "location")


@query("folder_statistics", f"""WITH {_LOC} SELECT folder, count(name) AS names, count(uid) AS uids, min(uid) AS min_uid,
    max(uid) AS max_uid FROM loc GROUP BY folder""")
def folder_statistics(spark, d):
    return ann.folder_statistics(_locations(spark, d))


@query("folder_prune", f"WITH {_LOC} SELECT folder, uid FROM loc WHERE uid % 4 = 1")
def folder_prune(spark, d):
    loc = _locations(spark, d)
    return ann.stale_entries(loc, loc.where("uid % 4 <> 1")).select("folder", "uid")


@query("moved_files", f"""WITH {_LOC}, n AS (SELECT * FROM loc WHERE name IS NOT NULL)
    SELECT n.folder, 'new-' || n.name AS name, o.f AS old_folder, o.nm AS old_name FROM n JOIN (SELECT oid, min(folder) AS f,
      min_by(name, (folder, name)) AS nm FROM n GROUP BY oid) o USING (oid) WHERE uid % 9 = 0""")
def moved_files(spark, d):
    loc = _locations(spark, d).where("name is not null")
    listed = loc.withColumn("name", F.when(F.col("uid") % 9 == 0, F.concat(F.lit("new-"), "name")).otherwise(F.col("name")))
    return ann.moved_files(loc, listed.select("folder", "name", "oid")).select("folder", "name", "old_folder", "old_name")


@query("entries_to_documents", f"""WITH {_LOC}, p AS (SELECT 'o' || (num % 307) AS oid, min(docid) AS docid FROM doc_posts GROUP BY 1)
    SELECT folder, uid, docid FROM loc JOIN p USING (oid) WHERE uid % 3 = 0""", "doc_posts")
def entries_to_documents(spark, d):
    loc = _locations(spark, d)
    docs = views.doc_posts(spark, d).select(F.concat(F.lit("o"), (F.col("num") % 307).cast("string")).alias("oid"), "docid")
    return ann.entries_to_documents(loc.where("uid % 3 = 0"), loc, docs).select("folder", "uid", "docid")


@query("folders_moved", f"""WITH {_LOC} SELECT CASE WHEN folder = 'f1' THEN 'f9' ELSE folder END AS folder, count(*) AS n
    FROM loc WHERE folder <> 'f2' AND uid % 10 <> 3 GROUP BY 1""")
def folders_moved(spark, d):
    loc = _locations(spark, d)
    kept = ann.forget_entries(ann.forget_folders(loc, ["f2"]), loc.where("uid % 10 = 3"), ["folder", "uid"])
    return ann.move_folder(kept, "f1", "f9").groupBy("folder").agg(F.count("*").alias("n"))


@query("keyword_export", f"""WITH {_LOC}, n AS (SELECT * FROM loc WHERE name IS NOT NULL AND CAST(substr(oid, 2) AS BIGINT) % 2 = 0)
    SELECT folder, name, split_part(name, ':', 1) || ':2,' || CASE WHEN name LIKE '%FX' THEN 'FSX' ELSE 'S' END AS new_name FROM n""")
def keyword_export(spark, d):
    loc = _locations(spark, d).where("name is not null")
    stored = loc.select("oid").distinct().where("cast(substr(oid, 2) as bigint) % 2 = 0").withColumn("kw", F.array(F.lit("seen")))
    return ann.export_plan(loc, stored).select("folder", "name", "new_name")


def _inboxes(spark, d):
    return views.conv_msgs(spark, d).select("inbox").distinct().select(
        "inbox", F.concat("inbox", F.lit("@Lists.example.org")).alias("address"),
        F.concat("inbox", F.lit(".lists.example.org")).alias("list_id"),
        F.replace("inbox", F.lit("list"), F.lit("")).cast("bigint").alias("pos"),
    )


@query("routes", """
    SELECT num, inbox FROM conv_msgs WHERE num % 2 = 1
    UNION ALL SELECT num, inbox FROM conv_msgs WHERE num % 2 = 0 AND num % 4 = 0""", "conv_msgs")
def routes(spark, d):
    m = views.conv_msgs(spark, d)
    odd = m.withColumn("to", F.when(F.col("num") % 2 == 1, F.col("to")).otherwise(F.lit("nobody@x.org"))).withColumn(
        "list_ids", F.when(F.col("num") % 4 == 0, F.array(F.concat("inbox", F.lit(".Lists.example.org")))).otherwise(
            F.array().cast("array<string>")))
    return lookup.route(odd, _inboxes(spark, d), ["num"])


@query("crossposts_by_recipient", "SELECT mid, inbox, num FROM conv_msgs", "conv_msgs")
def crossposts_by_recipient(spark, d):
    m = views.conv_msgs(spark, d)
    return lookup.crossposts_by_recipient(m, _inboxes(spark, d), m.select("mid", "inbox", "num"))


@query("found_across", """
    WITH a AS (SELECT mid, inbox, num, CAST(replace(inbox, 'list', '') AS BIGINT) AS pos FROM conv_msgs UNION ALL
      SELECT mid, 'list' || ((conv_id + 3) % 7), num + 5, (conv_id + 3) % 7 FROM conv_msgs WHERE turn % 2 = 0)
    SELECT mid, min_by(inbox, (CASE WHEN inbox = 'list2' THEN -1 ELSE pos END, num)) AS inbox,
      min_by(num, (CASE WHEN inbox = 'list2' THEN -1 ELSE pos END, num)) AS num FROM a GROUP BY mid""", "conv_msgs")
def found_across(spark, d):
    m = views.conv_msgs(spark, d)
    amap = m.select("mid", "inbox", "num").union(m.where("turn % 2 = 0").select(
        "mid", F.concat(F.lit("list"), ((F.col("conv_id") + 3) % 7).cast("string")), F.col("num") + 5))
    wanted = m.select("mid", F.lit("list2").alias("current"))
    return lookup.find_across(wanted, amap, _inboxes(spark, d)).select("mid", "inbox", "num")


@query("partial_ids", """
    SELECT mid, docid, 2 AS rung FROM (SELECT 'archive.message.' || kind || '.' || num AS mid, num AS docid, kind FROM arrivals)
    WHERE kind = 'view'""", "arrivals")
def partial_ids(spark, d):
    a = views.arrivals(spark, d).select(
        F.concat(F.lit("archive.message."), "kind", F.lit("."), F.col("num").cast("string")).alias("mid"), F.col("num").alias("docid"))
    return lookup.partial_id(a, "view.message@archive")


@query("selections", """
    SELECT num, CASE WHEN num % 6 = 5 THEN NULL WHEN num % 6 = 4 THEN 'blob' WHEN num % 6 = 3 THEN 'folder' ELSE 'mid' END AS kind,
      CASE num % 6 WHEN 5 THEN NULL WHEN 4 THEN 'abcdef' || num || '0' WHEN 3 THEN 'maildir:/m/' || num ELSE mid END AS value,
      CASE WHEN num % 6 = 1 THEN 1 ELSE 0 END AS threads FROM arrivals""", "arrivals")
def selections(spark, d):
    n, mid = F.col("num"), F.col("mid")
    text = (
        F.when(n % 6 == 0, F.concat(F.lit("see <"), mid, F.lit("> please")))
        .when(n % 6 == 1, F.concat(F.lit("https://example.org/list/"), mid, F.lit("/T/")))
        .when(n % 6 == 2, F.concat(F.lit("id:"), mid))
        .when(n % 6 == 3, F.concat(F.lit("maildir:/m/"), n.cast("string")))
        .when(n % 6 == 4, F.concat(F.lit("blob:abcdef"), n.cast("string"), F.lit("0")))
        .otherwise(F.lit("nothing here"))
    )
    a = views.arrivals(spark, d).select("num", text.alias("input"))
    return lookup.selections(a).select("num", "kind", "value", F.col("threads").cast("int").alias("threads"))


@query("reply_recipients", """
    SELECT num, role || (conv_id % 5) || '@Example.org' AS reply_to,
      CASE WHEN turn > 0 THEN 'crew' || (turn % 3) || '@example.net,' ELSE '' END || inbox || '@lists.example.org'
      || CASE WHEN turn > 0 THEN ',solo@example.com' ELSE '' END AS reply_cc FROM conv_msgs""", "conv_msgs")
def reply_recipients(spark, d):
    m = lookup.reply_recipients(views.conv_msgs(spark, d), F.lit(":all"), F.col("to"))
    return m.select("num", "reply_to", F.array_join("reply_cc", ",").alias("reply_cc"))


@query("inspected", """
    SELECT docid, mid, bytes, CAST(1 AS BIGINT) AS copies FROM doc_posts WHERE mid = 'd7@z'""", "doc_posts")
def inspected(spark, d):
    p = views.doc_posts(spark, d)
    x = p.select("docid", "inbox", F.col("num").alias("xnum"))
    out = lookup.inspect(p, x, views.annotations(spark, d), mid="d7@z")
    j = F.from_json("json", "mid string, bytes bigint, copies bigint")
    return out.select("docid", j["mid"].alias("mid"), j["bytes"].alias("bytes"), j["copies"].alias("copies"))


@query("inspected_copies", """
    SELECT docid, mid, bytes, CAST(1 AS BIGINT) AS copies, named FROM (SELECT docid, mid, bytes, 'blob' AS named FROM doc_posts WHERE oid =
      (SELECT oid FROM doc_posts WHERE num = 9) UNION ALL SELECT docid, mid, bytes, 'number' FROM doc_posts WHERE num = 12
      AND inbox = (SELECT inbox FROM doc_posts WHERE num = 12) UNION ALL SELECT docid, mid, bytes, 'folder' FROM doc_posts WHERE lang = 'de')""", "doc_posts")
def inspected_copies(spark, d):
    """The same record found by blob, by inbox and number, and by folder."""
    p = views.doc_posts(spark, d)
    x = p.select("docid", "inbox", F.col("num").alias("xnum"), "oid")
    a = views.annotations(spark, d)
    ninth, twelfth = (p.where(F.col("num") == n).select("oid", "inbox").first() for n in (9, 12))
    folders = p.select("oid", F.col("lang").alias("folder")).distinct()
    found = {
        "blob": lookup.inspect(p, x, a, oid=ninth.oid), "number": lookup.inspect(p, x, a, inbox=twelfth.inbox, num=12),
        "folder": lookup.inspect(p, x, a, folder="de", locations=folders),
    }
    j = F.from_json("json", "mid string, bytes bigint, copies bigint")
    parts = [
        df.select("docid", j["mid"].alias("mid"), j["bytes"].alias("bytes"), j["copies"].alias("copies"), F.lit(n).alias("named"))
        for n, df in found.items()
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query("parents_found", """
    SELECT num, parent AS parent_mid, CASE WHEN parent IN (SELECT mid FROM gap_msgs) THEN 1 ELSE 0 END AS found
    FROM gap_msgs WHERE parent IS NOT NULL""", "gap_msgs")
def parents_found(spark, d):
    m = views.gap_msgs(spark, d)
    return lookup.parents_found(m, m.select("mid")).select("num", "parent_mid", F.col("found").cast("int").alias("found"))


@query("delivery_checks", """
    SELECT num AS seq, CASE WHEN conv_id % 7 <> 3 THEN CASE WHEN subject = '' THEN 'subject,recipient' ELSE 'recipient' END
      ELSE CASE WHEN subject = '' THEN 'subject' ELSE '' END END AS reasons FROM conv_msgs""", "conv_msgs")
def delivery_checks(spark, d):
    out = decode(views.raw_mail(spark, d))
    r = policy.delivery_reasons(F.col("headers"), F.col("raw"), ["list3+tag@lists.example.org"])
    return out.select("seq", F.array_join(r, ",").alias("reasons"))


@query("content_policy", """
    SELECT num AS seq, CASE WHEN num % 2 = 0 THEN 'no HTML|suffixes: exe' ELSE '' END AS reasons FROM conv_msgs""", "conv_msgs")
def content_policy(spark, d):
    out = decode(views.raw_mail(spark, d))
    parts = F.transform("parts", lambda p: p.withField(
        "content_type", F.when(F.col("seq") % 2 == 0, "text/html; charset=x").otherwise(p["content_type"])).withField(
        "filename", F.when(F.col("seq") % 2 == 0, "Run.EXE").otherwise(p["filename"])))
    return out.select("seq", F.array_join(policy.content_reasons(parts), "|").alias("reasons"))


@query("watch_rules", """
    SELECT num AS seq, CASE WHEN turn % 2 = 0 OR conv_id % 7 = 2 THEN 1 ELSE 0 END AS watched,
      CASE WHEN conv_id % 7 = 4 THEN 1 ELSE 0 END AS listed FROM conv_msgs""", "conv_msgs")
def watch_rules(spark, d):
    h = F.col("headers")
    return decode(views.raw_mail(spark, d)).select(
        "seq", policy.watched(h, [("Status", "^R"), ("To", "^list2@")]).cast("int").alias("watched"),
        policy.watched_lists(h, ["list4.lists.example.org"]).cast("int").alias("listed"),
    )


@query("mirror_checks", """
    SELECT num AS seq, CASE WHEN conv_id % 7 = 1 THEN 'received from another host,list address not named' ELSE '' END AS reasons
    FROM conv_msgs""", "conv_msgs")
def mirror_checks(spark, d):
    rules = [
        ("List-Id", "<list1.Lists.example.org>", "*.kernel.org", "other@lists.example.org"),
        ("List-Id", "<list2.Lists.example.org>", "*.example.net;", "list2@lists.example.org"),
    ]
    r = policy.mirror_reasons(F.col("headers"), rules)
    return decode(views.raw_mail(spark, d)).select("seq", F.array_join(r, ",").alias("reasons"))


@query("filtered_by_inbox", """
    SELECT num AS seq, CASE WHEN inbox = 'list1' THEN 'ignore' ELSE 'accept' END AS verdict FROM conv_msgs""", "conv_msgs")
def filtered_by_inbox(spark, d):
    policy.register_filter("drop", lambda df: df.withColumn("verdict", F.lit("ignore")).withColumn("reason", F.lit("by rule")))
    out = decode(views.raw_mail(spark, d))
    return policy.apply_filters(out, {"list1": "drop", "list2": "content"}).select("seq", "verdict")


@query("message_differences", """
    WITH m AS (SELECT r.conv_id, r.turn, r.num, r."from", r.subject, r.ds, r.cc, len(r.refs) AS n_refs,
        regexp_replace(b.body, '\\s+$', '') AS body FROM conv_msgs r JOIN bodies b ON b.conv_id = r.conv_id AND b.turn = r.turn),
      p AS (SELECT x.num AS docid, unnest([
        CASE WHEN x."from" <> y."from" THEN 'from' END, CASE WHEN x.subject <> y.subject THEN 'subject' END,
        CASE WHEN x.ds <> y.ds THEN 'date' END, CASE WHEN x.cc IS NOT NULL THEN 'cc' END,
        CASE WHEN x.n_refs > 0 THEN 'ref' END, CASE WHEN x.body <> y.body THEN 'part 1' END]) AS component
      FROM m x JOIN m y ON x.conv_id = y.conv_id AND y.turn = 0 WHERE x.turn > 0)
    SELECT docid, component, 'changed' AS difference FROM p WHERE component IS NOT NULL""", "conv_msgs bodies")
def message_differences(spark, d):
    out = decode(views.raw_mail(spark, d)).select(
        F.col("conv_id").alias("group"), "turn", F.col("seq").alias("docid"),
        F.explode(hashing.hash_inputs(F.col("headers"), F.col("parts"))).alias("c"),
    ).select("group", "turn", "docid", "c.component", F.sha2("c.value", 256).alias("value"))
    report = dedupe.difference_report(out.where("turn > 0"), out.where("turn = 0"))
    return report.select("docid", "component", "difference")
