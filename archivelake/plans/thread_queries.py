"""Queries: thread ids, forests, topics, thread expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivelake.functions import subjects
from archivelake.operators import forest, rank, threads, topics
from archivelake.plans.registry import query
from archivelake.session import durable
from archivelake.sources import views

# All messages of a conversation are connected unless three turns in a row are
# missing; SQL finds the components by walking the shared ids.
_TID = """
    links AS (SELECT DISTINCT docid, unnest(list_append(refs, mid)) AS id FROM conv_msgs),
    reach AS (SELECT docid AS a, docid AS b FROM conv_msgs
      UNION SELECT reach.a, l2.docid FROM reach JOIN links l1 ON l1.docid = reach.b JOIN links l2 ON l2.id = l1.id),
    tids AS (SELECT a AS docid, min(b) AS tid FROM reach GROUP BY a)"""
_WITH_TID = f"WITH RECURSIVE {_TID}"

# Parents as the last reference, found or not; ghosts hang from the reference
# before them in the first message that names them.
_NODES = f"""{_TID},
    named AS (SELECT m.docid, m.ds, r.i, m.refs[r.i] AS id, CASE WHEN r.i > 1 THEN m.refs[r.i - 1] END AS before_id
      FROM conv_msgs m, LATERAL (SELECT unnest(range(1, len(m.refs) + 1)) AS i) r),
    ghost AS (SELECT id AS node, min_by(before_id, (ds, docid, i)) FILTER (before_id IS NOT NULL) AS parent FROM named
      WHERE id NOT IN (SELECT mid FROM conv_msgs) GROUP BY id),
    real_nodes AS (SELECT mid AS node, CASE WHEN len(refs) > 0 THEN refs[-1] END AS parent, docid, ds FROM conv_msgs),
    nodes AS (SELECT node, parent, docid, ds FROM real_nodes UNION ALL SELECT node, parent, NULL, NULL FROM ghost),
    down AS (SELECT node AS top, node, ds FROM nodes UNION ALL SELECT down.top, n.node, n.ds FROM down JOIN nodes n ON n.parent = down.node),
    keyed AS (SELECT n.node, n.parent, n.docid, n.ds, coalesce(n.ds, k.low) AS key FROM nodes n
      LEFT JOIN (SELECT top, min(ds) AS low FROM down GROUP BY top) k ON k.top = n.node),
    placed AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY key, docid NULLS FIRST, node) AS place FROM keyed),
    walk AS (SELECT node, parent, docid, ds, key, node AS root, 0 AS depth, CAST([] AS BIGINT[]) AS path FROM placed WHERE parent IS NULL
      UNION ALL SELECT p.node, p.parent, p.docid, p.ds, p.key, w.root, w.depth + 1, list_append(w.path, p.place) FROM placed p
      JOIN walk w ON p.parent = w.node),
    walked AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS position FROM walk)"""
_WALK = f"WITH RECURSIVE {_NODES}"

_NORM = "regexp_replace(regexp_replace(regexp_replace(subject, '\\s+', ' ', 'g'), '\\.+$', ''), '^Re: ', '')"
_SHOWN = f"CASE WHEN {_NORM} = '' THEN '(no subject)' ELSE {_NORM} END"


def _threaded(spark, d, gaps=False):
    m = views.gap_msgs(spark, d) if gaps else views.conv_msgs(spark, d)
    return threads.assign_threads(m).withColumn("sid", subjects.subject_key(F.col("subject")))


def _gaps(sql):
    """The SQL over messages of which some are missing."""
    return sql.replace("conv_msgs", "gap_msgs")


def _walked(spark, d, gaps=False):
    m = durable(_threaded(spark, d, gaps))
    return m, forest.preorder(forest.parents(m))


@query("thread_ids", _gaps(f"{_WITH_TID} SELECT docid, tid FROM tids"), "gap_msgs")
def thread_ids(spark, d):
    return _threaded(spark, d, gaps=True).select("docid", "tid")


@query("thread_ghosts", _gaps(f"""{_WITH_TID} SELECT id AS mid, min(tid) AS tid FROM links JOIN tids USING (docid)
    WHERE id NOT IN (SELECT mid FROM conv_msgs) GROUP BY id"""), "gap_msgs")
def thread_ghosts(spark, d):
    return threads.ghosts(_threaded(spark, d, gaps=True))


@query("thread_merge", _gaps(f"{_WITH_TID} SELECT docid, tid FROM tids"), "gap_msgs")
def thread_merge(spark, d):
    """Threads of the even turns, then the odd turns arrive and join them."""
    m = views.gap_msgs(spark, d)
    stored = durable(threads.assign_threads(m.where("turn % 2 = 0")))
    moved = threads.merge_threads(stored, m.where("turn % 2 = 1"))
    kept = stored.select("docid", "tid").join(moved.select("docid"), "docid", "left_anti")
    return kept.unionByName(moved)


@query("strict_thread", f"""{_WITH_TID} SELECT docid, ds FROM conv_msgs JOIN tids USING (docid)
    WHERE tid = (SELECT tid FROM tids JOIN conv_msgs USING (docid) WHERE mid = 'c9.0@z')""", "conv_msgs")
def strict_thread(spark, d):
    return threads.strict_thread(_threaded(spark, d), "c9.0@z").select("docid", "ds")


@query("loose_thread", f"""{_WITH_TID}, s AS (SELECT docid, tid, ds, {_NORM} AS norm, subject FROM conv_msgs JOIN tids USING (docid)),
    w AS (SELECT tid, norm FROM s WHERE docid = (SELECT min(docid) FROM conv_msgs WHERE mid = 'c9.0@z')),
    f AS (SELECT s.docid, s.ds, s.tid <> w.tid AS loose FROM s JOIN w ON s.tid = w.tid OR (s.norm = w.norm AND s.subject <> ''))
    SELECT docid, CAST(loose AS INT) AS loose, (SELECT count(*) FROM f) AS total FROM f""", "conv_msgs")
def loose_thread(spark, d):
    out = threads.loose_thread(_threaded(spark, d), "c9.0@z")
    return out.select("docid", F.col("loose").cast("int").alias("loose"), "total")


@query("thread_expansion", f"""{_WITH_TID}, h AS (SELECT docid FROM conv_msgs WHERE subject LIKE '%aside%')
    SELECT t.docid, CASE WHEN h.docid IS NULL THEN 0 ELSE 1 END AS is_hit FROM tids t LEFT JOIN h USING (docid)
    WHERE tid IN (SELECT tid FROM tids JOIN h USING (docid))""", "conv_msgs")
def thread_expansion(spark, d):
    t = durable(_threaded(spark, d))
    hits = t.where("subject like '%aside%'")
    return threads.expand_to_threads(hits, t).select("docid", F.col("is_hit").cast("int").alias("is_hit"))


@query("thread_collapse", f"""{_WITH_TID} SELECT docid, rank FROM (SELECT docid, bytes * 1000000000 + docid AS rank, tid, row_number() OVER
    (PARTITION BY tid ORDER BY bytes * 1000000000 + docid) AS rn FROM conv_msgs JOIN tids USING (docid)) WHERE rn = 1""", "conv_msgs")
def thread_collapse(spark, d):
    hits = _threaded(spark, d).withColumn("rank", F.col("bytes") * 1_000_000_000 + F.col("docid"))
    return rank.collapse_threads(hits).select("docid", "rank")


@query("thread_forest", _gaps(f"{_WALK} SELECT node, parent, root, depth, position FROM walked"), "gap_msgs")
def thread_forest(spark, d):
    return _walked(spark, d, gaps=True)[1].select("node", "parent", "root", "depth", "position")


@query("thread_skeleton", _gaps(f"""{_WALK} SELECT w.node, w.root, w.position, w.depth, CASE WHEN m.docid IS NULL THEN '[not found]'
    ELSE m.subject END AS subject FROM walked w LEFT JOIN conv_msgs m ON m.docid = w.docid"""), "gap_msgs")
def thread_skeleton(spark, d):
    m, w = _walked(spark, d, gaps=True)
    return forest.skeleton(forest.visible(w), m).select("node", "root", "position", "depth", "subject")


@query("thread_neighbours", _gaps(f"""{_WALK} SELECT w.node, (SELECT count(*) FROM nodes c WHERE c.parent = w.node) AS replies,
    CASE WHEN w.parent IS NULL THEN 0 ELSE (SELECT count(*) - 1 FROM nodes s WHERE s.parent = w.parent) END AS siblings,
    CASE WHEN w.parent IS NOT NULL THEN lag(w.node) OVER (PARTITION BY w.parent ORDER BY position) END AS prev_sibling,
    CASE WHEN w.parent IS NOT NULL THEN lead(w.node) OVER (PARTITION BY w.parent ORDER BY position) END AS next_sibling
    FROM walked w"""), "gap_msgs")
def thread_neighbours(spark, d):
    w = _walked(spark, d, gaps=True)[1]
    return forest.family_counts(w).select("node", "replies", "siblings", "prev_sibling", "next_sibling")


@query("thread_roots", _gaps(f"""{_WALK} SELECT root, key, CASE WHEN root = (SELECT root FROM walked WHERE node = 'c7.1@z') THEN 1 ELSE 0 END AS holds
    FROM walked WHERE node = root"""), "gap_msgs")
def thread_roots(spark, d):
    w = _walked(spark, d, gaps=True)[1]
    return forest.roots_for(w, "c7.1@z").select("root", "key", F.col("holds").cast("int").alias("holds"))


@query("recent_topics", f"""{_WALK}, r AS (SELECT w.root, w.position, w.ds, m.mid, {_SHOWN} AS subject FROM walked w
      JOIN conv_msgs m ON m.docid = w.docid),
    p AS (SELECT root, subject, min(position) AS first_at, max_by(mid, position) AS last_mid FROM r GROUP BY ALL)
    SELECT r.root, max(r.ds) AS latest, count(*) AS n, (SELECT min_by(p.subject, p.first_at) FROM p WHERE p.root = r.root) AS subject,
      (SELECT min_by(p.last_mid, p.first_at) FROM p WHERE p.root = r.root) AS mid FROM r GROUP BY r.root""", "conv_msgs")
def recent_topics(spark, d):
    m, w = _walked(spark, d)
    return topics.topics(w, m)[0].orderBy(F.desc("latest"), "root")


@query("topic_subjects", f"""{_WALK}, r AS (SELECT w.root, w.position, w.depth, m.mid, {_SHOWN} AS subject FROM walked w
      JOIN conv_msgs m ON m.docid = w.docid),
    p AS (SELECT root, subject, min(position) AS first_at, min_by(depth, position) AS level, max_by(mid, position) AS mid FROM r GROUP BY ALL)
    SELECT root, first_at, level, subject, mid FROM p WHERE first_at <> (SELECT min(q.first_at) FROM p q WHERE q.root = p.root)""", "conv_msgs")
def topic_subjects(spark, d):
    m, w = _walked(spark, d)
    return topics.topics(w, m)[1]


@query("window_topics", f"""{_WITH_TID}, x AS (SELECT m.*, tid FROM (SELECT * FROM conv_msgs ORDER BY ts DESC, docid DESC LIMIT 200) m
      JOIN tids USING (docid))
    SELECT tid, max(ds) AS latest, count(*) AS n, min_by({_SHOWN}, (ds, docid)) AS subject, max_by(mid, (ds, docid)) AS last_mid
    FROM x GROUP BY tid""", "conv_msgs")
def window_topics(spark, d):
    return topics.thread_topics(topics.recent(_threaded(spark, d), 200))
