"""Queries: patch edges, lineage, similar patches, diffstat."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from archivelake.functions import diffs, ids
from archivelake.operators import patches
from archivelake.operators import postings as post
from archivelake.operators import predicates as p
from archivelake.plans.registry import query
from archivelake.session import short_batches
from archivelake.sources import views


@query("patch_edges", """
    SELECT docid, pre, post, 'src/file' || hist || '.txt' AS path_b FROM patch_mail""", "patch_mail")
def patch_edges(spark, d):
    return patches.patch_edges(views.patch_mail(spark, d)).select("docid", "pre", "post", "path_b")


@query("diffstat_files", "SELECT docid, 'src/file' || hist || '.txt' AS path, 2 AS changed FROM patch_mail", "patch_mail")
def diffstat_files(spark, d):
    return patches.changed_files(views.patch_mail(spark, d))


@query("patch_lineage", """
    SELECT w.post AS want, w.v - m.v AS step, m.docid FROM (SELECT hist, max(v) AS v, max_by(post, v) AS post FROM patch_mail GROUP BY hist) w
    JOIN patch_mail m USING (hist)""", "patch_mail")
def patch_lineage(spark, d):
    mail = views.patch_mail(spark, d)
    newest = mail.groupBy("hist").agg(F.max_by("post", "v").alias("oid"))
    return patches.lineage(patches.patch_edges(mail), newest).select("want", "step", "docid")


@query("patch_lineage_to_known", """
    SELECT w.post AS want, w.v - m.v AS step, m.docid FROM (SELECT hist, max(v) AS v, max_by(post, v) AS post FROM patch_mail GROUP BY hist) w
    JOIN patch_mail m USING (hist) WHERE m.v > 2""", "patch_mail")
def patch_lineage_to_known(spark, d):
    mail = views.patch_mail(spark, d)
    newest = mail.groupBy("hist").agg(F.max_by("post", "v").alias("oid"))
    known = mail.where("v = 2").select(F.col("post").alias("oid"))
    return patches.lineage(patches.patch_edges(mail), newest, known).select("want", "step", "docid")


@query("similar_patches", """
    SELECT docid, 1 + CASE WHEN hist = 0 THEN 1 ELSE 0 END AS shared FROM patch_mail WHERE docid <> 41""", "patch_mail")
def similar_patches(spark, d):
    return patches.similar_patches(patches.patch_terms(views.patch_mail(spark, d)), 41, want=["dfn", "dfctx", "dfpre", "dfpost"])


@query("patch_successors", """
    SELECT docid, 1 AS shared FROM patch_mail WHERE pre = (SELECT post FROM patch_mail WHERE docid = 41)""", "patch_mail")
def patch_successors(spark, d):
    edges = patches.patch_edges(views.patch_mail(spark, d))
    probe = edges.where("docid = 41").select(F.lit(0).cast("bigint").alias("docid"), F.lit("b").alias("field"), F.col("post").alias("term"))
    features = edges.select("docid", F.lit("b").alias("field"), F.col("pre").alias("term")).distinct().union(probe)
    return patches.similar_patches(features, 0, want=["b"])


@query("patch_groups", """
    SELECT count(*) AS n, min(docid) AS first_docid FROM (SELECT docid, hist || '|' || v || '|' || regexp_replace(text, '[ \\t\\r]+', '', 'g')
      AS k FROM patch_mail UNION ALL SELECT docid + 1000000, hist || '|' || v || '|' || regexp_replace(text, '[ \\t\\r]+', '', 'g')
      FROM patch_mail WHERE docid % 3 = 0) GROUP BY k""", "patch_mail")
def patch_groups(spark, d):
    mail = views.patch_mail(spark, d).select("docid", "body")
    again = mail.where("docid % 3 = 0").select(
        F.col("docid") + 1_000_000,
        F.regexp_replace(F.regexp_replace("body", "@@ -1,2", "@@ -7,2"), "\n\\+", "\n+  ").alias("body"),
    )
    return patches.by_patch_key(mail.union(again)).select("n", "first_docid")


@query("blob_prefixes", """
    SELECT DISTINCT docid, substr(b, 1, n) AS prefix FROM (SELECT docid, unnest([pre, post]) AS b FROM patch_mail)
    CROSS JOIN (SELECT unnest([7, 8, 9, 10]) AS n)""", "patch_mail")
def blob_prefixes(spark, d):
    return patches.blob_prefixes(patches.patch_edges(views.patch_mail(spark, d)))


@query("blob_search", """
    SELECT docid FROM patch_mail WHERE pre = (SELECT post FROM patch_mail WHERE docid = 41)
      OR post = (SELECT post FROM patch_mail WHERE docid = 41)""", "patch_mail")
def blob_search(spark, d):
    mail = views.patch_mail(spark, d)
    edges = patches.patch_edges(mail)
    index = post.exact_terms(edges, "dfpre", F.array("pre"), 7).union(post.exact_terms(edges, "dfpost", F.array("post"), 7))
    # sha1("0:2") cut to seven digits: the blob the patch of docid 41 makes.
    oid = hashlib.sha1(b"0:2").hexdigest()[:7]
    return p.search(index, mail, p.Term(oid, "dfblob")).select("docid")


@query("diff_search", """
    SELECT docid FROM patch_mail WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 'with')
      AND hist = 3""", "patch_mail")
def diff_search(spark, d):
    mail = views.patch_mail(spark, d)
    index = post.build_postings(post.text_fields(mail.select("docid", "body")))
    return p.search(index, mail, p.Term("with", "dfb") & p.Phrase(("file3", "txt"), "dfn")).select("docid")


@query("old_style_paths", """
    SELECT docid, 'src/file' || hist || '.txt' AS shared FROM patch_mail""", "patch_mail")
def old_style_paths(spark, d):
    name = F.concat(F.lit("src/file"), F.col("hist").cast("string"), F.lit(".txt"))
    body = F.concat(F.lit("diff -u old/"), name, F.lit(" new/"), name, F.lit("\n ctx"))
    short_batches(spark)
    lines = views.patch_mail(spark, d).select("docid", F.explode(diffs.diff_lines(body)).alias("l"))
    return lines.where("l.kind = 'file'").select("docid", F.col("l.value").alias("shared"))


@query("long_id_words", """
    SELECT num, 'archive' || kind || 'longword' AS first_word, 3 AS n FROM arrivals""", "arrivals")
def long_id_words(spark, d):
    mid = F.concat(F.lit("archive"), "kind", F.lit("longword.abc.de."), F.lit("xyz@z"))
    words = ids.id_words(mid)
    return views.arrivals(spark, d).select("num", words[0].alias("first_word"), F.size(words).alias("n"))
