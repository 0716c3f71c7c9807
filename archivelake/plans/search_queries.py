"""Queries: term index, searches, ranking, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivelake.functions.stem import with_stems
from archivelake.operators import postings as post
from archivelake.operators import predicates as p
from archivelake.operators import rank, term_store
from archivelake.plans.registry import query
from archivelake.session import work_folder
from archivelake.sources import views


def _docs(spark, d):
    return views.doc_posts(spark, d)


def _index(spark, d, positions=True, whole=False):
    """Body postings of every document."""
    return post.build_postings(post.text_fields(_docs(spark, d).select("docid", "body")), positions, whole)


_HAS = "docid IN (SELECT docid FROM tokens WHERE term = '{}')"


@query("postings_index", """
    SELECT docid, 'nonquoted' AS field, term, count(*) AS wdf, min(pos) AS first_pos, max(pos) AS last_pos FROM tokens
    GROUP BY docid, term""", "tokens")
def postings_index(spark, d):
    return _index(spark, d, whole=True).select(
        "docid", "field", "term", "wdf", F.col("positions")[0].alias("first_pos"),
        F.element_at("positions", -1).alias("last_pos"),
    )


@query("document_frequencies", """
    SELECT 'nonquoted' AS field, term, count(DISTINCT docid) AS df, count(*) AS wdf FROM tokens GROUP BY term""", "tokens")
def document_frequencies(spark, d):
    return post.document_frequency(_index(spark, d, positions=False))


@query("terms_of_document", """
    SELECT 'nonquoted' AS field, count(DISTINCT term) AS n, min(term) AS first_term FROM tokens WHERE docid = 8""", "tokens")
def terms_of_document(spark, d):
    t = post.terms_of(_index(spark, d, positions=False), 8)
    return t.select("field", F.size("terms").alias("n"), F.array_min("terms").alias("first_term"))


@query("subject_terms", """
    SELECT DISTINCT unnest(regexp_extract_all(lower(subject), '[\\p{L}\\p{N}_]+')) AS term FROM doc_posts""", "doc_posts")
def subject_terms(spark, d):
    fields = post.text_fields(_docs(spark, d).select("docid", "subject"))
    return post.distinct_terms(post.build_postings(fields, False), "subject")


@query("term_search", f"SELECT docid FROM doc_posts WHERE {_HAS.format('with')}", "tokens")
def term_search(spark, d):
    return p.search(_index(spark, d), _docs(spark, d), p.Term("with")).select("docid")


@query("boolean_search", f"""SELECT docid FROM doc_posts WHERE {_HAS.format('that')} AND NOT {_HAS.format('with')}
    AND ({_HAS.format('for')} OR {_HAS.format('this')})""", "tokens")
def boolean_search(spark, d):
    expr = p.Term("that", "b") & ~p.Term("with", "b") & (p.Term("for", "nq") | p.Term("this", "nq"))
    return p.search(_index(spark, d), _docs(spark, d), expr).select("docid")


@query("negative_search", f"SELECT docid FROM doc_posts WHERE NOT {_HAS.format('the')} AND bytes >= 200", "tokens")
def negative_search(spark, d):
    expr = ~p.Term("the") & p.between("bytes", 200)
    return p.search(_index(spark, d), _docs(spark, d), expr).select("docid")


@query("phrase_search", """
    SELECT DISTINCT a.docid FROM tokens a JOIN tokens b ON a.docid = b.docid AND b.pos = a.pos + 1
    WHERE a.term = 'of' AND b.term = 'the'""", "tokens")
def phrase_search(spark, d):
    return p.search(_index(spark, d), _docs(spark, d), p.Phrase(("of", "the"))).select("docid")


@query("stem_search", """
    SELECT DISTINCT docid FROM tokens WHERE term = 'is'""", "tokens")
def stem_search(spark, d):
    """`is` shares its stem with no other word, so SQL can name the matches."""
    return p.search(with_stems(_index(spark, d, False), ["is"]), _docs(spark, d), p.Stem("is")).select("docid")


@query("prefix_search", "SELECT DISTINCT docid FROM tokens WHERE starts_with(term, 'eneinheit')", "tokens")
def prefix_search(spark, d):
    return p.search(_index(spark, d), _docs(spark, d), p.Prefix("eneinheit")).select("docid")


@query("field_search", f"""
    SELECT docid FROM doc_posts WHERE list_contains(regexp_extract_all(lower(subject), '[\\p{{L}}\\p{{N}}_]+'), 'the')
      AND ds BETWEEN 1700000000 AND 1700006000""", "doc_posts")
def field_search(spark, d):
    docs = _docs(spark, d)
    index = post.build_postings(post.text_fields(docs.select("docid", "subject", "from", "to")))
    expr = p.Term("the", "s") & p.between("ds", 1_700_000_000, 1_700_006_000)
    return p.search(index, docs, expr).select("docid")


@query("address_search", "SELECT docid FROM doc_posts WHERE inbox = 'src4' AND lang = 'fr'", "doc_posts")
def address_search(spark, d):
    docs = _docs(spark, d)
    index = post.build_postings(post.text_fields(docs.select("docid", "from", "to")))
    expr = p.Term("src4", "tcf") & p.Term("fr", "f") & p.Phrase(("src4", "lists"), "t")
    return p.search(index, docs, expr).select("docid")


@query("exact_id_search", "SELECT docid FROM conv_msgs WHERE mid IN ('c3.0@z', 'c5.1@z')", "conv_msgs")
def exact_id_search(spark, d):
    m = views.conv_msgs(spark, d)
    index = post.exact_terms(m, "mid", F.col("mids"))
    return p.search(index, m, p.Term("c3.0@z", "mid") | p.Term("c5.1@z", "mid")).select("docid")


@query("keyword_tags", """
    SELECT docid FROM doc_posts JOIN annotations USING (docid) WHERE list_contains(kw, 'flagged') AND list_contains(labels, 'batch2')""",
       "doc_posts annotations")
def keyword_tags(spark, d):
    docs = _docs(spark, d).join(views.annotations(spark, d), "docid", "left")
    return p.search(docs, docs, p.keyword("flagged") & p.label("batch2")).select("docid")


@query("inbox_restricted_search", f"""
    SELECT DISTINCT x.docid FROM xposts x WHERE x.inbox = 'src2' AND xnum <= 900 AND {_HAS.format('that').replace('docid IN', 'x.docid IN')}""",
       "xposts tokens")
def inbox_restricted_search(spark, d):
    hits = p.search(_index(spark, d, False), _docs(spark, d), p.Term("that"))
    return p.in_inbox(hits, views.xposts(spark, d), "src2", high=900).select("docid")


@query("altid_search", "SELECT docid FROM doc_posts WHERE num % 1000 = 77", "doc_posts")
def altid_search(spark, d):
    docs = _docs(spark, d)
    altid = docs.select(F.lit("gm").alias("prefix"), (F.col("num") % 1000).alias("num"), "mid")
    index = post.altid_terms(docs.select("docid", "mid"), altid)
    by_index = p.search(index, docs, p.Term("77", "gm")).select("docid")
    return by_index.join(p.by_altid(docs, altid, "gm", 77).select("docid"), "docid", "left_semi")


_BM25 = """
    len AS (SELECT docid, count(*) AS doclen FROM tokens GROUP BY docid),
    c AS (SELECT count(*) AS n, avg(doclen) AS a FROM len),
    w AS (SELECT docid, term, count(*) AS wdf FROM tokens WHERE term IN ('that', 'with', 'for') GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM w GROUP BY term),
    s AS (SELECT docid, CAST(sum(CAST(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (wdf * 2.2) / (wdf + 1.2 * (0.25 + 0.75 * doclen / a))
      * 1000000) AS BIGINT)) AS BIGINT) AS score FROM w JOIN f USING (term) JOIN len USING (docid) CROSS JOIN c GROUP BY docid)"""
_WORDS = ["that", "with", "for"]


def _scored(spark, d):
    fields = post.text_fields(_docs(spark, d).select("docid", "body"))
    return rank.bm25(post.build_postings(fields, False), _WORDS, lengths=post.field_lengths(fields))


@query("relevance_scores", f"""WITH {_BM25} SELECT docid, score, least(99, floor(100 * score / (SELECT max(score) FROM s)))::INT AS pct FROM s""", "tokens")
def relevance_scores(spark, d):
    return rank.percent(_scored(spark, d)).select("docid", "score", "pct")


@query("relevance_topk", f"""WITH {_BM25} SELECT docid, score FROM s JOIN doc_posts USING (docid) ORDER BY score DESC, ts DESC, docid LIMIT 200""", "tokens")
def relevance_topk(spark, d):
    scored = _scored(spark, d).join(_docs(spark, d).select("docid", "ts"), "docid")
    return rank.page(scored, rank.sort_order(1), limit=200).select("docid", "score")


def _stored_index(spark, d):
    """Bodies of all documents indexed in two batches."""
    path = work_folder(spark, "terms")
    docs = _docs(spark, d).select("docid", "body")
    for batch in range(2):
        term_store.add_documents(post.text_fields(docs.where(F.col("docid") % 2 == batch)), path, batch)
    return path


@query("stored_index_topk", f"""WITH {_BM25} SELECT docid, score FROM s JOIN doc_posts USING (docid) ORDER BY score DESC, ts DESC, docid LIMIT 200""", "tokens")
def stored_index_topk(spark, d):
    """The best hits by a stored index to which documents were added in two batches."""
    scored = term_store.scores(spark, _stored_index(spark, d), _WORDS)
    hits = scored.join(_docs(spark, d).select("docid", "ts"), "docid")
    return rank.page(hits, rank.sort_order(1), limit=200).select("docid", "score")


@query("stored_index_search", f"""
    SELECT docid FROM doc_posts WHERE {_HAS.format('with')} AND NOT ({_HAS.format('that')})""", "tokens")
def stored_index_search(spark, d):
    found = term_store.search(spark, _stored_index(spark, d), _docs(spark, d), p.Term("with") & ~p.Term("that"))
    return found.select("docid")


@query("stored_prefix_search", "SELECT DISTINCT docid FROM tokens WHERE starts_with(term, 't') AND NOT starts_with(term, 'th')", "tokens")
def stored_prefix_search(spark, d):
    """Words that begin with t; those that begin with th are taken off by a second wildcard search."""
    path, docs = _stored_index(spark, d), _docs(spark, d)
    words = term_store.words_with_prefix(spark, path, "t").where(~F.col("term").startswith("th"))
    postings = term_store.read_postings(spark, path, prefixes=["t"])
    return postings.join(words, "term", "left_semi").select("docid").distinct().join(docs.select("docid"), "docid")


@query("stored_wildcard_search", "SELECT DISTINCT docid FROM tokens WHERE starts_with(term, 'th') AND docid NOT IN (SELECT docid FROM tokens WHERE starts_with(term, 'en'))", "tokens")
def stored_wildcard_search(spark, d):
    """Over a thousand words begin with th."""
    found = term_store.search(spark, _stored_index(spark, d), _docs(spark, d), p.Prefix("th") & ~p.Prefix("en"))
    return found.select("docid")


@query("stored_frequencies", """
    SELECT 'nonquoted' AS field, term, count(DISTINCT docid) AS df, count(*) AS wdf FROM tokens GROUP BY term""", "tokens")
def stored_frequencies(spark, d):
    return term_store.frequencies(spark, _stored_index(spark, d))


@query("newest_hits_page", f"""WITH {_BM25} SELECT docid, score, ts FROM s JOIN doc_posts USING (docid) ORDER BY ts DESC, score DESC, docid LIMIT 50 OFFSET 25""", "tokens")
def newest_hits_page(spark, d):
    scored = _scored(spark, d).join(_docs(spark, d).select("docid", "ts"), "docid")
    return rank.page(scored, rank.sort_order(0), limit=50, offset=25).select("docid", "score", "ts")


@query("hits_by_docid", "SELECT DISTINCT docid FROM tokens WHERE term = 'for' ORDER BY docid DESC LIMIT 50", "tokens")
def hits_by_docid(spark, d):
    hits = p.search(_index(spark, d, False), _docs(spark, d), p.Term("for"))
    return rank.page(hits, rank.sort_order(-2), limit=50).select("docid")


@query("match_counts", "SELECT count(DISTINCT docid) AS matches FROM tokens WHERE term = 'for'", "tokens")
def match_counts(spark, d):
    return rank.estimated_matches(p.search(_index(spark, d, False), _docs(spark, d), p.Term("for")))


@query("percent_bounds", f"""WITH {_BM25} SELECT min(p) AS min_pct, max(p) AS max_pct FROM (SELECT
    least(99, floor(100 * score / (SELECT max(score) FROM s)))::INT AS p FROM s)""", "tokens")
def percent_bounds(spark, d):
    return rank.percent_bounds(rank.percent(_scored(spark, d)))


@query("source_union_search", """
    SELECT 'docs' AS origin, docid FROM doc_posts WHERE docid IN (SELECT docid FROM tokens WHERE term = 'that') UNION ALL
    SELECT 'conversations', docid FROM conv_msgs WHERE list_contains(regexp_extract_all(lower(body), '[\\p{L}\\p{N}_]+'), 'that')""",
       "tokens conv_msgs")
def source_union_search(spark, d):
    def one(name, docs):
        index = post.build_postings(post.text_fields(docs.select("docid", "body")), False)
        return p.search(index, docs, p.Term("that")).select(F.lit(name).alias("origin"), "docid")

    return one("docs", _docs(spark, d)).union(one("conversations", views.conv_msgs(spark, d)))


@query("quoted_text_search", """
    SELECT conv_id, turn FROM bodies WHERE quoted IS NOT NULL AND
      list_contains(regexp_extract_all(lower(quoted), '[\\p{L}\\p{N}_]+'), 'that')""", "bodies")
def quoted_text_search(spark, d):
    b = views.quoted_bodies(spark, d).withColumn("docid", F.col("conv_id") * 1_000_000 + F.col("turn"))
    index = post.build_postings(post.text_fields(b.select("docid", "body")), False)
    return p.search(index, b, p.Term("that", "q")).select("conv_id", "turn")


@query("probe_passages", """
    WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term,
        generate_subscripts(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 1) AS i FROM benchmark),
      probe AS (SELECT item_id, term, i FROM t), n AS (SELECT item_id, count(*) AS n FROM probe GROUP BY item_id)
    SELECT item_id, docid FROM (SELECT p.item_id, k.docid, k.pos - p.i AS start, count(*) AS votes FROM probe p JOIN tokens k
      ON k.term = p.term GROUP BY ALL) JOIN n USING (item_id) WHERE votes = n.n GROUP BY ALL""", "tokens")
def probe_passages(spark, d):
    """Documents that hold a whole benchmark passage, as phrases looked up together.

    A passage is found through its rarest word and then checked in full, so
    common words never meet each other.
    """
    from archivelake.functions import text

    docs = _docs(spark, d).select("docid", "body")
    tokens = text.words(F.col("body"))
    probe = views.table(spark, d, "benchmark").select(
        "item_id", F.array_join(text.words(F.col("text")), " ").alias("phrase")
    ).where("phrase <> ''")
    words = probe.select("item_id", "phrase", F.explode(F.split("phrase", " ")).alias("term")).distinct()
    wanted = words.select("term").distinct()
    # Only words of passages are counted.
    seen = docs.select("docid", F.explode(F.array_distinct(tokens)).alias("term")).join(wanted, "term", "left_semi")
    df = seen.groupBy("term").agg(F.count("*").alias("df"))
    rarest = (
        words.join(wanted.join(df, "term", "left"), "term")
        .groupBy("item_id").agg(F.min_by(F.struct("term", "phrase"), F.struct(F.coalesce("df", F.lit(0)), "term")).alias("r"))
        .select("item_id", "r.term", "r.phrase")
    )
    line = docs.select("docid", F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).alias("line"))
    near = seen.join(rarest, "term").select("docid", "item_id", "phrase")
    return near.join(line, "docid").where(
        F.contains("line", F.concat(F.lit(" "), "phrase", F.lit(" ")))
    ).select("item_id", "docid")
