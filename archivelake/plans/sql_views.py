"""The derived views of `sources.views`, written as SQL for the result checks."""

from __future__ import annotations

_PARENT = (
    "CASE WHEN {t} IS NULL OR {t} <= 0 THEN NULL WHEN c % 3 = 0 THEN {t} - 1 "
    "WHEN c % 3 = 1 THEN 0 ELSE ({t} - 1) // 2 END"
)

VIEWS = {
    "conv_a": "SELECT conv_id AS c, turn AS t, role, text, "
    + _PARENT.format(t="turn").replace("c %", "conv_id %")
    + " AS a1 FROM conversations",
    "conv_b": "SELECT *, " + _PARENT.format(t="a1") + " AS a2 FROM conv_a",
    "conv_c": "SELECT *, " + _PARENT.format(t="a2") + " AS a3 FROM conv_b",
    "conv_msgs": """
        SELECT c AS conv_id, t AS turn, role, 'list' || (c % 7) AS inbox,
          c * 1000000 + t + 1 AS num, c * 1000000 + t + 1 AS docid,
          'c' || c || '.' || t || '@z' AS mid,
          ['c' || c || '.' || x || '@z' FOR x IN [a3, a2, a1] IF x IS NOT NULL] AS refs,
          CASE WHEN a1 IS NOT NULL THEN 'c' || c || '.' || a1 || '@z' END AS parent,
          role || ' Person <' || role || (c % 5) || '@Example.org>' AS "from",
          'list' || (c % 7) || '@lists.example.org' AS "to",
          CASE WHEN t > 0 THEN '"Crew, Deck" <crew' || (t % 3)
            || '@example.net>, solo@example.com (Solo Sailor)' END AS cc,
          CASE WHEN c % 10 = 9 AND t % 4 = 2 THEN ''
            WHEN t = 0 THEN 'Topic ' || (c % 50) || '  for review'
            WHEN t % 4 = 3 THEN 'Re: Topic ' || (c % 50) || '  for review (was: aside).'
            ELSE 'Re: Topic ' || (c % 50) || '  for review' END AS subject,
          1700000000 + c * 3600 + t * 60 - CASE WHEN t % 5 = 4 THEN 150 ELSE 0 END AS ds,
          1700000000 + c * 3600 + t * 60 - CASE WHEN t % 5 = 4 THEN 150 ELSE 0 END
            + 7 + (t % 3) * 40 AS ts,
          strlen(text) AS bytes,
          length(text) - length(replace(text, chr(10), '')) AS lines, text AS body
        FROM conv_c""",
    "gap_msgs": "SELECT * FROM conv_msgs WHERE (conv_id * 31 + turn * 17) % 11 <> 5",
    "bodies": """
        SELECT a.conv_id, a.turn, a.text, b.text AS quoted,
          coalesce('> ' || replace(b.text, chr(10), chr(10) || '> ') || chr(10), '')
            || a.text || chr(10) AS body
        FROM conversations a LEFT JOIN conversations b
          ON a.conv_id = b.conv_id AND b.turn = a.turn - 1""",
    "raw_mail": """
        SELECT m.inbox, m.num AS seq, m.conv_id, m.turn, m.mid, m.ds, m.ts, b.body,
          'Received: from mx.example.net; ' || strftime(make_timestamp(m.ts * 1000000), '%a, %d %b %Y %H:%M:%S')
          || ' +0000' || chr(10) || 'From: ' || m."from" || chr(10) || 'To: ' || m."to" || chr(10)
          || coalesce('Cc: ' || m.cc || chr(10), '') || 'Subject: ' || m.subject || chr(10)
          || 'Date: ' || strftime(make_timestamp(m.ds * 1000000), '%a, %d %b %Y %H:%M:%S') || ' +0000' || chr(10)
          || 'Message-ID: <' || m.mid || '>' || chr(10)
          || CASE WHEN len(m.refs) > 0 THEN 'References: <' || array_to_string(m.refs, '> <') || '>' || chr(10)
             || 'In-Reply-To: <' || m.parent || '>' || chr(10) ELSE '' END
          || 'List-Id: <' || m.inbox || '.Lists.example.org>' || chr(10)
          || 'Status: ' || CASE WHEN m.turn % 2 = 0 THEN 'RO' ELSE 'O' END || chr(10)
          || CASE WHEN m.turn % 3 = 0 THEN 'X-Status: FA' || chr(10) ELSE '' END
          || 'Content-Type: text/plain; charset=utf-8' || chr(10)
          || 'Content-Transfer-Encoding: 8bit' || chr(10) || chr(10) || b.body AS raw
        FROM conv_msgs m JOIN bodies b ON m.conv_id = b.conv_id AND m.turn = b.turn""",
    "doc_posts": """
        SELECT source AS inbox, doc_id + 1 AS num, doc_id + 1 AS docid,
          'd' || doc_id || '@z' AS mid, split_part(text, chr(10), 1) AS subject,
          lang || '@' || source || '.example.org' AS "from",
          source || '@lists.example.org' AS "to",
          1700000000 + doc_id * 60 AS ds, 1700000000 + doc_id * 60 + 5 AS ts,
          strlen(text) AS bytes, sha256(text) AS content_hash,
          sha1(source || chr(10) || text) AS oid, text AS body, lang
        FROM documents""",
    "xposts": """
        SELECT min(num) OVER (PARTITION BY content_hash) AS docid, inbox, num AS xnum, oid,
          content_hash, ts FROM doc_posts""",
    "arrivals": """
        SELECT 'u' || user_id AS inbox, event_id + 1 AS num,
          CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(round(value * 100) AS BIGINT) AS bytes,
          event_type AS kind, 'e' || event_id || '@z' AS mid FROM events""",
    "changes": """
        SELECT 'list' || (user_id % 5) AS inbox, event_id AS seq,
          CASE WHEN event_type = 'error' THEN 'd' ELSE 'm' END AS op,
          CAST(floor(epoch(ts)) AS BIGINT) AS at, CAST(floor(epoch(ts)) AS BIGINT) AS ct,
          'b' || (event_id % 997) AS oid FROM events""",
    "annotations": """
        SELECT doc_id + 1 AS docid,
          [x FOR x IN [CASE WHEN quality = 1 THEN 'flagged' END,
            CASE WHEN toxic = 1 THEN 'junk' END] IF x IS NOT NULL] AS kw,
          [x FOR x IN [CASE WHEN quality = 1 THEN 'good' END, 'batch' || (doc_id % 4)]
            IF x IS NOT NULL] AS labels
        FROM labels""",
    "tokens": """
        SELECT docid, inbox, unnest(regexp_extract_all(lower(body), '[\\p{L}\\p{N}_]+')) AS term,
          generate_subscripts(regexp_extract_all(lower(body), '[\\p{L}\\p{N}_]+'), 1) - 1 AS pos
        FROM doc_posts""",
    "patch_mail": """
        SELECT doc_id + 1 AS docid, 1700000000 + doc_id * 60 AS ts, doc_id % 20 AS hist,
          doc_id // 20 AS v,
          CASE WHEN doc_id < 20 THEN '0000000000'
            ELSE substr(sha1((doc_id % 20) || ':' || (doc_id // 20 - 1)), 1, 10) END AS pre,
          substr(sha1((doc_id % 20) || ':' || (doc_id // 20)), 1, 10) AS post, text FROM documents""",
    "chain": """
        SELECT DISTINCT conv_id, mid, parent, docid, ds, turn FROM conv_msgs""",
}
DEPENDS = {
    "conv_b": ["conv_a"], "conv_c": ["conv_b"], "conv_msgs": ["conv_c"], "gap_msgs": ["conv_msgs"],
    "raw_mail": ["conv_msgs", "bodies"], "xposts": ["doc_posts"], "tokens": ["doc_posts"],
    "chain": ["conv_msgs"],
}


def with_views(sql: str, names: list[str]) -> str:
    """Prefix a statement with the views it names and those they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in DEPENDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return sql
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    text = sql.strip()
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {text[len('WITH RECURSIVE'):]}"
    if text.upper().startswith("WITH "):
        return f"WITH {head}, {text[len('WITH '):]}"
    return f"WITH {head} {text}"
