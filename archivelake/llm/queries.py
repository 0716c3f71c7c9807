"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivelake.llm import (
    bitpack, chat, langid, line_quality, merkle, minhash, mixing, packing, quality, repair, simhash, toxicity, url_lists,
)
from archivelake.llm.base import prepare, read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return function(spark, sf_dir)

        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens, one row per piece."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


@query("op10_packed_token_files")
def op10_packed_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to packed token files and read back, a row each."""
    manifest, folder = bitpack.encode_to_files(read_table(spark, sf_dir, "documents"))
    return bitpack.read_files(manifest, folder)


@query("op8_simhash_golay")
def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


@query("op3_hyperdimensional_language")
def op3_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("op4_toxic_spans_crf")
def op4_toxic_spans_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, with the offending spans."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.judge(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))


@query("op6_robust_quality_rules")
def op6_robust_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text counts, base rules and robust outlier verdict of every document."""
    return quality.judge(read_table(spark, sf_dir, "documents"))


@query("op7_minhash_fingerprints")
def op7_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    found = minhash.compare_with_next(read_table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.hex("fingerprint"))).withColumn(
        "edited_fingerprint", F.lower(F.hex("edited_fingerprint"))
    )


#: A conversation whose texts hold escape and control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


@query(
    "op2_chat_formatting",
    r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    ), placed AS (
        SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place,
            count(*) OVER (PARTITION BY conv_id) AS n
        FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
    ), judged AS (
        SELECT *, CASE
            WHEN before IS NULL THEN role IN ('system', 'user')
            WHEN before IN ('system', 'assistant') THEN role = 'user'
            WHEN before = 'user' THEN role = 'assistant'
            ELSE false END AND (place < n OR role = 'assistant') AS allowed
        FROM placed
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(4 + 2 + 8 + 2 * length(role || text) - length(regexp_replace(role || text, '[\\#:<]', '', 'g')))::BIGINT
            AS formatted_chars,
        bool_and(allowed) AS valid
    FROM judged GROUP BY conv_id
    """,
)
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and digests of what is read back from the output."""
    extra = spark.createDataFrame(
        [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = chat.read_back(chat.render(chat.segments(turns.unionByName(extra))))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join("loss_texts", "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


@query("op1_raked_mixing")
def op1_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling probability and draw of every document, raked to the target shares."""
    found = mixing.sample(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    names = ("source", "lang", "topic", "tokens", "probability", "sampled")
    return found.select("doc_id", *[F.col(f"mix_{n}").alias(n) for n in names])


def _url_list(pages: DataFrame, events: DataFrame) -> DataFrame:
    """A dated list from the tables: every event is an entry about a page.

    Pages are numbered densely in the order of their ids, and an event is about the page
    whose number is the event's id modulo the number of pages. So entries last as long as
    the events do, and an address is listed, taken off and listed again. Views and
    purchases list the page's host, clicks its address, sign-ups its domain; errors take
    its host off. Purchases expire after a day and sign-ups after six hours.
    """
    kind = F.when(F.col("event_type") == "click", "url").when(F.col("event_type") == "signup", "domain").otherwise("host")
    name = url_lists.host(F.col("url"))
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    dense = merkle.numbered(pages.select("page_id", "url").withColumn("all", F.lit(0)), "all", ["page_id", "url"])
    n = max(pages.count(), 1)
    met = events.select(F.pmod("event_id", F.lit(n)).alias("pos"), "event_type", "ts").join(dense.select("pos", "url"), "pos")
    return met.select(
        kind.alias("kind"),
        F.when(kind == "url", url_lists.address(F.col("url")))
        .when(kind == "domain", F.substring_index(name, ".", -2)).otherwise(name).alias("pattern"),
        at.alias("at"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"),
        F.when(F.col("event_type") == "purchase", at + 86400).when(F.col("event_type") == "signup", at + 21600).alias("expires"),
    )


@query(
    "op5_temporal_url_lists",
    r"""
    WITH parsed AS (
        SELECT page_id, url, 1704067200 + (page_id * 7919) % 2592000 AS fetched,
            row_number() OVER (ORDER BY page_id NULLS FIRST, url NULLS FIRST) - 1 AS number, count(*) OVER () AS n_pages,
            coalesce(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.$', '')), '') AS host,
            regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS rest
        FROM pages
    ), addressed AS (
        SELECT *, CASE WHEN host = '' THEN '' ELSE host || rest END AS address, string_split(host, '.') AS labels FROM parsed
    ), listed AS (
        SELECT DISTINCT
            CASE event_type WHEN 'click' THEN 'url' WHEN 'signup' THEN 'domain' ELSE 'host' END AS kind,
            CASE event_type WHEN 'click' THEN address WHEN 'signup' THEN array_to_string(labels[-2:], '.') ELSE host END AS pattern,
            floor(epoch(ts))::BIGINT AS since, (event_type = 'error')::INT AS off,
            CASE event_type WHEN 'purchase' THEN floor(epoch(ts))::BIGINT + 86400
                WHEN 'signup' THEN floor(epoch(ts))::BIGINT + 21600 END AS expires
        FROM events JOIN addressed ON number = (event_id % n_pages + n_pages) % n_pages
    ), chained AS (
        SELECT *, lead(since) OVER (PARTITION BY kind, pattern ORDER BY since, off, expires NULLS FIRST) AS next_at
        FROM listed WHERE pattern <> ''
    ), valid AS (
        SELECT kind, pattern, since AS valid_from,
            least(coalesce(next_at, 4611686018427387904), coalesce(expires, 4611686018427387904)) AS valid_to
        FROM chained WHERE off = 0
    ), tried AS (
        SELECT page_id, url, fetched, host, 1 AS rank, 'url' AS kind, address AS pattern FROM addressed
        UNION ALL SELECT page_id, url, fetched, host, 2, 'host', host FROM addressed
        UNION ALL
        SELECT page_id, url, fetched, host, 3, 'domain', array_to_string(labels[i:], '.')
        FROM addressed, unnest(range(1, len(labels))) AS t(i)
    ), met AS (
        SELECT t.*, v.valid_from FROM tried t JOIN valid v
            ON t.kind = v.kind AND t.pattern = v.pattern AND v.valid_from <= t.fetched AND t.fetched < v.valid_to
    ), best AS (
        SELECT page_id, url, fetched, count(DISTINCT kind || ' ' || pattern) AS n,
            min((rank, -length(pattern), kind, pattern, valid_from)) AS b
        FROM met GROUP BY ALL
    )
    SELECT DISTINCT p.page_id AS capture_id, p.host, p.fetched, b.n IS NOT NULL AS blocked, coalesce(b.n, 0) AS n_matches,
        b.b[3] AS kind, b.b[4] AS pattern, b.b[5] AS valid_from
    FROM addressed p LEFT JOIN best b ON p.page_id = b.page_id AND p.url = b.url AND p.fetched = b.fetched
    """,
)
def op5_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list entries active when it was fetched.

    The tables hold no fetch times: a page is fetched at a second of the month of the
    events that follows from its number.
    """
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.lit(1704067200) + (F.col("page_id") * 7919) % 2592000
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", fetched.alias("fetched"))
    return url_lists.judge(captures, _url_list(pages, read_table(spark, sf_dir, "events")))


@query(
    "op13_merkle_manifest",
    r"""
    WITH RECURSIVE crc_table AS (
        SELECT list(v ORDER BY n) AS t FROM (
            SELECT n, list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n) AS v
            FROM range(256) AS r(n)
        )
    ), documents_hit AS (
        SELECT *, xor(list_reduce(
            list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substring(doc_id::VARCHAR, i::INT, 1))::BIGINT),
            lambda v, byte: xor(v >> 8, t[xor(v & 255, byte) + 1]), 4294967295), 4294967295) % 3 = 0 AS hit
        FROM documents, crc_table
    ), fields AS (
        SELECT doc_id, lang, hit, text,
            coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS front,
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
        FROM documents_hit
    ), leaves AS (
        SELECT doc_id, lang, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
            sha256(front || coalesce(strlen(text) || ':' || CASE WHEN hit THEN lowered ELSE text END, '-')) AS shown
        FROM fields
    ), placed AS (
        SELECT *, row_number() OVER w - 1 AS pos, row_number() OVER () AS id, count(*) OVER (PARTITION BY lang) AS n
        FROM leaves WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)
    ), nodes AS (
        SELECT lang, 0 AS level, pos, leaf AS digest, n FROM placed
        UNION ALL
        SELECT lang, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8
        FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 8, n
    ), subroots AS (
        SELECT lang, digest AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place,
            count(*) OVER () AS n
        FROM nodes WHERE n = 1
    ), tops AS (
        SELECT 0 AS level, place AS pos, subroot AS digest, n FROM subroots
        UNION ALL
        SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8
        FROM tops WHERE n > 1 GROUP BY level, pos // 8, n
    ), runs AS (
        SELECT 0 AS part, lang, level, pos, digest, n, string_agg(digest, '') OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lft,
            string_agg(digest, '') OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rgt
        FROM nodes WINDOW b AS (PARTITION BY lang, level, pos // 8 ORDER BY pos)
        UNION ALL
        SELECT 1, NULL, level, pos, digest, n, string_agg(digest, '') OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            string_agg(digest, '') OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
        FROM tops WINDOW b AS (PARTITION BY level, pos // 8 ORDER BY pos)
    ), steps AS (
        SELECT id, part, level, coalesce(lft, '') AS lft, coalesce(rgt, '') AS rgt
        FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
        JOIN runs r ON r.n > 1 AND ((part = 0 AND r.lang IS NOT DISTINCT FROM p.lang AND r.pos = p.pos // (8 ** level)::BIGINT)
            OR (part = 1 AND r.pos = s.place // (8 ** level)::BIGINT))
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, level) AS k FROM steps
    ), proofs AS (
        SELECT id, string_agg(lft || rgt, '' ORDER BY k) AS siblings FROM numbered GROUP BY id
    ), folded AS (
        SELECT id, 0 AS k, shown AS digest FROM placed
        UNION ALL
        SELECT f.id, s.k::INT, sha256(s.lft || f.digest || s.rgt) FROM folded f JOIN numbered s ON s.id = f.id AND s.k = f.k + 1
    ), ends AS (
        SELECT id, max_by(digest, k) AS folded_root FROM folded GROUP BY id
    )
    SELECT p.doc_id, p.leaf, s.subroot, t.digest AS root, sha256(coalesce(x.siblings, '')) AS proof_sha256,
        e.folded_root, e.folded_root = t.digest AS verified
    FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN tops t ON t.n = 1
    JOIN ends e USING (id) LEFT JOIN proofs x USING (id)
    """,
)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root folded from a tampered leaf."""
    return merkle.manifest(read_table(spark, sf_dir, "documents"))


@query(
    "op11_conversation_repair",
    r"""
    WITH RECURSIVE crc_table AS (
        SELECT list(v ORDER BY n) AS t FROM (
            SELECT n, list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n) AS v
            FROM range(256) AS r(n)
        )
    ), named AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
        FROM conversations
    ), fated AS (
        SELECT named.*, xor(list_reduce(
            list_transform(range(1, length(name) + 1), lambda i: ascii(substring(name, i::INT, 1))::BIGINT),
            lambda v, byte: xor(v >> 8, t[xor(v & 255, byte) + 1]), 4294967295), 4294967295) % 20 AS fate
        FROM named, crc_table
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
            CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM fated, range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
    ), placed AS (
        SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
            CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial,
            lag(left(role, 1)) OVER w || left(role, 1) AS pair,
            regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS ended
        FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))
    ), judged AS (
        SELECT *, CASE WHEN ended = '' THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
            WHEN ended NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault
        FROM placed
    ), counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au') OR place > 1 AND pair IS NULL) AS illegal
        FROM judged GROUP BY conv_id
    ), best AS (  -- least (cost, edits) of the turns after `place`, by state: e, s, u, a
        SELECT conv_id, n AS place, {'c': 0, 'p': ''} AS e, {'c': 4, 'p': 'II'} AS s, {'c': 2, 'p': 'I'} AS u, {'c': 0, 'p': ''} AS a
        FROM judged WHERE place = n
        UNION ALL
        SELECT conv_id, place, list_min([de, iu, {'c': iia.c + 4, 'p': 'II' || iia.p}]), list_min([ds, iu, {'c': iia.c + 4, 'p': 'II' || iia.p}]),
            list_min([du, ia, {'c': iiu.c + 4, 'p': 'II' || iiu.p}]), list_min([da, iu, {'c': iia.c + 4, 'p': 'II' || iia.p}])
        FROM (
            SELECT *, {'c': du.c + 2, 'p': 'I' || du.p} AS iu, {'c': da.c + 2, 'p': 'I' || da.p} AS ia, du AS iiu, da AS iia FROM (
                SELECT b.conv_id, b.place - 1 AS place,
                    list_min([{'c': e.c + 3, 'p': 'D' || e.p}, CASE WHEN stays AND initial = 's' THEN {'c': s.c + cut, 'p': 'K' || s.p} END,
                        CASE WHEN stays AND initial = 'u' THEN {'c': u.c + cut, 'p': 'K' || u.p} END,
                        CASE WHEN stays THEN {'c': u.c + cut + 2, 'p': 'R' || u.p} END]) AS de,
                    list_min([{'c': s.c + 3, 'p': 'D' || s.p}, CASE WHEN stays AND initial = 'u' THEN {'c': u.c + cut, 'p': 'K' || u.p} END,
                        CASE WHEN stays THEN {'c': u.c + cut + 2, 'p': 'R' || u.p} END]) AS ds,
                    list_min([{'c': u.c + 3, 'p': 'D' || u.p}, CASE WHEN stays AND initial = 'a' THEN {'c': a.c + cut, 'p': 'K' || a.p} END,
                        CASE WHEN stays THEN {'c': a.c + cut + 2, 'p': 'R' || a.p} END]) AS du,
                    list_min([{'c': a.c + 3, 'p': 'D' || a.p}, CASE WHEN stays AND initial = 'u' THEN {'c': u.c + cut, 'p': 'K' || u.p} END,
                        CASE WHEN stays THEN {'c': u.c + cut + 2, 'p': 'R' || u.p} END]) AS da
                FROM best b JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, (fault = 'truncated')::INT AS cut FROM judged) j
                    ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.place = b.place
            )
        )
    ), answer AS (
        SELECT conv_id, e.c AS cost, e.p AS edits FROM best WHERE place = 0
    ), walked AS (  -- the edits one after the other: turns used, state, lines
        SELECT conv_id, edits, 0 AS step, 0::BIGINT AS used, 'e' AS state, []::VARCHAR[] AS lines FROM answer
        UNION ALL
        SELECT conv_id, edits, step + 1, used + (edit <> 'I')::INT,
            CASE edit WHEN 'D' THEN state WHEN 'K' THEN initial ELSE given END,
            CASE edit WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, long || ':')
                WHEN 'R' THEN list_append(lines, long || ':' || text) ELSE list_append(lines, role || ':' || text) END
        FROM (
            SELECT w.*, edits[step + 1] AS edit, CASE state WHEN 'u' THEN 'a' ELSE 'u' END AS given,
                CASE state WHEN 'u' THEN 'assistant' ELSE 'user' END AS long, j.initial, j.role, j.text
            FROM walked w LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.place = w.used + 1
            WHERE step < length(edits)
        )
    ), read AS (
        SELECT conv_id, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM walked WHERE step = length(edits)
    )
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
        coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
        coalesce(edits, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN answer a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN read r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after a damage, the cheapest edits that repair them and a digest."""
    return repair.audit(read_table(spark, sf_dir, "conversations"))


@query("op12_line_quality_crf")
def op12_line_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, with the lines that count as bad."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_quality.judge(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))
