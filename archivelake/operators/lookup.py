"""Routing, cross-inbox lookup, partial ids and inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivelake.functions import addresses, ids
from archivelake.operators.skew import salted_lookup

#: Edits that a mistyped id may be away from the one meant.
PARTIAL_EDITS = 3


def recipients(messages: DataFrame, row_id: list[str]) -> DataFrame:
    """(row id, pos, addr) of every To and Cc address, lower-cased."""
    both = F.concat(
        addresses.emails(F.coalesce("to", F.lit(""))), addresses.emails(F.coalesce("cc", F.lit("")))
    )
    return messages.select(*row_id, F.posexplode(both).alias("pos", "addr")).withColumn(
        "addr", F.lower("addr")
    )


def route(messages: DataFrame, inboxes: DataFrame, row_id: list[str]) -> DataFrame:
    """Destination inboxes: by recipient address, else by List-Id.

    `inboxes` has (inbox, address, list_id). Each destination appears once.
    """
    by_addr = inboxes.select(F.lower("address").alias("addr"), "inbox").dropDuplicates(["addr"])
    found = salted_lookup(recipients(messages, row_id), by_addr, ["addr"], spread_on=row_id)
    direct = found.select(*row_id, "inbox").distinct()
    rest = messages.join(direct.select(*row_id).distinct(), row_id, "left_anti")
    by_list = inboxes.select(F.lower("list_id").alias("list_id"), "inbox").dropDuplicates(["list_id"])
    listed = salted_lookup(
        rest.select(*row_id, F.explode("list_ids").alias("list_id")).withColumn("list_id", F.lower("list_id")),
        by_list, ["list_id"], spread_on=row_id,
    ).select(*row_id, "inbox").distinct()
    return direct.unionByName(listed)


def crossposts_by_recipient(messages: DataFrame, inboxes: DataFrame, article_map: DataFrame) -> DataFrame:
    """(mid, inbox, num) of the inboxes a message is addressed to and held by."""
    by_addr = inboxes.select(F.lower("address").alias("addr"), "inbox").dropDuplicates(["addr"])
    sent_to = salted_lookup(recipients(messages, ["mid"]), by_addr, ["addr"], spread_on="mid")
    wanted = sent_to.select("mid", "inbox").distinct()
    return wanted.join(article_map.select("mid", "inbox", "num"), ["mid", "inbox"])


def find_across(wanted: DataFrame, article_map: DataFrame, inboxes: DataFrame) -> DataFrame:
    """Best copy of each wanted id: the current inbox, then by inbox position.

    `wanted` has (mid, current); `inboxes` has (inbox, pos).
    """
    placed = salted_lookup(article_map, inboxes.select("inbox", "pos"), ["inbox"], spread_on="num")
    best = placed.groupBy("mid").agg(F.min(F.struct("pos", "num", "inbox")).alias("b"))
    any_copy = salted_lookup(wanted, best, ["mid"], spread_on="current", how="left")
    here = article_map.groupBy("mid", "inbox").agg(F.min("num").alias("here_num"))
    own = salted_lookup(
        any_copy, here.withColumnRenamed("inbox", "current"), ["mid", "current"], "mid", "left"
    )
    has_own = F.col("here_num").isNotNull()
    return own.select(
        "mid", "current",
        F.when(has_own, F.col("current")).otherwise(F.col("b.inbox")).alias("inbox"),
        F.when(has_own, F.col("here_num")).otherwise(F.col("b.num")).alias("num"),
    ).where("inbox is not null")


def partial_id(messages: DataFrame, wanted: str, edits: int = PARTIAL_EDITS, limit: int | None = None) -> DataFrame:
    """Ids like a partial one, and the first of three rungs on which any is found.

    Rungs: 1, ids that begin with it; 2, ids that hold all its words of three characters
    or more, in any order; 3, ids at most `edits` insertions, deletions or changes away.
    All ids of the rung are returned, or the first `limit` by docid if one is given. An
    empty id finds nothing.
    """
    import re

    mid, text = F.lower("mid"), wanted.lower()
    words = sorted({w for w in re.split(r"[\W_]+", text) if len(w) > 2})
    rungs = [mid.startswith(text)]
    if words:
        rungs.append(F.size(F.array_except(F.array(*map(F.lit, words)), F.split(mid, r"[\W_]+"))) == 0)
    rungs.append(F.levenshtein(mid, F.lit(text), edits) >= 0)
    rung = F.coalesce(*[F.when(r, F.lit(n)) for n, r in zip((1, 2, 3) if words else (1, 3), rungs, strict=True)])
    found = messages.where(F.lit(bool(text))).select("mid", "docid", rung.alias("rung")).where("rung is not null")
    best = found.agg(F.min("rung").alias("_best"))  # one row
    kept = found.join(F.broadcast(best), F.col("rung") == F.col("_best")).drop("_best").orderBy("docid")
    return kept if limit is None else kept.limit(limit)


#: Last pieces of a web address that stand for a form of the message or thread before them.
_WEB_FORMS = ("raw", "t", "T", "t.mbox.gz", "t.atom")


def _selection(token: Column) -> Column:
    """(kind, value, threads) that one word of an input names; kind null for none."""
    scheme = F.lower(F.substring_index(token, ":", 1))
    rest = F.substr(token, F.instr(token, ":") + 1)
    path = F.substring_index(F.substring_index(F.regexp_replace(rest, "^//[^/]*", ""), "?", 1), "#", 1)
    pieces = F.filter(F.split(path, "/"), lambda x: x != "")
    last = F.coalesce(F.try_element_at(pieces, F.lit(-1)), F.lit(""))
    form = last.isin(*_WEB_FORMS)
    owner = F.when(form, F.try_element_at(pieces, F.lit(-2)))
    shown = F.coalesce(F.try_element_at(F.filter(pieces, lambda x: F.contains(x, F.lit("@"))), F.lit(1)), owner)
    web = F.url_decode(F.replace(shown, F.lit("+"), F.lit("%2B")))
    named = F.contains(token, F.lit(":"))
    bracketed = F.regexp_extract(token, "<([^<>]+)>", 1)

    def pick(when: Column, kind: str, value: Column, threads: Column | None = None) -> Column:
        threads = F.lit(False) if threads is None else threads
        return F.when(named & when & value.isNotNull() & (value != ""), F.struct(
            F.lit(kind).alias("kind"), value.alias("value"), threads.alias("threads")
        ))

    return F.coalesce(
        pick(scheme.isin("http", "https"), "mid", web, form & (last != "raw")),
        pick(scheme.isin("nntp", "nntps", "news", "snews"), "mid", F.when(F.contains(last, F.lit("@")), last)),
        pick(scheme.isin("imap", "imaps"), "folder", token),
        pick(scheme.isin("m", "mid", "id"), "mid", F.regexp_replace(rest, "^<|>$", "")),
        pick(scheme == "blob", "blob", F.when(rest.rlike("^[0-9a-f]{7,}$"), rest)),
        F.when(bracketed != "", F.struct(F.lit("mid").alias("kind"), bracketed.alias("value"), F.lit(False).alias("threads"))),
    )


def selections(inputs: DataFrame, column: str = "input") -> DataFrame:
    """Reduce many notations to (kind, value, threads).

    Kinds: `mid`, `blob`, `folder`, or null when nothing is recognised. The first word
    of the input that names something counts; its scheme and the last piece of its path
    say what. A mail folder's path runs to the end of the input. Links to whole threads
    set `threads`.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    folder = F.when(F.instr(F.lower(text), "maildir:") > 0, F.substr(text, F.instr(F.lower(text), "maildir:")))

    def bare(word: Column) -> Column:
        inner = F.regexp_extract(word, "^<([A-Za-z]+:[^<>]*)>", 1)
        return F.when(inner != "", inner).when(F.contains(word, F.lit("<")), word).otherwise(
            F.regexp_replace(word, r"[\])},.;>]+$", "")
        )

    words = F.transform(F.split(text, r"\s+"), bare)
    found = F.try_element_at(F.filter(F.transform(words, _selection), lambda s: s.isNotNull()), F.lit(1))
    return inputs.withColumn("_found", found).withColumn(
        "kind", F.when(folder.isNotNull(), F.lit("folder")).otherwise(F.col("_found.kind"))
    ).withColumn("value", F.coalesce(folder, F.col("_found.value"))).withColumn(
        "threads", folder.isNull() & F.coalesce(F.col("_found.threads"), F.lit(False))
    ).drop("_found")


def reply_recipients(messages: DataFrame, policy: Column, list_address: Column) -> DataFrame:
    """Add `reply_to` and `reply_cc` by policy.

    The policy is a comma list of `:all`, `:list`, header names and addresses.
    The first address found is To, the rest are a sorted Cc without repeats.
    """
    steps = F.transform(F.split(F.coalesce(policy, F.lit(":all")), r"\s*,\s*"), F.trim)

    def listed(header: str) -> Column:
        return addresses.emails(F.coalesce(F.col(header), F.lit("")))

    everyone = F.concat(listed("from"), listed("to"), listed("cc"))

    def addresses_of(step: Column) -> Column:
        return (
            F.when(step == ":all", everyone)
            .when(step == ":list", F.array(list_address))
            .when(F.lower(step) == "from", listed("from"))
            .when(F.lower(step) == "to", listed("to"))
            .when(F.lower(step) == "cc", listed("cc"))
            .when(F.contains(step, F.lit("@")), F.array(step))
            .otherwise(F.array().cast("array<string>"))
        )

    found = F.flatten(F.transform(steps, addresses_of))
    lowered = F.transform(found, F.lower)
    once = F.filter(
        F.transform(found, lambda a, i: F.when(F.array_position(lowered, F.lower(a)) == i + 1, a)),
        lambda a: a.isNotNull(),
    )
    to = F.coalesce(F.get(once, F.lit(0)), list_address)
    cc = F.array_sort(F.filter(once, lambda a: F.lower(a) != F.lower(to)))
    return messages.withColumn("reply_to", to).withColumn("reply_cc", cc)


def inspect(
    messages: DataFrame, xref: DataFrame, annotations: DataFrame, mid: str | None = None, oid: str | None = None,
    inbox: str | None = None, num: int | None = None, folder: str | None = None, locations: DataFrame | None = None,
) -> DataFrame:
    """Everything known about the messages named, as one JSON text per document.

    Named by message id, by blob, by inbox and number, or by a folder that `locations`
    (oid, folder) records. Copies are counted, not listed: a message may have any number
    of them. The few documents are found first; the other tables are filtered by them.
    """
    if mid is not None:
        docs = messages.where(F.col("mid") == mid)
    else:
        rows = xref
        if oid is not None:
            rows = rows.where(F.col("oid") == oid)
        elif folder is not None:
            here = locations.where(F.col("folder") == folder).select("oid").distinct()
            rows = rows.join(here, "oid", "left_semi")
        else:
            rows = rows.where((F.col("inbox") == inbox) & (F.col("xnum") == num))
        docs = messages.join(rows.select("docid").distinct(), "docid", "left_semi")
    ids = docs.select("docid").distinct()
    places = xref.join(ids, "docid", "left_semi").groupBy("docid").agg(
        F.count("*").alias("copies"), F.min(F.struct("inbox", "xnum")).alias("first_copy")
    )
    noted = annotations.join(ids, "docid", "left_semi")
    joined = docs.join(places, "docid", "left").join(noted, "docid", "left")
    return joined.select(
        "docid",
        F.to_json(F.struct("mid", "subject", "ds", "ts", "bytes", "copies", "first_copy", "kw", "labels")).alias("json"),
    )


def search_inboxes(meta: DataFrame, word: str, fields: list[str] | None = None) -> DataFrame:
    """Inbox records holding a word in any field, last modified first."""
    names = fields or ["description", "address", "list_id", "url", "name"]
    present = [f for f in names if f in meta.columns]
    text = F.lower(F.concat_ws(" ", *present))
    tokens = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return meta.where(F.array_contains(tokens, word.lower())).orderBy(F.desc("modified"), "inbox")


def listing(meta: DataFrame, url_regex: str | None = None) -> DataFrame:
    """Inboxes not hidden from the listing whose URL matches."""
    shown = meta.where(~F.array_contains(F.coalesce("hide", F.array().cast("array<string>")), "www"))
    return shown.where(F.col("url").rlike(url_regex)) if url_regex else shown


def saved_searches(table: DataFrame, prefix: str = "") -> DataFrame:
    return table.where(F.col("output").startswith(prefix)).orderBy("output")


def parents_found(messages: DataFrame, article_map: DataFrame) -> DataFrame:
    """Last reference of each message and whether it can be found."""
    known = article_map.select(F.col("mid").alias("parent_mid")).distinct().withColumn("found", F.lit(True))
    asked = messages.withColumn("parent_mid", ids.in_reply_to(F.col("refs"))).where("parent_mid is not null")
    return salted_lookup(asked, known, ["parent_mid"], spread_on="mid", how="left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )
