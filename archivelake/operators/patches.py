"""Patch edges, lineage and more-like-this-patch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivelake.functions import diffs, ids
from archivelake.operators.ordered import WIDTH
from archivelake.operators.skew import salted_lookup
from archivelake.session import durable, durable_count, short_batches

ZERO = "^0+$"
SHORTEST = 7


def patch_edges(messages: DataFrame, text: str = "body") -> DataFrame:
    """(docid, ts, pre, post, path_a, path_b) of every file header in the text."""
    return messages.where(F.contains(text, F.lit("\nindex ")) | F.col(text).startswith("index ")).select(
        "docid", "ts", F.explode(diffs.diff_headers(F.col(text))).alias("h")
    ).select("docid", "ts", "h.*")


def changed_files(messages: DataFrame, text: str = "body") -> DataFrame:
    """(docid, path, changed) of every diffstat line."""
    return messages.select("docid", F.explode(diffs.diffstat(F.col(text))).alias("s")).select(
        "docid", "s.path", "s.changed"
    )


def full_ids(named: DataFrame) -> DataFrame:
    """(oid, full, ambiguous) of every distinct id of (oid).

    An id may be written short. It stands for the one longer id that begins with it, or
    for itself if there is none; `full` is null and `ambiguous` true if several unlike
    ones do. Ids are only compared at the lengths that occur, of which there are few.
    """
    every = durable(named.where(F.length("oid") >= SHORTEST).select("oid").distinct())
    sizes = sorted(r.n for r in every.select(F.length("oid").alias("n")).distinct().collect())
    cut = [F.when(F.length("oid") > n, F.substring("oid", 1, n)) for n in sizes] or [F.lit(None).cast("string")]
    begins = every.select("oid", F.explode(F.array_compact(F.array(*cut))).alias("short"))
    longest = every.join(begins.select(F.col("short").alias("oid")).distinct(), "oid", "left_anti")
    meant = (
        begins.join(longest, "oid", "left_semi").groupBy(F.col("short").alias("oid"))
        .agg(F.count("*").alias("n"), F.min("oid").alias("one"))
    )
    joined = every.join(meant, "oid", "left")
    return joined.select(
        "oid", F.when(F.coalesce("n", F.lit(1)) == 1, F.coalesce("one", "oid")).alias("full"),
        (F.coalesce("n", F.lit(1)) > 1).alias("ambiguous"),
    )


def file_runs(hop: DataFrame, n: int, entered: DataFrame) -> DataFrame:
    """`hop` (blob, jump, ts, docid, path, ..) with `top` and `back`, the run that each blob is in.

    A run is patches of one file, one after the other in time, each made on the one
    before. `top` is its newest blob, `back` how many steps a blob lies below it. A
    run is entered at its top only: it is cut at the blobs of `entered`, where histories
    meet, and between time ranges of about WIDTH of the `n` rows, so no task holds more.
    """
    meet = hop.groupBy(F.col("jump").alias("blob")).agg(F.count("*").alias("n")).where("n > 1").select("blob")
    cuts = entered.select("blob").union(meet).distinct().withColumn("cut", F.lit(True))
    ranges = hop.join(cuts, "blob", "left").repartitionByRange(
        max(1, -(-n // WIDTH)), "path", "ts", "docid", "blob"
    ).withColumn("range", F.spark_partition_id())
    newest_first = Window.partitionBy("range", "path").orderBy(F.desc("ts"), F.desc("docid"), F.desc("blob"))
    so_far = newest_first.rowsBetween(Window.unboundedPreceding, 0)
    follows = F.coalesce(F.lag("jump").over(newest_first) == F.col("blob"), F.lit(False)) & F.col("cut").isNull()
    placed = ranges.withColumn("row", F.row_number().over(newest_first)).withColumn(
        "first", F.when(~follows, F.struct("row", "blob"))
    ).withColumn("first", F.last("first", ignorenulls=True).over(so_far))
    return placed.select(
        *hop.columns, F.col("first.blob").alias("top"), (F.col("row") - F.col("first.row")).alias("back")
    )


def lineage(edges: DataFrame, wanted: DataFrame, known: DataFrame | None = None,
            max_rounds: int = 60) -> DataFrame:
    """Patches from each wanted blob back to a null or known blob.

    Returns (want, step, blob, pre, docid, ambiguous). Blobs are compared by their full
    ids; short ones are resolved first (`full_ids`). A history ends with `ambiguous` set
    where a patch changes a blob whose short id fits several. A wanted id that fits
    several, or is shorter than SHORTEST, has one row, step 0 without a blob, with
    `ambiguous` set. Of several patches making
    one blob, the latest is followed. Runs of patches of one file (`file_runs`; `path_b`
    and `path_a` of the edges may be missing) are followed as a whole. Runs are
    enumerated by doubling: after round k the first 2^k are there, so a history of many
    runs takes few rounds; a loop ends where it meets a run again.
    """
    name = [F.col(c) for c in ("path_b", "path_a") if c in edges.columns]
    usable = durable(edges.where(
        ~F.col("post").rlike(ZERO) & (F.length("post") >= SHORTEST) & (F.col("post") != F.col("pre"))
    ).select("ts", "docid", "pre", "post", F.coalesce(*name, F.lit("")).alias("path")))
    want = durable(wanted.select("oid").distinct())
    ids = [usable.select(F.col("post").alias("oid")), usable.where(~F.col("pre").rlike(ZERO)).select(F.col("pre").alias("oid")),
           want] + ([] if known is None else [known.select("oid")])
    resolved = durable(full_ids(reduce(DataFrame.union, ids)))
    post = resolved.where("full is not null").select(F.col("oid").alias("post"), F.col("full").alias("blob"))
    pre = resolved.select(F.col("oid").alias("pre"), F.col("full").alias("jump"), "ambiguous")
    newest = salted_lookup(usable, post, ["post"], spread_on="docid").groupBy("blob").agg(
        F.max(F.struct("ts", "docid", "pre", "path")).alias("e")
    ).select("blob", "e.*")
    if known is not None:
        stop = salted_lookup(
            known.select("oid"), resolved.where("full is not null").select("oid", "full"), ["oid"], spread_on="oid"
        ).select(F.col("full").alias("blob")).distinct()
        newest = newest.join(stop, "blob", "left_anti")
    hop, n = durable_count(salted_lookup(newest, pre, ["pre"], spread_on="blob", how="left").select(
        *newest.columns, "jump", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous")
    ), F.lit(True))
    start = durable(want.join(resolved.where("full is not null"), "oid").select(
        F.col("oid").alias("origin"), F.col("full").alias("blob")
    ))
    runs = durable(file_runs(hop, n, start).select("top", "back", "blob", "pre", "jump", "docid", "ambiguous"))
    # Rows of a wanted id lead to the tops on its way, rows of a top to the top 2^k runs on.
    ends = runs.groupBy("top").agg(F.max(F.struct("back", "jump")).alias("e")).where("e.jump is not null").select(
        F.col("top").alias("origin"), F.col("e.jump").alias("blob"), (F.col("e.back") + 1).alias("step"), F.lit(False).alias("wanted")
    )
    ways, size = durable_count(
        start.withColumn("step", F.lit(0)).withColumn("wanted", F.lit(True)).unionByName(ends), F.col("wanted")
    )
    for _ in range(max_rounds):
        links = ways.where("not wanted").select(
            F.col("origin").alias("blob"), F.col("blob").alias("next"), F.col("step").alias("more")
        )
        further = salted_lookup(ways, links, ["blob"], spread_on="origin").select(
            "origin", F.col("next").alias("blob"), (F.col("step") + F.col("more")).alias("step"), "wanted"
        )
        grown = ways.where("wanted").unionByName(further).groupBy("wanted", "origin", "blob").agg(F.min("step").alias("step"))
        before = size
        ways, size = durable_count(grown, F.col("wanted"))
        if size == before:
            break
    else:
        raise RuntimeError(f"histories did not end in {max_rounds} doublings")
    found = salted_lookup(
        ways.where("wanted").select(F.col("origin").alias("want"), F.col("blob").alias("top"), "step"),
        runs.drop("jump"), ["top"], spread_on="want",
    ).withColumn("step", F.col("step") + F.col("back"))
    unclear = want.where("oid is not null").join(
        resolved.where("full is not null"), "oid", "left_anti"
    ).select(
        F.col("oid").alias("want"), F.lit(0).alias("step"),
        *[F.lit(None).cast(runs.schema[c].dataType).alias(c) for c in ("blob", "pre", "docid")],
        F.lit(True).alias("ambiguous"),
    )
    return found.select("want", "step", "blob", "pre", "docid", "ambiguous").unionByName(unclear)


def patch_terms(messages: DataFrame, text: str = "body") -> DataFrame:
    """Distinct (docid, field, term) features of patches, for lookups by patch."""
    short_batches(messages.sparkSession)
    rows = messages.where(diffs.looks_like_diff(F.col(text))).select(
        "docid", F.explode(diffs.diff_lines(F.col(text))).alias("l")
    )
    names = {"file": "dfn", "added": "dfb", "removed": "dfa", "context": "dfctx",
             "hunk": "dfhh", "pre": "dfpre", "post": "dfpost"}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    value = F.regexp_replace("l.value", r"^\s+|\s+$", "")
    return rows.select(
        "docid", F.try_element_at(table, F.col("l.kind")).alias("field"), value.alias("term")
    ).where("field is not null and term <> ''").distinct()


def similar_patches(features: DataFrame, probe: int, want: list[str] | None = None) -> DataFrame:
    """Messages sharing features with one patch, by how many they share.

    Blob ids are compared in full, short ones once resolved; a short id that fits
    several is shared with none.
    """
    chosen = features.where(F.col("field").isin(want or ["dfpost"])).select("docid", "field", "term").distinct()
    blob = F.col("field").isin("dfpre", "dfpost")
    blobs = chosen.where(blob)
    resolved = full_ids(blobs.select(F.col("term").alias("oid"))).where("full is not null").select(
        F.col("oid").alias("term"), "full"
    )
    named = salted_lookup(blobs, resolved, ["term"], spread_on="docid").select("docid", "field", F.col("full").alias("term"))
    keyed = chosen.where(~blob).unionByName(named).distinct()
    mine = keyed.where(F.col("docid") == probe).select("field", "term")
    return (
        salted_lookup(keyed.where(F.col("docid") != probe), mine, ["field", "term"], "docid", "left_semi")
        .groupBy("docid").agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "docid")
    )


def by_patch_key(messages: DataFrame, text: str = "body") -> DataFrame:
    """Messages carrying the same patch: key, number of messages, first docid."""
    keyed = messages.select("docid", diffs.patch_key(F.col(text)).alias("patch_key"))
    return keyed.where("patch_key is not null").groupBy("patch_key").agg(
        F.count("*").alias("n"), F.min("docid").alias("first_docid")
    )


def blob_prefixes(edges: DataFrame) -> DataFrame:
    """(docid, prefix) rows of every blob id down to seven digits."""
    both = edges.select("docid", F.explode(F.array("pre", "post")).alias("oid"))
    return both.select("docid", F.explode(ids.id_prefixes(F.col("oid"), SHORTEST)).alias("prefix")).distinct()
