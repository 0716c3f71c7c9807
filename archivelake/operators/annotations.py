"""Keywords, labels and folder mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivelake.operators.skew import salted_lookup
from archivelake.sources.files import MAILDIR_KEYWORDS, flag_keywords

# System keywords and the rule for label names.
KEYWORDS = ["seen", "answered", "flagged", "draft", "forwarded", "phishing", "junk", "notjunk"]
LABEL_PATTERN = r"^[a-z0-9_](?:[a-z0-9_\-./@,]*[a-z0-9])?$"


def _empty() -> Column:
    return F.array().cast("array<string>")


def _or_empty(c: Column | str) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), _empty())


def valid_keywords(names: Column) -> Column:
    return F.filter(names, lambda n: n.isin(KEYWORDS))


def valid_labels(names: Column) -> Column:
    return F.filter(names, lambda n: n.rlike(LABEL_PATTERN))


def _per_doc(changes: DataFrame, columns: list[str]) -> DataFrame:
    """One row per docid with the union of each array column.

    Names are made distinct before they are gathered, so a document changed very often
    holds no more than its different names.
    """
    named = F.array(*[F.struct(F.lit(c).alias("column"), _or_empty(c).alias("names")) for c in columns])
    each = changes.select("docid", F.inline(named)).select("docid", "column", F.explode_outer("names").alias("name"))
    return each.distinct().groupBy("docid").agg(*[
        F.array_sort(F.collect_set(F.when(F.col("column") == c, F.col("name")))).alias(c) for c in columns
    ])


def set_annotations(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace `kw` and `labels`; a null set in `changes` leaves the old one."""
    new = changes.select("docid", F.col("kw").alias("_kw"), F.col("labels").alias("_l"))
    both = table.join(new, "docid", "full_outer")
    return both.select(
        "docid",
        F.array_sort(_or_empty(F.coalesce("_kw", "kw"))).alias("kw"),
        F.array_sort(_or_empty(F.coalesce("_l", "labels"))).alias("labels"),
    )


def modify_annotations(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply +/- sets: `add_kw`, `del_kw`, `add_labels`, `del_labels`.

    Removal comes first. Unknown keywords and malformed labels are not added.
    """
    names = ["add_kw", "del_kw", "add_labels", "del_labels"]
    per_doc = _per_doc(changes, names)
    both = table.join(per_doc, "docid", "full_outer")

    def done(old: str, add: Column, drop: str) -> Column:
        left = F.array_except(_or_empty(old), _or_empty(drop))
        return F.array_sort(F.array_union(left, add))

    return both.select(
        "docid",
        done("kw", valid_keywords(_or_empty("add_kw")), "del_kw").alias("kw"),
        done("labels", valid_labels(_or_empty("add_labels")), "del_labels").alias("labels"),
    )


def merge_annotations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of both sets, as when a document is built again."""
    n = new.select("docid", F.col("kw").alias("_kw"), F.col("labels").alias("_l"))
    return old.join(n, "docid", "full_outer").select(
        "docid",
        F.array_sort(F.array_union(_or_empty("kw"), _or_empty("_kw"))).alias("kw"),
        F.array_sort(F.array_union(_or_empty("labels"), _or_empty("_l"))).alias("labels"),
    )


def keywords_changed(stored: Column, new: Column) -> Column:
    """True when keywords differ; a stored `forwarded` is never seen as cleared."""
    kept = F.when(
        F.array_contains(new, "forwarded"), stored
    ).otherwise(F.array_remove(stored, "forwarded"))
    return F.array_sort(kept) != F.array_sort(new)


def with_annotations(messages: DataFrame, by_blob: DataFrame) -> DataFrame:
    """Messages with keywords and labels kept for their blob elsewhere."""
    extra = by_blob.groupBy("oid").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("kw")))).alias("_kw"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("_l"),
    )
    joined = salted_lookup(messages, extra, ["oid"], spread_on="docid", how="left")
    base_kw = _or_empty("kw") if "kw" in messages.columns else _empty()
    base_l = _or_empty("labels") if "labels" in messages.columns else _empty()
    return joined.withColumn("kw", F.array_sort(F.array_union(base_kw, _or_empty("_kw")))).withColumn(
        "labels", F.array_sort(F.array_union(base_l, _or_empty("_l")))
    ).drop("_kw", "_l")


def external_only(annotations: DataFrame, messages: DataFrame) -> DataFrame:
    """Records kept for messages stored elsewhere, full once they are imported."""
    m = messages.select("oid", "mid", "subject", "bytes", F.lit(True).alias("_here"))
    both = annotations.join(m, "oid", "full_outer")
    return both.select(
        "oid", "mid", F.coalesce("subject", F.lit("")).alias("subject"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
        _or_empty("kw").alias("kw"), _or_empty("labels").alias("labels"),
        F.coalesce("_here", F.lit(False)).alias("imported"),
    )


def flags_text(kw: Column) -> Column:
    """Maildir flag letters of keywords, sorted."""
    letters = [
        F.when(F.array_contains(kw, word), F.lit(letter))
        for letter, word in sorted(MAILDIR_KEYWORDS.items())
    ]
    return F.array_join(F.array_compact(F.array(*letters)), "")


def export_plan(entries: DataFrame, stored: DataFrame, merge: bool = True) -> DataFrame:
    """Renames that carry stored keywords into Maildir names.

    `entries` has (folder, name, oid); `stored` has (oid, kw). Unknown flag
    letters are kept; with `merge` the flags already in the name stay too.
    """
    base = F.regexp_replace("name", r":2,[A-Za-z]*$", "")
    flags = F.regexp_extract("name", r":2,([A-Za-z]*)$", 1)
    known = "".join(MAILDIR_KEYWORDS)
    joined = salted_lookup(entries, stored.select("oid", "kw"), ["oid"], spread_on="name")
    kw = F.array_union("kw", flag_keywords(flags)) if merge else F.col("kw")
    unknown = F.regexp_replace(flags, f"[{known}]", "")
    letters = F.array_join(
        F.array_sort(F.filter(F.split(F.concat(flags_text(kw), unknown), ""), lambda c: c != "")), ""
    )
    return joined.select(
        "folder", "name", "oid", F.concat(base, F.lit(":2,"), letters).alias("new_name")
    ).where("new_name <> name")


def blob_folders(locations: DataFrame) -> DataFrame:
    """Folders of every blob with how many places and the first of them."""
    return locations.groupBy("oid", "folder").agg(
        F.count("*").alias("places"), F.min("uid").alias("min_uid"), F.min("name").alias("first_name")
    )


def blob_places(locations: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Every (oid, folder, uid, name) where a blob lies: of all blobs or the wanted ones."""
    places = locations.select("oid", "folder", "uid", "name").distinct()
    if wanted is None:
        return places
    return salted_lookup(places, wanted.select("oid").distinct(), ["oid"], ["folder", "uid", "name"], "left_semi")


def blob_names(locations: DataFrame, folders: DataFrame) -> DataFrame:
    """File-named places with their folder path, even when the folder is gone."""
    named = locations.where("name is not null")
    return salted_lookup(named, folders.select("folder", "location"), ["folder"], "oid", "left")


def folder_statistics(locations: DataFrame) -> DataFrame:
    return locations.groupBy("folder").agg(
        F.count("name").alias("names"), F.count("uid").alias("uids"),
        F.min("uid").alias("min_uid"), F.max("uid").alias("max_uid"),
    )


def stale_entries(recorded: DataFrame, listed: DataFrame) -> DataFrame:
    """Recorded (folder, uid) entries a fresh listing no longer has."""
    return recorded.join(listed.select("folder", "uid").distinct(), ["folder", "uid"], "left_anti")


def moved_files(recorded: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed files with an unknown name whose blob is known elsewhere."""
    unknown = listed.join(recorded.select("folder", "name"), ["folder", "name"], "left_anti")
    old = recorded.groupBy("oid").agg(
        F.min(F.struct("folder", "name")).alias("_o")
    ).select("oid", F.col("_o.folder").alias("old_folder"), F.col("_o.name").alias("old_name"))
    return salted_lookup(unknown, old, ["oid"], spread_on="name")


def entries_to_documents(entries: DataFrame, recorded: DataFrame, messages: DataFrame,
                         key: str = "uid") -> DataFrame:
    """(folder, key) entries to their distinct docids, via the blob."""
    blobs = entries.select("folder", key).distinct().join(
        recorded.select("folder", key, "oid"), ["folder", key]
    ).distinct()
    docs = messages.groupBy("oid").agg(F.min("docid").alias("docid"))
    return salted_lookup(blobs, docs, ["oid"], spread_on=key)


def move_folder(locations: DataFrame, old: str, new: str) -> DataFrame:
    return locations.withColumn(
        "folder", F.when(F.col("folder") == old, new).otherwise(F.col("folder"))
    ).distinct()


def forget_folders(locations: DataFrame, gone: list[str]) -> DataFrame:
    return locations.where(~F.col("folder").isin(gone))


def forget_entries(locations: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return locations.join(gone.select(*keys).distinct(), keys, "left_anti")
