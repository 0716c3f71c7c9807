"""Merkle manifest of a dataset: a digest per row, a root per language, one root for all.

Digests are lower-case hex text. The nodes of a level, eight by eight, become their
parents: the digest of their concatenation. A run that is cut short by the end of the
level, even one of a single node, becomes a parent too, as long as the level has more
than one node.

Nodes are kept in aligned blocks of 512 neighbours, so three levels of the tree lie
inside a block. A block holds each of its levels as one string of concatenated digests:
a parent hashes a fixed-width substring of it, and what flanks a node in that substring
are its siblings. The roots of the blocks are the nodes of the next tier, 512 times
fewer, and the roots of the languages those of the last tree. No task holds more than
a block, however many rows a language has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivelake.llm.base import lower_ascii
from archivelake.session import durable, durable_count

#: Children of a node, levels inside a block, characters of a digest.
RUN, LEVELS, DIGEST = 8, 3, 64
BLOCK = RUN**LEVELS
#: Every so many crc32 values of the id, a row counts as tampered with.
TAMPERED = 3

_STEP = "struct<left:string,right:string>"


def _field(value: Column) -> Column:
    """UTF-8 byte count, a colon and the value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """Digest of a row of `documents` with the given text."""
    fields = ["doc_id", "source", "lang", "n_chars"]
    return F.sha2(F.concat(*[_field(F.col(c)) for c in fields], _field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, changed) of every row of `documents`.

    `changed` is the leaf of the tampered row: its text with A-Z in lower case, for the
    ids whose crc32 is a multiple of three. It is null for all other rows, for rows
    without an id or a text, and where that changes nothing.
    """
    lowered = lower_ascii(F.col("text"))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return docs.select("doc_id", "source", "lang", "n_chars", "text").select(
        "lang", "doc_id", leaf(F.col("text")).alias("leaf"),
        F.when(hit & F.col("text").rlike("[A-Z]"), leaf(lowered)).alias("changed"),
    )


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add `pos`, from 0 in the order of the given columns (nulls first) per group, and
    `size`, the rows of the group; rows of the group null make a group.

    Rows are dealt to ranges and sorted there, whatever their group; a row per range and
    group carries the positions onward, so a large group is many ranges. Rows that are
    equal in all of `order` may come in either order.
    """
    by = [F.col(c).asc_nulls_first() for c in [group, *order]]
    # The last column parts equal rows, which would otherwise share a range.
    spread = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = spread.repartitionByRange(*by, "_row").sortWithinPartitions(*by).drop("_row")
    placed = durable(dealt.withColumn("_at", F.monotonically_increasing_id()))
    ranged = placed.withColumn("_range", F.shiftright("_at", 33))
    counts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    every = Window.partitionBy(group)
    before = every.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(
        F.col(group).alias("_group"), F.col("_range").alias("_part"), "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"), F.sum("_n").over(every).alias("size"),
    )
    met = ranged.join(carried, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_part")))
    return met.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_skip")).alias("pos"), "size")


def _parents(level: Column) -> Column:
    """The next level's string: a digest for each run of the level's string."""
    runs = F.ceil(F.length(level) / (RUN * DIGEST)).cast("int")
    digests = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(
        F.substr(level, i * RUN * DIGEST + 1, F.lit(RUN * DIGEST)), 256
    ))
    return F.array_join(digests, "").cast("binary")


def _flanks(level: Column, at: Column) -> Column:
    """What stands before and after node `at` of a level's string inside its run."""
    low, own = (F.floor(at / RUN) * RUN * DIGEST).cast("int"), (at * DIGEST).cast("int")
    return F.struct(
        F.substr(level, low + 1, own - low).cast("string").alias("left"),
        F.substr(level, own + DIGEST + 1, low + (RUN - 1) * DIGEST - own).cast("string").alias("right"),
    )


def blocks(nodes: DataFrame, group: str, digest: str) -> DataFrame:
    """One row per aligned block of 512 nodes: group, block, members, level_0 to level_2
    (concatenated digests), top and size (blocks of the group).

    `nodes` has `pos` and `size` of `numbered`. Levels end with the one of a single node
    if the block is all the group has; otherwise a block is raised three levels.
    """
    others = [c for c in nodes.columns if c not in (group, "size")]
    members = F.sort_array(F.collect_list(F.struct("pos", *[c for c in others if c != "pos"])))
    found = nodes.groupBy(group, F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        members.alias("members"), F.max("size").alias("_size")
    )
    rows = found.withColumn("level_0", F.array_join(F.col(f"members.{digest}"), "").cast("binary"))
    for k in range(1, LEVELS + 1):
        # A group of n nodes has levels until one node is left.
        below = F.col(f"level_{k - 1}")
        rows = rows.withColumn(f"level_{k}", F.when(F.col("_size") > RUN ** (k - 1), _parents(below)).otherwise(below))
    return rows.withColumn("top", F.col(f"level_{LEVELS}").cast("string")).withColumn(
        "size", F.ceil(F.col("_size") / BLOCK)
    ).drop(f"level_{LEVELS}")


def _inside(member: Column) -> Column:
    """Siblings of a member inside its block, level by level."""
    at = (member["pos"] % BLOCK).cast("int")
    steps = [
        F.when(F.col("_size") > RUN**k, _flanks(F.col(f"level_{k}"), F.floor(at / RUN**k).cast("int")))
        for k in range(LEVELS)
    ]
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def paths(nodes: DataFrame, group: str, digest: str, keep: list[str]) -> DataFrame:
    """`keep`, `path` and `top` of every node: the siblings (left and right of it) at
    each level up to its group's root, and that root.

    `nodes` has `pos` and `size` of `numbered`. The blocks' roots are treated alike, so
    there are as many tiers as the largest group's size has digits to the base 512.
    """
    cut, more = durable_count(blocks(nodes, group, digest), F.col("size") > 1)
    if more:
        roots = cut.select(group, F.col("block").alias("pos"), "size", F.col("top").alias("digest"))
        above = paths(roots, group, "digest", [group, "pos"]).select(
            F.col(group).alias("_of"), F.col("pos").alias("_pos"), F.col("path").alias("_path"),
            F.col("top").alias("_root"),
        )
        cut = cut.join(above, F.col(group).eqNullSafe(F.col("_of")) & (F.col("block") == F.col("_pos")))
    else:
        cut = cut.withColumn("_path", F.expr(f"cast(array() AS array<{_STEP}>)")).withColumn("_root", F.col("top"))
    names = [c for c in keep if c != group]
    rows = F.transform("members", lambda m: F.struct(
        *[m[c].alias(c) for c in names], F.concat(_inside(m), F.col("_path")).alias("path")
    ))
    found = cut.select(group, F.col("_root").alias("top"), F.inline(rows))
    return found.select(*keep, "path", "top")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Leaves of a language ascend by doc_id (null first), rows of one id by leaf. A null
    language is a group of its own, the first one; languages are ordered by their UTF-8
    bytes. Rows without an id are never tampered with. Empty and null texts are values
    like others; repeated rows are leaves of their own. No rows give no rows.
    """
    own = numbered(leaves(docs), "lang", ["doc_id", "leaf"])
    found = paths(own, "lang", "leaf", ["lang", "doc_id", "leaf", "changed"])
    subroots = found.groupBy("lang").agg(F.first("top").alias("digest")).withColumn("all", F.lit(0))
    ranked = numbered(subroots, "all", ["lang"])
    upper = paths(ranked, "all", "digest", ["lang", "digest"]).select(
        F.col("lang").alias("_lang"), F.col("path").alias("_path"), F.col("top").alias("root")
    )
    whole = found.join(upper, F.col("lang").eqNullSafe(F.col("_lang")))
    path = F.concat("path", "_path")
    siblings = F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.coalesce("changed", "leaf"), path)
    return whole.select(
        "doc_id", "leaf", F.col("top").alias("subroot"), "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
