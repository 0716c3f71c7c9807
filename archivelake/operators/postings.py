"""Term index: build it, look into it, expand prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivelake.functions import diffs, ids, text
from archivelake.operators.skew import salted_lookup
from archivelake.session import short_batches

# Search field names and the index fields each one covers.
BODY = ["nonquoted", "dfn", "dfa", "dfb", "dfhh", "dfctx", "dfpre", "dfpost", "patchid"]
FIELDS = {
    "s": ["subject"], "m": ["mid_text"], "l": ["list_text"], "f": ["from"], "t": ["to"],
    "tc": ["to", "cc"], "c": ["cc"], "tcf": ["to", "cc", "from"], "a": ["to", "cc", "from"],
    "b": [*BODY, "quoted"], "bs": [*BODY, "quoted", "subject"], "n": ["filename"],
    "q": ["quoted"], "nq": BODY, "dfn": ["dfn"], "dfa": ["dfa"], "dfb": ["dfb"],
    "dfhh": ["dfhh"], "dfctx": ["dfctx"],
    "": ["mid_text", "subject", "from", "quoted", "filename", *BODY],
    "mid": ["mid"], "lid": ["lid"], "dfpre": ["dfpre"], "dfpost": ["dfpost"],
    "dfblob": ["dfpre", "dfpost"], "patchid": ["patchid"],
}
# Diff line kinds and the index field each one feeds.
DIFF_FIELDS = {
    "plain": "nonquoted", "file": "dfn", "added": "dfb", "removed": "dfa",
    "context": "dfctx", "hunk": "dfhh", "pre": "dfpre", "post": "dfpost",
}


# Blocks of one field are far apart, so no phrase runs from one into the next.
BLOCK_GAP = 1 << 24
PART_GAP = 10_000_000


def _field(df: DataFrame, field: str, value: Column, weight: int = 1, at: Column | None = None) -> DataFrame:
    place = F.lit(0) if at is None else at
    return df.select(
        "docid", F.lit(field).alias("field"), value.alias("value"),
        F.lit(weight).alias("weight"), place.cast("bigint").alias("at"),
    ).where("value is not null and value <> ''")


def text_fields(msgs: DataFrame) -> DataFrame:
    """(docid, field, value, weight, at) of the headers and body of plain messages.

    Quoted text gets weight 0: it can be found but does not raise the score.
    `at` orders the blocks of a field.
    """
    rows = [
        _field(msgs, name, F.col(name))
        for name in ("subject", "from", "to", "cc") if name in msgs.columns
    ]
    if "mid" in msgs.columns:
        long_words = F.array_join(ids.id_words(F.col("mid")), " ")
        rows.append(_field(msgs, "mid_text", F.col("mid")))
        rows.append(_field(msgs, "mid_text", long_words, at=F.lit(1)))
    if "body" in msgs.columns:
        short_batches(msgs.sparkSession)
        base = F.col("part_pos") * PART_GAP if "part_pos" in msgs.columns else F.lit(0)
        blocks = msgs.select(
            "docid", "body", base.alias("base"), F.explode(text.quote_blocks(F.col("body"))).alias("b")
        )
        is_diff = ~F.col("b.quoted") & diffs.looks_like_diff(F.col("b.text"))
        at = (F.col("base") + F.col("b.pos")).cast("bigint")
        rows.append(
            blocks.where(~is_diff).select(
                "docid",
                F.when(F.col("b.quoted"), "quoted").otherwise("nonquoted").alias("field"),
                F.col("b.text").alias("value"),
                F.when(F.col("b.quoted"), 0).otherwise(1).alias("weight"),
                at.alias("at"),
            )
        )
        # Diffs are classified line by line; other messages skip this branch.
        lines = blocks.where(diffs.looks_like_diff(F.col("body")) & is_diff).select(
            "docid", at.alias("at0"), F.explode(diffs.diff_lines(F.col("b.text"))).alias("l")
        )
        kinds = F.create_map(*[F.lit(x) for kv in DIFF_FIELDS.items() for x in kv])
        named = lines.select(
            "docid", F.try_element_at(kinds, F.col("l.kind")).alias("field"),
            F.col("l.value").alias("value"), F.lit(1).alias("weight"),
            (F.col("at0") + F.col("l.line")).cast("bigint").alias("at"),
        ).where("field is not null and value <> '' and field not in ('dfpre', 'dfpost')")
        rows.append(named)
    return reduce(DataFrame.unionByName, rows)


def part_fields(parts: DataFrame) -> DataFrame:
    """`text_fields` rows of exploded MIME parts.

    Names of attachments are indexed, and attached messages give their own ids
    and headers to the message that carries them.
    """
    text_rows = text_fields(
        parts.where("text is not null").select("docid", "part_pos", F.col("text").alias("body"))
    )
    at = F.col("part_pos") * PART_GAP
    names = _field(parts, "filename", F.col("filename"), at=at)
    attached = parts.where("is_submsg")
    head = F.split_part(F.decode("body", "UTF-8"), F.lit("\n\n"), F.lit(1))
    inner = [
        _field(attached, field,
               F.regexp_extract(head, "(?imd)^" + name + r":[ \t]*([^\r\n]*)", 1), at=at + 1)
        for field, name in (("subject", "subject"), ("from", "from"), ("to", "to"),
                            ("cc", "cc"), ("mid_text", "message-id"))
    ]
    return reduce(DataFrame.unionByName, [text_rows, names, *inner])


def _codes(column: pa.Array) -> np.ndarray:
    """A number per distinct value; null is -1."""
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _group_starts(rows: pa.Table) -> np.ndarray:
    """Rows where another (docid, field) begins; equal ones stand together."""
    if not rows.num_rows:
        return np.zeros(0, np.int64)
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for name in ("docid", "field"):
        codes = _codes(rows.column(name).combine_chunks())
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _grouped(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Postings of text blocks (docid, field, weight, at, words) of whole groups."""
    rows = rows.combine_chunks()
    starts = _group_starts(rows)
    lists = rows.column("words").combine_chunks()
    words = lists.flatten()
    if not len(words):
        return
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    block = np.repeat(np.arange(rows.num_rows), sizes)
    group = (np.searchsorted(starts, np.arange(rows.num_rows), side="right") - 1)[block]
    place = np.arange(len(words)) - (np.cumsum(sizes) - sizes)[block]
    at = rows.column("at").combine_chunks().to_numpy(zero_copy_only=False)
    weight = rows.column("weight").combine_chunks().to_numpy(zero_copy_only=False)
    terms = words.dictionary_encode()
    key = group * len(terms.dictionary) + terms.indices.to_numpy(zero_copy_only=False)
    pos = at[block] * BLOCK_GAP + place
    order = np.lexsort((pos, key))
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    yield pa.RecordBatch.from_arrays(
        [
            *[rows.column(c).combine_chunks().take(pa.array(starts[key[first] // len(terms.dictionary)])) for c in ("docid", "field")],
            terms.dictionary.take(pa.array(key[first] % len(terms.dictionary))),
            pa.array(np.add.reduceat(weight[block][order], first).astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(np.r_[first, len(key)].astype(np.int32)), pa.array(pos[order])),
        ],
        names=["docid", "field", "term", "wdf", "positions"],
    )


def _group_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of sorted text blocks; a group may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = pa.Table.from_batches([*(b.slice(b.num_rows - 1) for b in held[-1:]), batch])
        last = int(_group_starts(edge)[-1]) - (edge.num_rows - batch.num_rows)
        if last < 0 or (last == 0 and not held):
            held.append(batch)
            continue
        yield from _grouped(pa.Table.from_batches([*held, batch.slice(0, last)]))
        held = [batch.slice(last)]
    if held:
        yield from _grouped(pa.Table.from_batches(held))


def whole_postings(fields: DataFrame, parts: int | None = None) -> DataFrame:
    """`build_postings` of every word: a document's blocks meet once, as text.

    The words are grouped within the document, so no single word is shuffled, sorted or
    spilled. A task holds the words of one (docid, field) and of a short Arrow batch.
    Without `parts` Spark merges small partitions.
    """
    short_batches(fields.sparkSession)
    together = fields.repartition(*([parts] if parts else []), "docid", "field").sortWithinPartitions("docid", "field", "at")
    blocks = together.select("docid", "field", "weight", "at", text.words(F.col("value")).alias("words"))
    kind = fields.schema["docid"].dataType.simpleString()
    return blocks.mapInArrow(_group_blocks, f"docid {kind}, field string, term string, wdf bigint, positions array<bigint>")


def build_postings(
    fields: DataFrame, positions: bool = True, whole: bool = False, parts: int | None = None
) -> DataFrame:
    """Postings (docid, field, term, wdf, positions) of text fields.

    `positions=False` is the smaller index level that cannot match phrases. `whole` is for
    an index of which every posting is wanted; without it, conditions on terms reach the
    single words before they are grouped. `parts` is the number of partitions of a whole index.
    """
    if whole:
        found = whole_postings(fields, parts)
        return found if positions else found.drop("positions")
    tokens = fields.select(
        "docid", "field", "weight", "at",
        F.posexplode(text.words(F.col("value"))).alias("pos", "term"),
    ).withColumn("pos", F.col("at") * BLOCK_GAP + F.col("pos"))
    grouped = tokens.groupBy("docid", "field", "term")
    wdf = F.sum("weight").cast("long").alias("wdf")
    if not positions:
        return grouped.agg(wdf)
    return grouped.agg(wdf, F.array_sort(F.collect_list("pos")).alias("positions"))


def exact_terms(docs: DataFrame, field: str, values: Column, prefixes_to: int | None = None) -> DataFrame:
    """Postings of an exact-match field; blob ids also match by prefix."""
    one = F.explode(values).alias("term")
    rows = docs.select("docid", one).where("term is not null and term <> ''")
    if prefixes_to is not None:
        rows = rows.select("docid", F.explode(ids.id_prefixes(F.col("term"), prefixes_to)).alias("term"))
    return rows.distinct().select(
        "docid", F.lit(field).alias("field"), "term", F.lit(0).cast("long").alias("wdf"),
        F.array().cast("array<bigint>").alias("positions"),
    )


def altid_terms(message_ids: DataFrame, altid: DataFrame) -> DataFrame:
    """Exact postings of alternate serial numbers (field = prefix)."""
    joined = salted_lookup(
        message_ids.select("docid", "mid"),
        altid.groupBy("mid").agg(F.array_distinct(F.collect_list(F.struct("prefix", "num"))).alias("alts")),
        ["mid"], spread_on="docid",
    )
    return joined.select("docid", F.explode("alts").alias("a")).select(
        "docid", F.col("a.prefix").alias("field"), F.col("a.num").cast("string").alias("term"),
        F.lit(0).cast("long").alias("wdf"), F.array().cast("array<bigint>").alias("positions"),
    )


def document_lengths(postings: DataFrame) -> DataFrame:
    return postings.groupBy("docid").agg(F.sum("wdf").alias("doclen"))


def field_lengths(fields: DataFrame) -> DataFrame:
    """`document_lengths` straight from text fields: no term leaves its task."""
    size = F.size(text.words(F.col("value"))) * F.col("weight")
    return fields.groupBy("docid").agg(F.sum(size).cast("bigint").alias("doclen"))


def document_frequency(postings: DataFrame) -> DataFrame:
    """Documents and weighted occurrences of every (field, term)."""
    return postings.groupBy("field", "term").agg(
        F.count("*").alias("df"), F.sum("wdf").alias("wdf")
    )


def terms_of(postings: DataFrame, docid: int) -> DataFrame:
    """Sorted distinct terms of one document by field."""
    return postings.where(F.col("docid") == docid).groupBy("field").agg(
        F.array_sort(F.collect_set("term")).alias("terms")
    )


def distinct_terms(postings: DataFrame, field: str) -> DataFrame:
    return postings.where(F.col("field") == field).select("term").distinct().orderBy("term")


def expand_prefix(postings: DataFrame, prefix: str, fields: list[str]) -> DataFrame:
    """Distinct terms a trailing wildcard stands for."""
    found = postings.where(F.col("field").isin(fields) & F.col("term").startswith(prefix))
    return found.select("term").distinct()
