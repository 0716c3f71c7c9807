"""Document fingerprints by MinHash.

A text's shingles are runs of five words (A-Z lowered, parted by ASCII white space),
hashed to 64 bits. Each of 128 universal hash functions keeps its least value over the
shingles, and 16 bits of each make the fingerprint: the share of equal parts of two
fingerprints estimates the Jaccard likeness of the shingle sets. All of it is numpy
over whole batches of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivelake.llm import wordhash
from archivelake.llm.base import released
from archivelake.operators.skew import salted_lookup
from archivelake.session import durable

SHINGLE_WORDS = 5
FUNCTIONS = 128
SEED = 7
#: Bands of this many values: texts of likeness 0.8 miss all 25 once in 20,000 pairs.
BAND_ROWS = 5
THRESHOLD = 0.8
#: Band groups up to this size are compared pair by pair; the texts of larger ones meet
#: on their rarest shingles.
PAIRWISE = 64

#: Shingle hashes that the functions are applied to at once.
_SHINGLES = 1 << 17


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes; factors and summands of the hash functions."""
    rng = np.random.default_rng(SEED)
    factors, summands = rng.integers(0, (1 << 64) - 1, (2, FUNCTIONS), dtype=np.uint64, endpoint=True)
    return wordhash.byte_values(SEED), factors | np.uint64(1), summands


def _word_hashes(data: bytes) -> np.ndarray:
    """Hash of every word of UTF-8 text, A-Z lowered."""
    if len(data) > wordhash.CHUNK:  # a word longer than a chunk
        found = hashlib.blake2b(data.lower().strip(), digest_size=8).digest()
        return np.frombuffer(found, "<u8")
    raw = np.frombuffer(data, np.uint8)
    low = raw + (((raw >= 65) & (raw <= 90)) << 5).astype(np.uint8)
    return wordhash.span_hashes(low, *wordhash.word_spans(raw), _tables()[0])


def _shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SHINGLE_WORDS words; of all words if there are fewer."""
    if not len(hashes):
        return hashes
    size = min(SHINGLE_WORDS, len(hashes))
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        total = total * np.uint64(wordhash.BASE) + hashes[k:len(hashes) - size + 1 + k]
    return wordhash.mix(total + np.uint64(size))


def shingle_hashes(text: str) -> np.ndarray:
    """Shingle hashes of a whole text, repeats included."""
    return _shingles(np.concatenate([_word_hashes(p) for p in wordhash.parts(text.encode())]))


def signatures(texts: list[str]) -> np.ndarray:
    """Fingerprint, 128 values of 16 bits, of each text.

    Texts without words share one fingerprint, and equal texts always do.
    """
    _, factors, summands = _tables()
    out = np.full((len(texts), FUNCTIONS), 0xFFFF, np.uint16)
    group: list[np.ndarray] = []
    members: list[int] = []
    held = 0

    def flush() -> None:
        if not members:
            return
        found = np.concatenate(group)
        at = np.cumsum([0, *(len(g) for g in group[:-1])])
        least = np.empty((len(members), FUNCTIONS), np.uint64)
        for k in range(FUNCTIONS):
            least[:, k] = np.minimum.reduceat(found * factors[k] + summands[k], at)
        # The top bits of a minimum are nearly all zero: mix before taking 16.
        out[members] = wordhash.mix(least) >> np.uint64(48)

    for i, text in enumerate(texts):
        found = shingle_hashes(text)
        if len(found):
            group.append(found)
            members.append(i)
            held += len(found)
        if held > _SHINGLES:
            flush()
            group, members, held = [], [], 0
    flush()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal values of fingerprints."""
    return (a == b).mean(axis=-1)


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the next text's beginning."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double"
)


def _compared(doc_ids: list, texts: list[str], own: np.ndarray, following: list[str], theirs: np.ndarray) -> pa.RecordBatch:
    """Result rows of texts and the texts that come next."""
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    new = signatures(changed)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(doc_ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        "fingerprint": pa.array([f.tobytes() for f in own], pa.binary()),
        "edited_fingerprint": pa.array([f.tobytes() for f in new], pa.binary()),
        "near_edited": pa.array(likeness(own, new), pa.float64()),
        "near_next": pa.array(likeness(own, theirs), pa.float64()),
    })


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    The next document is the one before it by doc_id, that of the first is the last;
    equal ids stand by text, rows without an id after all others, a null text counts as
    empty, and a single document is its own next.

    Texts are shuffled once, by ranges of doc_id, and each task walks its rows in order.
    Only the last row of a range needs a row of another: both are set aside with their
    text, two rows per range, and are matched afterwards.
    """

    def record(rows: pa.RecordBatch, kind: str, first: int | None) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * n, pa.string()), pa.array([first] * n, pa.int64()), pa.array([None] * n, pa.string()),
             *rows.columns], names=["kind", "range", "text", *rows.schema.names],
        )

    def aside(kind: str, first: int, doc_id: int | None, text: str, fp: np.ndarray) -> pa.RecordBatch:
        row = {"kind": [kind], "range": [first], "text": [text], "doc_id": pa.array([doc_id], pa.int64()),
               "n_chars": pa.array([len(text)], pa.int64()), "edited_sha256": pa.array([None], pa.string()),
               "fingerprint": [fp.tobytes()], "edited_fingerprint": pa.array([None], pa.binary()),
               "near_edited": pa.array([None], pa.float64()), "near_next": pa.array([None], pa.float64())}
        return pa.RecordBatch.from_pydict(row)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            own = signatures(texts)
            if held is None:
                first = batch.column("range")[0].as_py()
                yield aside("head", first, ids[0], texts[0], own[0])
            else:
                ids, texts, own = [held[0], *ids], [held[1], *texts], np.vstack([held[2], own])
            if len(ids) > 1:
                yield record(_compared(ids[:-1], texts[:-1], own[:-1], texts[1:], own[1:]), "row", None)
            held = ids[-1], texts[-1], own[-1]
        if held is not None:
            yield aside("tail", first, *held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last()]
    ranged = rows.repartitionByRange(order[0]).sortWithinPartitions(*order)
    numbered = ranged.withColumn("range", F.spark_partition_id().cast("long"))
    found = durable(numbered.mapInArrow(released(task), f"kind string, range long, text string, {_RESULT}"))

    heads = found.where("kind = 'head'").select(
        F.col("range").alias("next_range"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp")
    )
    # Two numbers per range: ranges follow each other by number.
    ranges = found.where("kind = 'head'").select("range")
    over = Window.orderBy("range")
    ring = ranges.select("range", F.coalesce(
        F.lead("range").over(over), F.min("range").over(Window.partitionBy())
    ).alias("next_range"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, theirs = [
                    np.stack([np.frombuffer(f, np.uint16) for f in batch.column(c).to_pylist()])
                    for c in ("fingerprint", "next_fp")
                ]
                texts, following = [batch.column(c).to_pylist() for c in ("text", "next_text")]
                yield _compared(batch.column("doc_id").to_pylist(), texts, own, following, theirs)

    tails = found.where("kind = 'tail'").select("range", "doc_id", "text", "fingerprint")
    met = tails.join(ring, "range").join(heads, "next_range")
    last = met.select("doc_id", "text", "fingerprint", "next_text", "next_fp").mapInArrow(finish, _RESULT)
    return found.where("kind = 'row'").drop("kind", "range", "text").unionByName(last)


def _rare_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, of all rows of (text_id, shingles) whose likeness can be `threshold`.

    Two sets of likeness t have at least t of each in common, so with shingles in one
    order for all they share one of the first n - ceil(t n) + 1 of either. Rare ones come
    first, so what many texts have in common seldom counts. The holders of a shingle that
    more than PAIRWISE texts begin with are dealt to several tasks on one side.
    """
    each = sets.select("text_id", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("often"))
    ranked = salted_lookup(each, often, ["shingle"], spread_on="text_id").groupBy("text_id").agg(
        F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("ranked")
    )
    n = F.size("ranked")
    # A little is taken off, so that rounding can only lengthen the beginning.
    reach = (n - F.ceil(n * F.lit(threshold) - F.lit(1e-6)) + 1).cast("int")
    begun = durable(ranked.select("text_id", n.alias("n"), F.explode(
        F.transform(F.slice("ranked", 1, reach), lambda x: x["shingle"])
    ).alias("shingle")))
    shares = begun.groupBy("shingle").agg(
        F.ceil(F.count("*") / PAIRWISE).cast("int").alias("shares"), F.count("*").alias("met")
    ).where("met > 1").drop("met")
    dealt = salted_lookup(begun, shares, ["shingle"], spread_on="text_id")
    left = dealt.select(
        "shingle", F.pmod(F.xxhash64("text_id"), F.col("shares")).cast("int").alias("share"),
        F.col("text_id").alias("a"), F.col("n").alias("n_a"),
    )
    right = dealt.select(
        "shingle", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
        F.col("text_id").alias("b"), F.col("n").alias("n_b"),
    )
    alike = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(threshold) - F.lit(1e-6)
    return left.join(right, ["shingle", "share"]).where(F.col("a") < F.col("b")).where(alike).select("a", "b")


def near_links(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Links between different texts whose shingle sets have a Jaccard likeness of
    `threshold`, and the text every document has.

    Returns (a, b, jaccard) with a < b, ids of texts, and (doc_id, text_id); a text's id
    is the hash of it, so copies meet in one text before anything is compared. Texts
    meet in bands of their fingerprints. Groups of up to PAIRWISE texts are compared
    pair by pair; the texts of all larger ones meet on their rarest shingles, which finds
    every link among them. Every link is verified on the full sets of shingle hashes.
    """
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("text_id", F.xxhash64("text"))
    texts = keyed.groupBy("text_id").agg(F.first("text").alias("text"))
    n_bands = FUNCTIONS // BAND_ROWS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [t or "" for t in batch.column("text").to_pylist()]
            values = signatures(own)[:, :n_bands * BAND_ROWS].reshape(len(own), n_bands, BAND_ROWS).astype(np.uint64)
            keys = np.zeros((len(own), n_bands), np.uint64)
            for k in range(BAND_ROWS):
                keys = wordhash.mix(keys * np.uint64(wordhash.BASE) + values[:, :, k] + np.uint64(1))
            keys ^= wordhash.mix(np.arange(n_bands, dtype=np.uint64))
            yield pa.RecordBatch.from_pydict({
                "text_id": batch.column("text_id"),
                "bands": pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                "shingles": pa.array([np.unique(shingle_hashes(t)).view(np.int64) for t in own], pa.list_(pa.int64())),
            })

    signed = durable(texts.mapInArrow(released(task), "text_id long, bands array<long>, shingles array<long>"))
    banded = signed.where(F.size("shingles") > 0).select("text_id", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("text_id").alias("least")).where("n > 1")
    shared = banded.join(sizes, "band")
    small = shared.where(F.col("n") <= PAIRWISE)
    left, right = small.select("band", F.col("text_id").alias("a")), small.select("band", F.col("text_id").alias("b"))
    pairs = left.join(right, "band").where("a < b").select("a", "b")
    sets = signed.select("text_id", "shingles")
    crowded = shared.where(F.col("n") > PAIRWISE).select("text_id").distinct()
    rare = _rare_pairs(sets.join(crowded, "text_id"), threshold)
    candidates = pairs.union(rare).distinct()
    both = candidates.join(sets.toDF("a", "_a"), "a").join(sets.toDF("b", "_b"), "b")
    common = F.size(F.array_intersect("_a", "_b"))
    jaccard = common / (F.size("_a") + F.size("_b") - common)
    links = both.select("a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold)
    return links, keyed.select("doc_id", "text_id")
