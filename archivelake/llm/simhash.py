"""Near-duplicates by SimHash fingerprints and Golay-code fuzzy keys.

Two fingerprints link when at most two of their 64 bits differ. The bits are cut
into segments of 23, 23 and 18. Of two linked fingerprints at least one segment is
equal, and the segment after it differs in at most two bits. Words of 23 bits at
most two apart have a word between them at most one away from both; the perfect
(23,12) Golay code gives that word one codeword. So every fingerprint gets, for
each segment, its exact value together with the codewords of all words within one
bit of the next segment - one or six of them - and linked fingerprints always
share such a key. Candidates meet on the keys and are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivelake.llm.base import free_name, released
from archivelake.operators.skew import salted_lookup, with_group_totals
from archivelake.operators.threads import components
from archivelake.session import durable

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
#: (shift, width) of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the binary Golay code (23,12): fixed value.
GENERATOR = 0b110001110101

#: Key groups up to this size are compared pair by pair; larger ones are linked
#: through the 65 words within one bit of each member, which finds the same links.
PAIRWISE = 64

_CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of a whole UTF-8 text: a bit is set in over half the shingles.

    A-Z is lowered; words are runs without ASCII white space; a text of fewer words
    than a shingle is one shingle, a text without words has fingerprint zero.
    """
    import xxhash

    found = (text or b"").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(SHINGLE_WORDS, len(found)) - 1
    ends, starts = ends[last:], starts[:len(starts) - last]
    votes = np.zeros(64, np.int64)
    for low in range(0, len(starts), _CHUNK):
        spans = zip(starts[low:low + _CHUNK].tolist(), ends[low:low + _CHUNK].tolist(), strict=True)
        hashes = np.fromiter(
            map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in spans], repeat(SEED)), np.uint64
        )
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp): the text's hash and its fingerprint, both signed longs.

    A null text has no words.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(found.view(np.int64))],
                names=["doc_id", "text_key", "fp"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
        F.col("text").cast("binary").alias("text"),
    )
    return rows.mapInArrow(released(task), "doc_id long, text_key long, fp long")


def _remainders(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words after division by the generator polynomial."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
    return words


@lru_cache(maxsize=1)
def _errors() -> np.ndarray:
    """Error pattern of at most three bits for each of the 2048 remainders."""
    one = [1 << i for i in range(23)]
    two = [a | b for i, a in enumerate(one) for b in one[:i]]
    three = [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    patterns = np.array([0, *one, *two, *three], np.int64)
    table = np.zeros(2048, np.int64)
    table[_remainders(patterns)] = patterns
    return table


def decode(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word (at most 3 bits away)."""
    return (words ^ _errors()[_remainders(words)]) >> 11


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint; keys are non-negative longs."""
    bits = fps.view(np.uint64)
    parts = [(bits >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64) for shift, width in SEGMENTS]
    rows, keys = [], []
    for i, exact in enumerate(parts):
        j = (i + 1) % len(parts)
        flips = np.array([0, *(1 << b for b in range(SEGMENTS[j][1]))], np.int64)
        near = np.sort(decode((parts[j][:, None] ^ flips).ravel()).reshape(len(fps), len(flips)), axis=1)
        first = np.ones_like(near, bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        row, column = np.nonzero(first)
        rows.append(row)
        keys.append(i << 35 | exact[row] << 12 | near[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.asarray(batch.column("fp"))
            row, key = fuzzy_keys(values)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(values[row])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(released(task), "key long, fp long")


def links(fps: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """(a, b), b < a: links that connect all fingerprints at most two bits apart.

    `fps` holds distinct fingerprints. In key groups of up to `pairwise` members every
    pair is compared. Members of larger groups are dealt to the words within one bit
    of them: fingerprints at most two bits apart share such a word, and the at most 65
    fingerprints around a word are all linked, so each is tied to the least of them.
    """
    keyed = durable(_keyed(fps))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, "key")
    small = shared.where(F.col("n") <= pairwise)
    left = small.select("key", F.col("fp").alias("b"))
    right = small.select("key", F.col("fp").alias("a"))
    close = (F.col("b") < F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    pairs = left.join(right, (left.key == right.key) & close).select("a", "b")

    crowded = shared.where(F.col("n") > pairwise).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    around = crowded.select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word")
    )
    least = F.min("fp").over(Window.partitionBy("word"))
    stars = around.select(F.col("fp").alias("a"), least.alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """(doc_id, text_key, fp, component_id, first) of every row of (doc_id, text).

    `component_id` is the least doc_id that links reach, and null only if every
    reachable doc_id is null. `first` marks the component's row of least doc_id, then
    least text_key; repeated rows share the mark. Equal texts, nulls and empty texts
    included, always share a component. Copies are one fingerprint from the first step
    on, so groups of copies of any size cost no more than one text.
    """
    hashed = durable(fingerprints(docs))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    fps = durable(hashed.groupBy("fp").agg(F.min(rank).alias("least")))
    roots = components(links(fps, pairwise)).select(F.col("node").alias("fp"), "root")
    rooted = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labelled = with_group_totals(rooted, ["root"], {"best": (F.col("least"), "min")}, spread_on="fp")
    met = salted_lookup(hashed, labelled.select("fp", "best"), ["fp"], spread_on="doc_id")
    return met.select(
        "doc_id", "text_key", "fp", F.col("best.doc_id").alias("component_id"), (F.col("best") == rank).alias("first")
    )


def keep_first(docs: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """Documents without near duplicates: the first of every component, once.

    All columns of `docs` are kept. Texts are shuffled once, to meet the decisions.
    """
    own = free_name(docs, "_row")
    an_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keys = [f"{own}_id", f"{own}_text"]
    first = near_duplicates(docs, pairwise).where("first").select(an_id, F.col("text_key")).toDF(*keys).distinct()
    keyed = docs.withColumns(dict(zip(keys, (an_id, F.xxhash64("text")), strict=True)))
    return keyed.join(first, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def hex_fingerprint(fp: str = "fp"):
    """The fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
