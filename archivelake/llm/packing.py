"""Documents packed into as few fixed-size sequences as can be found.

Pieces are counted per length first. Lengths are at most the capacity, so the
plan - which lengths share a sequence, and how many such sequences there are - is
made from that bounded histogram, whatever the number of pieces:

1. Reduction by Martello and Toth's dominance criterion: a set of at most three
   pieces that dominates every other set with its largest piece is fixed for good.
2. Best fit, longest first, of what remains.

Spark then numbers the pieces of each length and looks their place up in the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivelake.llm import tokens
from archivelake.llm.base import prepare, released
from archivelake.session import durable

CAPACITY = 2048
END_ID = 0

#: One kind of sequence: (number of sequences, [(length, pieces of it), ...]).
Pattern = tuple[int, list[tuple[int, int]]]


def token_pieces(
    docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document.

    A document is its ids and the end id, so an empty or null text is one piece of
    length 1. Only documents longer than the capacity are cut; equal doc_ids are
    documents of their own.
    """
    prepare(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokens.encoder(path)
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows: dict[str, list] = defaultdict(list)
            found = codec.ids(batch.column("text").to_pylist())
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                ids = np.concatenate([own.astype("<u4"), end])
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    for name, value in (("doc_id", doc_id), ("piece", piece), ("start", start),
                                        ("length", len(part)), ("ids_crc32", zlib.crc32(part.tobytes()))):
                        rows[name].append(value)
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows)
                )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(task), schema)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fixed patterns, and the counts that remain.

    For the longest piece s not yet tried, with room r = capacity - s, a set is fixed
    when every other set holding s can be split into parts that fit into the fixed
    set's pieces, which cannot raise the number of sequences:

    - {s}, if the shortest piece does not fit into r;
    - {s, t} with t the longest fitting into r, if t fills r, or if no two pieces fit
      into r, or if no three do and t is at least the best sum of two;
    - {s, t, u} with t the longest fitting and u the longest fitting beside it, if no
      four pieces fit into r, s + t + u is full and u is the longest that can stand
      beside any other choice.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    fixed: list[Pattern] = []

    def take(pattern: list[int]) -> None:
        need: dict[int, int] = defaultdict(int)
        for s in pattern:
            need[s] += 1
        times = min(left[s] // k for s, k in need.items())
        fixed.append((times, sorted(need.items(), reverse=True)))
        for s, k in need.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
                sizes.pop(bisect.bisect_left(sizes, s))

    def longest(room: int, used: list[int]) -> int | None:
        """Longest length within `room` of which a piece is left beside those used."""
        at = bisect.bisect_right(sizes, room) - 1
        while at >= 0 and left[sizes[at]] <= used.count(sizes[at]):
            at -= 1
        return sizes[at] if at >= 0 else None

    def shortest(n: int, used: list[int]) -> list[int]:
        out: list[int] = []
        for s in sizes:
            while len(out) < n and left[s] > used.count(s) + out.count(s):
                out.append(s)
            if len(out) == n:
                break
        return out

    def best_two(room: int, used: list[int]) -> int:
        """Largest sum of two pieces within `room`, by two pointers."""
        low, high, best = 0, bisect.bisect_right(sizes, room) - 1, 0
        while low <= high:
            a, b = sizes[low], sizes[high]
            have = left[b] - used.count(b)
            if a + b > room or have < 1:
                high -= 1
            elif left[a] - used.count(a) < 1 or (a == b and have < 2):
                low += 1
            else:
                best = max(best, a + b)
                low += 1
        return best

    def dominant(s: int) -> list[int] | None:
        room = capacity - s
        t = longest(room, [s])
        if t is None:
            return [s]
        low = shortest(4, [s])
        if t == room or len(low) < 2 or low[0] + low[1] > room:
            return [s, t]
        if (len(low) < 3 or sum(low[:3]) > room) and t >= best_two(room, [s]):
            return [s, t]
        if len(low) >= 4 and sum(low) <= room:
            return None
        u = longest(room - t, [s, t])
        if u is not None and s + t + u == capacity and (len(low) < 3 or sum(low[:3]) > room):
            # Every other pair beside s has its longer piece within t; its shorter one
            # must fit into u.
            rival = max((min(v, room - v) for v in sizes if low[0] <= v <= t and v <= room - low[0]), default=0)
            shorter = longest(min(rival, room // 2), [s])
            if shorter is None or shorter <= u:
                return [s, t, u]
        return None

    tried = capacity + 1
    while sizes:
        at = bisect.bisect_left(sizes, tried) - 1
        if at < 0:
            break
        s = sizes[at]
        found = dominant(s)
        if found is None:
            tried = s  # later fixes only take pieces away; those below s come next
        else:
            take(found)
            if s not in left:
                tried = s
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest first: every piece goes where it leaves the least room.

    All sequences with equal contents are one class, so equal pieces are placed
    together: the work depends on the number of lengths, not of pieces.
    """
    # room -> classes [sequences, contents]; contents are (length, pieces) runs.
    open_by_room: dict[int, list[list]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, n: int, contents: tuple) -> None:
        if n:
            if not open_by_room[room]:
                bisect.insort(rooms, room)
            open_by_room[room].append([n, contents])

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                per = capacity // s
                put(capacity - per * s, n // per, ((s, per),))
                if rest := n % per:
                    put(capacity - rest * s, 1, ((s, rest),))
                break
            room = rooms[at]
            have, contents = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms.pop(at)
            per = min(room // s, n)  # the fullest fit stays the fullest until s does not fit
            times = min(have, n // per)
            put(room - per * s, times, (*contents, (s, per)))
            put(room, have - times, contents)
            n -= per * times
    return [(n, list(contents)) for room in rooms for n, contents in open_by_room[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold every piece of the histogram."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: pieces over half each need their own."""
    total = -(-sum(s * n for s, n in counts.items()) // capacity)
    return max(total, sum(n for s, n in counts.items() if 2 * s > capacity))


def _slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, number after the last, first sequence, pieces per sequence, offset)."""
    rows, numbered, first_sequence = [], defaultdict(int), 0
    for times, contents in patterns:
        offset = 0
        for s, k in contents:
            first = numbered[s]
            numbered[s] += times * k
            rows.append((s, first, numbered[s], first_sequence, k, offset))
            offset += s * k
        first_sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, piece_rows: int = 100_000) -> DataFrame:
    """Add `sequence_id` and `offset` to pieces with a `length` of 1 to `capacity`.

    `pieces` needs doc_id and piece, and is read several times: pass a stored table.
    Rows of one length may be most of the table, so they are numbered in parts of
    about `piece_rows` rows: within (length, part), then by the sizes of the parts.
    Equal rows are interchangeable. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    histogram = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = max(1, sum(histogram.values()) // piece_rows)
    slots = _slots(plan(histogram, capacity))
    names = "_length long, _low long, _high long, _sequence long, _per long, _offset long"
    # At most a few rows per length: bounded by the capacity, not by the data.
    where = F.broadcast(spark.createDataFrame(slots or [], names))

    cut = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    in_part = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", *[
        c for c in ("start", "ids_crc32") if c in pieces.columns
    ])
    sizes = cut.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    skip = sizes.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    numbered = (
        cut.withColumn("_rank", F.row_number().over(in_part) - 1)
        .join(skip, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_skip"))
    )
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    nth = F.col("_rank") - F.col("_low")
    return numbered.join(where, here).select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(nth / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (nth % F.col("_per")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """Tokenise, cut and pack whole documents; the pieces are stored once between."""
    return pack(durable(token_pieces(docs, capacity, path, end_id)), capacity)
