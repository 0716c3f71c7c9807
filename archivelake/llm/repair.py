"""Repair of conversation structure: the cheapest edits that give a legal turn order.

A legal conversation is empty, or an optional system turn and then user and assistant
turns by turns, ending with the assistant. A turn may be kept (K), given the role of
user or assistant (R), or deleted (D), and empty turns may be inserted (I). Blank turns
and repetitions have to go; a truncated turn that stays costs something.

The cheapest edits are found by iterative-deepening A*: a depth-first search tries the
edits in ASCII order and gives up a branch whose cost and lower bound exceed the bound;
the next bound is the least cost that exceeded this one. States that failed are kept in
a table with what they are known to cost at least. So the first path that is accepted
is the cheapest one, and the first of those in ASCII order.

Turns are reduced to one letter each for the search. They are dealt to ranges by
conversation and turn and cut into pieces of 32 turns. Nearly every conversation is a
single piece, which is searched and read out on the spot. The pieces of longer ones are
searched for every state before and after them, a chain over those costs picks the
states, and the texts are hashed piece after piece as they stream by.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from archivelake.llm.base import released
from archivelake.operators.skew import with_group_totals
from archivelake.session import durable

#: Turns of a piece. A search is as deep as a piece has turns and insertions.
PIECE = 32
#: No more turns are inserted in one place: two come back to the same expected role.
INSERTS = 2

DELETE, INSERT, REROLE = 3, 2, 2
#: States: nothing kept yet, after a system, a user and an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = (EMPTY, SYSTEM, USER, ASSISTANT)
ACCEPTED = frozenset((EMPTY, ASSISTANT))
#: The state after a kept turn, by state and initial of the role.
KEEP = {
    (EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
#: The state after an inserted turn or one with a new role, and that role.
GIVEN = {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL_PAIRS = frozenset(("su", "ua", "au"))

#: A turn's letter: the initial of its role (x: no legal one), upper case if it is
#: truncated, or a dash if it has to go. Its value is the least that the turn costs.
LEAST = {"-": DELETE, "s": 0, "u": 0, "a": 0, "x": REROLE, "S": 1, "U": 1, "A": 1, "X": REROLE + 1}


def search(letters: str, start: int, goals: frozenset[int], at_end: bool) -> tuple[int, str] | None:
    """Cost and edits of the cheapest path from `start` to a goal, the ASCII-least one.

    `at_end` allows insertions after the last turn. None if no path leads to a goal.
    """
    n = len(letters)
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + LEAST[letters[i]]
    known: dict[tuple[int, int, int], float] = {}
    path: list[str] = []

    def edits(i: int, state: int, inserted: int) -> Iterator[tuple[str, int, int, int, int]]:
        """(letter, cost, next turn, state, insertions) in ASCII order of the letters."""
        letter = letters[i] if i < n else ""
        if letter:
            yield "D", DELETE, i + 1, state, 0
        if inserted < INSERTS and (letter or at_end):
            yield "I", INSERT, i, GIVEN[state], inserted + 1
        if letter and letter != "-":
            cut = int(letter.isupper())
            after = KEEP.get((state, letter.lower()))
            if after is not None:
                yield "K", cut, i + 1, after, 0
            yield "R", REROLE + cut, i + 1, GIVEN[state], 0

    def descend(i: int, state: int, inserted: int, budget: float) -> float:
        """What is left to pay at least; `path` is filled, backwards, if the budget does."""
        if i == n and state in goals:
            return 0
        key = (i, state, inserted)
        need = known.get(key, least[i])
        if need > budget:
            return need
        need = math.inf
        for letter, cost, *to in edits(*key):
            rest = descend(*to, budget - cost)
            if rest <= budget - cost:
                path.append(letter)
                return cost + rest
            need = min(need, cost + rest)
        known[key] = need
        return need

    bound: float = least[0]
    while bound < math.inf:
        need = descend(0, start, 0, bound)
        if need <= bound:
            return int(need), "".join(reversed(path))
        bound = need
    return None


@lru_cache(maxsize=20_000)
def whole_search(letters: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation of at most a piece."""
    found = search(letters, EMPTY, ACCEPTED, True)
    assert found is not None  # deleting every turn is always a way
    return found


@lru_cache(maxsize=2_000)
def piece_search(letters: str) -> tuple[tuple[int, int, int, str], ...]:
    """(state before, state after, cost, edits) of every way through a piece."""
    ways = []
    for a in STATES:
        for b in STATES:
            if b in (EMPTY, SYSTEM) and a not in (EMPTY, b):
                continue  # nothing leads back to the beginning
            found = search(letters, a, frozenset((b,)), False)
            if found:
                ways.append((a, b, *found))
    return tuple(ways)


#: How a conversation may end after its last turn, as the ways of a last, empty piece.
ENDINGS = tuple((a, a if a in ACCEPTED else ASSISTANT, *found) for a in STATES if (found := search("", a, ACCEPTED, True)))


def edited(edits: str, state: int, turns: list[tuple[str, str]]) -> tuple[list[str], int]:
    """The `role:text` lines that the edits give, and the state after them.

    `turns` are the (role, text) pairs of the turns that do not have to go; None stands
    for one that does.
    """
    lines, at = [], 0
    for letter in edits:
        if letter == "I":
            state = GIVEN[state]
            lines.append(f"{ROLES[state]}:")
            continue
        turn, at = turns[at], at + 1
        if letter == "D":
            continue
        role, text = turn
        if letter == "R":
            state = GIVEN[state]
            role = ROLES[state]
        else:
            state = KEEP[state, role[:1]]
        lines.append(f"{role}:{text}")
    return lines, state


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of `conversations` after a damage that their ids decide.

    By crc32 of "conv_id:turn" modulo 20 a row is dropped (0), emptied (1), robbed of its
    full stops, exclamation and question marks (2), repeated (3: `copies` is 2) or made
    a user's (4). A null is one space, also in the id.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20).alias("_fate"),
    ).where("_fate != 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("_fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fate") == 1, F.lit("")).when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("_fate") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _key(conv_id: str) -> Column:
    """The conversation as a text; rows without an id are one conversation."""
    return F.coalesce(F.col(conv_id).cast("string"), F.lit(""))


def marked(rows: DataFrame) -> DataFrame:
    """(_conv, conv_id, turn, role, text, digest, copies, fault) of distinct rows.

    `rows` has conv_id, turn, role, text (no nulls in the last two) and copies. `fault`
    is the first that applies: blank, duplicate (role and text were seen at an earlier
    turn of the conversation), truncated, or none. It is that of the first copy; any
    further copy of a row that is not blank is a duplicate.
    """
    told = rows.withColumn("_conv", _key("conv_id")).withColumn("digest", F.sha2("text", 256))
    # Equal rows stand side by side, so they are counted before anything is sorted.
    once = told.groupBy("_conv", "conv_id", "turn", "role", "digest").agg(
        F.first("text").alias("text"), F.sum("copies").alias("copies")
    ).withColumn("_when", F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at")))
    seen = with_group_totals(once, ["_conv", "role", "digest"], {"_first": (F.col("_when"), "min")}, ["_when"])
    ended = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(ended == "", "blank").when(F.col("_when") > F.col("_first"), "duplicate")
        .when(~ended.isin(".", "!", "?"), "truncated").otherwise("none")
    )
    return seen.withColumn("fault", fault).drop("_when", "_first")


_ANSWER = pa.schema(
    [("_conv", pa.string()), ("conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)
_WAY = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int32()), ("edits", pa.string())])
_PIECES = pa.schema([
    ("part", pa.int32()), ("seq", pa.int64()), ("whole", pa.bool_()), *_ANSWER, ("first", pa.string()), ("last", pa.string()),
    ("ways", pa.list_(_WAY)), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])


class _Piece:
    """Turns of one conversation that stand together."""

    def __init__(self, conv: str, conv_id: int | None) -> None:
        self.conv, self.conv_id = conv, conv_id
        self.letters: list[str] = []
        self.initials: list[str] = []
        self.turns: list[tuple[str, str] | None] = []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, role: str, text: str, fault: str) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        gone = fault in ("blank", "duplicate")
        self.initials.append(initial)
        self.letters.append("-" if gone else initial.upper() if fault == "truncated" else initial)
        self.turns.append(None if gone else (role, text))
        if fault != "none":
            self.faults[fault] += 1

    def row(self, part: int, seq: int, whole: bool) -> dict:
        letters = "".join(self.letters)
        pairs = zip(self.initials, self.initials[1:], strict=False)
        row = {
            "_conv": self.conv, "conv_id": self.conv_id, "part": part, "seq": seq, "whole": whole, **self.faults,
            "illegal": sum(a + b not in LEGAL_PAIRS for a, b in pairs), "first": self.initials[0],
            "last": self.initials[-1], "cost": None, "audit": None, "repaired_sha256": None, "ways": None,
            "roles": None, "texts": None,
        }
        if whole:
            row["cost"], row["audit"] = whole_search(letters)
            lines, _ = edited(row["audit"], EMPTY, self.turns)
            row["repaired_sha256"] = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        else:
            row["ways"] = [
                {"before": a, "after": b, "cost": cost, "edits": edits} for a, b, cost, edits in piece_search(letters)
            ]
            row["roles"] = [t[0] if t else None for t in self.turns]
            row["texts"] = [t[1] if t else None for t in self.turns]
        return row


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to pieces. A conversation is whole if others surround it here."""
    part = TaskContext.get().partitionId()
    ready: list[dict] = []
    piece: _Piece | None = None
    seq, alone = 0, False  # alone: the piece's conversation began in this range, with this piece
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("_conv", "conv_id", "role", "text", "copies", "fault")]
        for conv, conv_id, role, text, copies, fault in zip(*columns, strict=True):
            if piece is None or piece.conv != conv:
                if piece is not None:
                    ready.append(piece.row(part, seq, alone))
                alone, seq, piece = piece is not None, seq + 1, _Piece(conv, conv_id)
            for k in range(copies):
                if len(piece.letters) == PIECE:
                    ready.append(piece.row(part, seq, False))
                    alone, seq, piece = False, seq + 1, _Piece(conv, conv_id)
                    if len(ready) >= 100:
                        yield pa.RecordBatch.from_pylist(ready, _PIECES)
                        ready.clear()
                piece.add(role, text, fault if k == 0 or fault == "blank" else "duplicate")
        if ready:
            yield pa.RecordBatch.from_pylist(ready, _PIECES)
            ready.clear()
    if piece is not None:
        yield pa.RecordBatch.from_pylist([piece.row(part, seq, False)], _PIECES)


def pieces(rows: DataFrame) -> DataFrame:
    """The pieces of all conversations, with the answer of those that are one piece.

    Equal turns are ordered by role, then by the digest of the text. What stands first
    or last in its range may go on in the next one, so it is never taken for whole.
    """
    order = ["_conv", F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = marked(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(dealt.select("_conv", "conv_id", "role", "text", "copies", "fault").mapInArrow(released(_cut), from_arrow_schema(_PIECES)))


def chain(table: pd.DataFrame) -> pd.DataFrame:
    """The state before and after every piece of a conversation.

    Rows hold a way each: part, seq, before, after, cost and the rank of its edits
    among those of the piece. From one state, two ways' edits always differ before one
    of them ends, because insertions come before a turn and never last in a piece, so
    equal costs are settled by the ranks of a single piece.
    """
    places = sorted(set(zip(table["part"], table["seq"], strict=True)))
    by_place: dict[tuple, dict[int, list]] = {p: {} for p in places}
    for part, seq, before, after, cost, rank in table[["part", "seq", "before", "after", "cost", "rank"]].itertuples(index=False):
        by_place[part, seq].setdefault(before, []).append((cost, rank, after))
    left = {a: cost for a, _, cost, _ in ENDINGS}
    picks = []
    for place in reversed(places):
        now, pick = {}, {}
        for before, ways in by_place[place].items():
            possible = [(cost + left[after], rank, after) for cost, rank, after in ways if after in left]
            if possible:
                now[before], _, pick[before] = min(possible)
        left = now
        picks.append((place, pick))
    state, out = EMPTY, []
    for (part, seq), pick in reversed(picks):
        out.append((table["_conv"].iloc[0], part, seq, state, pick[state]))
        state = pick[state]
    return pd.DataFrame(out, columns=["_conv", "part", "seq", "before", "after"])


def _read_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and place, with their edits, to an answer each."""
    row: dict | None = None

    def answer() -> pa.RecordBatch:
        ending = next(e for e in ENDINGS if e[0] == state)
        lines, _ = edited(ending[3], state, [])
        for line in lines:
            add(line)
        row["cost"] += ending[2]
        audit.append(ending[3])
        return pa.RecordBatch.from_pylist(
            [row | {"audit": "".join(audit), "repaired_sha256": text_hash.hexdigest()}], _ANSWER
        )

    def add(line: str) -> None:
        nonlocal begun
        text_hash.update((("\n" if begun else "") + line).encode())
        begun = True

    for batch in batches:
        for p in batch.to_pylist():
            if row is None or row["_conv"] != p["_conv"]:
                if row is not None:
                    yield answer()
                row = {"_conv": p["_conv"], "conv_id": p["conv_id"], "cost": 0, "illegal": 0,
                       "blank": 0, "duplicate": 0, "truncated": 0}
                text_hash, begun, audit, state, last = hashlib.sha256(), False, [], EMPTY, None
            for c in ("blank", "duplicate", "truncated", "illegal"):
                row[c] += p[c]
            row["illegal"] += last is not None and last + p["first"] not in LEGAL_PAIRS
            last = p["last"]
            turns = [None if r is None else (r, t) for r, t in zip(p["roles"], p["texts"], strict=True)]
            lines, state = edited(p["edits"], p["before"], turns)
            for line in lines:
                add(line)
            row["cost"] += p["way_cost"]
            audit.append(p["edits"])
    if row is not None:
        yield answer()


def repaired(rows: DataFrame) -> DataFrame:
    """(_conv, conv_id, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) of every conversation in `rows` (conv_id, turn, role, text, copies).

    What a task holds: a piece's texts, of a conversation in several pieces the costs of
    at most 16 ways per 32 turns, and its edits, one letter per turn.
    """
    cut = pieces(rows)
    done = cut.where("whole").select(*_ANSWER.names)
    longer = cut.where("NOT whole")
    ranks = F.array_sort(F.array_distinct(F.col("ways.edits")))
    table = longer.select("_conv", "part", "seq", F.inline(F.transform("ways", lambda w: F.struct(
        w["before"].alias("before"), w["after"].alias("after"), w["cost"].alias("cost"),
        F.array_position(ranks, w["edits"]).cast("int").alias("rank"),
    ))))
    states = table.groupBy("_conv").applyInPandas(chain, "_conv string, part int, seq long, before int, after int")
    taken = F.filter("ways", lambda w: (w["before"] == F.col("before")) & (w["after"] == F.col("after")))[0]
    chosen = longer.join(states, ["_conv", "part", "seq"]).select(
        "_conv", "conv_id", "part", "seq", "before", "blank", "duplicate", "truncated", "illegal", "first", "last",
        "roles", "texts", taken["edits"].alias("edits"), taken["cost"].alias("way_cost"),
    )
    streamed = chosen.repartition("_conv").sortWithinPartitions("_conv", "part", "seq")
    return done.unionByName(streamed.mapInArrow(released(_read_out), from_arrow_schema(_ANSWER)))


def audit(turns: DataFrame) -> DataFrame:
    """Every conversation of `turns` (conv_id, turn, role, text), damaged and repaired.

    Returns conv_id, gaps (turn numbers missing between the least and the greatest),
    blank, duplicate, truncated, illegal (neighbours whose roles may not follow each
    other), cost, audit (the edits) and repaired_sha256. A conversation of which no row
    is left has zeros, no edits and the hash of an empty text. Null ids make one
    conversation, null turns come first and count for no gap, a null role or text is one
    space, and an empty role has no initial: it cannot be kept. Repeated rows stand side
    by side.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    rows = damaged(turns)
    numbers = rows.groupBy(_key("conv_id").alias("_conv"), "turn").agg(F.count("*").alias("_n")).groupBy("_conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps")
    )
    every = turns.groupBy(_key("conv_id").alias("_conv")).agg(F.max("conv_id").alias("conv_id"))
    found = every.join(numbers, "_conv", "left").join(repaired(rows).drop("conv_id"), "_conv", "left")
    counts = [
        F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    ]
    return found.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
