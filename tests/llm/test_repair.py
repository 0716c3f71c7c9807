"""Conversation repair against all edits, a plain walk over whole tables, and the SQL."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

from archivelake.llm import queries, repair

NAME = "op11_conversation_repair"
SCHEMA = "conv_id long, turn long, role string, text string"
INITIALS = re.compile("(s?(ua)+)?")


def every_way(letters):
    """(cost, edits, initials) of all edits with at most two insertions in a place."""
    ways = [(0, "", "")]
    for k in range(len(letters) + 1):
        ways = [(c + 2 * len(add), e + "I" * len(add), r + "".join(add))
                for c, e, r in ways for n in range(3) for add in itertools.product("ua", repeat=n)]
        if k == len(letters):
            break
        letter = letters[k]
        cut = int(letter.isupper())
        out = []
        for c, e, r in ways:
            out.append((c + 3, e + "D", r))
            if letter != "-":
                out.append((c + cut, e + "K", r + letter.lower()))
                out += [(c + cut + 2, e + "R", r + x) for x in "ua"]
        ways = [w for w in out if re.fullmatch("s?(ua)*u?", w[2])]
    return min((c, e) for c, e, r in ways if INITIALS.fullmatch(r))


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_search_equals_all_edits(n):
    for letters in itertools.product(repair.LEAST, repeat=n):
        assert repair.whole_search("".join(letters)) == every_way("".join(letters))


def test_longer_searches_equal_all_edits():
    rng = random.Random(5)
    for _ in range(25):
        letters = "".join(rng.choice("suaSUAx-") for _ in range(5))
        assert repair.whole_search(letters) == every_way(letters)


def plain_best(letters):
    """Cheapest edits by recursion from the end, for conversations of any length."""

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        ways = [(0, "")] if i == len(letters) and state in "ea" else []
        given = "a" if state == "u" else "u"
        if inserted < 2:
            ways.append((2, "I", i, given, inserted + 1))
        if i < len(letters):
            letter, cut = letters[i].lower(), int(letters[i].isupper())
            ways.append((3, "D", i + 1, state, 0))
            if letter != "-":
                ways.append((2 + cut, "R", i + 1, given, 0))
                if (state, letter) in {("e", "s"), ("e", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    ways.append((cut, "K", i + 1, letter, 0))
        ways = [(w[0] + best(*w[2:])[0], w[1] + best(*w[2:])[1]) if len(w) > 2 else w for w in ways]
        return min(ways, default=(10**9, ""))

    import sys

    before = sys.getrecursionlimit()
    sys.setrecursionlimit(100_000)
    try:
        return best(0, "e", 0)
    finally:
        sys.setrecursionlimit(before)


def plain(rows):
    """Every column of the query, one conversation after the other."""
    convs = {}
    for r in rows:
        convs.setdefault(r.conv_id, []).append(r)
    out = []
    for conv, turns in convs.items():
        kept = []
        for r in turns:
            role, text = (" " if v is None else v for v in (r.role, r.text))
            name = ":".join(" " if v is None else str(v) for v in (r.conv_id, r.turn))
            fate = zlib.crc32(name.encode()) % 20
            if fate == 0:
                continue
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            role = "user" if fate == 4 else role
            item = ((r.turn is not None, r.turn or 0), role, hashlib.sha256(text.encode()).hexdigest(), text)
            kept += [item] * (2 if fate == 3 else 1)
        kept.sort()
        faults, seen, letters = [], set(), ""
        for _, role, _, text in kept:
            core = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            letters += "-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        numbers = {k[0][1] for k in kept if k[0][0]}
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(kept)]
        cost, edits = plain_best(letters)
        lines, state, at = [], "e", 0
        for e in edits:
            if e in "IR":
                state = "a" if state == "u" else "u"
                text = "" if e == "I" else kept[at][3]
                lines.append({"u": "user", "a": "assistant"}[state] + ":" + text)
            elif e == "K":
                state = kept[at][1][:1]
                lines.append(kept[at][1] + ":" + kept[at][3])
            at += e != "I"
        out.append((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
                    *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, edits,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, folder):
    return sorted(map(tuple, queries.QUERIES[NAME](spark, folder).collect()), key=repr)


def sql_rows(folder):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    return sorted(connection.execute(queries.ORACLES[NAME]).fetchall(), key=repr)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_whole_table(spark, size):
    folder = f"/root/testdata/{size}"
    found = got(spark, folder)
    assert found == plain(spark.read.parquet(f"{folder}/conversations.parquet").collect())
    assert found == sql_rows(folder)


@pytest.fixture
def odd_turns(spark):
    """Nulls everywhere, no role, equal turns and rows, spaces of other kinds, other roles."""
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, 2, "user", "a "),
        (2, None, None, "x"), (2, None, None, "x"), (2, 4, "", "y."), (2, 5, "", "y."), (2, 9, "assistant", "z?\n\x0b "),
        (None, 0, "user", "Q?"), (None, 1, "assistant", "A!"), (None, None, "assistant", "A!"), (None, None, None, None),
        (3, 0, "system", "s."), (4, 7, "tool", "t"), (4, 8, "User", "t."), (5, 0, "user", " \t\n\x0b\x0c\r"),
        (6, 0, "user", "long " * 30_000), (6, 1, "assistant", "long " * 30_000 + "."), (7, 2, "ünknown", "é."),
        (8, -3, "user", "a."), (8, 10**12, "assistant", "b."),
    ]
    return spark.createDataFrame(rows + [(9, k, None, "x.") for k in range(20)], SCHEMA)


def test_odd_rows(odd_turns, store, spark):
    folder = store(conversations=odd_turns.selectExpr("*", "1 AS copies", "2 AS fault", "3 AS part", "4 AS _conv"))
    assert got(spark, folder) == plain(odd_turns.collect())
    assert got(spark, store(conversations=odd_turns.limit(0))) == []


def test_all_rows_dropped(spark, store):
    hit = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    folder = store(conversations=spark.createDataFrame([(hit, 0, "user", "x")], SCHEMA))
    assert got(spark, folder) == [(hit, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversations(spark, store, monkeypatch):
    """Conversations of many pieces over many ranges equal the search over all turns."""
    rng = random.Random(3)
    rows = []
    for conv in range(6):
        for k in range([3, 700, 33, 150, 64, 1][conv]):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool"])
            text = rng.choice(["", f"t{k}.", f"t{k}", "again.", f"u{k}!", f"v{k}."])
            rows.append((conv, k // 3 if conv == 3 else k, role, text))
    folder = store(conversations=spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got(spark, folder) == plain(spark.read.parquet(f"{folder}/conversations.parquet").collect())


def test_one_row_many_times(spark, store):
    rows = [(1, 0, "user", "Same.")] * 500 + [(1, 1, "assistant", "Yes.")]
    folder = store(conversations=spark.createDataFrame(rows, SCHEMA))
    assert got(spark, folder) == plain(spark.read.parquet(f"{folder}/conversations.parquet").collect())
