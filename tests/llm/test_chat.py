"""Chat formatting: round trip, loss mask, turn order, and the registered SQL."""

import hashlib

import duckdb
import pytest

from archivelake.llm import chat, queries

SF = "/root/testdata/sf0.001"
NAME = "op2_chat_formatting"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Digest per conversation, straight from the rows."""
    template = chat.Template()
    convs = {}
    for r in rows:
        convs.setdefault(r.conv_id, []).append(((r.turn is not None, r.turn or 0), r.role or "", r.text or ""))
    out = set()
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        chars = sum(len(template.open + template.middle + template.close) + len(role + text)
                    + sum(c in "\\#:<" for c in role + text) for _, role, text in turns)
        state, valid = chat.START, True
        for _, role, _ in turns:
            valid &= role in template.follows.get(state, ())
            state = role
        out.add((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                 hashlib.sha256(loss.encode()).hexdigest(), chars, valid and state == "assistant"))
    return out


EXTRA = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def check(spark, folder, rows):
    extra = spark.createDataFrame(EXTRA, SCHEMA).collect()
    got = [tuple(r) for r in queries.QUERIES[NAME](spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == plain([*rows, *extra])


def test_whole_table(spark):
    check(spark, SF, spark.read.parquet(f"{SF}/conversations.parquet").collect())


def test_registered_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = set(connection.execute(queries.ORACLES[NAME]).fetchall())
    assert {tuple(r) for r in queries.QUERIES[NAME](spark, SF).collect()} == want


@pytest.fixture
def odd_turns(spark):
    return spark.createDataFrame([
        (1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, None, "x"), (2, 1, "assistant", "### user: </turn>\n"),
        (3, None, "user", "no turn"), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "\\a\\\\b#:<" * 3000),
        (None, 5, "assistant", "no id"), (4, 4095, "user", "é漢😀"), (4, 4096, "assistant", "over\r\nthe span"),
        (4, 9000, "user", "</turn>"), (4, 9001, "assistant", "done"), (5, 0, "system", "s"), (5, 1, "user", "u"),
        (6, 0, "to:ol#", "strange role"),
    ], SCHEMA)


def test_odd_rows(spark, odd_turns, store):
    extended = odd_turns.withColumnRenamed("text", "text").selectExpr("*", "1 AS place", "2 AS _span")
    check(spark, store(conversations=extended), odd_turns.collect())


def test_empty_table(spark, odd_turns, store):
    check(spark, store(conversations=odd_turns.limit(0)), [])


def test_segments_make_up_the_formatted_text(spark, odd_turns):
    rendered = {r.conv_id: r.formatted for r in chat.render(chat.segments(odd_turns)).collect()}
    for r in chat.segments(odd_turns).collect():
        assert rendered[r.conv_id][r.start:r.start + len(r.segment)] == r.segment
        assert not r.loss or r.part == 1


def test_own_template(spark):
    template = chat.Template(
        open="[", middle="]", close="^", escape="~", learned=("user",), follows={chat.START: ("user",)}, ends=("user",)
    )
    turns = spark.createDataFrame([(1, 0, "user", "a^[b]~x"), (2, 0, "bot", "")], SCHEMA)
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.segments(turns, template), template), template).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "a^[b]~x")] and back[1].loss_texts == ["a^[b]~x"]
    assert back[1].valid and not back[2].valid and back[2].loss_texts == []
    with pytest.raises(ValueError):
        chat.Template(escape="#").codes()
