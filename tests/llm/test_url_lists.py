"""Temporal URL lists against a plain loop and the registered SQL."""

import duckdb
import pytest

from archivelake.llm import queries, url_lists

SF = "/root/testdata/sf0.001"
NAME = "op5_temporal_url_lists"
ENTRY = "kind string, pattern string, at long, action string, expires long"
CAPTURE = "capture_id long, url string, fetched long"


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_registered_sql(spark, sf):
    connection = duckdb.connect()
    for name in ("pages", "events"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = sorted(connection.execute(queries.ORACLES[NAME]).fetchall(), key=repr)
    got = queries.QUERIES[NAME](spark, sf)
    assert got.columns == [d[0] for d in connection.description]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {r[3] for r in want} == {True, False}


def test_every_event_is_an_entry(spark):
    """The list lasts the whole month, and an address is added, taken off and added again."""
    for sf, n in ((SF, 1000), ("/root/testdata/sf0.1", 100_000)):
        pages, events = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "events"))
        rows = queries._url_list(pages, events).collect()
        assert len(rows) == n == events.count()
        last = events.selectExpr("max(unix_seconds(cast(ts AS timestamp)))").first()[0]
        assert max(r.at for r in rows) == last and last > 1704067200 + 2592000 - 3600 * (1 if n > 1000 else 10)
        actions = {}
        for r in sorted(rows, key=lambda r: r.at):
            actions.setdefault((r.kind, r.pattern), []).append(r.action)
        assert any("add remove add" in " ".join(a) for a in actions.values())
        if n > 1000:
            assert len({r.pattern for r in rows if r.kind == "url"}) > 2000


ENTRIES = [
    ("host", "a.example.org", 100, "add", None), ("host", "a.example.org", 200, "remove", None),
    ("host", "a.example.org", 9000, "add", 9500), ("domain", "example.org", 50, "add", 60),
    ("domain", "example.org", 20000, "add", None), ("url", "b.example.org/x?q=1", 10, "add", None),
    ("host", "tie.org", 5, "remove", None), ("host", "tie.org", 5, "add", None), ("host", "late.org", 7, "add", 7),
    ("host", "a.example.org", 100, "add", None), (None, "x", 1, "add", None), ("host", None, 1, "add", None),
    ("host", "", 1, "add", None), ("host", "n.org", None, "add", None), ("host", "n.org", 1, None, None),
]
URLS = [
    "http://a.example.org/", "https://User@A.Example.ORG.:80/p#f", "http://b.example.org/x?q=1#top", "http://tie.org",
    "http://late.org/", "nonsense", "", None, "http://localhost/x", "http://n.org/", "ftp://c.d.example.org",
]
TIMES = [0, 10, 50, 59, 60, 99, 100, 150, 200, 8999, 9000, 9499, 9500, 19999, 20000, 10**9, None]


def plain(url, fetched):
    """(n_matches, best) by walking the entries of each pattern."""
    from urllib.parse import urlsplit

    parts = urlsplit(url or "")
    host = (parts.hostname or "").rstrip(".") if "://" in (url or "") else ""
    if not host or fetched is None:
        return 0, None
    address = host + parts.path + (f"?{parts.query}" if parts.query else "")
    labels = host.split(".")
    tried = [("url", address), ("host", host), *(("domain", ".".join(labels[i:])) for i in range(len(labels) - 1))]
    hits = []
    for kind, pattern in tried:
        own = sorted({e for e in ENTRIES if e[:2] == (kind, pattern) and e[2] is not None and e[3]}, key=lambda e: (e[2], e[3] == "remove"))
        past = [e for e in own if e[2] <= fetched]
        if past and past[-1][3] == "add" and (past[-1][4] is None or fetched < past[-1][4]):
            hits.append((url_lists.KINDS.index(kind), -len(pattern), kind, pattern, past[-1][2]))
    return len(hits), min(hits)[2:] if hits else None


def test_odd_rows_equal_plain_walk(spark):
    rows = [(i * 100 + j, u, t) for i, u in enumerate(URLS) for j, t in enumerate(TIMES)]
    captures = spark.createDataFrame([*rows, rows[0], (None, URLS[0], 150)], CAPTURE).selectExpr("*", "1 AS span", "'k' AS kind")
    entries = spark.createDataFrame(ENTRIES, ENTRY).selectExpr("*", "2 AS next_at")
    got = {r.capture_id: r for r in url_lists.judge(captures, entries).collect()}
    assert len(got) == len(rows) + 1
    for n, url, fetched in [*rows, (None, URLS[0], 150)]:
        count, best = plain(url, fetched)
        assert (got[n].n_matches, got[n].blocked) == (count, count > 0), (url, fetched)
        assert (tuple(got[n])[5:] == best) if best else got[n].kind is None


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.example.org/", 150)], CAPTURE)
    entries = spark.createDataFrame(ENTRIES, ENTRY)
    assert [r.blocked for r in url_lists.judge(captures, entries.limit(0)).collect()] == [False]
    assert url_lists.judge(captures.limit(0), entries).collect() == []
