"""Registered queries against their SQL, over the smallest test tables.

ARCHIVELAKE_ALL_QUERIES=1 runs every query; by default a spread of them.
"""

import os

import pytest

import __spark_entry__ as entry_points

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "pages", "benchmark", "labels", "conversations"]
QUICK = [
    "overview_range", "maildrop_stat", "gap_scan", "net_of_deletes", "json_records", "page_links", "content_hashes",
    "xref_peers", "split_documents", "dedupe_content", "annotations_modified", "phrase_search", "boolean_search",
    "relevance_topk", "probe_passages", "patch_lineage", "blob_search", "thread_ids", "stream_notifications",
]
from archivelake.plans import QUERIES  # noqa: E402

NAMES = sorted(QUERIES) if os.environ.get("ARCHIVELAKE_ALL_QUERIES") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return str(value) if value is not None else None


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sql, name):
    df = entry_points.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    cursor = sql.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()], key=repr)
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry_points.oracle_sql())


def test_flagship(spark):
    assert entry_points.entry(spark).columns == ["root", "latest", "n", "subject", "mid"]
