"""Log tables: whole versions, bounded folders, repeated batches, pinned readers."""

import random

from archivelake.streaming import ingest
from archivelake.streaming.log_table import LogTable
from archivelake.streaming.tables import stream_files

SCHEMA = "k bigint, v string"


def batch(spark, n):
    return spark.createDataFrame([(n * 10 + i, f"v{n}") for i in range(3)], SCHEMA)


def keys(df):
    return sorted(r.k for r in df.collect())


def data_folders(path):
    return sorted(str(f.relative_to(path)) for f in path.glob("level=*/*"))


def test_batches_leave_few_folders(spark, tmp_path):
    table = LogTable(spark, str(tmp_path), SCHEMA, top="k", fan=3, keep=2)
    assert table.read().collect() == [] and table.manifest().top is None
    for n in range(30):
        table.append(batch(spark, n), n)
        found = table.manifest()
        # At most two folders a level, and a level for each digit of the count to base 3.
        assert len(found.entries) <= 2 * 4 and (found.top, found.batch, found.rows) == (n * 10 + 2, n, 3 * (n + 1))
    assert keys(table.read()) == sorted(n * 10 + i for n in range(30) for i in range(3))
    assert {r.batch for r in table.read().collect()} == set(range(30))
    # Folders of versions that are no longer kept are gone.
    named = {e["folder"] for v in table.versions() for e in table.manifest(v).entries}
    assert set(data_folders(tmp_path)) == named and len(table.versions()) <= 3


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = LogTable(spark, str(tmp_path), SCHEMA, fan=3)
    for n in (0, 1, 1, 0):
        table.append(batch(spark, n), n)
    assert keys(table.read()) == [0, 1, 2, 10, 11, 12]


def test_what_was_not_committed_is_not_read(spark, tmp_path):
    """A driver lost before the manifest leaves a folder that the next try overwrites."""
    table = LogTable(spark, str(tmp_path), SCHEMA)
    table.append(batch(spark, 0), 0)
    batch(spark, 7).selectExpr("k", "v", "1L AS batch").write.parquet(f"{tmp_path}/level=0/1")
    assert keys(table.read()) == [0, 1, 2]
    table.append(batch(spark, 1), 1)
    assert keys(table.read()) == [0, 1, 2, 10, 11, 12]


def test_pinned_readers_see_their_version_during_merges(spark, tmp_path):
    table = LogTable(spark, str(tmp_path), SCHEMA, fan=2, keep=6)
    table.append(batch(spark, 0), 0)
    pinned, version = table.read(), table.manifest().version
    for n in (1, 2):
        table.append(batch(spark, n), n)  # merges folder 0 away
    assert keys(pinned) == keys(table.read(version)) == [0, 1, 2]
    assert len(keys(table.read())) == 9


def test_merged_index_over_many_batches(spark, tmp_path):
    """A stream of small files gives the index that one batch gives."""
    schema = "op string, inbox string, xnum bigint, oid string, mid string, content_hash string, seq bigint"
    rng = random.Random(2)
    rows, live = [], []
    for n in range(1, 41):
        older = [x for x in live if (x[2] - 1) // 8 < (n - 1) // 8]  # deletes of a batch come first
        if older and rng.random() < 0.4:
            gone = rng.choice(older)
            live.remove(gone)
            rows.append(("d", gone[0], None, gone[1], None, None, n))
        else:
            text = rng.randrange(8)
            live.append((f"i{n % 3}", f"o{n}", n, text))
            rows.append(("m", f"i{n % 3}", n, f"o{n}", f"m{text}", f"h{text}", n))
    for k in range(0, 40, 8):
        spark.createDataFrame(rows[k:k + 8], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stream_files(spark, f"{tmp_path}/in", schema)
        ingest.merge_log(stream, str(tmp_path), available_now=True).awaitTermination()
    got = ingest.merged_xref(spark, str(tmp_path)).collect()
    assert sorted((r.inbox, r.oid, r.xnum) for r in got) == sorted(t[:3] for t in live)
    by_text = {}
    for r in got:
        by_text.setdefault(r.mid, set()).add(r.docid)
    assert all(len(d) >= 1 for d in by_text.values()) and len({(r.docid, r.mid) for r in got}) == len({r.docid for r in got})
