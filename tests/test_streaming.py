"""Streams over several micro-batches equal their batch twins."""

import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from rivetgraph.streaming import jobs as sj
from rivetgraph.streaming.bucketed import BucketedTable
from rivetgraph.streaming.runner import drain_updates, file_stream
from tests.conftest import rows_of

T0 = dt.datetime(2024, 1, 1)


def at(secs):
    return T0 + dt.timedelta(seconds=secs)


@pytest.fixture
def batches(spark, tmp_path):
    """batches([rows, rows, …], ddl) → stream of one micro-batch per list, in order."""

    def run(parts, ddl):
        import os

        path = tmp_path / f"in{len(list(tmp_path.iterdir()))}"
        for i, rows in enumerate(parts):
            one = tmp_path / f"part{path.name}-{i}"
            spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(one))
            path.mkdir(exist_ok=True)
            source = next(one.glob("part-*.parquet"))
            target = path / f"{i}.parquet"
            target.write_bytes(source.read_bytes())
            os.utime(target, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
        return file_stream(spark, str(path), spark.read.parquet(str(path)).schema, files_per_trigger=1)

    return run


FOLD = "job_id string, seq bigint, kind string, will_retry boolean, error_category string, status string, progress bigint"


@pytest.mark.parametrize("deltas", [1, 8])
def test_run_fold_over_batches(batches, spark, deltas):
    def ev(job, seq, kind, retry=False, cat="transient", status=None, progress=None):
        return (job, seq, kind, retry, cat, status, progress)

    parts = [
        [ev("a", 1, "drv_failed", True), ev("a", 2, "progress", progress=10), ev("b", 1, "job_done", status="done"), ev("b", 2, "drv_failed")],
        [ev("a", 3, "drv_failed"), ev("a", 4, "drv_failed", cat="propagated_failure"), ev("a", 5, "progress", progress=20), ev("b", 3, "job_done", status="failed")],
        [ev("a", 6, "job_done", status="failed"), ev("a", 7, "job_done", status="done"), ev("a", 8, "drv_failed"), ev("c", 1, "progress", progress=1)],
        [ev("a", 9, "drv_failed", True), ev("c", 2, "drv_failed", True)],
    ]
    got = sj.folded_runs(batches(parts, FOLD), buckets=4, max_deltas=deltas)
    assert rows_of(got, "job_id", "ended_seq", "status", "retries", "own_failures", "progress") == [
        ("a", 6, "failed", 1, 1, 20), ("b", 1, "done", 0, 0, None), ("c", None, None, 1, 0, 1),
    ]


def test_exact_dedup_over_batches(batches):
    ddl = "drv_hash string, seq bigint"
    got = sj.dedup_exact(batches([[("a", 2), ("a", 1)], [("a", 0), ("b", 3)], [("b", 4)]], ddl), ["drv_hash"], ["seq"])
    assert rows_of(got) == [("a", 1), ("b", 3)]


def first_row(rows):
    return rows.groupBy("k").agg(F.min_by("x", "__v").alias("x"))


def sets_of(table):
    return sorted(str(p.relative_to(table.path)) for p in pathlib.Path(table.path, "data").glob("*/bucket=*"))


def test_a_batch_writes_the_buckets_it_touches(spark, make, tmp_path):
    table = BucketedTable(spark, ["k"], first_row, path=str(tmp_path / "t"), buckets=8, max_deltas=2)
    ddl = "k int, x int"
    table.apply(0, make([(i, 0) for i in range(100)], ddl))
    assert len(sets_of(table)) == 8
    table.apply(1, make([(5, 1)], ddl))
    assert len(sets_of(table)) == 9
    # run again: the same batch gives the same table
    table.apply(1, make([(5, 1)], ddl))
    assert len(sets_of(table)) == 9 and table.read().count() == 100 and table.raw().count() == 101


def test_full_buckets_are_compacted_and_old_files_go(spark, make, tmp_path):
    table = BucketedTable(spark, ["k"], first_row, path=str(tmp_path / "t"), buckets=2, max_deltas=2)
    ddl = "k int, x int"
    for n in range(7):
        table.apply(n, make([(1, n), (100 + n, n)], ddl))
        assert all(len(sets) <= 3 for sets in table.manifest(n).values())
        want = [(1, 0)] + [(100 + i, i) for i in range(n + 1)]
        assert rows_of(table.read()) == sorted(want, key=repr)
        if n:
            assert table.read(n - 1).count() == n + 1  # the version before is still whole
    live = {f"data/{s}" for v in (5, 6) for sets in table.manifest(v).values() for s in sets}
    assert set(sets_of(table)) == live and table.versions() == [5, 6]


UPLOADS = "claim_id int, attempt int, original_size bigint, truncated boolean, log_gz binary, stored_at timestamp, upload_id int"


@pytest.mark.parametrize("deltas", [1, 8])
def test_log_archive_over_batches(batches, spark, make, deltas):
    parts = [
        [(1, 1, 10, False, b"a", at(0), 0)],
        [(1, 9, 20, True, b"bb", at(5), 1), (1, 8, 15, True, b"old", at(4), 9), (2, 1, 1, False, b"ccc", at(1), 2)],
        [(3, 1, 1, False, b"d", at(1), 3)],
        [(2, 7, 2, True, b"newest", at(0), 4)],
    ]
    archive = sj.LogArchive(spark, buckets=2, max_deltas=deltas).keep(batches(parts, UPLOADS))
    assert rows_of(archive.listing(), "claim_id", "attempt", "original_size", "truncated", "stored_size") == [
        (1, 1, 20, True, 2), (2, 1, 2, True, 6), (3, 1, 1, False, 1),
    ]
    assert "log_gz" not in archive.listing()._jdf.queryExecution().executedPlan().toString()
    wanted = make([(1,), (2,), (7,)], "claim_id int")
    assert {r.claim_id: bytes(r.log_gz) for r in archive.with_blobs(wanted).collect()} == {1: b"bb", 2: b"newest"}


def test_gaps_add_up_to_what_the_stream_counts(batches, make):
    rows = [("a", s) for s in (1, 2, 5, 9)] + [("b", 4), ("b", 5)]
    gaps = sj.sequence_gaps(make(rows, "job_id string, seq bigint"))
    assert rows_of(gaps) == [("a", 5, 2), ("a", 9, 3)]
    live = drain_updates(sj.missed_events(batches([rows[:3], rows[3:]], "job_id string, seq bigint")), ["job_id"])
    assert rows_of(live, "job_id", "missed") == [("a", 5), ("b", 0)]
