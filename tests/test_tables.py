"""Ingest, failures, lifecycle, logs, retention, comparison, quality."""

import datetime as dt
import gzip
import random
import types

import pytest
from pyspark.sql import functions as F

from rivetgraph.operators import failures as fail, ingest, lifecycle, logs, quality, retention, state
from rivetgraph.plans import q_failures
from rivetgraph.plans.catalog import QUERIES
from tests.conftest import rows_of

T0 = dt.datetime(2024, 1, 1)


def at(secs):
    return T0 + dt.timedelta(seconds=secs)


INGEST = (
    "job_id string, batch_id int, pos int, drv_path string, drv_name string, system string, "
    "required_features array<string>, input_drvs array<string>, attr string"
)


def row(job, batch, pos, path, inputs=(), system="x86", name=None):
    return (job, batch, pos, path, name or path, system, [], list(inputs), None)


def test_ingest_batch_end_to_end(make):
    rows = make(
        [
            row("j", 1, 0, "/s/h-a.drv", ["/s/h-b.drv", "/s/h-a.drv", "junk"]),
            row("j", 1, 1, "/s/h-a.drv"),
            row("j", 1, 2, ""),
            row("j", 2, 0, "/s/h-a.drv", system="arm"),
            row("j", 2, 1, "/s/h-c.drv", ["/s/h-new-1.0.drv"], system="arm"),
            row("k", 3, 0, "/s/h-b.drv"),
        ],
        INGEST,
    )
    checked = ingest.with_reject_reason(rows)
    good = checked.where(F.col("reject_reason").isNull())
    reg = ingest.registry(good)
    assert rows_of(reg, "drv_hash", "batch_id", "pos", "system") == [
        ("h-a.drv", 1, 0, "x86"), ("h-b.drv", 3, 0, "x86"), ("h-c.drv", 2, 1, "arm"),
    ]
    wanted = ingest.exploded_inputs(good)
    assert rows_of(wanted, "dep_path", "edge_error") == [
        ("/s/h-a.drv", "self_loop"), ("/s/h-b.drv", None), ("/s/h-new-1.0.drv", None), ("junk", "bad_path"),
    ]
    edges = ingest.wire_edges(wanted)
    assert rows_of(edges, "src", "dst") == [("h-a.drv", "h-b.drv"), ("h-c.drv", "h-new-1.0.drv")]
    assert rows_of(ingest.wire_edges(wanted, make([("h-b.drv",)], "drv_hash string")), "dst") == [("h-new-1.0.drv",)]
    # b came late but in full, so only the step nobody described is a placeholder
    assert rows_of(ingest.placeholders(wanted, reg)) == [("h-new-1.0.drv", "/s/h-new-1.0.drv", "new-1.0", "arm")]
    assert rows_of(ingest.membership(good, wanted)) == [
        ("j", "h-a.drv"), ("j", "h-b.drv"), ("j", "h-c.drv"), ("j", "h-new-1.0.drv"), ("k", "h-b.drv"),
    ]
    marked = checked.join(ingest.mark_new(good).select("batch_id", "pos", "is_new"), ["batch_id", "pos"], "left")
    acc = ingest.accounting(marked, wanted)
    assert rows_of(acc, "batch_id", "sent", "new_drvs", "dedup_skipped", "errored", "edge_errors") == [
        (1, 3, 1, 1, 3, 2), (2, 2, 1, 1, 0, 0), (3, 1, 1, 0, 0, 0),
    ]
    assert quality.unbalanced_batches(acc).count() == 0


def test_cap_rejects_the_batch_and_all_after_it(make):
    b = make(
        [("j", 1, 60, 20), ("j", 2, 60, 0), ("j", 3, 1, 0), ("j", 4, 1, 0), ("k", 1, 100, 100), ("k", 2, 100, 0)],
        "job_id string, batch_id int, incoming bigint, released bigint",
    )
    got = ingest.cap_reservation(b, cap=100)
    assert rows_of(got, "job_id", "batch_id", "reserved", "verdict") == [
        ("j", 1, 60, "accepted"), ("j", 2, 100, "accepted"), ("j", 3, 101, "eval_too_large"),
        ("j", 4, 102, "job_already_failed"), ("k", 1, 100, "accepted"), ("k", 2, 100, "accepted"),
    ]


def test_cache_hit_needs_more_than_the_expiry(make):
    steps = make([("/s/h-a.drv",), ("/s/h-b.drv",), ("/s/h-c.drv",)], "drv_path string")
    cache = make([("/s/h-a", at(1)), ("/s/h-b", at(0))], "output_path string, expires_at timestamp")
    got = ingest.cache_hits(steps, cache, F.lit(T0))
    assert rows_of(got, "output_path", "cached_failed") == [("/s/h-a", True), ("/s/h-b", False), ("/s/h-c", False)]
    # neither a hit nor expired
    assert rows_of(retention.expire_cache(cache, F.lit(T0)), "output_path") == [("/s/h-a",), ("/s/h-b",)]


CACHE = "output_path string, drv_hash string, failed_at timestamp, expires_at timestamp, worker_id string"


def test_cache_insert_takes_only_terminal_build_failures(make):
    old = make([("a", "da", at(-9), at(-5), None)], CACHE)
    new = make(
        [
            ("a", "da", at(0), at(60), "w", "build_failure", None),
            ("b", "db", at(2), at(62), "w2", "build_failure", None),
            ("b", "db", at(1), at(61), "w1", "build_failure", None),
            ("c", "dc", at(0), at(60), "w", "transient", None),
            ("d", "dd", at(0), at(60), "w", "disk_full", None),
            ("e", "de", at(0), at(60), None, "build_failure", "a"),
        ],
        CACHE + ", error_category string, propagated_from string",
    )
    got = ingest.insert_failed_outputs(old, new)
    assert rows_of(got, "output_path", "worker_id", "expires_at") == [("a", None, at(-5)), ("b", "w1", at(61))]
    got = ingest.insert_failed_outputs(old, new, as_of=F.lit(T0), refresh_expired=True)
    assert rows_of(got, "output_path", "worker_id", "expires_at") == [("a", "w", at(60)), ("b", "w1", at(61))]


def test_job_create_is_idempotent_per_reference(make):
    req = make(
        [(1, "r", at(5), 9), (2, "r", at(1), 7), (3, None, at(0), 0), (4, None, at(0), 0)],
        "request_id int, external_ref string, created_at timestamp, priority int",
    )
    jobs, mapping = ingest.create_jobs(req)
    assert rows_of(mapping) == [(1, 2), (2, 2), (3, 3), (4, 4)]
    assert rows_of(jobs, "job_id", "priority") == [(2, 7), (3, 0), (4, 0)]


FAIL = (
    "job_id string, drv_hash string, drv_name string, error_category string, error_message string, "
    "log_tail string, propagated_from string, worker_id string, ord int"
)


def failure(i, cat="transient", worker="w", origin=None, job="j", name=None):
    return (job, f"d{i}", name or f"n{i}", cat, None, f"tail{i}", origin, worker, i)


@pytest.mark.parametrize(
    "rows, want",
    [
        ([failure(i) for i in range(3)], "w"),
        ([failure(i) for i in range(2)], None),
        ([failure(i, worker="a" if i < 2 else "b") for i in range(4)], None),
        ([failure(i, worker="a" if i < 3 else "b") for i in range(5)], "a"),
        ([failure(i, cat="build_failure") for i in range(5)], None),
        ([failure(i, cat="disk_full") for i in range(3)], "w"),
        ([failure(i) for i in range(2)] + [failure(9, origin="d0")], None),
        ([failure(i, worker="") for i in range(5)], None),
        ([failure(i, worker=None) for i in range(5)], None),
    ],
)
def test_suspicion(make, rows, want):
    got = [r["suspected_worker"] for r in fail.suspected_workers(make(rows, FAIL)).collect()]
    assert got == ([want] if want else [])


@pytest.mark.parametrize("n", [0, 10, 500, 501, 2000])
def test_failure_cap_and_tails(make, n):
    df = make([failure(i) for i in range(n)] + [failure(0, job="other")], FAIL)
    got = sorted(fail.capped_failures(df, [F.col("ord")]).where("job_id = 'j'").collect(), key=lambda r: r["place"])
    assert len(got) == min(n, 501)
    assert sum(r["log_tail"] is not None for r in got) == min(n, 10)
    if n > 500:
        assert got[-1]["drv_name"] == "<truncated>" and got[-1]["error_category"] == "propagated_failure"
        assert got[-1]["error_message"] == f"{n - 500} additional failures truncated from snapshot"


def test_eval_errors_dedup_then_cap(make):
    rows = [("j", i, f"a{i % 6}", f"e{i}") for i in range(12)] + [("k", 0, "x", "y")]
    got = ingest.capped_eval_errors(make(rows, "job_id string, ord int, attr string, error string"), cap=4)
    assert rows_of(got.where("job_id = 'j'"), "place", "attr", "error") == [
        (1, "a0", "e0"), (2, "a1", "e1"), (3, "a2", "e2"), (4, "a3", "e3"), (5, "<truncated>", "cap of 4 eval errors reached"),
    ]
    assert got.where("job_id = 'k'").count() == 1


def test_file_names_never_collide(make):
    def brute(names):
        used, out = set(), []
        for n in names:
            c, i = f"{n}.log", 2
            while c in used:
                c, i = f"{n}-{i}.log", i + 1
            used.add(c)
            out.append(c)
        return out

    jobs = {
        "plain": ["a", "a", "b", "a"],
        "clash": ["foo", "foo-2", "foo", "foo", "foo-2"],
        "early": ["foo-2", "foo", "foo", "foo-3", "foo"],
        "deep": ["x", "x-2", "x-2-2", "x-2", "x", "x-2-2"],
        "late": ["a", "a", "a", "a", "a-3", "a-3", "a-3-2", "a-9", "a"],
    }
    rng = random.Random(8)
    for k in range(25):
        jobs[f"random{k}"] = [
            rng.choice(["n", "n-2", "n-3", "n-2-2", "n-2-3", "n-02", "n-1", "m-4", "m"]) for _ in range(rng.randrange(1, 40))
        ]
    rows = [(j, i, f"d{i}", n, "transient") for j, names in jobs.items() for i, n in enumerate(names)]
    rows.append(("plain", 9, "d9", "a", "propagated_failure"))
    got = logs.export_names(make(rows, "job_id string, place int, drv_hash string, drv_name string, error_category string"))
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.job_id, r.place)):
        found.setdefault(r.job_id, []).append(r.file_name)
    assert found == {j: brute(names) for j, names in jobs.items()}


def test_log_export_as_files(make, tmp_path):
    named = make([("j", "a.log", "one\ntwo"), ("j", "b.log", "three")], "job_id string, file_name string, content string")
    logs.export_failure_logs(named, str(tmp_path / "out"), as_files=True)
    files = list((tmp_path / "out" / "job_id=j").glob("file_name=*/part-*.txt"))
    assert sorted(f.read_text() for f in files) == ["one\ntwo\n", "three\n"]


LOGS = "claim_id int, job_id int, drv_hash string, attempt int, original_size bigint, truncated boolean, stored_size bigint, log_gz binary, stored_at timestamp"


def test_log_upsert_keeps_first_identity_and_last_bytes(make):
    old = make([(1, 1, "d", 1, 10, False, 3, b"old", at(0))], LOGS)
    new = make(
        [(1, 1, "CHANGED", 9, 20, True, 4, b"new", at(5), 2), (1, 1, "X", 8, 15, False, 5, b"mid", at(4), 1), (2, 1, "e", 3, 5, False, 1, b"b", at(1), 3)],
        LOGS + ", upload_id int",
    )
    got = logs.upsert_logs(old, new)
    assert rows_of(got, "claim_id", "drv_hash", "attempt", "original_size", "truncated", "stored_at") == [
        (1, "d", 1, 20, True, at(5)), (2, "e", 3, 5, False, at(1)),
    ]
    assert rows_of(got, "claim_id", "stored_size", F.decode("log_gz", "UTF-8")) == [(1, 4, "new"), (2, 1, "b")]


def test_newest_archived_log_is_fetched_once(make):
    gz = lambda t: gzip.compress(t.encode())
    archive = make(
        [("j", "d", 1, 1, gz("first")), ("j", "d", 2, 2, gz("second")), ("j", "e", 1, 3, b"not gzip"), ("k", "d", 1, 4, gz("other"))],
        "job_id string, drv_hash string, attempt int, claim_id int, log_gz binary",
    )
    failed = make(
        [("j", "d", None, "tail d"), ("j", "e", None, "tail e"), ("j", "f", None, None), ("j", "g", "d", "spoilt")],
        "job_id string, drv_hash string, propagated_from string, log_tail string",
    )
    assert rows_of(logs.failure_logs(failed, archive), "drv_hash", "content", "log_source") == [
        ("d", "second", "archive"), ("e", "tail e", "tail"), ("f", logs.NO_LOG, "none"),
    ]


def test_byte_ceiling(make):
    df = make([(1, 1, "d", 1, 0, False, 40, b"x", at(0)), (2, 1, "d", 1, 0, False, 30, b"x", at(1)), (3, 1, "d", 1, 0, False, 30, b"x", at(1))], LOGS)
    keep = lambda cap: rows_of(logs.prune_to_ceiling(df, max_bytes=cap).where("keep"), "claim_id")
    assert keep(100) == [(1,), (2,), (3,)]
    assert keep(99) == [(2,), (3,)]
    # equal times: the larger claim is the newer
    assert keep(59) == [(3,)]
    assert keep(29) == []


def test_retention_bounds(make):
    day = 86_400
    jobs = make([("a", "done", at(-14 * day)), ("b", "done", at(-14 * day - 1)), ("c", "pending", None)], "job_id string, status string, done_at timestamp")
    assert rows_of(retention.retain_jobs(jobs, F.lit(T0)), "job_id") == [("a",), ("c",)]
    with pytest.raises(ValueError):
        retention.check_retention(7, 14)


def test_refute(make):
    cache = make([("p1", "d1", at(0), at(1), "w1"), ("p2", "d2", at(0), at(1), None), ("p3", "d3", at(0), at(1), "w3")], CACHE)
    left = lambda **kw: rows_of(retention.refute(cache, **kw), "output_path")
    assert left() == [("p1",), ("p2",), ("p3",)]
    assert left(worker_id="w1") == [("p2",), ("p3",)]
    assert left(drv_hash="d2", worker_id="w3") == [("p1",)]
    assert left(output_paths=make([("p1",), ("p1",)], "output_path string")) == [("p2",), ("p3",)]


def test_terminal_write_once(make):
    ddl = "job_id string, status string, done_at timestamp, result string"
    jobs = make([("a", "pending", None, None), ("b", "failed", at(1), "r")], ddl)
    writes = make([("a", "done", at(5), "late"), ("a", "failed", at(4), "first"), ("b", "done", at(0), "x")], ddl)
    assert rows_of(lifecycle.write_terminal_once(jobs, writes)) == [("a", "failed", at(4), "first"), ("b", "failed", at(1), "r")]


def test_listing_pages_and_since(make):
    jobs = make([(i, "failed", at(i)) for i in range(5)] + [(9, "pending", None)], "job_id int, status string, done_at timestamp")
    page = fail.list_jobs(jobs, "failed", limit=2)
    assert rows_of(page, "job_id", "next_cursor") == [(3, at(3)), (4, at(3))]
    page = fail.list_jobs(jobs, "failed", limit=2, cursor=F.lit(at(1)))
    assert rows_of(page, "job_id", "next_cursor") == [(0, None)]
    # since is applied after the fetch of limit + 1
    assert rows_of(fail.list_jobs(jobs, "failed", limit=2, since=F.lit(at(4))), "job_id", "next_cursor") == [(4, None)]
    assert fail.list_jobs(jobs, "pending").count() == 0


def test_comparison_severity(make):
    ddl = "pair_id int, drv_hash string, drv_name string, error_category string, propagated_from string"
    a = make([(1, "d", "n", "transient", None), (2, "d", "n", "transient", None), (3, "d", "<truncated>", "x", None), (3, "e", "n", "x", "d")], ddl)
    b = make([(1, "d", "n", "build_failure", None)], ddl)
    f = fail.compare_runs(a, b)
    assert rows_of(f, "pair_id", "finding") == [(1, "category_mismatch"), (2, "only_in_a")]
    cols = ["total", "pending", "building", "done", "failed"]
    ddl = "pair_id int, status_a string, status_b string, suspected_a string, suspected_b string, " + ", ".join(f"{c}_{s} bigint" for s in "ab" for c in cols)
    zero = [0] * 10
    pairs = make(
        [(1, "failed", "failed", None, "w", *zero), (2, "done", "done", None, None, *zero), (3, "done", "done", None, None, *[5, 0, 0, 5, 0, 9, 0, 0, 5, 0]),
         (4, "done", "failed", None, None, *zero), (5, "done", "done", None, None, *[5, 0, 0, 5, 0, 5, 0, 0, 4, 0])],
        ddl,
    )
    got = rows_of(fail.comparison_report(pairs, f), "pair_id", "severity", "new_suspicion")
    # a differing total alone does not matter
    assert got == [(1, "minor", True), (2, "major", False), (3, "matched", False), (4, "critical", False), (5, "minor", False)]


def test_live_and_terminal_status_may_differ(make):
    jobs = make([("j", True), ("open", False)], "job_id string, sealed boolean")
    roots = make([("j", True, False)], "job_id string, finished boolean, failed boolean")
    none = make([], "job_id string")
    assert rows_of(state.terminal_status(jobs, roots, none), "job_id", "terminal_status") == [("j", "done"), ("open", None)]
    live = state.live_status(F.lit(True), F.lit(1), F.lit(1), F.lit(2))
    assert jobs.select(live).first()[0] == "failed"
    errors = make([("j",)], "job_id string")
    assert rows_of(state.terminal_status(jobs, roots, errors), "terminal_status") == [("failed",), (None,)]


def test_overlapping_claims_sees_long_earlier_ones(make):
    c = make([("d", "a", at(0), at(100)), ("d", "b", at(10), at(20)), ("d", "c", at(30), at(40)), ("e", "x", at(0), at(5)), ("e", "y", at(5), at(9))],
             "drv_hash string, claim_id string, started_at timestamp, ended_at timestamp")
    assert rows_of(quality.overlapping_claims(c), "claim_id") == [("b",), ("c",)]


def test_membership_takes_a_jobs_own_inputs_only(make):
    ddl = "job_id string, drv_hash string"
    inputs = make([("a", "x", "y", None), ("b", "x", "z", None), ("b", "x", "w", "bad_path")], "job_id string, src string, dst string, edge_error string")
    sent = make([("a", "x"), ("b", "x")], ddl)
    assert rows_of(ingest.membership(sent, inputs)) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "z")]
    assert rows_of(ingest.membership(sent, inputs, make([("z",)], "drv_hash string"))) == [("a", "x"), ("a", "y"), ("b", "x")]


@pytest.mark.parametrize("seed", range(3))
def test_liveness_is_the_union_of_life_spans(make, seed):
    rng = random.Random(seed)
    jobs, members = [], []
    for j in range(40):
        a = rng.randrange(200)
        jobs.append((j, at(a), None if rng.random() < 0.1 else at(a + rng.randrange(0, 15))))
        members += [(j, d) for d in "xyz" if rng.random() < 0.6] * 2
    got = ingest.liveness(make(members, "job_id int, drv_hash string"), make(jobs, "job_id int, created_at timestamp, done_at timestamp"))
    want = []
    for d in "xyz":
        spans = sorted((jobs[j][1], jobs[j][2] or at(10**6)) for j in {j for j, x in members if x == d})
        merged = []
        for a, b in spans:
            if a == b:
                continue
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        want += [(d, a, None if b == at(10**6) else b) for a, b in merged]
    assert rows_of(got) == sorted(want, key=repr)


def test_a_step_nobody_holds_is_minted_anew(make):
    rows = make(
        [("d", 1, 0, at(0)), ("d", 2, 0, at(5)), ("d", 3, 0, at(50))], "drv_hash string, batch_id int, pos int, arrived_at timestamp"
    )
    live = ingest.liveness(
        make([(1, "d"), (2, "d"), (3, "d")], "job_id int, drv_hash string"),
        make([(1, at(0), at(10)), (2, at(5), at(20)), (3, at(50), None)], "job_id int, created_at timestamp, done_at timestamp"),
    )
    assert rows_of(ingest.registry(rows, live), "batch_id") == [(1,), (3,)]


def test_every_failure_of_a_large_job_is_named(make):
    lines = make([(i, 7, i % 650, "R") for i in range(1300)], "l_orderkey bigint, l_suppkey bigint, l_partkey bigint, l_returnflag string")
    tables = types.SimpleNamespace(raw=lambda name: lines)
    rows = logs.export_names(q_failures.named_failures(tables)).repartition(3).collect()
    assert len(rows) == 650
    taken, want = set(), {}
    for r in sorted(rows, key=lambda r: r["place"]):
        n, name = 1, f"{r.base}.log"
        while name in taken:
            n += 1
            name = f"{r.base}-{n}.log"
        taken.add(name)
        want[r.drv_hash] = name
    assert {r.drv_hash: r.file_name for r in rows} == want


def test_log_sizes_are_the_bytes_of_the_texts(spark, tmp_path):
    """Not the listed number of characters, which may say anything."""
    rows = [(1, "abc", 70, "s"), (102, "héé", 70, "s"), (203, None, 70, "s"), (4, "", 70, "t")]
    spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, source string").write.parquet(f"{tmp_path}/documents.parquet")
    logs_by = lambda name, *cols: sorted(rows_of(QUERIES[name](spark, str(tmp_path)), *cols))
    assert logs_by("wn_11_attempt_history", "claim_id", "original_size", "stored_size") == [(1, 3, 3), (4, 0, 0), (102, 5, 5), (203, None, None)]
    assert logs_by("ag_25_archive_capacity", "total_bytes", "row_count") == [(8, 4)]
    assert logs_by("wn_03_byte_ceiling_fits", "claim_id", "bytes") == [(1, 3), (4, 0), (102, 5), (203, None)]
    assert logs_by("prj_22_compression_ratio", "claim_id", "ratio") == [(1, 4.0), (4, None), (102, 4.0), (203, None)]


def test_byte_totals_rejects_and_maintenance_count_whole_texts(spark, tmp_path):
    """Sizes, warnings, buckets, rejects and the byte ceiling follow the bytes of the texts."""
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    texts = [(60, "sixsix"), (61, "héé"), (62, "é" * 29_995), (162, "a" * 9_400), (71, "b" * 5_000), (80, "c" * 5_000)]
    save([(i, t, 70, "s") for i, t in texts], "doc_id bigint, text string, n_chars bigint, source string", "documents")
    orders = [(i, 1, "F", dt.datetime(1998, 1, 1), "1-URGENT") for i in (60, 61, 62, 71)]
    save(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp, o_orderpriority string", "orders")
    save([], "p_partkey bigint, p_name string, p_size int", "part")
    amounts = "l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    keys = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint"
    save([], f"{keys}, {amounts}, l_returnflag string, l_linestatus string, l_shipdate timestamp", "lineitem")
    got = lambda name, *cols: sorted(rows_of(QUERIES[name](spark, str(tmp_path)), *cols))
    assert got("ag_14_log_bytes_per_job", "job_id", "claim_id", "job_bytes", "crossed") == [
        (60, 60, 6, False), (61, 61, 5, False), (62, 62, 59_990, True), (62, 162, 69_390, False),
        (71, 71, 5_000, False), (80, 80, 5_000, False),
    ]
    # five jobs: 6, 5, 69 390, 5 000 and 5 000 bytes
    assert {(r.le, r.cumulative) for r in QUERIES["ag_20_log_bytes_histogram"](spark, str(tmp_path)).collect()} >= {
        (1024.0, 2), (10_240.0, 4), (102_400.0, 5), (None, 5)
    }
    assert got("prj_17_upload_validation", "claim_id", "reason") == [
        (60, None), (61, None), (62, "body_too_large"), (71, "size_without_truncation"), (80, None), (162, "body_too_large")
    ]
    # newest first: 9 400 (162), 5 000 (71), then 59 990 (62) goes over 60 000 and all older ones with it
    assert got("rt_04_maintenance", "job_rows", "row_count", "total_bytes") == [(4, 2, 14_400)]
