"""Worker health, claims, leases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rivetgraph.operators import claims as cl, state, workers
from tests.conftest import rows_of

T0 = dt.datetime(2024, 1, 1)


def at(secs):
    return T0 + dt.timedelta(seconds=secs)


def fails(make, rows):
    return make([(w, at(s)) for w, s in rows], "worker_id string, ts timestamp")


def test_window_is_inclusive_at_both_ends(make):
    df = fails(make, [("w", 0), ("w", 300), ("w", 301), ("w", 601), ("", 5), (None, 6)])
    got = workers.trailing_failures(df, window_secs=300)
    assert [(r["ts"], r["failures_in_window"]) for r in got.orderBy("ts").collect()] == [
        (at(0), 1),
        (at(300), 2),
        (at(301), 2),
        (at(601), 2),
    ]


def test_ten_failures_at_threshold_five_trip_six_times(make):
    df = fails(make, [("w", i) for i in range(10)])
    t = workers.trips(df, threshold=5, window_secs=300)
    assert t.count() == 6
    got = workers.quarantine_intervals(t, cooldown_secs=900).collect()
    assert [(r["trip_ts"], r["release_at"], r["trips"]) for r in got] == [(at(4), at(909), 6)]


def test_intervals_merge_until_the_cooldown_has_passed(make):
    t = fails(make, [("w", 0), ("w", 900), ("w", 1801)])
    got = workers.quarantine_intervals(t, cooldown_secs=900).orderBy("trip_ts").collect()
    assert [(r["trip_ts"], r["release_at"]) for r in got] == [(at(0), at(1800)), (at(1801), at(2701))]


def test_quarantined_as_of_bounds(make):
    iv = make([("w", at(100), at(1000))], "worker_id string, trip_ts timestamp, release_at timestamp")
    checks = fails(make, [("w", 99), ("w", 100), ("w", 999), ("w", 1000), ("x", 500), ("", 500), (None, 500)])
    got = workers.quarantined_as_of(checks, iv, cooldown_secs=900)
    hit = {(r["worker_id"], r["ts"]) for r in got.where("quarantined").collect()}
    assert hit == {("w", at(100)), ("w", at(999))} and got.count() == 7


def brute_resets(events, threshold, window, cooldown):
    out = []
    for w in sorted({e[0] for e in events}):
        recent, release, trip = [], None, None
        for _, s, bad in sorted(e for e in events if e[0] == w):
            if bad:
                recent = [r for r in recent if r >= s - window] + [s]
                if len(recent) >= threshold:
                    release, trip = s + cooldown, s if trip is None else trip
            elif release is not None and s >= release:
                out.append((w, at(trip), at(release), at(s)))
                recent, release, trip = [], None, None
        if release is not None:
            out.append((w, at(trip), at(release), None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_quarantine_with_resets_equals_a_step_by_step_fold(make, seed):
    rng = random.Random(seed)
    events = []
    for w in "abcd":
        secs = rng.sample(range(6000), 120)
        events += [(w, s, rng.random() < 0.6) for s in secs]
    bad = fails(make, [(w, s) for w, s, b in events if b])
    asks = fails(make, [(w, s) for w, s, b in events if not b])
    got = workers.quarantine_with_resets(bad, asks, threshold=3, window_secs=100, cooldown_secs=150)
    want = brute_resets(events, 3, 100, 150)
    assert len(want) > 10
    assert rows_of(got, "worker_id", "trip_ts", "release_at", "cleared_at") == want


@pytest.mark.parametrize("block", [1, 2, 3])
def test_resets_go_through_blocks_of_bursts(make, block):
    """A long window and a short cooldown: a reset reaches several bursts ahead."""
    rng = random.Random(block)
    events = [(w, s, rng.random() < 0.75) for w in "ab" for s in rng.sample(range(6000), 260)]
    bad = fails(make, [(w, s) for w, s, f in events if f])
    ok = fails(make, [(w, s) for w, s, f in events if not f])
    got = workers.quarantine_with_resets(bad, ok, threshold=4, window_secs=400, cooldown_secs=60, block_bursts=block)
    assert rows_of(got) == brute_resets(events, 4, 400, 60)


@pytest.mark.parametrize("seed", range(3))
def test_trailing_counts_equal_brute_force(make, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.randrange(200)) for _ in range(300)]
    got = workers.trailing_failures(fails(make, rows), window_secs=25)
    want = [(w, at(s), sum(v == w and s - 25 <= t <= s for v, t in rows)) for w, s in rows]
    assert rows_of(got, "worker_id", "ts", "failures_in_window") == sorted(want, key=repr)


def test_fence_spares_nameless_workers(make):
    req = make([("a",), ("b",), (None,), ("",)], "worker_id string")
    got = workers.unfenced(req, make([("a",), ("a",)], "worker_id string"))
    assert rows_of(got) == [("",), ("b",), (None,)]


CLAIMS = "claim_id string, job_id string, drv_hash string, worker_id string, issued_at timestamp"


def test_completions_wrong_job_keeps_the_claim_and_first_takes_it(make):
    c = make([("c1", "j1", "d", "w", 1)], "claim_id string, job_id string, drv_hash string, worker_id string, attempt int")
    done = make(
        [("p1", "c1", "j2", at(1)), ("p2", "c1", "j1", at(2)), ("p3", "c1", "j1", at(3)), ("p4", "zz", "j1", at(1))],
        "completion_id string, claim_id string, job_id string, completed_at timestamp",
    )
    got = cl.completion_validity(done, c)
    assert rows_of(got, "completion_id", "validity") == [("p1", "wrong_job"), ("p2", "ok"), ("p3", "ignored"), ("p4", "ignored")]


def test_completion_of_a_finished_or_unknown_step_is_stale(make):
    valid = make(
        [("p1", "d", at(1), False), ("p2", "d", at(2), True), ("p3", "d", at(3), True), ("p4", "gone", at(1), True)],
        "completion_id string, drv_hash string, completed_at timestamp, ends boolean",
    )
    got = cl.stale_completions(valid, make([("d",)], "drv_hash string"), F.col("ends"))
    assert rows_of(got, "completion_id", "accepted") == [("p1", True), ("p2", True), ("p3", False), ("p4", False)]


def lease(make, extends, lifetime=None, window=100, as_of=10_000, own=None):
    c = make([("c", "j", "d", "w", at(0))], CLAIMS)
    jobs = make([("j", own)], "job_id string, claim_deadline_secs bigint")
    ext = make([("c", at(s)) for s in extends], "claim_id string, ts timestamp")
    row = cl.lease_timeline(c, ext, jobs, F.lit(at(as_of)), window_secs=window, lifetime_secs=lifetime).first()
    return (row["deadline"] - T0).total_seconds()


def test_leases(make):
    assert lease(make, []) == 100
    assert lease(make, [50]) == 150
    assert lease(make, [50, 140]) == 240
    # at its deadline a claim is over, and so are all later extensions
    assert lease(make, [100]) == 100
    assert lease(make, [50, 160, 170]) == 150
    assert lease(make, [50, 140], lifetime=200) == 200
    assert lease(make, [50, 140], as_of=60) == 150
    assert lease(make, [], own=30) == 30


def test_expiry_bounds_and_cause(make):
    rows = [("past", "d1", at(9), None), ("now", "d2", at(10), at(10)), ("later", "d3", at(11), None), ("hard", "d4", at(5), at(8))]
    leases = make(rows, "claim_id string, drv_hash string, deadline timestamp, hard_deadline timestamp")
    got = cl.expired_claims(leases, make([("d1",)], "drv_hash string"), F.lit(at(10)))
    assert rows_of(got, "claim_id", "rearm", "cause") == [
        ("hard", True, "hard_ceiling"),
        ("now", True, "hard_ceiling"),
        ("past", False, "lease_lapsed"),
    ]


def test_claimable_steps_come_in_schedule_order(make):
    ready = make(
        [("a", "x86", [], 0), ("b", "arm", [], 0), ("c", "x86", ["kvm"], 0), ("d", "x86", [], 9), ("e", "x86", ["big"], 0)],
        "drv_hash string, system string, required_features array<string>, next_attempt_at long",
    )
    members = make([(j, s) for j in "JKLM" for s in "abcde"], "job_id string, drv_hash string")
    slots = make(
        [("J", 1, 50, None, False), ("K", 5, 90, 2, False), ("L", 5, 10, 0, True), ("M", 5, 90, 1, False)],
        "job_id string, priority int, created_at long, free_slots long, at_cap boolean",
    )
    got = state.claimable(ready, members, slots, systems=["arm", "x86"], features=["kvm"], now_ms=F.lit(5))
    rows = [tuple(r) for r in got.orderBy("place").select("job_id", "drv_hash", "job_place", "job_rank", "place").collect()]
    # L is at its cap and keeps its place; K and M are cut at their free slots, ties go by job
    assert rows == [
        ("K", "b", 2, 1, 1), ("K", "a", 2, 2, 2), ("M", "b", 3, 1, 3),
        ("J", "b", 4, 1, 4), ("J", "a", 4, 2, 5), ("J", "c", 4, 3, 6),
    ]


def shuffles(spark, df):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_claim_is_shuffled_once(spark, make):
    ts = "timestamp"
    held = make([("a", 1, dt.datetime(2024, 1, 1))], f"claim_id string, job_id int, issued_at {ts}")
    later = make([("a", dt.datetime(2024, 1, 1, 0, 5))], f"claim_id string, ts {ts}")
    jobs = make([(1, 600)], "job_id int, claim_deadline_secs bigint")
    leases = cl.lease_timeline(held, later, jobs, F.lit("2100-01-01").cast("timestamp"), lifetime_secs=3000)
    assert shuffles(spark, leases) <= 3  # claims and jobs by job, then all by claim
    done = make([("c", "a", 1, dt.datetime(2024, 1, 2))], f"completion_id string, claim_id string, job_id int, completed_at {ts}")
    owners = make([("a", 1, 5, 1, "w")], "claim_id string, job_id int, drv_hash int, attempt int, worker_id string")
    assert shuffles(spark, cl.completion_validity(done, owners)) <= 2


def test_leases_of_repeated_claims(spark, make):
    """Issues of one claim that touch are one session, others give a row each; no claim, no row."""
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    held = make(
        [("a", 1, t(0)), ("a", 1, t(0)), ("b", 1, t(0)), ("b", 1, t(30)), ("c", 1, None), (None, 1, t(0)), ("d", 2, t(0))],
        "claim_id string, job_id int, issued_at timestamp",
    )
    later = make([("b", t(5)), ("b", t(10)), ("x", t(1)), ("d", t(10)), ("a", None)], "claim_id string, ts timestamp")
    jobs = make([(1, 600)], "job_id int, claim_deadline_secs bigint")
    got = cl.lease_timeline(held, later, jobs, F.lit("2100-01-01").cast("timestamp"), window_secs=300, lifetime_secs=540)
    assert rows_of(got, "claim_id", "issued_at", "deadline") == sorted(
        [
            ("a", t(0), t(9)), ("a", t(0), t(9)),
            ("b", t(0), t(9)), ("b", t(0), t(40)), ("b", t(30), t(20)), ("b", t(30), t(40)),
            ("d", t(0), t(5)),
        ],
        key=repr,
    )
