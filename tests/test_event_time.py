"""Event-time processors: any split of the input gives the batch rule's result.

``simulated`` drives a processor as the engine does (rows, then timers at the watermark), so
many splits run fast; one test per operator runs it in a real stream.
"""

import collections
import datetime as dt
import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row, functions as F

from rivetgraph.operators import workers
from rivetgraph.streaming import stateful as st
from rivetgraph.streaming.runner import drain, file_stream
from tests.conftest import rows_of

US = 1_000_000
T0 = dt.datetime(2024, 1, 1)
BASE = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) * US


class Store:
    """One key's value state and timers."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


def simulated(processor, batches, delay):
    """(key, result) of all rows, the stores left, and the watermark."""
    stores, out, watermark, newest = collections.defaultdict(Store), [], 0, 0
    processor.planned()

    def results(key, rows):
        out.extend((key, {n: r[n] for n in r.asDict() if n != processor.KEY}) for r in rows)

    for batch in [*batches, []]:
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
        by_key = collections.defaultdict(list)
        for key, row in batch:
            by_key[key].append(Row(**row))
            newest = max(newest, row["us"])
        for key, rows in by_key.items():
            processor.init(stores[key])
            results(key, processor.handleInputRows((key,), iter(rows), clock))
        for key, store in list(stores.items()):
            for ms in sorted(m for m in store.timers if m <= watermark):
                store.timers.discard(ms)
                processor.init(store)
                results(key, processor.handleExpiredTimer((key,), clock, None))
        watermark = max(watermark, newest // 1000 - delay * 1000)
    return out, stores, watermark * 1000


def split(rows, rng, n):
    rows = list(rows)
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(len(rows)), min(n, len(rows) - 1)))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]


def at(key, secs, ord_=0, **more):
    return key, {"us": BASE + int(secs * US), "ord": ord_, **more}


END = at("~", 10_000_000)  # a row far ahead lets the watermark pass all others


def found(out):
    return sorted(((k, *v.values()) for k, v in out if v["late_us"] is None), key=repr)


def stepped_quarantine(rows, threshold, window, cooldown):
    out = []
    for w in sorted({k for k, _ in rows}):
        recent, release = [], None
        for us, bad in sorted((r["us"], r["is_failure"]) for k, r in rows if k == w):
            if bad:
                recent = [r for r in recent if r >= us - window * US] + [us]
                if len(recent) >= threshold:
                    release = us + cooldown * US
                    out.append((w, "tripped", us, release, None))
            elif release is not None and us >= release:
                out.append((w, "cleared", us, release, None))
                recent, release = [], None
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(12))
def test_quarantine_of_any_split(spark, seed):
    rng = random.Random(seed)
    rows = [
        at(w, s, int(not bad), is_failure=bad)
        for w in "ab"
        for s in rng.sample(range(3000), 90)
        for bad in [rng.random() < 0.7]
    ]
    processor = st.Quarantine(3, 100 * US, 150 * US, None)
    end = ("~", END[1] | {"is_failure": False})
    out, stores, _ = simulated(processor, [*split(rows, rng, rng.randrange(1, 20)), [end]], 5000)
    got = found(out)
    assert [r for r in got if r[1] != "released"] == stepped_quarantine(rows, 3, 100, 150)
    trips = [r for r in got if r[1] == "tripped"]
    # a release is announced unless another trip came first
    want = {(w, rel) for w, _, us, rel, _ in trips if not any(x[0] == w and us < x[2] <= rel - 1 for x in trips)}
    assert {(r[0], r[3]) for r in got if r[1] == "released"} == want
    left = [s.value for k, s in stores.items() if k != "~" and s.value is not None]
    assert all(v[2] is None and v[3] is not None for v in left)  # only releases no check has cleared


def test_quarantine_state_empties(spark):
    rows = [at("a", s, 0, is_failure=True) for s in (0, 1, 2, 500)] + [at("b", 3, 0, is_failure=True)]
    end = ("~", END[1] | {"is_failure": False})
    out, stores, _ = simulated(st.Quarantine(3, 100 * US, 150 * US, 1000 * US), [rows, [end], []], 0)
    assert [r[1] for r in found(out)] == ["released", "tripped"]
    assert all(s.value is None and not s.timers for k, s in stores.items() if k != "~")


@pytest.mark.parametrize("seed", range(12))
def test_leases_of_any_split(spark, seed):
    rng, rows, want = random.Random(seed), [], []
    for c in range(25):
        issued, window = rng.randrange(500), rng.choice([None, 40])
        lifetime = rng.choice([None, 120])
        events = [(issued, "issue")] + [(issued + rng.randrange(1, 300), rng.choice(["extend", "extend", "complete"])) for _ in range(rng.randrange(6))]
        rows += [at(c, s, ("issue", "extend", "complete").index(k), kind=k, window_secs=window, lifetime_secs=lifetime) for s, k in events]
        w, deadline, over = window or 60, issued + (window or 60), False
        for s, k in sorted(events, key=lambda e: (e[0], ("issue", "extend", "complete").index(e[1])))[1:]:
            if s >= deadline or over:
                break
            over = k == "complete"
            if k == "extend":
                deadline = min(s + w, issued + lifetime) if lifetime else s + w
        if not over:
            cause = "hard_ceiling" if lifetime and deadline >= issued + lifetime else "lease_lapsed"
            want.append((c, BASE + deadline * US, cause, None))
    end = ("~", END[1] | {"kind": "none", "window_secs": None, "lifetime_secs": None})
    out, stores, _ = simulated(st.Leases(60 * US, None), [*split(rows, rng, rng.randrange(1, 30)), [end]], 2000)
    assert found(out) == sorted(want, key=repr)
    assert all(s.value is None and not s.timers for k, s in stores.items() if k != "~")


def test_late_rows_come_out_apart(spark):
    lease = {"kind": "issue", "window_secs": None, "lifetime_secs": None}
    batches = [[at("a", 100, **lease)], [at("b", 1000, **lease)], [at("c", 50, **lease)], [at("d", 3000, **lease)]]
    out, stores, _ = simulated(st.Leases(60 * US, None), batches, 10)
    assert [(k, v["late_us"]) for k, v in out if v["late_us"] is not None] == [("c", BASE + 50 * US)]
    assert [r[0] for r in found(out)] == ["a", "b"] and stores["c"].value is None


@pytest.mark.parametrize("seed", range(8))
def test_heartbeats_of_any_split(spark, seed):
    rng = random.Random(seed)
    rows = [at(j, s) for j in "abc" for s in rng.sample(range(2000), 60)]
    out, stores, _ = simulated(st.Heartbeats(50 * US, 10**6 * US), [*split(rows, rng, 15), [END]], 3000)
    want = []
    for j in "abc":
        beats = sorted(r["us"] for k, r in rows if k == j)
        want.append((j, next(a + 50 * US for a, b in zip(beats, [*beats[1:], 10**18]) if b - a >= 50 * US), None))
    assert found(out) == want
    assert all(s.value is None for k, s in stores.items() if k != "~")


@pytest.mark.parametrize("seed", range(8))
def test_job_ends_of_any_split(spark, seed):
    rng, rows, want = random.Random(seed), [], []
    kinds = ("member", "finished", "failed", "seal")
    for j in "abcdef":
        events = [(rng.randrange(900), "seal")] if rng.random() < 0.8 else []
        for _ in range(rng.randrange(6)):
            s = rng.randrange(800)
            events += [(s, "member"), (s + rng.randrange(200), rng.choice(kinds[1:3]))]
        rows += [at(j, s, kinds.index(k), kind=k) for s, k in events]
        count, sealed = collections.Counter(), False
        for s, k in sorted(events, key=lambda e: (e[0], kinds.index(e[1]))):
            count[k] += 1
            if count["seal"] and count["finished"] + count["failed"] >= count["member"]:
                want.append((j, BASE + s * US, count["finished"], count["failed"], None))
                break
    end = ("~", END[1] | {"kind": "none"})
    out, stores, _ = simulated(st.JobEnds(10**5 * US), [*split(rows, rng, 12), [end]], 5000)
    assert found(out) == sorted(want, key=repr)
    done = {w[0] for w in want}
    assert all((s.value is None) == (k in done) for k, s in stores.items() if k != "~")


@pytest.mark.parametrize("seed", range(8))
def test_levels_of_any_split(spark, seed):
    rng, rows, every = random.Random(seed), [], 60
    for j in "abc":
        for i in range(rng.randrange(1, 12)):
            s, took = rng.randrange(900), rng.randrange(1, 200)
            rows += [(j, s, "member", f"s{i}"), (j, s + 1, "started", f"s{i}")]
            rows += [(j, s + took + 1, k, f"s{i}") for k in rng.choice([["completed"], ["failed"], ["retried"], []])]
        rows += [(j, rng.randrange(900), k, None) for k in ("propagated", "seal") if rng.random() < 0.6]
    rank = {k: i for i, k in enumerate(st.LEVEL_KINDS)}
    want = []
    for j in "abc":
        mine = sorted((r for r in rows if r[0] == j), key=lambda r: (r[1], rank[r[2]]))
        for tick in sorted({(r[1] // every + 1) * every for r in mine}):
            count, flying = collections.Counter(), {}
            for _, s, k, step in mine:
                if s < tick:
                    count[k] += 1
                    if k == "started":
                        flying[step] = s
                    elif k in ("completed", "failed", "retried"):
                        flying.pop(step)
            failed = count["failed"] + count["propagated"]
            pending = max(0, count["member"] - count["completed"] - failed - len(flying))
            want.append(
                (j, BASE + tick * US, count["member"], pending, len(flying), count["completed"], failed, count["retried"],
                 count["propagated"], count["seal"] > 0, sorted((BASE + s * US, x) for x, s in flying.items()), None)
            )
    fed = [at(j, s, rank[k], kind=k, step=step) for j, s, k, step in rows]
    end = ("~", END[1] | {"kind": "none", "step": None})
    out, _, _ = simulated(st.Levels(every * US), [*split(fed, rng, 10), [end]], 5000)
    assert found(out) == sorted(want, key=repr)


def test_last_level_drops_the_job(spark):
    rows = [at("a", 1, 0, kind="member", step=None), at("a", 2, 7, kind="job_done", step=None)]
    end = ("~", END[1] | {"kind": "none", "step": None})
    out, stores, _ = simulated(st.Levels(60 * US), [rows, [end]], 0)
    assert len(found(out)) == 1 and stores["a"].value is None


@pytest.fixture
def stream_of(spark, tmp_path):
    """stream_of(parts, ddl) → stream of one file per trigger, in the order given."""

    def run(parts, ddl):
        folder = tmp_path / "in"
        folder.mkdir()
        for i, rows in enumerate(parts):
            one = tmp_path / f"part{i}"
            spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(one))
            (folder / f"{i}.parquet").write_bytes(next(one.glob("part-*.parquet")).read_bytes())
            os.utime(folder / f"{i}.parquet", (1_700_000_000 + i * 10,) * 2)
        return file_stream(spark, str(folder), spark.read.parquet(str(folder)).schema, files_per_trigger=1)

    return run


def secs(s):
    return T0 + dt.timedelta(seconds=s)


def test_live_quarantine_equals_the_batch_operator(spark, make, stream_of):
    rng = random.Random(5)
    rows = [(w, secs(s), rng.random() < 0.7) for w in "ab" for s in rng.sample(range(3000), 80)]
    rows += [("", secs(1), True), (None, secs(2), True)]
    parts = split(rows, rng, 4) + [[("z", secs(9000), False)]]
    changes = st.quarantine_stream(
        stream_of(parts, "worker_id string, ts timestamp, is_failure boolean"), threshold=3, window_secs=100, cooldown_secs=150, late="1 hour"
    )
    results, late = st.split_late(drain(changes))
    batch = make(rows, "worker_id string, ts timestamp, is_failure boolean")
    want = workers.quarantine_with_resets(
        batch.where("is_failure"), batch.where("not is_failure"), threshold=3, window_secs=100, cooldown_secs=150
    )
    assert rows_of(st.quarantines_of(results)) == rows_of(want) and late.count() == 0


def test_live_leases_and_their_late_rows(stream_of):
    ddl = "claim_id string, ts timestamp, kind string, window_secs bigint, lifetime_secs bigint"
    issue = lambda c, s, w=None, life=None: (c, secs(s), "issue", w, life)
    more = lambda c, s, k: (c, secs(s), k, None, None)
    parts = [
        [more("done", 99, "complete"), more("extended", 90, "extend"), more("capped", 90, "extend")],
        [issue("done", 0), issue("edge", 0), issue("extended", 0), issue("own", 10, 30), issue("capped", 0, None, 120)],
        [more("edge", 100, "complete"), more("extended", 150, "complete"), issue("open", 3990)],
        [issue("late", 20)],
        [issue("end", 4000)],
    ]
    out = st.lease_expiries(stream_of(parts, ddl), window_secs=100, late="10 minutes")
    results, late = st.split_late(drain(out))
    assert rows_of(results.select("claim_id", F.timestamp_micros("expired_us"), "cause")) == [
        ("capped", secs(120), "hard_ceiling"), ("edge", secs(100), "lease_lapsed"), ("own", secs(40), "lease_lapsed"),
    ]
    assert rows_of(late.select("claim_id", F.timestamp_micros("late_us"))) == [("late", secs(20))]


def test_live_job_ends_timeouts_and_levels(stream_of):
    ddl = "job_id bigint, ts timestamp, kind string, step string"
    parts = [
        [(1, secs(50), "finished", "a"), (1, secs(60), "seal", None), (2, secs(5), "member", "b")],
        [(1, secs(1), "member", "a"), (2, secs(6), "failed", "b"), (2, secs(70), "seal", None)],
        [(9, secs(9000), "member", "x")],
    ]
    stream = stream_of(parts, ddl)
    ends, _ = st.split_late(drain(st.terminal_jobs(stream, late="1 hour")))
    assert rows_of(ends.select("job_id", F.timestamp_micros("ended_us"), "finished", "failed")) == [(1, secs(60), 1, 0), (2, secs(70), 0, 1)]
    out, _ = st.split_late(drain(st.heartbeat_timeouts(stream.select("job_id", "ts"), late="1 hour")))
    assert rows_of(out.select("job_id", F.timestamp_micros("cancelled_us"))) == [(1, secs(31)), (2, secs(36))]
    levels, _ = st.split_late(drain(st.progress_levels(stream.replace("finished", "completed", "kind"), every_secs=60, late="1 hour")))
    assert rows_of(levels.select("job_id", F.timestamp_micros("tick_us"), "total", "done", "failed", "sealed")) == [
        (1, secs(60), 1, 1, 0, False), (1, secs(120), 1, 1, 0, True), (2, secs(60), 1, 0, 1, False), (2, secs(120), 1, 0, 1, True),
    ]


@pytest.mark.parametrize("seed", range(4))
def test_keys_of_one_bucket_share_state_and_timer(seed):
    """Same results as a state per key, with a few calls for state per batch, not per key."""
    rng = random.Random(seed)
    kind = ("issue", "extend", "complete")
    rows = [
        at(k, rng.randrange(2000), o, kind=kind[o], window_secs=None, lifetime_secs=None)
        for k in range(200)
        for o in rng.choices(range(3), [5, 2, 1], k=4)
    ]
    end = at("~", 10_000_000, kind="complete", window_secs=None, lifetime_secs=None)
    batches = [*split(rows, rng, 3), [end]]
    single, _, _ = simulated(st.Leases(30 * US, 300 * US), batches, 5000)

    calls = collections.Counter()

    class Counted(Store):
        def update(self, value):
            calls["update"] += 1
            super().update(value)

        def registerTimer(self, ms):
            calls["timer"] += 1
            super().registerTimer(ms)

    store, out, watermark, newest = Counted(), [], 0, 0
    buckets = st.InBuckets(st.Leases(30 * US, 300 * US))
    buckets.init(store)
    for batch in [*batches, []]:
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
        if batch:
            out.extend(buckets.handleInputRows((0,), iter([Row(claim_id=k, **r) for k, r in batch]), clock))
            newest = max(newest, *(r["us"] for _, r in batch))
        for ms in sorted(m for m in store.timers if m <= watermark):
            store.timers.discard(ms)
            out.extend(buckets.handleExpiredTimer((0,), clock, None))
        watermark = max(watermark, newest // 1000 - 5_000_000)
    assert sorted(((r["claim_id"], r["expired_us"], r["cause"]) for r in out), key=repr) == sorted(
        ((k, r["expired_us"], r["cause"]) for k, r in single), key=repr
    )
    assert len(out) > 100 and len(store.timers) <= 1
    assert calls["update"] <= 2 * len(batches) and calls["timer"] <= 2 * len(batches)
