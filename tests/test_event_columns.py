"""Rules over columns give what the rules by row give, for any split of the input."""

import datetime as dt
import random
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pytest

from rivetgraph.streaming import columns, stateful as st
from rivetgraph.streaming.runner import drain
from tests.conftest import rows_of
from tests.test_event_time import BASE, US, at, secs, simulated, split, stream_of  # noqa: F401


class Engine:
    """A bucket's list, values and timers."""

    def __init__(self):
        self.values, self.lists, self.timers, self.bytes = {}, {}, set(), 0

    def getListState(self, name, schema):
        rows = self.lists.setdefault(name, [])

        def add(value):
            self.bytes += sum(map(len, value))
            rows.append(value)

        return SimpleNamespace(get=lambda: iter([*rows]), appendValue=add, clear=rows.clear)

    def getValueState(self, name, schema):
        return SimpleNamespace(
            get=lambda: self.values.get(name),
            update=lambda v: self.values.__setitem__(name, v),
            clear=lambda: self.values.pop(name, None),
        )

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


def packed(rule, rows):
    """Rows (key, values) as the operator packs them, two tasks' worth."""
    found = []
    for some in (rows[::2], rows[1::2]):
        if some:
            names = rule.rows.names
            plain = pa.schema([(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in rule.rows])
            batch = pa.RecordBatch.from_pylist([dict(zip(names, (k, *map(r.get, names[1:])))) for k, r in some], schema=plain)
            found += [p.to_pandas() for p in columns.packs(iter([batch]))]
    return found


def in_columns(rule, batches, delay):
    """Results, the engine and what is left, as ``simulated`` gives them; all keys share a bucket."""
    engine, out, watermark, newest = Engine(), [], 0, 0
    processor = columns.InPacks(rule)
    processor.init(engine)

    def results(pdfs):
        frame = pd.concat([*pdfs, pd.DataFrame({"found": []})])
        for table in columns.opened(iter([pa.RecordBatch.from_arrays([pa.array(frame["found"].tolist(), pa.binary())], ["found"])])):
            out.extend(table.to_pylist())

    for batch in [*batches, []]:
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
        if batch:
            results(processor.handleInputRows((0,), iter(packed(rule, batch)), clock))
            newest = max(newest, *(r["us"] for _, r in batch))
        assert len(engine.timers) <= 1
        for ms in sorted(m for m in engine.timers if m <= watermark):
            results(processor.handleExpiredTimer((0,), clock, None))
            engine.timers.discard(ms)
        watermark = max(watermark, newest // 1000 - delay * 1000)
    return out, engine


def same(by_row, got, key):
    tuples = lambda v: [tuple(x.values()) if isinstance(x, dict) else x for x in v] if isinstance(v, list) else v
    names = [n for n in got[0] if n != key]
    want = sorted(([k, *(v[n] for n in names)] for k, v in by_row), key=repr)
    assert sorted(([r[key], *(tuples(r[n]) for n in names)] for r in got), key=repr) == want
    assert len(want) > 5


@pytest.mark.parametrize("few", [1, 10**9])  # all keys at a time, or row by row
@pytest.mark.parametrize("seed", range(6))
def test_leases_in_columns(spark, monkeypatch, seed, few):
    monkeypatch.setattr(columns, "FEW", few)
    rng = random.Random(seed)
    kinds = ("issue", "extend", "complete", "other")
    rows = [
        at(k, rng.randrange(2000), o, kind=kinds[o - 1], window_secs=rng.choice([None, 40, -5, 0]), lifetime_secs=rng.choice([None, 90]))
        for k in [None, *map(str, range(60))]
        for o in rng.choices(range(1, 5), [5, 3, 1, 1], k=9)
    ]
    rows = list({(k, r["us"], r["ord"]): (k, r) for k, r in rows}.values())
    for _, r in rows:
        r["ord"] %= 4
    batches = [*split(rows, rng, 9), [at("~", 10_000_000, 0, kind="none", window_secs=None, lifetime_secs=None)]]
    by_row = st.Leases(30 * US, rng.choice([None, 300 * US]))
    late = rng.choice([100, 400, 700])
    want, _, _ = simulated(by_row, batches, late)
    got, engine = in_columns(columns.LeaseColumns(by_row, "string"), batches, late)
    same(want, got, "claim_id")
    assert any(r["late_us"] for r in got) and "kept" not in engine.values


@pytest.mark.parametrize("listed", [3, 100_000])  # levels that leave a timer together
@pytest.mark.parametrize("seed", range(8))
def test_levels_in_columns(spark, monkeypatch, seed, listed):
    monkeypatch.setattr(columns, "FOUND_ROWS", listed)
    monkeypatch.setattr(columns, "PACK_ROWS", 7)
    rng = random.Random(seed)
    rank = {k: i + 1 for i, k in enumerate(st.LEVEL_KINDS)} | {"other": 0}
    rows = [
        at(j, rng.randrange(900), rank[kind], kind=kind, step=rng.choice("abcde"))
        for j in [None, *range(8)]
        for kind in rng.choices([*rank], [4, 9, 2, 3, 2, 1, 1, 0.4, 1], k=40)
    ]
    rows = list({(k, r["us"], r["ord"]): (k, r) for k, r in rows}.values())
    batches = [*split(rows, rng, 9), [at(-1, 10_000_000, 0, kind="other", step=None)]]
    late = rng.choice([100, 300, 700])
    want, _, _ = simulated(st.Levels(60 * US), batches, late)
    got, _ = in_columns(columns.LevelColumns(st.Levels(60 * US), "bigint"), batches, late)
    same(want, got, "job_id")
    assert any(r["late_us"] for r in got) and any(len(r["in_flight"] or ()) > 1 for r in got)


def test_steps_of_one_instant_are_listed_by_name(spark):
    rows = [at(1, 5, 2, kind="started", step=s) for s in "cabd"] + [at(1, 6, 4, kind="completed", step=s) for s in "ab"]
    end = at(2, 10_000_000, 0, kind="other", step=None)
    got, _ = in_columns(columns.LevelColumns(st.Levels(60 * US), "bigint"), [rows, [end]], 0)
    assert [f["step"] for f in got[0]["in_flight"]] == ["c", "d"] and got[0]["done"] == 2


def test_packs_give_their_columns_back(spark):
    rng = random.Random(1)
    table = pa.table(
        {
            "text": pa.array([rng.choice(["", "é", "abc", None]) for _ in range(300)], pa.string()),
            "empty": pa.nulls(300, pa.string()),
            "whole": pa.array([rng.choice([None, 7, -(2**63), 2**63 - 1]) for _ in range(300)], pa.int64()),
            "stepped": pa.array([i * 5_000_000 - 10**15 for i in range(300)], pa.int64()),
            "day": pa.array([rng.choice([None, dt.date(2024, 1, 1)]) for _ in range(300)], pa.date32()),
        }
    )
    for n in (0, 1, 2, 300):
        assert columns.unpack(columns.pack(table.slice(5, n)), table.schema).equals(table.slice(5, n))


def held(made, rows):
    """Bytes of state a row until the watermark has passed it."""
    engine = Engine()
    processor = columns.InPacks(made)
    processor.init(engine)
    [*processor.handleInputRows((0,), iter(packed(made, rows)), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))]
    return engine.bytes / len(rows)


def test_a_held_row_takes_few_bytes(spark):
    rng = random.Random(3)
    claims = [(f"{rng.getrandbits(128):032x}", rng.randrange(10**8)) for _ in range(400)]
    leases = [at(c, t + s, o, kind=k, window_secs=None, lifetime_secs=40) for c, t in claims for s, o, k in ((0, 1, "issue"), (15, 2, "extend"), (33, 3, "complete"))]
    levels = [at(t % 99, t + s, o, kind=k, step=c) for c, t in claims for s, o, k in ((0, 1, "member"), (5, 2, "started"), (33, 4, "completed"))]
    for made, rows in (
        (columns.LeaseColumns(st.Leases(30 * US, None), "string"), leases),
        (columns.LevelColumns(st.Levels(60 * US), "bigint"), levels),
    ):
        assert held(made, rows) < 16  # a digest alone is 16 bytes, and both tasks have it


def plan_of(stream):
    return stream._jdf.queryExecution().analyzed().toString()


def test_live_operators_move_packs(stream_of):  # noqa: F811
    rows = [(str(c), secs(c), "issue", None, None) for c in range(50)] + [("end", secs(90_000), "complete", None, None)]
    out = st.lease_expiries(stream_of([rows], "claim_id string, ts timestamp, kind string, window_secs bigint, lifetime_secs bigint"), late="1 hour")
    levels = st.progress_levels(out.selectExpr("claim_id AS job_id", "timestamp_micros(expired_us) AS ts", "'member' AS kind", "cause AS step"), every_secs=60, late="1 hour")
    assert "packs" in plan_of(out) and "packs" in plan_of(levels)
    got, late = st.split_late(drain(out))
    assert rows_of(got.select("claim_id", "expired_us")) == sorted((str(c), BASE + (c + 3600) * US) for c in range(50)) and late.count() == 0
