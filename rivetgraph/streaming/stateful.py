"""Keyed state by event time: quarantine, leases, heartbeats, job ends, progress levels.

All five are ``InTimeOrder`` processors on ``transformWithState``. A key's rows are held until
the watermark has passed them and are then applied in time order, so the result does not
depend on how the input was cut into files or in which order they came. Whatever happens
without a row (a lease runs out, a quarantine ends, a tick is due) happens at its own time
through the key's one timer, which stands at the next such time or held row. State that can
change nothing any more is dropped.

A row behind the watermark is not applied; it comes out flagged ``late`` with its time, and
``split_late`` puts it in a side table. Rows of one instant are applied in the order named by
each operator. Times before 1970 are behind every watermark.

State per key: the rows between watermark and newest row, and what the operator keeps (the
last few failures, one deadline, counts and open claims). Keys are dealt into ``STATE_BUCKETS``
buckets, and the engine keeps one state and one timer per bucket: every call for state is a
message to the JVM, which cost more than the rules themselves where a key has few rows. A
bucket's keys are held in its task one bucket at a time.

Leases and progress levels, which see every row of the largest tables, go through the same
buckets as columns (``columns``): rows are packed before the shuffle and stay packed until the
watermark has passed them. ``Leases`` and ``Levels`` state the rules, row by row.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from rivetgraph import params as P
from rivetgraph.streaming import columns

US = 1_000_000
STATE_BUCKETS = 2048  # keys that share one are read and written together


class InTimeOrder(StatefulProcessor):
    """Base of the processors below.

    ``KEY``: name of the key column; ``ROW``: columns of a held row, ``us`` and ``ord`` first;
    ``KEPT``: what a subclass keeps, all nullable; ``OUT``: its result columns.
    """

    KEY = ""
    ROW = "us bigint, ord int"
    KEPT = ""
    OUT = ""

    def planned(self) -> InTimeOrder:
        """Reads the column lists where a session is at hand."""
        row = T.StructType(_fields(self.ROW)).simpleString()
        self.state_ddl = f"armed bigint, held array<{row}>, {self.KEPT}"
        self.row_names = [f.name for f in _fields(self.ROW)]
        self.kept_names = [f.name for f in _fields(self.KEPT)]
        self.out_names = [f.name for f in _fields(self.OUT)]
        return self

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_ddl)

    # what a subclass defines; ``s`` is a dict of its kept columns, None where never set
    def on_row(self, s: dict, row: tuple) -> Iterator[dict]:
        raise NotImplementedError

    def on_time(self, s: dict, until: int) -> Iterator[dict]:
        """What is due at or before ``until``."""
        raise NotImplementedError

    def wake(self, s: dict) -> int | None:
        """The next time at which ``on_time`` has something to do."""
        raise NotImplementedError

    def idle(self, s: dict) -> bool:
        """Whether nothing needs to be remembered."""
        raise NotImplementedError

    def _read(self) -> tuple[int | None, list[tuple], dict]:
        found = self.state.get()
        if found is None:
            return None, [], dict.fromkeys(self.kept_names)
        armed, held, *kept = found
        return armed, [tuple(r) for r in held or ()], dict(zip(self.kept_names, kept))

    def _write(self, armed: int | None, held: list[tuple], s: dict) -> None:
        """Keep what is needed and set the timer to the next time that matters."""
        times = [r[0] for r in held]
        if (due := self.wake(s)) is not None:
            times.append(due)
        if not times and self.idle(s):
            if armed is not None:
                self.handle.deleteTimer(armed)
            self.state.clear()
            return
        # a timer is in milliseconds and must not fire before its time
        at = -(-min(times) // 1000) if times else None
        if at != armed:
            if armed is not None:
                self.handle.deleteTimer(armed)
            if at is not None:
                self.handle.registerTimer(at)
        self.state.update((at, held, *(s[n] for n in self.kept_names)))

    def _out(self, key, values: dict) -> Row:
        return Row(**{self.KEY: key[0]}, **{n: values.get(n) for n in self.out_names}, late_us=values.get("late_us"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = []
        for r in rows:
            if r.us is None:
                continue
            if seen and r.us <= seen:
                yield self._out(key, {"late_us": r.us})
            else:
                fresh.append(tuple(r[n] for n in self.row_names))
        if fresh:
            armed, held, s = self._read()
            self._write(armed, held + fresh, s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        _, held, s = self._read()
        due = sorted((r for r in held if r[0] <= now), key=lambda r: r[:2])
        for row in due:
            for found in self.on_time(s, row[0]):
                yield self._out(key, found)
            for found in self.on_row(s, row):
                yield self._out(key, found)
        for found in self.on_time(s, now):
            yield self._out(key, found)
        self._write(None, [r for r in held if r[0] > now], s)

    def close(self) -> None:
        pass


class Cell:
    """One key's state and timer inside a bucket; to a processor it is the engine's handle."""

    def __init__(self, at: int | None = None, value: tuple | None = None) -> None:
        self.at, self.value = at, value

    def getValueState(self, name: str, schema: str) -> Cell:
        return self

    def get(self) -> tuple | None:
        return self.value

    def update(self, value: tuple) -> None:
        self.value = value

    def clear(self) -> None:
        self.value = None

    def registerTimer(self, ms: int) -> None:
        self.at = ms

    def deleteTimer(self, ms: int) -> None:
        if self.at == ms:
            self.at = None


class InBuckets(StatefulProcessor):
    """Many keys of ``processor`` under one state and one timer, which stands at their first.

    The state is the bucket's (key, timer, value) as pickled tuples: as columns every number of
    it would be converted on both sides, for every key of the bucket."""

    def __init__(self, processor: InTimeOrder) -> None:
        self.processor = processor.planned()

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "armed bigint, cells binary")

    def _read(self) -> tuple[int | None, dict]:
        found = self.state.get()
        if found is None:
            return None, {}
        armed, cells = found
        return armed, {key: Cell(at, value) for key, at, value in pickle.loads(cells)}

    def _write(self, armed: int | None, cells: dict) -> None:
        kept = [(key, c.at, c.value) for key, c in cells.items() if c.value is not None]
        at = min((c[1] for c in kept if c[1] is not None), default=None)
        if at != armed:
            if armed is not None:
                self.handle.deleteTimer(armed)
            if at is not None:
                self.handle.registerTimer(at)
        if kept:
            self.state.update((at, pickle.dumps(kept, protocol=4)))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mine = defaultdict(list)
        for row in rows:
            mine[row[self.processor.KEY]].append(row)
        armed, cells = self._read()
        for name, own in mine.items():
            self.processor.init(cells.setdefault(name, Cell()))
            yield from self.processor.handleInputRows((name,), own, timerValues)
        self._write(armed, cells)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        _, cells = self._read()
        for name, cell in cells.items():
            if cell.at is not None and cell.at <= now:
                cell.at = None
                self.processor.init(cell)
                yield from self.processor.handleExpiredTimer((name,), timerValues, expiredTimerInfo)
        self._write(None, cells)

    def close(self) -> None:
        pass


def _fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def _applied(
    rows: DataFrame, processor: InTimeOrder, late: str, ord_: Column, buckets: int = STATE_BUCKETS
) -> DataFrame:
    """``rows`` (key, ts, …) through ``processor``; ``late`` is the watermark's delay.

    The time goes on as a number: Spark would drop late rows by a time column before they
    could be told apart."""
    key = processor.KEY
    timed = _timed(rows, key, processor.ROW, late, ord_, buckets)
    key_type = timed.schema[key].dataType.simpleString()
    out = f"{key} {key_type}, {processor.OUT}, late_us bigint"
    return timed.groupBy("bucket").transformWithState(InBuckets(processor), out, "append", "EventTime")


def _timed(rows: DataFrame, key: str, ddl: str, late: str, ord_: Column, buckets: int) -> DataFrame:
    """(bucket, key, columns of ``ddl``) with the watermark set."""
    extra = [F.col(f.name).cast(f.dataType).alias(f.name) for f in _fields(ddl)[2:]]
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    return rows.withWatermark("ts", late).select(
        bucket, key, F.unix_micros("ts").alias("us"), ord_.cast("int").alias("ord"), *extra
    )


def _applied_columns(
    rows: DataFrame, rule: type[columns.Rule], by_row: InTimeOrder, late: str, ord_: Column, buckets: int = STATE_BUCKETS
) -> DataFrame:
    """``_applied`` with a bucket's rows as columns: results of ``by_row``, by ``rule``."""
    key = by_row.KEY
    made = rule(by_row, rows.schema[key].dataType.simpleString())
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _fields(by_row.ROW) if f.name in made.rows.names)
    timed = _timed(rows, key, ddl, late, ord_, buckets).where(F.col("us").isNotNull())
    with_bucket = (F.col("bucket") * columns.ORDS + F.col("ord")).alias("ord")
    packs = timed.select(*[with_bucket if n == "ord" else n for n in made.rows.names]).mapInArrow(columns.packs, columns.PACK_DDL)
    found = packs.groupBy("bucket").transformWithStateInPandas(columns.InPacks(made), columns.FOUND_DDL, "append", "EventTime")
    return found.mapInArrow(columns.opened, made.out_ddl)


def split_late(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an operator found, and (key, late_us) of the rows that came too late."""
    key = results.columns[0]
    return (
        results.where(F.col("late_us").isNull()).drop("late_us"),
        results.where(F.col("late_us").isNotNull()).select(key, "late_us"),
    )


def _rank(kinds: tuple[str, ...]) -> Column:
    """Place of ``kind`` among rows of one instant."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), F.lit(0))


class Quarantine(InTimeOrder):
    KEY = "worker_id"
    ROW = "us bigint, ord int, is_failure boolean"
    KEPT = "recent array<bigint>, release bigint, announced boolean"
    OUT = "kind string, at_us bigint, release_us bigint"

    def __init__(self, threshold: int, window: int, cooldown: int, forget: int | None) -> None:
        self.threshold, self.window, self.cooldown, self.forget = threshold, window, cooldown, forget

    def on_row(self, s: dict, row: tuple) -> Iterator[dict]:
        us, _, bad = row
        if bad:
            # of all failures in the window the last ``threshold`` decide
            recent = [r for r in s["recent"] or () if r >= us - self.window] + [us]
            s["recent"] = recent[-self.threshold :]
            if len(recent) >= self.threshold:
                s["release"], s["announced"] = us + self.cooldown, False
                yield {"kind": "tripped", "at_us": us, "release_us": s["release"]}
        elif s["release"] is not None and us >= s["release"]:
            yield {"kind": "cleared", "at_us": us, "release_us": s["release"]}
            s["recent"], s["release"], s["announced"] = None, None, None

    def on_time(self, s: dict, until: int) -> Iterator[dict]:
        if s["release"] is not None and not s["announced"] and s["release"] <= until:
            s["announced"] = True
            yield {"kind": "released", "at_us": s["release"], "release_us": s["release"]}
        if s["recent"] and s["recent"][-1] + self.window < until:
            s["recent"] = None
        if self.forget is not None and s["announced"] and not s["recent"] and s["release"] + self.forget <= until:
            s["release"], s["announced"] = None, None

    def wake(self, s: dict) -> int | None:
        times = []
        if s["release"] is not None and not s["announced"]:
            times.append(s["release"])
        if s["recent"]:
            times.append(s["recent"][-1] + self.window + 1)
        elif self.forget is not None and s["announced"]:
            times.append(s["release"] + self.forget)
        return min(times, default=None)

    def idle(self, s: dict) -> bool:
        return not s["recent"] and s["release"] is None


def quarantine_stream(
    events: DataFrame,
    *,
    threshold: int = P.QUARANTINE_FAILURES,
    window_secs: int = P.QUARANTINE_WINDOW_SECS,
    cooldown_secs: int = P.QUARANTINE_COOLDOWN_SECS,
    forget_secs: int | None = None,
    late: str,
) -> DataFrame:
    """ST-05: (worker_id, kind, at_us, release_us) as quarantine goes on.

    ``tripped``: a failure at or over the threshold, with the new release; ``released``: the
    release came without another trip; ``cleared``: the first claim check after it, which
    also forgets the worker's failures. ``events``: worker_id, ts, is_failure (else a claim
    check); nameless workers are never counted. Failures go before checks of one instant.

    Failures are forgotten once they leave the window. A release is remembered until a check
    clears it, or, with ``forget_secs``, for so long; a later check then clears nothing.
    """
    named = events.where(F.coalesce("worker_id", F.lit("")) != "")
    forget = None if forget_secs is None else forget_secs * US
    processor = Quarantine(threshold, window_secs * US, cooldown_secs * US, forget)
    return _applied(named, processor, late, F.when(F.col("is_failure"), 0).otherwise(1))


def quarantines_of(changes: DataFrame) -> DataFrame:
    """WN-05's rows (worker_id, trip_ts, release_at, cleared_at) from the changes of ST-05.

    A quarantine ends where a check clears it; ``changes`` are few, one per trip."""
    from pyspark.sql import Window

    by_time = Window.partitionBy("worker_id").orderBy("at_us", "kind")
    before = F.count_if(F.col("kind") == "cleared").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    stamp = lambda c: F.timestamp_micros(c)
    return (
        changes.where("kind <> 'released'")
        .withColumn("n", before)
        .groupBy("worker_id", "n")
        .agg(
            stamp(F.min(F.when(F.col("kind") == "tripped", F.col("at_us")))).alias("trip_ts"),
            stamp(F.max("release_us")).alias("release_at"),
            stamp(F.max(F.when(F.col("kind") == "cleared", F.col("at_us")))).alias("cleared_at"),
        )
        .drop("n")
    )


class Leases(InTimeOrder):
    KEY = "claim_id"
    ROW = "us bigint, ord int, kind string, window_secs bigint, lifetime_secs bigint"
    KEPT = "window bigint, deadline bigint, hard bigint"
    OUT = "expired_us bigint, cause string"

    def __init__(self, window: int, lifetime: int | None) -> None:
        self.window, self.lifetime = window, lifetime

    def on_row(self, s: dict, row: tuple) -> Iterator[dict]:
        us, _, kind, window, lifetime = row
        if kind == "issue" and s["deadline"] is None:
            s["window"] = self.window if window is None else window * US
            lifetime = self.lifetime if lifetime is None else lifetime * US
            s["hard"] = None if lifetime is None else us + lifetime
            s["deadline"] = us + s["window"]
        elif kind == "extend" and s["deadline"] is not None:
            due = us + s["window"]
            s["deadline"] = due if s["hard"] is None else min(due, s["hard"])
        elif kind == "complete":
            s.update(dict.fromkeys(s))
        yield from ()

    def on_time(self, s: dict, until: int) -> Iterator[dict]:
        due = s["deadline"]
        if due is not None and due <= until:
            at_ceiling = s["hard"] is not None and due >= s["hard"]
            yield {"expired_us": due, "cause": "hard_ceiling" if at_ceiling else "lease_lapsed"}
            s.update(dict.fromkeys(s))

    def wake(self, s: dict) -> int | None:
        return s["deadline"]

    def idle(self, s: dict) -> bool:
        return s["deadline"] is None


def lease_expiries(
    events: DataFrame, *, window_secs: int = P.CLAIM_DEADLINE_SECS, lifetime_secs: int | None = None, late: str
) -> DataFrame:
    """ST-06: (claim_id, expired_us, cause) of claims neither completed nor extended in time.

    ``events``: claim_id, ts, kind in issue / extend / complete and, on the issue, the job's
    own window_secs and lifetime_secs (null: the arguments). An extension moves the deadline
    to its time plus the window, at most to issue plus lifetime. A lease is over at its very
    deadline: what comes then or later finds nothing. A claim's state is its deadline and
    goes with it.
    """
    processor = Leases(window_secs * US, None if lifetime_secs is None else lifetime_secs * US)
    return _applied_columns(events, columns.LeaseColumns, processor, late, _rank(("issue", "extend", "complete")))


class Heartbeats(InTimeOrder):
    KEY = "job_id"
    ROW = "us bigint, ord int"
    KEPT = "last bigint, cancelled bigint"
    OUT = "cancelled_us bigint"

    def __init__(self, gap: int, forget: int | None) -> None:
        self.gap, self.forget = gap, forget

    def on_row(self, s: dict, row: tuple) -> Iterator[dict]:
        if s["cancelled"] is None:
            s["last"] = row[0]
        yield from ()

    def on_time(self, s: dict, until: int) -> Iterator[dict]:
        if s["last"] is not None and s["last"] + self.gap <= until:
            s["cancelled"], s["last"] = s["last"] + self.gap, None
            yield {"cancelled_us": s["cancelled"]}
        if self.forget is not None and s["cancelled"] is not None and s["cancelled"] + self.forget <= until:
            s["cancelled"] = None

    def wake(self, s: dict) -> int | None:
        if s["last"] is not None:
            return s["last"] + self.gap
        return None if self.forget is None or s["cancelled"] is None else s["cancelled"] + self.forget

    def idle(self, s: dict) -> bool:
        return s["last"] is None and s["cancelled"] is None


def heartbeat_timeouts(
    beats: DataFrame,
    *,
    gap_secs: int = P.HEARTBEAT_TIMEOUT_SECS,
    forget_secs: int | None = P.JOB_RETENTION_DAYS * 86_400,
    late: str,
) -> DataFrame:
    """ST-07: (job_id, cancelled_us), once per job, when it has been silent for the gap.

    ``beats``: job_id, ts. A cancelled job's later beats change nothing for ``forget_secs``,
    after which it is forgotten (None: never)."""
    forget = None if forget_secs is None else forget_secs * US
    return _applied(beats, Heartbeats(gap_secs * US, forget), late, F.lit(0))


class JobEnds(InTimeOrder):
    KEY = "job_id"
    ROW = "us bigint, ord int, kind string"
    KEPT = "members bigint, finished bigint, failed bigint, sealed boolean, over bigint"
    OUT = "ended_us bigint, finished bigint, failed bigint"

    def __init__(self, forget: int | None) -> None:
        self.forget = forget

    def on_row(self, s: dict, row: tuple) -> Iterator[dict]:
        us, _, kind = row
        if s["over"] is not None:
            return
        if kind == "seal":
            s["sealed"] = True
        elif kind in ("member", "finished", "failed"):
            counted = "members" if kind == "member" else kind
            s[counted] = (s[counted] or 0) + 1
        done = (s["finished"] or 0) + (s["failed"] or 0)
        if s["sealed"] and done >= (s["members"] or 0):
            yield {"ended_us": us, "finished": s["finished"] or 0, "failed": s["failed"] or 0}
            s.update(dict.fromkeys(s), over=us)

    def on_time(self, s: dict, until: int) -> Iterator[dict]:
        if self.forget is not None and s["over"] is not None and s["over"] + self.forget <= until:
            s["over"] = None
        yield from ()

    def wake(self, s: dict) -> int | None:
        return None if self.forget is None or s["over"] is None else s["over"] + self.forget

    def idle(self, s: dict) -> bool:
        return all(v is None for v in s.values())


def terminal_jobs(
    events: DataFrame, *, forget_secs: int | None = P.JOB_RETENTION_DAYS * 86_400, late: str
) -> DataFrame:
    """ST-11: (job_id, ended_us, finished, failed) once, at the first moment at which a job is
    sealed and all its members so far have ended.

    ``events``: job_id, ts, kind in member / finished / failed / seal, applied in this order
    within an instant. A job that is over ignores what follows for ``forget_secs``."""
    forget = None if forget_secs is None else forget_secs * US
    return _applied(events, JobEnds(forget), late, _rank(("member", "finished", "failed", "seal")))


class Levels(InTimeOrder):
    KEY = "job_id"
    ROW = "us bigint, ord int, kind string, step string"
    KEPT = (
        "total bigint, done bigint, failed bigint, retries bigint, propagated bigint, sealed boolean, "
        "open array<struct<started: bigint, step: string>>, due bigint, over boolean"
    )
    OUT = (
        "tick_us bigint, total bigint, pending bigint, building bigint, done bigint, failed bigint, retries bigint, "
        "propagated bigint, sealed boolean, in_flight array<struct<started_us: bigint, step: string>>"
    )

    def __init__(self, every: int) -> None:
        self.every = every

    def on_row(self, s: dict, row: tuple) -> Iterator[dict]:
        us, _, kind, step = row
        counts = {
            "member": ("total",),
            "completed": ("done",),
            "failed": ("failed",),
            "retried": ("retries",),
            "propagated": ("failed", "propagated"),
        }
        for name in counts.get(kind, ()):
            s[name] = (s[name] or 0) + 1
        now_open = [tuple(o) for o in s["open"] or ()]
        if kind == "started":
            now_open.append((us, step))
        elif kind in ("completed", "failed", "retried"):
            mine = [o for o in now_open if o[1] == step]
            if mine:
                now_open.remove(min(mine))
        elif kind == "seal":
            s["sealed"] = True
        elif kind == "job_done":
            s["over"] = True
        s["open"] = now_open or None
        if s["due"] is None:
            s["due"] = (us // self.every + 1) * self.every
        yield from ()

    def on_time(self, s: dict, until: int) -> Iterator[dict]:
        if s["due"] is None or s["due"] > until:
            return
        now_open = sorted(tuple(o) for o in s["open"] or ())
        count = {n: s[n] or 0 for n in ("total", "done", "failed", "retries", "propagated")}
        pending = max(0, count["total"] - count["done"] - count["failed"] - len(now_open))
        yield count | {
            "tick_us": s["due"], "pending": pending, "building": len(now_open),
            "sealed": bool(s["sealed"]), "in_flight": now_open,
        }
        s["due"] = None
        if s["over"]:
            s.update(dict.fromkeys(s))

    def wake(self, s: dict) -> int | None:
        return s["due"]

    def idle(self, s: dict) -> bool:
        return all(v is None for v in s.values())


LEVEL_KINDS = ("member", "started", "retried", "completed", "failed", "propagated", "seal", "job_done")


def progress_levels(events: DataFrame, *, every_secs: int = P.PROGRESS_TICK_SECS, late: str) -> DataFrame:
    """ST-02: a job's level at each tick that follows a change: counts by state, retries,
    propagated failures, sealed, and the steps in flight, longest first.

    ``events``: job_id, ts, kind (``LEVEL_KINDS``, applied in this order within an instant)
    and step, which pairs an end with the earliest open start. A level holds what happened
    before its tick; a tick without change since the one before would repeat it and is left
    out. ``job_done`` gives the last level and drops the job's state."""
    return _applied_columns(events, columns.LevelColumns, Levels(every_secs * US), late, _rank(LEVEL_KINDS))
