"""Leases and progress levels by event time, a bucket's rows as columns.

The rules are those of ``stateful.Leases`` and ``stateful.Levels``, for tables where a Python
object per row costs too much time and disk. A task gathers its rows and cuts them by bucket
into packs (compressed Arrow), so that shuffle and state hold a few bytes a row and the engine
moves packs, not rows. A bucket's packs are only opened by its timer, which applies all rows
that the watermark has passed with array operations, in order of (key, time, kind).

``InPacks`` is the processor, with one list of packs, one state and one timer per bucket; what
it finds leaves it as Arrow bytes too, which ``opened`` turns into rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

US = 1_000_000
PACK_BYTES = 64 << 20  # rows that a task gathers before it cuts them by bucket
PACK_ROWS = 100_000  # at most, in a pack
FOUND_ROWS = 100_000  # rows and list elements that leave a timer together, about
ORDS = 16  # above any place in a list of kinds
FEW = 32  # keys for which array operations do not pay
NEVER, EVER = np.iinfo(np.int64).max, np.iinfo(np.int64).min
PACK_DDL = "bucket int, first_us bigint, rows binary"
FOUND_DDL = "found binary"


def _bytes(table: pa.Table | pa.RecordBatch) -> pa.Buffer:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write(table)
    return sink.getvalue()


def _is_text(kind: pa.DataType) -> bool:
    return pa.types.is_string(kind) or pa.types.is_binary(kind)


def _packed_type(kind: pa.DataType) -> pa.DataType:
    return pa.dictionary(pa.int32(), kind) if _is_text(kind) else kind


def _squeezed(bytes_: bytes) -> tuple[int, bytes]:
    return len(bytes_), pa.compress(bytes_, codec="zstd", asbytes=True) if bytes_ else b""


def _spread(size: int, squeezed: bytes) -> bytes:
    return pa.decompress(squeezed, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _steps(values: np.ndarray) -> tuple[tuple[int, int, int], bytes]:
    """Whole numbers as steps from one to the next over what divides all steps, first bytes,
    second bytes, … as far as any step has them."""
    steps = np.diff(values)
    unit = 1
    if len(steps) and steps.min() != EVER:
        unit = int(np.gcd.reduce(steps)) or 1
        steps //= unit
    folded = ((steps << 1) ^ (steps >> 63)).view(np.uint64)
    width = -(-int(folded.max()).bit_length() // 8) if len(folded) else 0
    return (int(values[0]), unit, width), folded.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _walked(n: int, how: tuple[int, int, int], bytes_: bytes) -> np.ndarray:
    start, unit, width = how
    wide = np.zeros((n - 1, 8), np.uint8)
    wide[:, :width] = np.frombuffer(bytes_, np.uint8).reshape(width, n - 1).T
    folded = wide.view(np.uint64).ravel()
    values = np.empty(n, np.int64)
    values[0] = start
    values[1:] = (folded >> np.uint64(1)).view(np.int64) ^ -(folded & np.uint64(1)).view(np.int64)
    values[1:] *= unit
    return np.cumsum(values)


def pack(table: pa.Table | pa.RecordBatch) -> bytes:
    """Columns of whole numbers and texts in few bytes; others as Arrow has them."""
    n, how, numbers, texts = table.num_rows, [], [], []
    for column in table.columns if n else ():
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if _is_text(column.type):
            column = column.dictionary_encode()
        if pa.types.is_dictionary(column.type):
            known = column.dictionary
            column = column.indices.fill_null(-1)
            how.append(len(known))
            if len(known):
                _, ends, text = known.buffers()
                ends = np.frombuffer(ends, np.int32)[known.offset : known.offset + len(known) + 1].astype(np.int64)
                length, bytes_ = _steps(np.diff(ends))
                how.append(length)
                numbers.append(bytes_)
                texts.append(text[ends[0] : ends[-1]].to_pybytes() if text else b"")
        elif not pa.types.is_integer(column.type):
            how.append(None)
            texts.append(_bytes(pa.table([column], names=["c"])).to_pybytes())
            how.append(len(texts[-1]))
            continue
        nulls = b""
        if column.null_count:
            nulls = np.packbits(column.is_null().to_numpy(zero_copy_only=False)).tobytes()
            column = column.fill_null(0)
        values, bytes_ = _steps(column.to_numpy().astype(np.int64))
        how += [values, len(nulls)]
        numbers += [bytes_, nulls]
    return pickle.dumps((n, how, _squeezed(b"".join(numbers)), _squeezed(b"".join(texts))), protocol=4)


def unpack(packed: bytes, schema: pa.Schema) -> pa.Table:
    n, how, numbers, texts = pickle.loads(packed)
    if not n:
        return schema.empty_table()
    how, numbers, texts = iter(how), memoryview(_spread(*numbers)), memoryview(_spread(*texts))

    def whole(n: int, values: tuple[int, int, int]) -> np.ndarray:
        nonlocal numbers
        size = values[2] * (n - 1)
        bytes_, numbers = numbers[:size], numbers[size:]
        return _walked(n, values, bytes_)

    columns = []
    for field in schema:
        kind, known, first = field.type, None, next(how)
        inner = kind.value_type if pa.types.is_dictionary(kind) else kind
        if first is None:
            size = next(how)
            columns.append(pa.ipc.open_stream(texts[:size]).read_all().column(0))
            texts = texts[size:]
            continue
        if _is_text(inner):
            offsets = np.zeros(first + 1, np.int32)
            if first:
                np.cumsum(whole(first, next(how)), out=offsets[1:])
            known = pa.Array.from_buffers(inner, first, [None, pa.py_buffer(offsets), pa.py_buffer(texts[: offsets[-1]])])
            texts = texts[offsets[-1] :]
            first = next(how)
        values, mask, size = whole(n, first), None, next(how)
        if size:
            mask = np.unpackbits(np.frombuffer(numbers[:size], np.uint8), count=n).astype(bool)
            numbers = numbers[size:]
        if known is None:
            columns.append(pa.array(values.astype(kind.to_pandas_dtype()), kind, mask=mask))
            continue
        coded = pa.DictionaryArray.from_arrays(pa.array(values, pa.int32(), mask=values < 0), known)
        columns.append(coded if inner is not kind else coded.cast(kind))
    return pa.table(columns, schema=schema)


def _packs(gathered: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(gathered)
    both = table["ord"].to_numpy()  # with the bucket, since every column costs time on its way here
    bucket = (both // ORDS).astype(np.uint16)  # sorted by digits then
    order = np.argsort(bucket, kind="stable")
    table = table.set_column(table.column_names.index("ord"), "ord", pa.array(both % ORDS, pa.int32()))
    rows = table.take(pa.array(order)).combine_chunks().to_batches()[0]
    bucket, us = bucket[order], rows.column("us").to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    cuts = [(c, min(b, c + PACK_ROWS)) for a, b in zip(edges, edges[1:]) for c in range(a, b, PACK_ROWS)]
    packed = []
    for a, b in cuts:
        packed.append(pack(rows.slice(a, b - a)))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([int(bucket[a]) for a, _ in cuts], pa.int32()),
            pa.array([int(us[a:b].min()) for a, b in cuts], pa.int64()),
            pa.array(packed, pa.binary()),
        ],
        names=["bucket", "first_us", "rows"],
    )


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, us, ord, …), whose ord holds ``ORDS`` times the bucket too, to packs of a
    bucket's rows (``PACK_DDL``)."""
    gathered, size = [], 0
    for batch in batches:
        if batch.num_rows:
            gathered.append(batch)
            size += batch.nbytes
        if size >= PACK_BYTES:
            yield from _packs(gathered)
            gathered, size = [], 0
    if gathered:
        yield from _packs(gathered)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What timers found (``FOUND_DDL``) as rows."""
    for batch in batches:
        for found in batch.column(0):
            yield from pa.ipc.open_stream(found.as_buffer())


def _coded(*columns: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers for the values of all columns, 0 for null, and the values from 1 on."""
    encoded = [c if pa.types.is_dictionary(c.type) else c.dictionary_encode() for c in columns]
    one = pa.chunked_array([k for c in encoded for k in c.chunks], type=encoded[0].type)
    one = one.unify_dictionaries().combine_chunks()
    return one.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1, one.dictionary


def _named(code: np.ndarray, names: pa.Array) -> pa.Array:
    return names.take(pa.array(code - 1, pa.int64(), mask=code == 0))


def _plain(table: pa.Table) -> pa.Table:
    """Texts themselves in place of their places in a list, which may have texts of other rows."""
    return pa.table({n: c.cast(c.type.value_type) if pa.types.is_dictionary(c.type) else c for n, c in zip(table.column_names, table.columns)})


def _filled(column: pa.ChunkedArray, instead: int) -> np.ndarray:
    return column.fill_null(instead).to_numpy()


class Rule:
    """What both rules share. ``rows`` of ``apply`` have us at or before ``now`` and come in
    any order; ``kept`` are the tables that the last call gave."""

    def __init__(self, key: str, key_ddl: str, row_ddl: str, out_ddl: str) -> None:
        self.key = key
        row = to_arrow_schema(T.StructType.fromDDL(f"{key} {key_ddl}, {row_ddl}"))
        self.key_type = row.field(key).type
        self.rows = pa.schema([(f.name, _packed_type(f.type)) for f in row])
        self.out_ddl = f"{key} {key_ddl}, {out_ddl}, late_us bigint"
        self.out = to_arrow_schema(T.StructType.fromDDL(self.out_ddl))

    def kept_schemas(self) -> tuple[pa.Schema, ...]:
        raise NotImplementedError

    def apply(self, rows: pa.Table, kept: tuple, now: int) -> tuple[tuple, int | None, Iterator[pa.RecordBatch]]:
        """What to keep, the next time at which something is due, and what was found."""
        raise NotImplementedError

    def found(self, n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in self.out], schema=self.out)

    def late(self, rows: pa.Table) -> pa.RecordBatch:
        names = _named(*_coded(rows[self.key]))
        return self.found(rows.num_rows, **{self.key: names, "late_us": rows["us"].combine_chunks()})


class InPacks(StatefulProcessor):
    """Many keys of ``rule`` under one list of packs, one state and one timer."""

    def __init__(self, rule: Rule) -> None:
        self.rule = rule

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "packs binary")
        self.kept = handle.getValueState("kept", "tables binary")
        self.armed = handle.getValueState("armed", "at bigint")

    @staticmethod
    def _out(found: pa.RecordBatch) -> pd.DataFrame:
        return pd.DataFrame({"found": [_bytes(found).to_pybytes()]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, first = timerValues.getCurrentWatermarkInMs() * 1000, NEVER
        for pdf in rows:
            fresh = []
            for us, packed in zip(pdf["first_us"].tolist(), pdf["rows"]):
                if seen and us <= seen:
                    table = unpack(packed, self.rule.rows)
                    late = pc.less_equal(table["us"], seen)
                    yield self._out(self.rule.late(table.filter(late)))
                    table = table.filter(pc.invert(late))
                    if not table.num_rows:
                        continue
                    us, packed = pc.min(table["us"]).as_py(), pack(_plain(table))
                fresh.append(bytes(packed))
                first = min(first, us)
            self._hold(fresh)
        if first != NEVER:
            self._arm(first)

    def _hold(self, packed: list[bytes]) -> None:
        # every value is a message to the JVM
        if packed:
            self.held.appendValue((pickle.dumps(packed, protocol=4),))

    def _arm(self, us: int) -> None:
        # a timer is in milliseconds and must not fire before its time
        at, armed = -(-us // 1000), self.armed.get()
        if armed is None or at < armed[0]:
            if armed is not None:
                self.handle.deleteTimer(armed[0])
            self.handle.registerTimer(at)
            self.armed.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = self.rule.rows
        rows = pa.concat_tables([rows.empty_table(), *(unpack(p, rows) for held in self.held.get() for p in pickle.loads(held[0]))])
        kept, schemas = self.kept.get(), self.rule.kept_schemas()
        kept = tuple(map(unpack, pickle.loads(kept[0]), schemas)) if kept else tuple(s.empty_table() for s in schemas)
        passed = pc.less_equal(rows["us"], now)
        due, rest = rows.filter(passed), rows.filter(pc.invert(passed))
        del rows
        self.held.clear()
        for a in range(0, rest.num_rows, PACK_ROWS):
            self._hold([pack(_plain(rest.slice(a, PACK_ROWS)))])
        kept, wake, found = self.rule.apply(due, kept, now)
        if any(t.num_rows for t in kept):
            self.kept.update((pickle.dumps([pack(t) for t in kept], protocol=4),))
        else:
            self.kept.clear()
        times = [t for t in (pc.min(rest["us"]).as_py(), wake) if t is not None]
        # the engine itself drops the timer that called
        self.armed.clear()
        if times:
            self._arm(min(times))
        for one in found:
            yield self._out(one)

    def close(self) -> None:
        pass


class LeaseColumns(Rule):
    """``stateful.Leases``; the key's rows are taken first, second, … of all keys at a time."""

    ISSUE, EXTEND, COMPLETE = 1, 2, 3  # places in the operator's list of kinds

    def __init__(self, by_row, key_ddl: str) -> None:
        self.by_row = by_row
        self.kinds = (None, "issue", "extend", "complete")
        super().__init__(by_row.KEY, key_ddl, "us bigint, ord int, window_secs bigint, lifetime_secs bigint", by_row.OUT)

    def kept_schemas(self) -> tuple[pa.Schema, ...]:
        return (pa.schema([(self.key, self.key_type), *((n, pa.int64()) for n in ("window", "deadline", "hard"))]),)

    def apply(self, rows, kept, now):
        (kept,) = kept
        n = rows.num_rows
        code, names = _coded(rows[self.key], kept[self.key])
        code, old = code[:n], code[n:]
        window, deadline, hard = (np.full(len(names) + 1, x, np.int64) for x in (0, NEVER, NEVER))
        window[old], deadline[old], hard[old] = kept["window"], kept["deadline"], _filled(kept["hard"], NEVER)
        us, kind = rows["us"].to_numpy(), rows["ord"].to_numpy()
        order = np.lexsort((kind, us, code))
        code, us, kind = code[order], us[order], kind[order]
        longest = (1 << 61) // US
        secs = lambda c: np.clip(_filled(rows[c], 0), -longest, longest)[order] * US
        unset = lambda c: rows[c].is_null().to_numpy()[order]
        own = np.where(unset("window_secs"), self.by_row.window, secs("window_secs"))
        limit = NEVER if self.by_row.lifetime is None else self.by_row.lifetime
        life = np.where(unset("lifetime_secs"), limit, secs("lifetime_secs"))
        count = np.bincount(code, minlength=len(window))
        first = np.cumsum(count) - count
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def lapse(keys: np.ndarray, until) -> None:
            over = deadline[keys] <= until
            keys = keys[over]
            if len(keys):
                found.append((keys, deadline[keys], deadline[keys] >= hard[keys]))
                deadline[keys] = hard[keys] = NEVER

        left, turn = np.flatnonzero(count), 0
        while len(left) >= FEW:
            at = first[left] + turn
            lapse(left, us[at])
            free = deadline[left] == NEVER
            new = (kind[at] == self.ISSUE) & free
            keys, i = left[new], at[new]
            window[keys], deadline[keys] = own[i], us[i] + own[i]
            hard[keys] = np.where(life[i] == NEVER, NEVER, us[i] + np.where(life[i] == NEVER, 0, life[i]))
            more = (kind[at] == self.EXTEND) & ~free
            keys, i = left[more], at[more]
            deadline[keys] = np.minimum(us[i] + window[keys], hard[keys])
            keys = left[kind[at] == self.COMPLETE]
            deadline[keys] = hard[keys] = NEVER
            turn += 1
            left = left[count[left] > turn]
        for k in left.tolist():  # few keys with many rows: row by row
            a, b = first[k] + turn, first[k] + count[k]
            given = [None if x == NEVER else int(x) for x in (window[k], deadline[k], hard[k])]
            s = dict(zip(("window", "deadline", "hard"), given if given[1] is not None else [None] * 3))
            for t, o, w, x in zip(us[a:b].tolist(), kind[a:b].tolist(), own[a:b].tolist(), life[a:b].tolist()):
                for one in self.by_row.on_time(s, t):
                    found.append(tuple(np.array([x]) for x in (k, one["expired_us"], one["cause"] == "hard_ceiling")))
                # the window and lifetime are here in microseconds, with the defaults filled in
                if self.kinds[o if 0 <= o <= 3 else 0] == "issue" and s["deadline"] is None:
                    s.update(window=w, deadline=t + w, hard=None if x == NEVER else t + x)
                elif o != self.ISSUE:
                    for _ in self.by_row.on_row(s, (t, o, self.kinds[o if 0 <= o <= 3 else 0], None, None)):
                        pass
            window[k] = s["window"] or 0
            deadline[k], hard[k] = (NEVER if s[x] is None else s[x] for x in ("deadline", "hard"))
        lapse(np.arange(len(window)), now)

        live = np.flatnonzero(deadline != NEVER)
        unlimited = hard[live] == NEVER
        kept = pa.table(
            [_named(live, names), pa.array(window[live]), pa.array(deadline[live]), pa.array(hard[live], mask=unlimited)],
            schema=self.kept_schemas()[0],
        )
        return (kept,), int(deadline[live].min()) if len(live) else None, self._found(found, names)

    def _found(self, found, names) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        keys, due, ceiling = (np.concatenate(x) for x in zip(*found))
        causes = pa.array(["lease_lapsed", "hard_ceiling"])
        for a in range(0, len(keys), FOUND_ROWS):
            at = slice(a, a + FOUND_ROWS)
            yield self.found(
                len(keys[at]),
                **{self.key: _named(keys[at], names)},
                expired_us=pa.array(due[at]),
                cause=causes.take(pa.array(ceiling[at].astype(np.int8))),
            )


class LevelColumns(Rule):
    """``stateful.Levels``. A job's rows between two ticks are a group; the groups up to one
    with ``job_done`` are a span, over which counts run and starts meet their ends."""

    # places in the operator's list of kinds
    MEMBER, STARTED, RETRIED, COMPLETED, FAILED, PROPAGATED, SEAL, JOB_DONE = range(1, 9)
    COUNTS = ("total", "done", "failed", "retries", "propagated")

    def __init__(self, by_row, key_ddl: str) -> None:
        self.every = by_row.every
        super().__init__(by_row.KEY, key_ddl, "us bigint, ord int, step string", by_row.OUT)

    def kept_schemas(self) -> tuple[pa.Schema, ...]:
        key = (self.key, self.key_type)
        flags = [("sealed", pa.int64()), ("over", pa.int64()), ("due", pa.int64())]
        return pa.schema([key, *((c, pa.int64()) for c in self.COUNTS), *flags]), pa.schema([key, ("started", pa.int64()), ("step", pa.string())])

    def apply(self, rows, kept, now):
        jobs, opens = kept
        n, m = rows.num_rows, jobs.num_rows
        if not n + m:
            return kept, None, iter(())
        code, names = _coded(rows[self.key], jobs[self.key], opens[self.key])
        step, steps = _coded(rows["step"], opens["step"])
        step = np.concatenate([step[:n], np.zeros(m, np.int64), step[n:]])
        mine, theirs = slice(n, n + m), slice(n + m, None)  # a row for what is kept of a job, then its open starts
        us, kind = np.full(len(code), EVER), np.zeros(len(code), np.int8)
        us[:n], us[theirs] = rows["us"], opens["started"]
        kind[:n], kind[theirs] = rows["ord"], self.STARTED
        due = np.full(len(names) + 1, EVER)
        due[code[mine]] = _filled(jobs["due"], EVER)
        tick = due[code]  # EVER: nothing is due
        tick[:n] = (us[:n] // self.every + 1) * self.every
        # counts, then whether sealed and whether over
        add = np.zeros((7, len(code)), np.int64)
        for i, kinds in enumerate(
            [(self.MEMBER,), (self.COMPLETED,), (self.FAILED, self.PROPAGATED), (self.RETRIED,), (self.PROPAGATED,), (self.SEAL,), (self.JOB_DONE,)]
        ):
            add[i] = np.isin(kind, kinds)
        for i, name in enumerate((*self.COUNTS, "sealed", "over")):
            add[i, mine] = jobs[name]

        order = np.lexsort((kind, us, code))
        code, us, kind, tick, step, add = code[order], us[order], kind[order], tick[order], step[order], add[:, order]
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (tick[1:] != tick[:-1])])
        head, group = np.flatnonzero(new), np.cumsum(new) - 1
        tail = np.concatenate([head[1:], [len(code)]]) - 1
        job, tick = code[head], tick[head]
        shown = (tick != EVER) & (tick <= now)
        over = np.add.reduceat(add[6], head) > 0
        last = np.concatenate([job[1:] != job[:-1], [True]])
        closes = shown & over
        opening = np.concatenate([[True], (last | closes)[:-1]])
        span, from_group = np.cumsum(opening) - 1, np.flatnonzero(opening)
        to_group = np.concatenate([from_group[1:], [len(head)]])
        run = np.cumsum(add, axis=1)
        start = head[from_group]
        level = run[:, tail] - (run[:, start] - add[:, start])[:, span]
        del run, add

        begun, ended, started, step = self._flights(code, us, kind, step, group, span, to_group, steps)
        building = np.cumsum(np.bincount(begun, minlength=len(head) + 1) - np.bincount(ended, minlength=len(head) + 1))[:-1]

        pending = tick > now
        stays = last & ~closes & ((level[:6] != 0).any(axis=0) | pending | (building > 0))
        keeps = np.flatnonzero(stays)
        jobs = pa.table(
            [
                _named(job[keeps], names),
                *(pa.array(level[i, keeps]) for i in range(6)),
                pa.array((over & pending)[keeps].astype(np.int64)),
                pa.array(tick[keeps], mask=~pending[keeps]),
            ],
            schema=self.kept_schemas()[0],
        )
        still = np.flatnonzero((ended == to_group[span[begun]]) & stays[ended - 1])
        opens = pa.table([_named(job[begun[still]], names), pa.array(started[still]), _named(step[still], steps)], schema=self.kept_schemas()[1])
        wake = tick[keeps][pending[keeps]]
        found = self._found(job, tick, level, building, np.flatnonzero(shown), begun, ended, started, step, names, steps)
        return (jobs, opens), int(wake.min()) if len(wake) else None, found

    def _flights(self, code, us, kind, step, group, span, to_group, steps):
        """Of every start, by (job, time, step): the group in which it is first in flight, the
        one in which it no longer is, its time and step. An end meets the earliest open start."""
        at = np.flatnonzero((kind >= self.STARTED) & (kind <= self.FAILED))
        pair = span[group[at]] * (len(steps) + 1) + step[at]
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        first = np.concatenate([[True], pair[1:] != pair[:-1]])[: len(at)]
        head, pair = np.flatnonzero(first), np.cumsum(first) - 1
        starts = kind[at] == self.STARTED
        move = np.where(starts, 1, -1)
        depth = np.cumsum(move)
        depth -= (depth - move)[head][pair]
        apart = pair * (2 * len(at) + 2)  # so that a minimum does not reach into the next pair
        least = np.concatenate([[0], (np.minimum.accumulate(depth - apart) + apart)[:-1]])[: len(at)]
        least[head] = 0
        meets = ~starts & (depth >= np.minimum(least, 0))

        pairs = len(head)
        ends, n_ends = at[meets], np.bincount(pair[meets], minlength=pairs)
        first_end = np.cumsum(n_ends) - n_ends
        of = pair[starts]
        n_starts = np.bincount(of, minlength=pairs)
        rank = np.arange(len(of)) - (np.cumsum(n_starts) - n_starts)[of]
        at = at[starts]
        begun = group[at]
        ended = to_group[span[begun]]
        met = rank < n_ends[of]
        ended[met] = group[ends[first_end[of[met]] + rank[met]]]

        job, started, step = code[at], us[at], step[at]
        place = np.zeros(len(at), np.int64)
        order = np.lexsort((started, job))
        tied = (job[order][1:] == job[order][:-1]) & (started[order][1:] == started[order][:-1])
        if tied.any():
            tied = np.concatenate([[False], tied]) | np.concatenate([tied, [False]])
            rows = order[tied]
            some, which = np.unique(step[rows], return_inverse=True)
            sort = pc.sort_indices(_named(some, steps)).to_numpy()
            ranks = np.empty(len(some), np.int64)
            ranks[sort] = np.arange(len(some))
            place[rows] = ranks[which]
            order = np.lexsort((place, started, job))
        return begun[order], ended[order], started[order], step[order]

    def _found(self, job, tick, level, building, shown, begun, ended, started, step, names, steps) -> Iterator[pa.RecordBatch]:
        """Levels of the groups ``shown``, some at a time, since each lists its starts in flight."""
        if not len(shown):
            return
        before = np.zeros(len(job) + 1, np.int64)  # groups shown before a group
        before[shown + 1] = 1
        before = np.cumsum(before)
        low, high = before[begun], before[ended]
        size = np.cumsum(building[shown] + 1) // FOUND_ROWS
        edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(shown)]
        total, done, failed, retries, propagated, sealed = range(6)
        in_flight = self.out.field("in_flight").type
        for a, b in zip(edges, edges[1:]):
            g = shown[a:b]
            some = np.flatnonzero(high[: np.searchsorted(low, b)] > a)
            lo, hi = np.maximum(low[some], a), np.minimum(high[some], b)
            n = np.maximum(hi - lo, 0)
            which = np.repeat(np.arange(len(some)), n)
            at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which] - a
            by = np.argsort(at, kind="stable")
            starts = some[which[by]]
            offsets = np.concatenate([[0], np.cumsum(building[g])]).astype(np.int32)
            flights = pa.StructArray.from_arrays(
                [pa.array(started[starts]), _named(step[starts], steps)], fields=list(in_flight.value_type)
            )
            yield self.found(
                len(g),
                **{self.key: _named(job[g], names)},
                tick_us=pa.array(tick[g]),
                total=pa.array(level[total, g]),
                pending=pa.array(np.maximum(0, level[total, g] - level[done, g] - level[failed, g] - building[g])),
                building=pa.array(building[g]),
                done=pa.array(level[done, g]),
                failed=pa.array(level[failed, g]),
                retries=pa.array(level[retries, g]),
                propagated=pa.array(level[propagated, g]),
                sealed=pa.array(level[sealed, g] > 0),
                in_flight=pa.ListArray.from_arrays(pa.array(offsets), flights, type=in_flight),
            )

