"""Sick-worker detection: trailing failure counts, quarantine intervals, as-of checks.

A worker is cut into time tiles before any window runs, so the work of one very busy
(or very broken) worker spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rivetgraph import params as P
from rivetgraph.operators.blocks import running_total, trailing_tiles
from rivetgraph.session import cut

US = 1_000_000
BLOCK_BURSTS = 512


def _micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def named_failures(failures: DataFrame) -> DataFrame:
    """Failures without a worker name are never counted against anyone."""
    return failures.where(F.coalesce("worker_id", F.lit("")) != "")


def trailing_failures(failures: DataFrame, *, window_secs: float = P.QUARANTINE_WINDOW_SECS) -> DataFrame:
    """WN-04: ``failures_in_window`` over [t − window, t], both ends in, itself included.

    Failures of one worker at the same instant count together. ``failures``: worker_id, ts, …

    The count is that of all failures up to t less that of those before t − window. Both are
    read off one running sum: an instant is listed in its own window-wide tile and, as history,
    in the next, and asks at t − window. So a tile costs a sort, however many failures it has.
    """
    width = int(window_secs * US)
    rows = named_failures(failures).withColumn("__us", _micros("ts"))
    instants = rows.groupBy("worker_id", "__us").agg(F.count(F.lit(1)).alias("n"))
    us, n, none = F.col("__us"), F.col("n"), F.lit(None).cast("bigint")
    tile = F.floor(us / F.lit(width)).cast("bigint")

    def mark(tile: Column, pos: Column, ord_: int, n: Column, asks: Column, sign: int) -> Column:
        parts = {"tile": tile, "pos": pos, "ord": F.lit(ord_), "add": n, "at": asks, "sign": F.lit(sign)}
        return F.struct(*[c.cast("int" if k in ("ord", "sign") else "bigint").alias(k) for k, c in parts.items()])

    marks = instants.select(
        "worker_id",
        F.inline(
            F.array(
                mark(tile, us, 1, n, us, 1),
                mark(tile + 1, us, 1, n, none, 0),
                # what lies before the window, so ahead of a failure at its very start
                mark(tile, us - width, 0, F.lit(0), us, -1),
            )
        ),
    )
    so_far = F.sum("add").over(
        Window.partitionBy("worker_id", "tile").orderBy("pos", "ord").rowsBetween(Window.unboundedPreceding, 0)
    )
    counts = (
        marks.withColumn("so_far", so_far)
        .where("sign <> 0")
        .groupBy("worker_id", "tile", "at")
        .agg(F.sum(F.col("sign") * F.col("so_far")).alias("failures_in_window"))
        .select("worker_id", F.col("at").alias("__us"), "failures_in_window")
    )
    return rows.join(counts, ["worker_id", "__us"]).select(*failures.columns, "failures_in_window")


def trips(
    failures: DataFrame, *, threshold: int = P.QUARANTINE_FAILURES, window_secs: float = P.QUARANTINE_WINDOW_SECS
) -> DataFrame:
    """Failures at or above the threshold."""
    return trailing_failures(failures, window_secs=window_secs).where(F.col("failures_in_window") >= threshold)


def quarantine_intervals(trip_rows: DataFrame, *, cooldown_secs: float = P.QUARANTINE_COOLDOWN_SECS) -> DataFrame:
    """WN-05 without resets: (worker_id, trip_ts, release_at, trips), overlaps merged.

    Two trips in one cooldown-wide tile always overlap, so each tile is first reduced to
    its ends; the merge then sees at most one row per worker and cooldown of history.
    """
    width = int(cooldown_secs * US)
    us = _micros("ts")
    tiles = (
        trip_rows.select("worker_id", us.alias("us"))
        .groupBy("worker_id", F.floor(F.col("us") / F.lit(width)).alias("tile"))
        .agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count(F.lit(1)).alias("n"))
    )
    by_time = Window.partitionBy("worker_id").orderBy("tile")
    starts = F.col("first") - F.lag("last").over(by_time) > width
    islands = tiles.withColumn("island", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(by_time))
    return islands.groupBy("worker_id", "island").agg(
        F.timestamp_micros(F.min("first")).alias("trip_ts"),
        F.timestamp_micros(F.max("last") + width).alias("release_at"),
        F.sum("n").alias("trips"),
    ).drop("island")


def quarantined_as_of(
    checks: DataFrame, intervals: DataFrame, *, cooldown_secs: float = P.QUARANTINE_COOLDOWN_SECS
) -> DataFrame:
    """JN-10: ``quarantined`` on each check (worker_id, ts, …): trip ≤ t < release.

    An interval is listed under every cooldown-wide tile it touches, so the join is an
    equi-join on (worker, tile) and each check meets the few intervals of its own tile.
    """
    width = int(cooldown_secs * US)
    tile = lambda us: F.floor(us / F.lit(width))
    spans = intervals.select(
        F.col("worker_id").alias("__w"),
        _micros("trip_ts").alias("__from"),
        _micros("release_at").alias("__to"),
    ).withColumn("__tile", F.explode(F.sequence(tile(F.col("__from")), tile(F.col("__to")))))
    us = _micros("ts")
    hit = checks.withColumn("__us", us).withColumn("__t", tile(us)).join(
        spans,
        (F.col("worker_id") == F.col("__w"))
        & (F.col("__t") == F.col("__tile"))
        & (F.col("__us") >= F.col("__from"))
        & (F.col("__us") < F.col("__to")),
        "left",
    )
    return hit.withColumn("quarantined", F.col("__w").isNotNull()).drop(
        "__us", "__t", "__w", "__from", "__to", "__tile"
    )


def quarantine_with_resets(
    failures: DataFrame,
    claim_checks: DataFrame,
    *,
    threshold: int = P.QUARANTINE_FAILURES,
    window_secs: float = P.QUARANTINE_WINDOW_SECS,
    cooldown_secs: float = P.QUARANTINE_COOLDOWN_SECS,
    block_bursts: int = BLOCK_BURSTS,
) -> DataFrame:
    """WN-05 exact: the first claim check after release also forgets the worker's failures.

    Gives one row per quarantine that took hold: (worker_id, trip_ts, release_at,
    cleared_at). ``failures`` and ``claim_checks``: worker_id, ts; instants must differ.

    What a reset changes is only whether the next burst trips: it does if a burst has
    ``threshold`` failures inside the window *and after the reset*. So:
    1. candidates = failures whose threshold-th latest failure lies in the window; keep
       that failure's time (``since``);
    2. candidates and checks shrink to one row per worker and cooldown-wide tile; two
       candidates of a tile have no free check between them;
    3. tiles join into bursts, split where a free check falls;
    4. the time of the last reset goes through the bursts in order, block by block
       (``held_bursts``).
    """
    width = int(window_secs * US)
    cool = int(cooldown_secs * US)
    tiled = trailing_tiles(named_failures(failures).select("worker_id", "ts"), _micros("ts"), width)
    in_tile = Window.partitionBy("worker_id", "__tile").orderBy("__us")
    candidates = (
        tiled.withColumn("since", F.lag("__us", threshold - 1).over(in_tile))
        .where(F.col("__own") & (F.col("__us") - F.col("since") <= width))
        .select("worker_id", F.col("__us").alias("us"), "since")
    )
    cool_tile = lambda c: F.floor(c / F.lit(cool))
    candidates = candidates.withColumn("tile", cool_tile(F.col("us")))
    hot = candidates.groupBy("worker_id", "tile").agg(
        F.min("us").alias("first"), F.max("us").alias("last"), F.max("since").alias("since")
    )
    # checks matter only where no candidate is within a cooldown before them
    asked = named_failures(claim_checks).select("worker_id", _micros("ts").alias("q"))
    near = hot.select("worker_id", F.explode(F.array("tile", F.col("tile") + 1)).alias("tile"), "first", "last")
    near = near.groupBy("worker_id", "tile").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    free = (
        asked.withColumn("tile", cool_tile(F.col("q")))
        .join(near, ["worker_id", "tile"], "left")
        .where(
            F.coalesce(
                ~F.exists("spans", lambda s: (s["first"] <= F.col("q")) & (s["last"] > F.col("q") - cool)),
                F.lit(True),
            )
        )
        .groupBy("worker_id", "tile")
        .agg(F.min("q").alias("free_at"))
    )
    # one row per tile: the free check of a tile always precedes its candidates
    tiles = hot.join(free, ["worker_id", "tile"], "full_outer").withColumn("opens", F.col("free_at").isNotNull().cast("bigint"))
    numbered = running_total(tiles, [F.col("tile")], F.col("opens"), keys=["worker_id"], out="burst")
    bursts = numbered.groupBy("worker_id", "burst").agg(
        F.min("free_at").alias("opened_by"), F.max("last").alias("last"), F.max("since").alias("since")
    )
    ends = bursts.select("worker_id", (F.col("burst") - 1).alias("burst"), F.col("opened_by").alias("cleared"))
    held = held_bursts(bursts.join(ends, ["worker_id", "burst"], "left").where("last is not null"), cool, block_bursts)
    # the trip is the first candidate of the burst that the last reset did not defuse
    trip = (
        held.join(numbered.select("worker_id", "burst", "tile"), ["worker_id", "burst"])
        .join(candidates, ["worker_id", "tile"])
        .where(F.col("since") > F.col("reset"))
        .groupBy("worker_id", "burst")
        .agg(F.min("us").alias("trip"))
    )
    folded = held.join(trip, ["worker_id", "burst"])
    stamp = lambda c: F.timestamp_micros(F.col(c))
    return folded.select(
        "worker_id",
        stamp("trip").alias("trip_ts"),
        stamp("release").alias("release_at"),
        stamp("cleared").alias("cleared_at"),
    )


def held_bursts(bursts: DataFrame, cool: int, block_bursts: int) -> DataFrame:
    """(worker_id, burst, reset, release, cleared) of the bursts that trip, given in order the
    time of the last reset.

    A burst trips if its ``since`` is after the last reset, and its ``cleared`` is the next
    reset. What a block of ``block_bursts`` bursts makes of the reset it is given depends on
    the first burst that trips only, and any reset given lies before the block. So a block's
    effect is a list of (since, reset after the block) for its first few bursts, up to one
    that trips whatever the reset. Blocks are put through their effects in order, then each
    is folded on its own with the reset it was given.
    """
    block = F.floor(F.col("burst") / block_bursts).alias("block")
    blocks = cut(
        bursts.groupBy("worker_id", block).agg(
            F.array_sort(F.collect_list(F.struct("burst", "opened_by", "last", "since", "cleared"))).alias("bursts")
        )
    )
    pair = "array<struct<since:bigint,after:bigint>>"

    def before(acc: Column, b: Column) -> Column:
        """From the last burst to the first: the reset after the block if this one trips."""
        nxt = F.get(F.filter(acc, lambda e: e["since"] > b["cleared"]), 0)["after"]
        return F.concat(F.array(F.struct(b["since"].alias("since"), F.coalesce(nxt, b["cleared"]).alias("after"))), acc)

    effect = F.aggregate(F.reverse("bursts"), F.array().cast(pair), before)
    sure = F.col("bursts")[0]["opened_by"]
    needed = blocks.select("worker_id", "block", effect.alias("effect"), sure.alias("sure")).withColumn(
        "effect",
        F.filter(
            "effect",
            lambda e, i: (i == 0) | F.coalesce(F.get(F.col("effect"), i - 1)["since"] < F.col("sure"), F.lit(True)),
        ),
    )
    listed = needed.groupBy("worker_id").agg(F.array_sort(F.collect_list(F.struct("block", "effect"))).alias("blocks"))

    def through(acc: Column, b: Column) -> Column:
        given = acc[F.size(acc) - 1]["reset"]
        trips = F.get(F.filter(b["effect"], lambda e: e["since"] > given), 0)
        after = F.when(trips.isNull(), given).otherwise(F.coalesce(trips["after"], given))
        return F.concat(acc, F.array(F.struct((b["block"] + 1).alias("follows"), after.alias("reset"))))

    never = F.struct(F.lit(0).cast("bigint").alias("follows"), F.lit(-(2**62)).cast("bigint").alias("reset"))
    # the i-th block is given what stands at place i
    given = listed.select(
        "worker_id",
        F.inline(
            F.zip_with(
                "blocks",
                F.slice(F.aggregate("blocks", F.array(never), through), 1, F.size("blocks")),
                lambda b, r: F.struct(b["block"].alias("block"), r["reset"].alias("reset")),
            )
        ),
    )

    def fold(acc: Column, b: Column) -> Column:
        trips = b["since"] > acc["reset"]
        row = F.struct(
            b["burst"].alias("burst"), acc["reset"].alias("reset"), (b["last"] + cool).alias("release"), b["cleared"].alias("cleared")
        )
        return F.struct(
            F.when(trips, F.coalesce(b["cleared"], acc["reset"])).otherwise(acc["reset"]).alias("reset"),
            F.when(trips, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(
        F.col("reset").alias("reset"),
        F.array().cast("array<struct<burst:bigint,reset:bigint,release:bigint,cleared:bigint>>").alias("out"),
    )
    return blocks.join(given, ["worker_id", "block"]).select(
        "worker_id", F.inline(F.aggregate("bursts", start, fold)["out"])
    )


def unfenced(requests: DataFrame, fenced: DataFrame) -> DataFrame:
    """JN-09: claim requests of fenced workers drop out; a request without a name never does."""
    return requests.join(fenced.select("worker_id").distinct(), "worker_id", "left_anti")
