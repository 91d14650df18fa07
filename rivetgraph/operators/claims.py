"""Claims (leases) and completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rivetgraph import params as P
from rivetgraph.functions.outcomes import is_terminal
from rivetgraph.functions.times import plus_seconds, seconds_between
from rivetgraph.operators.blocks import numbered
from rivetgraph.session import cut


def completion_validity(completions: DataFrame, claims: DataFrame) -> DataFrame:
    """JN-05: ``validity`` = ok / wrong_job / ignored. A wrong-job report leaves the
    claim in place; of several right ones only the first takes it."""
    owner = claims.select("claim_id", F.col("job_id").alias("__job"), "drv_hash", "attempt", "worker_id")
    seen = completions.join(owner, "claim_id", "left")
    right = F.coalesce(F.col("__job") == F.col("job_id"), F.lit(False))
    stamp = F.struct("completed_at", "completion_id")
    taker = F.min(F.when(right, stamp)).over(Window.partitionBy("claim_id"))
    return (
        seen.withColumn(
            "validity",
            F.when(F.col("__job").isNull(), "ignored")
            .when(~right, "wrong_job")
            .when(stamp == taker, "ok")
            .otherwise("ignored"),
        )
        .drop("__job")
    )


def stale_completions(valid: DataFrame, steps: DataFrame, ends_step: Column) -> DataFrame:
    """JN-06: ``accepted`` for valid completions. Once a step is finished (by the first
    completion where ``ends_step`` holds) later ones are stale; so are those of unknown steps.
    """
    order = [F.col("completed_at"), F.col("completion_id")]
    # read twice, so written once: what is valid is costly to find
    known = cut(valid.join(steps.select("drv_hash", F.lit(True).alias("__known")), "drv_hash", "left"))
    ends = (
        known.where(ends_step & F.col("__known"))
        .groupBy("drv_hash")
        .agg(F.min(F.struct("completed_at", "completion_id")).alias("__end"))
    )
    stamp = F.struct(*order)
    return (
        known.join(ends, "drv_hash", "left")
        .withColumn(
            "accepted",
            F.coalesce("__known", F.lit(False)) & (F.col("__end").isNull() | (stamp <= F.col("__end"))),
        )
        .drop("__known", "__end")
    )


def claims_of_terminal_jobs(claims: DataFrame, jobs: DataFrame) -> DataFrame:
    """JN-07: claims to evict."""
    gone = jobs.where(is_terminal(F.col("status"))).select("job_id")
    return claims.join(gone, "job_id", "left_semi")


def in_flight(claims: DataFrame, steps: DataFrame, as_of: Column) -> DataFrame:
    """JN-08: what is being built, with names; the hash stands in for an unknown name."""
    names = steps.select("drv_hash", "drv_name")
    return claims.join(names, "drv_hash", "left").select(
        "job_id",
        "claim_id",
        F.coalesce("drv_name", F.col("drv_hash").cast("string")).alias("drv_name"),
        F.col("started_at"),
        F.greatest(F.lit(0), F.unix_millis(as_of) - F.unix_millis("started_at")).alias("elapsed_ms"),
    )


def attempt_numbers(claims: DataFrame) -> DataFrame:
    """WN-10: 1, 2, … per step in the order of issue."""
    order = [F.col("issued_at"), F.col("claim_id")]
    return numbered(claims, order, keys=["drv_hash"], out="attempt_no")


def claim_listing(leases: DataFrame, as_of: Column) -> DataFrame:
    """WN-12: elapsed and remaining (not below 0) of open claims."""
    now = F.unix_millis(as_of)
    return leases.where(F.col("issued_at") <= as_of).select(
        "claim_id",
        "job_id",
        "drv_hash",
        "worker_id",
        (now - F.unix_millis("issued_at")).alias("elapsed_ms"),
        F.greatest(F.lit(0), F.unix_millis("deadline") - now).alias("remaining_ms"),
    )


def lease_timeline(
    claims: DataFrame,
    extends: DataFrame,
    jobs: DataFrame,
    as_of: Column,
    *,
    window_secs: int = P.CLAIM_DEADLINE_SECS,
    lifetime_secs: int | None = None,
) -> DataFrame:
    """WN-15: the deadline of each claim at ``as_of``.

    The window is the job's own if set. Each extension moves the deadline to its time
    plus the window, at most to the hard deadline. One that arrives at or after the
    deadline finds nothing to extend, and neither does any later one. So a lease is the
    session that the issue opens and extensions keep open.

    A claim's issue and extensions meet in one shuffle and are folded as one short array;
    joins and a session window moved every claim five times.
    """
    base = claims.join(jobs.select("job_id", "claim_deadline_secs"), "job_id", "left").withColumn(
        "window_secs", F.coalesce("claim_deadline_secs", F.lit(window_secs).cast("bigint"))
    )
    hard = (
        F.lit(None).cast("timestamp")
        if lifetime_secs is None
        else plus_seconds(F.col("issued_at"), F.lit(lifetime_secs))
    )
    base = base.withColumn("hard_deadline", hard).drop("claim_deadline_secs").where(F.col("claim_id").isNotNull())
    rest = [c for c in base.columns if c != "claim_id"]
    issues = base.select("claim_id", F.struct(*rest).alias("claim"))
    later = extends.where(F.col("ts") <= as_of).select("claim_id", "ts")
    held = (
        issues.unionByName(later, allowMissingColumns=True)
        .repartition("claim_id")
        .groupBy("claim_id")
        .agg(F.collect_list("claim").alias("claims"), F.collect_list(F.unix_micros("ts")).alias("times"))
        .select("claim_id", "claims", F.explode(_sessions(F.col("claims"), F.col("times"))).alias("s"))
        .where("s.own")
        .select("claim_id", F.timestamp_micros("s.due").alias("due"), F.col("s.touches").alias("touches"), F.inline("claims"))
    )
    # only an extension is held to the hard deadline
    deadline = F.when(F.col("touches") > 1, F.least("due", "hard_deadline")).otherwise(F.col("due"))
    return held.select("claim_id", *rest, deadline.alias("deadline"))


def _sessions(claims: Column, times: Column) -> Column:
    """Sessions (due, touches, own) of a claim's issues and of the times that come after them;
    a touch holds for its issue's window, and one at the session's very end opens another."""

    def touch(us: Column, claim: Column, own: bool) -> Column:
        return F.struct(us.alias("us"), (us + claim["window_secs"] * 1_000_000).alias("due"), F.lit(own).alias("own"))

    def touches(claim: Column) -> Column:
        start = F.unix_micros(claim["issued_at"])
        after = F.filter(times, lambda us: us > start)
        return F.concat(F.array(touch(start, claim, True)), F.transform(after, lambda us: touch(us, claim, False)))

    in_order = F.array_sort(F.filter(F.flatten(F.transform(claims, touches)), lambda t: t["due"] > t["us"]))
    session = lambda due, n, own: F.struct(due.alias("due"), n.alias("touches"), own.alias("own"))

    def step(acc: Column, t: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = session(F.greatest(last["due"], t["due"]), last["touches"] + 1, last["own"] | t["own"])
        opened = session(t["due"], F.lit(1), t["own"])
        return F.when(last["due"] > t["us"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(
            F.concat(acc, F.array(opened))
        )

    return F.aggregate(in_order, F.array().cast("array<struct<due:bigint,touches:int,own:boolean>>"), step)


def expired_claims(leases: DataFrame, finished: DataFrame, as_of: Column) -> DataFrame:
    """RT-07 and RT-08: claims due at ``as_of`` with the cause; ``rearm`` says whether
    their step goes back to the queue."""
    done = finished.select("drv_hash").distinct().withColumn("__done", F.lit(True))
    return (
        leases.where(F.col("deadline") <= as_of)
        .join(done, "drv_hash", "left")
        .withColumn("rearm", F.col("__done").isNull())
        .withColumn("cause", reap_cause(F.col("hard_deadline"), as_of))
        .drop("__done")
    )


def reap_cause(hard_deadline: Column, as_of: Column) -> Column:
    return F.when(F.coalesce(as_of >= hard_deadline, F.lit(False)), "hard_ceiling").otherwise("lease_lapsed")


def claim_ages(ends: DataFrame) -> DataFrame:
    """WN-16: seconds from issue to completion or expiry (issued_at, ended_at)."""
    return ends.withColumn("age_secs", seconds_between(F.col("ended_at"), F.col("issued_at")))


def dispatch_waits(claims: DataFrame) -> DataFrame:
    """WN-17: both readings: since the worker began to poll, and since the step was ready."""
    return claims.withColumn(
        "poll_wait", seconds_between(F.col("issued_at"), F.col("poll_started_at"))
    ).withColumn("ready_wait", seconds_between(F.col("issued_at"), F.col("ready_at")))
