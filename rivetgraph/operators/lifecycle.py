"""Job records: heartbeats, seal / fail / cancel requests, write-once results, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rivetgraph import params as P
from rivetgraph.functions.times import plus_seconds
from rivetgraph.operators.blocks import first_per_key


def write_terminal_once(jobs: DataFrame, writes: DataFrame) -> DataFrame:
    """SNK-01: the jobs table after terminal writes (job_id, status, done_at, result).

    The first write of a job wins, and only if the job has no ``done_at`` yet.
    """
    first = first_per_key(writes, ["job_id"], [F.col("done_at"), F.col("status")]).select(
        "job_id",
        F.col("status").alias("__status"),
        F.col("done_at").alias("__done_at"),
        F.col("result").alias("__result"),
    )
    open_ = F.col("done_at").isNull() & F.col("__done_at").isNotNull()
    joined = jobs.join(first, "job_id", "left").withColumn("__take", open_)
    for c in ("status", "result", "done_at"):
        joined = joined.withColumn(c, F.when(F.col("__take"), F.col(f"__{c}")).otherwise(F.col(c)))
    return joined.select(*jobs.columns)


def fold_heartbeats(jobs: DataFrame, heartbeats: DataFrame) -> DataFrame:
    """SNK-09: newest heartbeat, applied to pending jobs only."""
    newest = heartbeats.groupBy("job_id").agg(F.max("ts").alias("__hb"))
    pending = F.col("status") == "pending"
    return (
        jobs.join(newest, "job_id", "left")
        .withColumn(
            "last_heartbeat",
            F.when(pending, F.greatest("last_heartbeat", "__hb")).otherwise(F.col("last_heartbeat")),
        )
        .select(*jobs.columns)
    )


def fold_lifecycle(requests: DataFrame) -> DataFrame:
    """SNK-10: job state from requests (job_id, request_id, ts, kind, message).

    kinds: create, seal, fail, cancel, done. The first of fail / cancel / done decides
    and keeps its message; sealing twice is fine; a seal after the end changes nothing.
    """
    ends = F.col("kind").isin("fail", "cancel", "done")
    first_end = F.min(F.when(ends, F.struct("ts", "request_id", "kind", "message")))
    folded = requests.groupBy("job_id").agg(
        F.min(F.when(F.col("kind") == "create", F.col("ts"))).alias("created_at"),
        F.min(F.when(F.col("kind") == "seal", F.col("ts"))).alias("first_seal"),
        first_end.alias("e"),
    )
    status = (
        F.when(F.col("e.kind") == "fail", "failed")
        .when(F.col("e.kind") == "cancel", "cancelled")
        .when(F.col("e.kind") == "done", "done")
        .otherwise("pending")
    )
    sealed_in_time = F.col("first_seal").isNotNull() & (
        F.col("e.ts").isNull() | (F.col("first_seal") <= F.col("e.ts"))
    )
    return folded.select(
        "job_id",
        "created_at",
        status.alias("status"),
        sealed_in_time.alias("sealed"),
        F.col("e.ts").alias("done_at"),
        F.col("e.message").alias("eval_error"),
    )


def sentinel_result(job_id: Column, sealed: Column, message: str) -> Column:
    """The JSON stored for a job that was cancelled without a result."""
    zeros = F.struct(*[F.lit(0).alias(c) for c in ("total", "pending", "building", "done", "failed")])
    none = F.array().cast("array<string>")
    return F.to_json(
        F.struct(
            job_id.cast("string").alias("id"),
            F.lit("cancelled").alias("status"),
            sealed.alias("sealed"),
            zeros.alias("counts"),
            none.alias("failures"),
            F.lit(message).alias("eval_error"),
            none.alias("eval_errors"),
        )
    )


def _cancel(jobs: DataFrame, hit: Column, as_of: Column, sealed: Column, message: str) -> DataFrame:
    result = sentinel_result(F.col("job_id"), sealed, message)
    return (
        jobs.withColumn("__hit", hit)
        .withColumn("result", F.when(F.col("__hit"), result).otherwise(F.col("result")))
        .withColumn("status", F.when(F.col("__hit"), "cancelled").otherwise(F.col("status")))
        .withColumn("done_at", F.when(F.col("__hit"), as_of).otherwise(F.col("done_at")))
        .drop("__hit")
    )


def reap_stale_jobs(jobs: DataFrame, as_of: Column, *, timeout_secs: int = P.HEARTBEAT_TIMEOUT_SECS) -> DataFrame:
    """RT-05: open jobs without a recent heartbeat become cancelled."""
    cutoff = plus_seconds(as_of, -timeout_secs)
    stale = (F.col("status") == "pending") & F.col("done_at").isNull() & (F.col("last_heartbeat") < cutoff)
    return _cancel(jobs, stale, as_of, F.lit(False), "heartbeat timeout; job reaped")


def repair_after_restart(jobs: DataFrame, as_of: Column) -> DataFrame:
    """RT-06: every open job becomes cancelled and keeps its ``sealed``."""
    stuck = (F.col("status") == "pending") & F.col("done_at").isNull()
    return _cancel(jobs, stuck, as_of, F.col("sealed"), "coordinator restarted; job aborted")


def unfinished_terminal_writes(jobs: DataFrame, counts: DataFrame) -> DataFrame:
    """RT-09: sealed jobs whose members are all finished but which have no end yet."""
    full = counts.where(F.col("done") + F.col("failed") >= F.col("total")).select("job_id")
    return jobs.where(F.col("sealed") & F.col("done_at").isNull()).join(full, "job_id", "left_semi")
