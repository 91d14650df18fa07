"""Expiry, cascade and refutation; the maintenance job that runs them in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rivetgraph import params as P
from rivetgraph.functions.outcomes import is_terminal
from rivetgraph.functions.times import plus_seconds
from rivetgraph.operators.logs import archive_capacity, prune_to_ceiling

DAY = 86_400


def expire_cache(failed_outputs: DataFrame, as_of: Column) -> DataFrame:
    """RT-01: rows that stay. One that expires exactly now is kept, though no longer a hit."""
    return failed_outputs.where(F.col("expires_at") >= as_of)


def retain_jobs(jobs: DataFrame, as_of: Column, *, days: int = P.JOB_RETENTION_DAYS) -> DataFrame:
    """RT-02: rows that stay."""
    old = is_terminal(F.col("status")) & (F.col("done_at") < plus_seconds(as_of, -days * DAY))
    return jobs.where(~F.coalesce(old, F.lit(False)))


def retain_logs(logs: DataFrame, as_of: Column, *, days: int = P.LOG_RETENTION_DAYS) -> DataFrame:
    """RT-03: rows that stay."""
    return logs.where(F.col("stored_at") >= plus_seconds(as_of, -days * DAY))


def check_retention(job_days: int, log_days: int) -> None:
    if log_days > job_days:
        raise ValueError("logs go with their job: log_days must not exceed job_days")


def cascade_logs(logs: DataFrame, jobs: DataFrame) -> DataFrame:
    """JN-14: logs whose job is still there."""
    return logs.join(jobs.select("job_id"), "job_id", "left_semi")


def refute(
    failed_outputs: DataFrame,
    *,
    output_paths: DataFrame | None = None,
    drv_hash=None,
    worker_id: str | None = None,
) -> DataFrame:
    """JN-15: rows that stay after removing those named by path list, hash or worker.

    Nothing given removes nothing; rows without a worker are not touched by a worker.
    """
    rules = []
    if drv_hash is not None:
        rules.append(F.coalesce(F.col("drv_hash") == drv_hash, F.lit(False)))
    if worker_id is not None:
        rules.append(F.coalesce(F.col("worker_id") == worker_id, F.lit(False)))
    out = failed_outputs.where(~reduce(Column.__or__, rules)) if rules else failed_outputs
    if output_paths is not None:
        out = out.join(output_paths.select("output_path").distinct(), "output_path", "left_anti")
    return out


def maintain(
    failed_outputs: DataFrame,
    jobs: DataFrame,
    logs: DataFrame,
    as_of: Column,
    *,
    job_days: int = P.JOB_RETENTION_DAYS,
    log_days: int = P.LOG_RETENTION_DAYS,
    max_log_bytes: int = P.LOG_STORE_CEILING_BYTES,
) -> dict[str, DataFrame]:
    """RT-04: the tables after one maintenance run, and the capacity left."""
    check_retention(job_days, log_days)
    cache = expire_cache(failed_outputs, as_of)
    kept_jobs = retain_jobs(jobs, as_of, days=job_days)
    kept_logs = retain_logs(cascade_logs(logs, kept_jobs), as_of, days=log_days)
    within = prune_to_ceiling(kept_logs, max_bytes=max_log_bytes).where("keep").select("claim_id")
    kept_logs = kept_logs.join(within, "claim_id", "left_semi")
    return {
        "failed_outputs": cache,
        "jobs": kept_jobs,
        "build_logs": kept_logs,
        "capacity": archive_capacity(kept_logs),
    }
