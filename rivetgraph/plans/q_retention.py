"""RT-01 … RT-04, JN-14, JN-15."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivetgraph.functions.paths import output_path
from rivetgraph.operators import retention
from rivetgraph.plans.registry import query
from rivetgraph.plans.views import MEASURED_LOGS


def at(text: str):
    return F.lit(text).cast("timestamp")


@query("rt_01_expire_cache", "SELECT output_path, expires_at FROM failed_outputs WHERE NOT expires_at < TIMESTAMP '1995-01-01'")
def _(t):
    return retention.expire_cache(t.failed_outputs, at("1995-01-01")).select("output_path", "expires_at")


@query(
    "rt_02_job_retention",
    "SELECT job_id FROM jobs WHERE NOT coalesce(status IN ('done', 'failed', 'cancelled') AND done_at < TIMESTAMP '1998-01-01' - INTERVAL 14 DAYS, false)",
)
def _(t):
    return retention.retain_jobs(t.jobs, at("1998-01-01")).select("job_id")


@query("rt_03_log_retention", "SELECT claim_id FROM build_logs WHERE stored_at >= TIMESTAMP '2024-01-07 02:00:00' - INTERVAL 6 DAYS")
def _(t):
    return retention.retain_logs(t.build_logs, at("2024-01-07 02:00:00"), days=6).select("claim_id")


# Jobs and cache rows are some 26 to 29 years older than the logs; their times move up.
KEPT = {
    "late_jobs": "SELECT job_id FROM jobs WHERE NOT coalesce(done_at + INTERVAL 26 YEARS < TIMESTAMP '2024-01-08 01:00:00' - INTERVAL 730 DAYS, false)",
    "kept_logs": "SELECT * FROM build_logs WHERE job_id IN (SELECT job_id FROM late_jobs) AND stored_at >= TIMESTAMP '2024-01-01 01:00:00'",
    "fit_logs": "SELECT * FROM (SELECT *, sum(original_size) OVER (ORDER BY stored_at DESC, claim_id DESC) AS running FROM kept_logs) WHERE running <= 60000",
}


@query(
    "rt_04_maintenance",
    """SELECT (SELECT count(*) FROM failed_outputs WHERE expires_at + INTERVAL 26 YEARS >= TIMESTAMP '2024-01-08 01:00:00') AS cache_rows,
              (SELECT count(*) FROM late_jobs) AS job_rows, count(*) AS row_count, CAST(coalesce(sum(original_size), 0) AS BIGINT) AS total_bytes FROM fit_logs""",
    **KEPT,
    build_logs=MEASURED_LOGS,
)
def _(t):
    later = F.expr("INTERVAL 26 YEARS")
    jobs = t.jobs.withColumn("done_at", F.col("done_at") + later)
    cache = t.failed_outputs.withColumn("expires_at", F.col("expires_at") + later)
    out = retention.maintain(
        cache, jobs, t.measured_logs, at("2024-01-08 01:00:00"), job_days=730, log_days=7, max_log_bytes=60_000
    )
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).scalar().alias(name)
    return out["capacity"].select(
        one(out["failed_outputs"], "cache_rows"), one(out["jobs"], "job_rows"), "row_count", "total_bytes"
    )


@query("jn_14_cascade_delete", "SELECT claim_id FROM build_logs WHERE job_id IN (SELECT job_id FROM jobs WHERE status <> 'failed')")
def _(t):
    return retention.cascade_logs(t.build_logs, t.jobs.where(F.col("status") != "failed")).select("claim_id")


@query(
    "jn_15_refute",
    """SELECT output_path FROM failed_outputs WHERE NOT (output_path IN (SELECT regexp_replace(drv_path, '(\\.drv)+$', '') FROM steps WHERE system = 'aarch64-linux')
              OR drv_hash = 5 OR coalesce(nullif(worker_id, '') = 'w3', false))""",
)
def _(t):
    listed = t.steps.where(F.col("system") == "aarch64-linux").select(output_path(F.col("drv_path")).alias("output_path"))
    rows = t.failed_outputs.withColumn("worker_id", F.nullif("worker_id", F.lit("")))
    return retention.refute(rows, output_paths=listed, drv_hash=5, worker_id="w3").select("output_path")


@query("jn_15_refute_nothing", "SELECT output_path FROM failed_outputs")
def _(t):
    return retention.refute(t.failed_outputs).select("output_path")
