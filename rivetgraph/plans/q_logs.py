"""WN-03, WN-11, AG-14, AG-25 on documents as archived logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivetgraph.operators import logs
from rivetgraph.plans.registry import query
from rivetgraph.plans.views import MEASURED_LOGS


@query(
    "wn_03_byte_ceiling_prune",
    """SELECT claim_id, stored_at, original_size AS bytes, running <= 1000000 AS keep
       FROM (SELECT *, sum(original_size) OVER (ORDER BY stored_at DESC, claim_id DESC) AS running FROM build_logs)""",
    build_logs=MEASURED_LOGS,
)
def _(t):
    return logs.prune_to_ceiling(t.measured_logs, max_bytes=1_000_000)


@query("wn_03_byte_ceiling_fits", "SELECT claim_id, original_size AS bytes, true AS keep FROM build_logs", build_logs=MEASURED_LOGS)
def _(t):
    return logs.prune_to_ceiling(t.measured_logs).select("claim_id", "bytes", "keep")


@query(
    "wn_11_attempt_history",
    "SELECT job_id, drv_hash, attempt, claim_id, original_size, original_size AS stored_size, truncated FROM build_logs ORDER BY job_id, drv_hash, attempt DESC",
    build_logs=MEASURED_LOGS,
)
def _(t):
    return logs.attempt_history(t.measured_logs).orderBy("job_id", "drv_hash", F.col("attempt").desc())


@query(
    "ag_14_log_bytes_per_job",
    """SELECT job_id, claim_id, CAST(running AS BIGINT) AS job_bytes, running >= 10000 AND running - original_size < 10000 AS crossed
       FROM (SELECT *, sum(original_size) OVER (PARTITION BY job_id ORDER BY stored_at, claim_id ROWS UNBOUNDED PRECEDING) AS running FROM build_logs)""",
    build_logs=MEASURED_LOGS,
)
def _(t):
    return logs.log_bytes_per_job(t.measured_logs, warn_at=10_000).select("job_id", "claim_id", "job_bytes", "crossed")


@query("ag_25_archive_capacity", "SELECT CAST(sum(original_size) AS BIGINT) AS total_bytes, count(*) AS row_count FROM build_logs", build_logs=MEASURED_LOGS)
def _(t):
    return logs.archive_capacity(t.measured_logs)
