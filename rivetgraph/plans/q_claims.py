"""JN-05 … JN-07, WN-10, WN-12, WN-15 … WN-17, RT-05 … RT-08."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivetgraph.functions.outcomes import will_retry
from rivetgraph.functions.times import plus_seconds
from rivetgraph.operators import claims as cl, lifecycle
from rivetgraph.plans.registry import query

AS_OF = "1998-01-01 00:00:00"

VIEWS = {
    "claims": "SELECT claim_id, job_id, drv_hash, worker_id, started_at AS issued_at, 1 + duration_ms % 3 AS attempt FROM retried WHERE duration_ms % 11000 <> 0",
    "completions": """
SELECT claim_id AS completion_id, claim_id, CASE WHEN duration_ms % 9000 = 0 THEN job_id + 1 ELSE job_id END AS job_id, ended_at AS completed_at, success, error_category FROM retried
UNION ALL SELECT claim_id || 'b', claim_id, job_id, ended_at + to_seconds(60), success, error_category FROM retried WHERE open""",
    "judged": """
SELECT p.*, c.drv_hash, c.attempt, CASE WHEN c.claim_id IS NULL THEN 'ignored' WHEN c.job_id <> p.job_id THEN 'wrong_job'
       WHEN row_number() OVER (PARTITION BY p.claim_id, c.job_id = p.job_id ORDER BY completed_at, completion_id) = 1 THEN 'ok' ELSE 'ignored' END AS validity
FROM completions p LEFT JOIN claims c USING (claim_id)""",
}


def claims(t):
    return t.retried_once.where(F.col("duration_ms") % 11000 != 0).select(
        "claim_id",
        "job_id",
        "drv_hash",
        "worker_id",
        F.col("started_at").alias("issued_at"),
        (1 + F.col("duration_ms") % 3).alias("attempt"),
    )


def completions(t):
    first = t.retried_once.select(
        F.col("claim_id").alias("completion_id"),
        "claim_id",
        F.when(F.col("duration_ms") % 9000 == 0, F.col("job_id") + 1).otherwise(F.col("job_id")).alias("job_id"),
        F.col("ended_at").alias("completed_at"),
        "success",
        "error_category",
    )
    again = t.retried_once.where("open").select(
        F.concat("claim_id", F.lit("b")).alias("completion_id"),
        "claim_id",
        "job_id",
        plus_seconds(F.col("ended_at"), 60).alias("completed_at"),
        "success",
        "error_category",
    )
    return first.unionByName(again)


@query("jn_05_completion_validity", "SELECT completion_id, validity FROM judged", **VIEWS)
def _(t):
    return cl.completion_validity(completions(t), claims(t)).select("completion_id", "validity")


@query(
    "jn_06_stale_completions",
    """WITH valid AS (SELECT *, success OR NOT (coalesce(error_category, 'build_failure') IN ('transient', 'disk_full') AND attempt < 2) AS ends FROM judged WHERE validity = 'ok'),
            known AS (SELECT v.*, s.drv_hash IS NOT NULL AS known FROM valid v LEFT JOIN (SELECT drv_hash FROM latches WHERE created) s USING (drv_hash))
       SELECT completion_id, known AND coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY drv_hash ORDER BY completed_at, completion_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS accepted FROM known""",
    **VIEWS,
)
def _(t):
    valid = cl.completion_validity(completions(t), claims(t)).where(F.col("validity") == "ok")
    ends = F.col("success") | ~will_retry(F.col("error_category"), F.col("attempt"))
    valid = valid.select("completion_id", "drv_hash", "completed_at", "success", "error_category", "attempt")
    out = cl.stale_completions(valid, t.latches.where("created"), ends)
    return out.select("completion_id", "accepted")


@query(
    "jn_07_claims_of_terminal_jobs",
    "SELECT job_id, count(*) AS evicted FROM attempts JOIN jobs USING (job_id) WHERE open AND status IN ('done', 'failed', 'cancelled') GROUP BY ALL",
)
def _(t):
    gone = cl.claims_of_terminal_jobs(t.attempts.where("open"), t.jobs)
    return gone.groupBy("job_id").agg(F.count(F.lit(1)).alias("evicted"))


@query(
    "wn_10_attempt_numbers",
    "SELECT claim_id, row_number() OVER (PARTITION BY drv_hash ORDER BY issued_at, claim_id) AS attempt_no FROM claims",
    **VIEWS,
)
def _(t):
    return cl.attempt_numbers(claims(t)).select("claim_id", "attempt_no")


LEASES = VIEWS | {
    "win": """
SELECT c.*, coalesce(j.claim_deadline_secs, 3600) AS w, epoch_us(issued_at) AS t0, epoch_us(issued_at) + 3000000000 AS hard
FROM claims c LEFT JOIN jobs j USING (job_id)""",
    "d0": "SELECT *, t0 + w * 1000000 AS due0, t0 + 500000000 AS e1, t0 + 1100000000 AS e2, t0 + 2500000000 AS e3 FROM win",
    "d1": "SELECT *, CASE WHEN e1 < due0 THEN least(e1 + w * 1000000, hard) ELSE due0 END AS due1 FROM d0",
    "d2": "SELECT *, CASE WHEN attempt > 1 AND e2 < due1 THEN least(e2 + w * 1000000, hard) ELSE due1 END AS due2 FROM d1",
    "leases": "SELECT *, make_timestamp(CASE WHEN attempt > 2 AND e3 < due2 THEN least(e3 + w * 1000000, hard) ELSE due2 END) AS deadline, make_timestamp(hard) AS hard_deadline FROM d2",
}


def leases(t):
    c = claims(t)
    extends = c.select(
        "claim_id", F.explode(F.slice(F.array(F.lit(500), F.lit(1100), F.lit(2500)), 1, F.col("attempt").cast("int"))).alias("s"), "issued_at"
    ).select("claim_id", plus_seconds(F.col("issued_at"), F.col("s")).alias("ts"))
    far = F.lit("2100-01-01").cast("timestamp")
    return cl.lease_timeline(c, extends, t.jobs, far, lifetime_secs=3000)


@query("wn_15_lease_timeline", "SELECT claim_id, deadline, hard_deadline FROM leases", **LEASES)
def _(t):
    return leases(t).select("claim_id", "deadline", "hard_deadline")


@query(
    "wn_12_claim_listing",
    f"""SELECT claim_id, job_id, drv_hash, worker_id, epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(issued_at) AS elapsed_ms,
               greatest(0, epoch_ms(deadline) - epoch_ms(TIMESTAMP '{AS_OF}')) AS remaining_ms FROM leases WHERE issued_at <= TIMESTAMP '{AS_OF}'""",
    **LEASES,
)
def _(t):
    return cl.claim_listing(leases(t), F.lit(AS_OF).cast("timestamp"))


@query(
    "rt_07_expired_claims",
    f"""SELECT claim_id, drv_hash NOT IN (SELECT drv_hash FROM latches WHERE finished) AS rearm,
               CASE WHEN TIMESTAMP '{AS_OF}' >= hard_deadline THEN 'hard_ceiling' ELSE 'lease_lapsed' END AS cause FROM leases WHERE deadline <= TIMESTAMP '{AS_OF}'""",
    **LEASES,
)
def _(t):
    out = cl.expired_claims(leases(t), t.latches.where("finished"), F.lit(AS_OF).cast("timestamp"))
    return out.select("claim_id", "rearm", "cause")


@query(
    "rt_08_reap_cause",
    """SELECT claim_id, CASE WHEN CASE WHEN attempt > 1 THEN deadline + to_seconds(attempt) ELSE deadline END >= hard_deadline THEN 'hard_ceiling' ELSE 'lease_lapsed' END AS cause FROM leases""",
    **LEASES,
)
def _(t):
    seen = F.when(F.col("attempt") > 1, plus_seconds(F.col("deadline"), F.col("attempt"))).otherwise(F.col("deadline"))
    return leases(t).select("claim_id", cl.reap_cause(F.col("hard_deadline"), seen).alias("cause"))


@query("wn_16_claim_age", "SELECT claim_id, duration_ms / 1000.0 AS age_secs FROM attempts")
def _(t):
    ends = t.attempts.select("claim_id", F.col("started_at").alias("issued_at"), "ended_at")
    return cl.claim_ages(ends).select("claim_id", "age_secs")


@query(
    "wn_17_dispatch_wait",
    "SELECT claim_id, CAST(duration_ms % 60 AS DOUBLE) AS poll_wait, epoch_ms(started_at - created_at) / 1000.0 AS ready_wait FROM attempts JOIN jobs USING (job_id)",
)
def _(t):
    rows = t.attempts.join(t.jobs.select("job_id", F.col("created_at").alias("ready_at")), "job_id").select(
        "claim_id",
        F.col("started_at").alias("issued_at"),
        "ready_at",
        plus_seconds(F.col("started_at"), -(F.col("duration_ms") % 60)).alias("poll_started_at"),
    )
    return cl.dispatch_waits(rows).select("claim_id", "poll_wait", "ready_wait")


SENTINEL = """'{{"id":"' || job_id || '","status":"cancelled","sealed":{sealed},"counts":{{"total":0,"pending":0,"building":0,"done":0,"failed":0}},"failures":[],"eval_error":"{why}","eval_errors":[]}}'"""


def _repaired(hit: str, sealed: str, why: str) -> str:
    doc = SENTINEL.format(sealed=sealed, why=why)
    return f"""SELECT job_id, CASE WHEN hit THEN 'cancelled' ELSE status END AS status, CASE WHEN hit THEN TIMESTAMP '{AS_OF}' ELSE done_at END AS done_at,
       CASE WHEN hit THEN {doc} END AS result FROM (SELECT *, {hit} AS hit FROM jobs)"""


@query(
    "rt_05_stale_job_reap",
    _repaired(f"status = 'pending' AND done_at IS NULL AND last_heartbeat < TIMESTAMP '{AS_OF}' - INTERVAL 30 SECONDS", "false", "heartbeat timeout; job reaped"),
)
def _(t):
    jobs = t.jobs.withColumn("result", F.lit(None).cast("string"))
    return lifecycle.reap_stale_jobs(jobs, F.lit(AS_OF).cast("timestamp")).select("job_id", "status", "done_at", "result")


@query(
    "rt_06_restart_repair",
    _repaired("status = 'pending' AND done_at IS NULL", "' || CASE WHEN sealed THEN 'true' ELSE 'false' END || '", "coordinator restarted; job aborted"),
)
def _(t):
    jobs = t.jobs.withColumn("result", F.lit(None).cast("string"))
    return lifecycle.repair_after_restart(jobs, F.lit(AS_OF).cast("timestamp")).select("job_id", "status", "done_at", "result")
