"""DQ-01 … DQ-11: the violations found in the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivetgraph.operators import metrics, quality
from rivetgraph.plans.q_failures import PLACED, stored_jobs
from rivetgraph.plans.q_ingest import ACCOUNTS, VIEWS as INGEST, batch_accounts
from rivetgraph.plans.q_state import STATES, counts
from rivetgraph.plans.registry import query
from rivetgraph.sources.documents import snapshots

TERMINAL = "status IN ('done', 'failed', 'cancelled')"


@query(
    "dq_01_terminal_counts",
    f"SELECT job_id, total, done, failed FROM counts JOIN jobs USING (job_id) WHERE {TERMINAL} AND total <> done + failed",
    **STATES,
)
def _(t):
    return quality.terminal_counts_add_up(t.jobs, counts(t)).select("job_id", "total", "done", "failed")


@query("dq_02_duplicate_steps", "SELECT drv_hash, count(*) AS n FROM retried GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return quality.duplicate_steps(t.retried)


RUNNABLE = """
SELECT drv_hash FROM latches l WHERE runnable AND (NOT created OR EXISTS (SELECT 1 FROM edges e JOIN latches d ON d.drv_hash = e.dst WHERE e.src = l.drv_hash AND NOT d.finished))"""


def runnable_early(t):
    return quality.runnable_too_early(t.latches, t.edges).select("drv_hash")


@query("dq_03_runnable_too_early", RUNNABLE)
def _(t):
    return runnable_early(t)


TIMES = "SELECT drv_hash, min(started_at) AS started_at, max(ended_at) AS ended_at FROM attempts GROUP BY ALL"
EARLY = "SELECT e.src, e.dst FROM edges e JOIN times a ON a.drv_hash = e.src JOIN times b ON b.drv_hash = e.dst WHERE a.started_at < b.ended_at"


def started_early(t):
    times = t.attempts.groupBy("drv_hash").agg(F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"))
    return quality.started_before_input(t.edges, times).select("src", "dst")


@query("dq_04_started_before_input", EARLY, times=TIMES)
def _(t):
    return started_early(t)


OVERLAP = """
SELECT claim_id, busy AS busy_until FROM (SELECT *, max(ended_at) OVER (PARTITION BY drv_hash ORDER BY started_at, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM retried) WHERE busy > started_at"""


@query("dq_05_overlapping_claims", OVERLAP)
def _(t):
    rows = t.retried.select("drv_hash", "claim_id", "started_at", "ended_at")
    return quality.overlapping_claims(rows).select("claim_id", "busy_until")


ODD_JOBS = """
SELECT job_id, CASE WHEN job_id % 10 = 3 THEN 'lost' ELSE status END AS status, CASE WHEN job_id % 10 <> 4 THEN done_at END AS done_at,
       CASE WHEN job_id % 10 <> 5 THEN 'x' END AS result FROM jobs"""
BAD_JOBS = f"""
SELECT job_id, 'unknown_status' AS rule FROM odd_jobs WHERE status NOT IN ('pending', 'building', 'done', 'failed', 'cancelled')
UNION ALL SELECT job_id, 'terminal_without_done_at' FROM odd_jobs WHERE {TERMINAL} AND done_at IS NULL
UNION ALL SELECT job_id, 'done_at_without_terminal' FROM odd_jobs WHERE NOT {TERMINAL} AND done_at IS NOT NULL
UNION ALL SELECT job_id, 'done_at_without_result' FROM odd_jobs WHERE done_at IS NOT NULL AND result IS NULL"""


def bad_jobs(t):
    k = F.col("job_id") % 10
    odd = t.jobs.select(
        "job_id",
        F.when(k == 3, "lost").otherwise(F.col("status")).alias("status"),
        F.when(k != 4, F.col("done_at")).alias("done_at"),
        F.when(k != 5, "x").alias("result"),
    )
    return quality.bad_job_rows(odd).select("job_id", "rule")


@query("dq_06_job_row_rules", "SELECT * FROM bad_jobs", odd_jobs=ODD_JOBS, bad_jobs=BAD_JOBS)
def _(t):
    return bad_jobs(t)


@query(
    "dq_07_batch_accounting",
    """SELECT batch_id FROM (SELECT * REPLACE (CASE WHEN batch_id % 11 = 0 THEN new_drvs + 1 ELSE new_drvs END AS new_drvs) FROM accounts)
       WHERE edge_errors = 0 AND new_drvs + dedup_skipped + errored <> sent""",
    accounts=ACCOUNTS,
    **INGEST,
)
def _(t):
    # every eleventh batch claims one new step too many
    counted = F.when(F.col("batch_id") % 11 == 0, F.col("new_drvs") + 1).otherwise(F.col("new_drvs"))
    return quality.unbalanced_batches(batch_accounts(t).withColumn("new_drvs", counted)).select("batch_id")


@query(
    "dq_08_terminal_counter",
    f"""SELECT j.status, j.n AS in_table, c.n AS counted FROM (SELECT status, count(*) AS n FROM jobs WHERE {TERMINAL} GROUP BY ALL) j
        FULL JOIN (SELECT status, count(*) AS n FROM jobs WHERE {TERMINAL} AND priority > 0 GROUP BY ALL) c USING (status) WHERE j.n IS DISTINCT FROM c.n""",
)
def _(t):
    counted = metrics.counter(t.jobs.where((F.col("status") != "pending") & (F.col("priority") > 0)), "status")
    return quality.terminal_counter_gap(t.jobs, counted)


@query("dq_09_leftover_claims", "SELECT claim_id FROM attempts WHERE NOT success AND open")
def _(t):
    done = t.attempts.where(F.col("success") | ~F.col("open"))
    return quality.leftover_claims(t.attempts, done).select("claim_id")


@query(
    "dq_10_oversized_results",
    "SELECT job_id, CAST(4 AS INTEGER) AS n_failures FROM placed JOIN jobs USING (job_id) WHERE done_at IS NOT NULL AND n > 3 GROUP BY job_id",
    placed=PLACED,
)
def _(t):
    return quality.oversized_results(snapshots(stored_jobs(t)), F.col("snapshot"), cap=2).where(
        F.col("n_failures") > 3
    ).select("job_id", "n_failures")


@query(
    "dq_11_assertions",
    """SELECT name, n = 0 AS passed, n || ' violations' AS detail FROM (
         SELECT 'one_step_per_hash' AS name, count(*) AS n FROM (SELECT drv_hash FROM steps GROUP BY ALL HAVING count(*) > 1)
         UNION ALL SELECT 'runnable_has_no_open_input', count(*) FROM runnable_early
         UNION ALL SELECT 'input_ends_before_start', count(*) FROM early
         UNION ALL SELECT 'job_rows_are_sound', count(*) FROM bad_jobs)""",
    times=TIMES,
    early=EARLY,
    runnable_early=RUNNABLE,
    odd_jobs=ODD_JOBS,
    bad_jobs=BAD_JOBS,
)
def _(t):
    return quality.assertions(
        {
            "one_step_per_hash": quality.duplicate_steps(t.steps),
            "runnable_has_no_open_input": runnable_early(t),
            "input_ends_before_start": started_early(t),
            "job_rows_are_sound": bad_jobs(t),
        }
    )
