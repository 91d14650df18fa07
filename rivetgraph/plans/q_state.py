"""AG-01 … AG-07, WN-06 … WN-09, WN-14, ST-12, RT-09."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivetgraph.operators import claims as cl, failures as fail, graph, lifecycle, state
from rivetgraph.plans.registry import query

STATES = {
    "member_states": """
SELECT m.job_id, m.drv_hash, l.finished, l.previous_failure AS failed,
       CASE WHEN finished AND previous_failure THEN 'failed' WHEN finished THEN 'done' WHEN runnable THEN 'pending' WHEN tries > 0 THEN 'building' ELSE 'pending' END AS state
FROM members m JOIN latches l USING (drv_hash)""",
    "counts": """
SELECT job_id, total, greatest(0, total - building - done - failed) AS pending, building, done, failed FROM (
  SELECT s.job_id, count(*) AS total, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, coalesce(any_value(c.n), 0) AS building
  FROM member_states s LEFT JOIN (SELECT job_id, count(*) AS n FROM active_claims GROUP BY ALL) c USING (job_id) GROUP BY s.job_id)""",
}


def member_states(t):
    latches = state.step_states(t.latches).select("drv_hash", "state", "finished", F.col("previous_failure").alias("failed"))
    return t.members.join(latches, "drv_hash")


def counts(t):
    return state.job_counts(member_states(t), t.active_claims)


@query("ag_01_job_counts", "SELECT * FROM counts", **STATES)
def _(t):
    return counts(t)


@query(
    "ag_02_live_status",
    """SELECT j.job_id, CASE WHEN j.sealed AND done + failed >= total AND failed > 0 THEN 'failed' WHEN j.sealed AND done + failed >= total THEN 'done'
              WHEN j.sealed THEN 'building' ELSE 'pending' END AS live_status FROM jobs j JOIN counts USING (job_id)""",
    **STATES,
)
def _(t):
    c = counts(t).join(t.jobs.select("job_id", "sealed"), "job_id")
    status = state.live_status(F.col("sealed"), F.col("done"), F.col("failed"), F.col("total"))
    return c.select("job_id", status.alias("live_status"))


@query(
    "ag_03_terminal_status",
    """SELECT j.job_id, CASE WHEN sealed AND coalesce(fin, true) THEN CASE WHEN coalesce(bad, false) OR coalesce(n, 0) > 0 THEN 'failed' ELSE 'done' END END AS terminal_status
       FROM jobs j LEFT JOIN (SELECT job_id, bool_and(finished) AS fin, bool_or(failed) AS bad FROM member_states JOIN roots USING (drv_hash) GROUP BY ALL) r USING (job_id)
       LEFT JOIN (SELECT job_id, count(*) AS n FROM attempts WHERE error_category = 'disk_full' GROUP BY ALL) e USING (job_id)""",
    **STATES,
)
def _(t):
    roots = member_states(t).join(t.roots.select("drv_hash"), "drv_hash", "left_semi")
    errors = t.attempts.where(F.col("error_category") == "disk_full")
    return state.terminal_status(t.jobs, roots, errors).select("job_id", "terminal_status")


@query(
    "ag_04_registry_counts",
    """SELECT count(*) AS steps_total, count(*) FILTER (s = 'pending') AS steps_pending, count(*) FILTER (s = 'building') AS steps_building,
              count(*) FILTER (s = 'done') AS steps_done, count(*) FILTER (s = 'failed') AS steps_failed
       FROM (SELECT CASE WHEN finished AND previous_failure THEN 'failed' WHEN finished THEN 'done' WHEN runnable THEN 'pending' WHEN tries > 0 THEN 'building' ELSE 'pending' END AS s FROM latches)""",
)
def _(t):
    return state.registry_counts(t.latches)


@query(
    "ag_05_admin_snapshot",
    """SELECT (SELECT count(*) FROM jobs WHERE status = 'pending') AS submissions, count(*) AS steps_total, count(*) FILTER (NOT finished AND (runnable OR tries = 0)) AS steps_pending,
              count(*) FILTER (NOT finished AND NOT runnable AND tries > 0) AS steps_building, count(*) FILTER (finished AND NOT previous_failure) AS steps_done,
              count(*) FILTER (finished AND previous_failure) AS steps_failed, (SELECT count(*) FROM active_claims) AS active_claims,
              (SELECT array_to_string(list(job_id ORDER BY job_id), '|') FROM (SELECT job_id FROM jobs WHERE status = 'failed' ORDER BY done_at DESC, job_id LIMIT 5)) AS recent_failures
       FROM latches""",
)
def _(t):
    recent = state.newest(t.jobs.where(F.col("status") == "failed"), 5)
    return state.admin_snapshot(t.jobs, t.latches, t.active_claims, recent)


@query(
    "ag_06_job_dump",
    """SELECT job_id, priority, max_workers, sealed, (SELECT count(*) FROM members m WHERE m.job_id = j.job_id) AS member_count,
              (SELECT count(*) FROM members m JOIN roots r USING (drv_hash) WHERE m.job_id = j.job_id) AS toplevel_count,
              (SELECT count(*) FROM failures f WHERE f.job_id = j.job_id) AS failure_count,
              (SELECT count(*) FROM active_claims c WHERE c.job_id = j.job_id) AS active_claims
       FROM jobs j WHERE status = 'pending'""",
)
def _(t):
    roots = t.members.join(t.roots.select("drv_hash"), "drv_hash", "left_semi")
    return state.job_dump(t.jobs, t.members, roots, t.failures, t.active_claims)


@query(
    "ag_07_drain_view",
    """SELECT count(*) FILTER (status = 'pending') AS open_submissions, (SELECT count(*) FROM active_claims) AS in_flight_claims, false AS safe_to_stop FROM jobs""",
)
def _(t):
    return state.drain_view(t.jobs, t.active_claims)


@query(
    "wn_06_schedule_order",
    "SELECT job_id, row_number() OVER (ORDER BY priority DESC, created_at, job_id) AS place FROM jobs WHERE status = 'pending'",
)
def _(t):
    return state.scheduled_jobs(t.jobs).select("job_id", "place")


SLOTS = {
    "slots": """
SELECT j.job_id, j.status, j.priority, j.created_at, coalesce(n, 0) AS active, CASE WHEN max_workers IS NOT NULL THEN greatest(0, max_workers - coalesce(n, 0)) END AS free_slots,
       coalesce(coalesce(n, 0) >= max_workers, false) AS at_cap
FROM jobs j LEFT JOIN (SELECT job_id, count(*) AS n FROM active_claims GROUP BY ALL) USING (job_id)"""
}


@query("wn_07_free_slots", "SELECT job_id, active, free_slots, at_cap FROM slots", **SLOTS)
def _(t):
    return state.free_slots(t.jobs, t.active_claims).select("job_id", "active", "free_slots", "at_cap")


@query(
    "wn_08_claimable_steps",
    """WITH ready AS (SELECT l.drv_hash FROM latches l WHERE NOT finished AND created AND l.drv_hash NOT IN (SELECT e.src FROM edges e JOIN latches d ON d.drv_hash = e.dst WHERE NOT d.finished)),
            fit AS (SELECT s.job_id, m.drv_hash, st.system, s.priority, s.created_at, s.free_slots,
                           row_number() OVER (PARTITION BY s.job_id ORDER BY CASE st.system WHEN 'aarch64-linux' THEN 1 ELSE 2 END, m.drv_hash) AS job_rank
                    FROM slots s JOIN members m USING (job_id) JOIN ready r USING (drv_hash) JOIN steps st USING (drv_hash) JOIN latches l USING (drv_hash)
                    WHERE s.status = 'pending' AND NOT s.at_cap AND list_has_all(['kvm'], st.required_features) AND l.next_attempt_at <= 1000000),
            queue AS (SELECT job_id, row_number() OVER (ORDER BY priority DESC, created_at, job_id) AS job_place FROM slots WHERE status = 'pending')
       SELECT job_id, drv_hash, system, priority, created_at, job_place, job_rank, row_number() OVER (ORDER BY job_place, job_rank) AS place
       FROM fit JOIN queue USING (job_id) WHERE free_slots IS NULL OR job_rank <= free_slots""",
    **SLOTS,
)
def _(t):
    ready = graph.ready_frontier(t.latches, t.edges).select("drv_hash", "next_attempt_at")
    ready = ready.join(t.steps.select("drv_hash", "system", "required_features"), "drv_hash")
    slots = state.free_slots(t.jobs, t.active_claims).where(F.col("status") == "pending")
    return state.claimable(
        ready, t.members, slots, systems=["aarch64-linux", "x86_64-linux"], features=["kvm"], now_ms=F.lit(1_000_000)
    )


@query(
    "wn_09_exhausted_steps",
    """SELECT drv_hash, drv_name, 'transient' AS error_category,
              'max_retries_exceeded: ' || tries || ' attempts completed (cap ' || max_tries || '); last claim expired before reporting' AS error_message, CAST(NULL AS VARCHAR) AS worker_id
       FROM latches WHERE tries >= max_tries AND NOT finished""",
)
def _(t):
    return state.exhausted_steps(t.latches)


@query(
    "wn_09_exhausted_propagation",
    """SELECT node, origin FROM hit QUALIFY row_number() OVER (PARTITION BY node ORDER BY origin) = 1""",
    dead="SELECT drv_hash FROM latches WHERE tries >= max_tries AND NOT finished",
    hit="""
SELECT e.src AS node, e.dst AS origin FROM edges e JOIN dead d ON d.drv_hash = e.dst JOIN latches s ON s.drv_hash = e.src
WHERE NOT s.finished AND e.src NOT IN (SELECT drv_hash FROM dead)
UNION SELECT e.src, h.origin FROM hit h JOIN edges e ON e.dst = h.node JOIN latches s ON s.drv_hash = e.src
WHERE NOT s.finished AND e.src NOT IN (SELECT drv_hash FROM dead)""",
)
def _(t):
    at = F.lit("2024-01-02").cast("timestamp")
    dead = state.exhausted_steps(t.latches).select(F.col("drv_hash").alias("node"), at.alias("failed_at"))
    finished = t.latches.where("finished").select(F.col("drv_hash").alias("node"))
    return graph.propagate_failures(dead, t.edges, finished).select("node", "origin")


@query(
    "wn_14_in_flight_top",
    """SELECT l_job AS job_id, claim_id, CAST(row_number() OVER (PARTITION BY l_job ORDER BY started_at, claim_id) AS INTEGER) AS place,
              greatest(0, count(*) OVER (PARTITION BY l_job) - 4) AS more
       FROM (SELECT drv_hash AS l_job, * FROM active_claims) QUALIFY place <= 4""",
)
def _(t):
    flying = t.active_claims.select(F.col("drv_hash").alias("job_id"), "claim_id", "started_at")
    return state.in_flight_top(flying).select("job_id", "claim_id", "place", "more")


@query("st_12_retry_schedule", "SELECT drv_hash, next_attempt_at, next_attempt_at <= 950000 AS eligible FROM latches WHERE NOT finished")
def _(t):
    return state.retryable_later(t.latches, F.lit(950_000)).select("drv_hash", "next_attempt_at", "eligible")


@query(
    "rt_09_unfinished_terminal_writes",
    "SELECT job_id FROM counts JOIN jobs USING (job_id) WHERE done + failed >= total AND status = 'pending' AND priority > 1",
    **STATES,
)
def _(t):
    jobs = t.jobs.withColumn("sealed", F.col("priority") > 1)
    return lifecycle.unfinished_terminal_writes(jobs, counts(t)).select("job_id")


@query(
    "jn_08_in_flight_names",
    """SELECT c.job_id, c.claim_id, coalesce(s.drv_name, CAST(c.drv_hash AS VARCHAR)) AS drv_name, c.started_at,
              greatest(0, epoch_ms(TIMESTAMP '1998-01-01') - epoch_ms(c.started_at)) AS elapsed_ms
       FROM active_claims c LEFT JOIN steps s ON c.drv_hash = s.drv_hash AND s.system = 'x86_64-linux'""",
)
def _(t):
    names = t.steps.where(F.col("system") == "x86_64-linux")
    return cl.in_flight(t.active_claims, names, F.lit("1998-01-01").cast("timestamp"))


@query(
    "jn_11_newest_per_ref",
    "SELECT external_ref, job_id, status FROM jobs QUALIFY row_number() OVER (PARTITION BY external_ref ORDER BY done_at DESC NULLS FIRST, job_id) = 1",
)
def _(t):
    return fail.newest_per_ref(t.jobs).select("external_ref", "job_id", "status")


@query(
    "jn_11_lookup_by_ref",
    "SELECT job_id, external_ref, status, done_at FROM jobs WHERE external_ref = 'cust-11' ORDER BY done_at DESC NULLS FIRST, job_id LIMIT 1",
)
def _(t):
    return fail.find_job(t.jobs, external_ref="cust-11").select("job_id", "external_ref", "status", "done_at")
