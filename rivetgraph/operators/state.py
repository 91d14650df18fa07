"""Job and step state: counts, statuses, snapshots, schedule order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rivetgraph import params as P
from rivetgraph.functions.outcomes import features_ok, is_terminal, step_state
from rivetgraph.operators.blocks import numbered, top_per_key, zero


def step_states(steps: DataFrame) -> DataFrame:
    """PRJ-12 on a steps table (finished, previous_failure, runnable, tries)."""
    return steps.withColumn(
        "state",
        step_state(F.col("finished"), F.col("previous_failure"), F.col("runnable"), F.col("tries")),
    )


def job_counts(member_states: DataFrame, active_claims: DataFrame) -> DataFrame:
    """AG-01. ``member_states``: job_id, state; ``active_claims``: job_id.

    Both sides are reduced to one row per job before they meet.
    """
    members = member_states.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("state") == "done").alias("done"),
        F.count_if(F.col("state") == "failed").alias("failed"),
    )
    claims = active_claims.groupBy("job_id").agg(F.count(F.lit(1)).alias("building"))
    building = F.coalesce("building", zero())
    return members.join(claims, "job_id", "left").select(
        "job_id",
        "total",
        F.greatest(zero(), F.col("total") - building - F.col("done") - F.col("failed")).alias("pending"),
        building.alias("building"),
        "done",
        "failed",
    )


def live_status(sealed: Column, done: Column, failed: Column, total: Column) -> Column:
    """AG-02: over all members."""
    finished = done + failed >= total
    return (
        F.when(sealed & finished & (failed > 0), "failed")
        .when(sealed & finished, "done")
        .when(sealed, "building")
        .otherwise("pending")
    )


def terminal_status(jobs: DataFrame, root_states: DataFrame, eval_errors: DataFrame) -> DataFrame:
    """AG-03: over the roots only, plus eval errors. Null while not terminal.

    ``root_states``: job_id, finished, failed; ``eval_errors``: job_id.
    """
    roots = root_states.groupBy("job_id").agg(
        F.bool_and("finished").alias("roots_finished"), F.bool_or("failed").alias("root_failed")
    )
    errors = eval_errors.groupBy("job_id").agg(F.count(F.lit(1)).alias("eval_error_count"))
    done = F.col("sealed") & F.coalesce("roots_finished", F.lit(True))
    bad = F.coalesce("root_failed", F.lit(False)) | (F.coalesce("eval_error_count", zero()) > 0)
    return (
        jobs.join(roots, "job_id", "left")
        .join(errors, "job_id", "left")
        .withColumn("terminal_status", F.when(done & bad, "failed").when(done, "done"))
        .drop("roots_finished", "root_failed", "eval_error_count")
    )


def registry_counts(steps: DataFrame) -> DataFrame:
    """AG-04: one row."""
    s = F.col("state")
    return step_states(steps).agg(
        F.count(F.lit(1)).alias("steps_total"),
        *[F.count_if(s == name).alias(f"steps_{name}") for name in ("pending", "building", "done", "failed")],
    )


def admin_snapshot(jobs: DataFrame, steps: DataFrame, active_claims: DataFrame, recent: DataFrame) -> DataFrame:
    """AG-05: one row; ``recent`` is a list of at most five job summaries.

    The four parts are one-row aggregates, put side by side as scalar subqueries.
    """
    live = jobs.where(~is_terminal(F.col("status"))).agg(F.count(F.lit(1)).alias("n")).scalar()
    claims = active_claims.agg(F.count(F.lit(1)).alias("n")).scalar()
    last = recent.agg(F.array_sort(F.collect_list("job_id")).alias("ids")).scalar()
    return registry_counts(steps).select(
        live.alias("submissions"), "*", claims.alias("active_claims"), last.alias("recent_failures")
    )


def job_dump(
    jobs: DataFrame, members: DataFrame, roots: DataFrame, failures: DataFrame, active_claims: DataFrame
) -> DataFrame:
    """AG-06: one line of numbers per live job.

    Each input is counted per job first, so the joins see one row per job.
    """

    def per_job(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("job_id").agg(F.count(F.lit(1)).alias(name))

    out = jobs.where(~is_terminal(F.col("status"))).select("job_id", "priority", "max_workers", "sealed")
    for df, name in (
        (members, "member_count"),
        (roots, "toplevel_count"),
        (failures, "failure_count"),
        (active_claims, "active_claims"),
    ):
        out = out.join(per_job(df, name), "job_id", "left").withColumn(name, F.coalesce(name, zero()))
    return out


def drain_view(jobs: DataFrame, active_claims: DataFrame) -> DataFrame:
    """AG-07."""
    claims = active_claims.agg(F.count(F.lit(1)).alias("n")).scalar()
    return jobs.agg(F.count_if(~is_terminal(F.col("status"))).alias("open_submissions")).select(
        "open_submissions",
        claims.alias("in_flight_claims"),
        ((F.col("open_submissions") == 0) & (claims == 0)).alias("safe_to_stop"),
    )





def schedule_order() -> list[Column]:
    return [F.col("priority").desc(), F.col("created_at"), F.col("job_id")]


def scheduled_jobs(jobs: DataFrame) -> DataFrame:
    """WN-06: open jobs with their place in the schedule."""
    return numbered(jobs.where(~is_terminal(F.col("status"))), schedule_order(), out="place")


def free_slots(jobs: DataFrame, active_claims: DataFrame) -> DataFrame:
    """WN-07: null slots mean no limit."""
    active = active_claims.groupBy("job_id").agg(F.count(F.lit(1)).alias("active"))
    return (
        jobs.join(active, "job_id", "left")
        .withColumn("active", F.coalesce("active", zero()))
        .withColumn(
            "free_slots",
            F.when(F.col("max_workers").isNotNull(), F.greatest(zero(), F.col("max_workers") - F.col("active"))),
        )
        .withColumn("at_cap", F.coalesce(F.col("active") >= F.col("max_workers"), F.lit(False)))
    )


def claimable(
    ready: DataFrame,
    members: DataFrame,
    slots: DataFrame,
    *,
    systems: list[str],
    features: list[str],
    now_ms: Column,
    finished: DataFrame | None = None,
) -> DataFrame:
    """WN-08: what a worker of one class could take, in the order it would be offered.

    ``ready``: drv_hash, system, required_features, next_attempt_at; ``slots``: all open
    jobs with priority, created_at, free_slots, at_cap. ``job_place`` is the job's place in
    the schedule (WN-06, jobs at their cap hold theirs), ``job_rank`` the step's within the
    job, ``place`` the step's over all jobs. A job shows at most its free slots; a step of
    several jobs is offered in each. A planning report: nothing is claimed.
    """
    fit = ready.where(
        F.col("system").isin(*systems)
        & features_ok(F.col("required_features"), F.array(*[F.lit(f) for f in features]).cast("array<string>"))
        & (F.col("next_attempt_at") <= now_ms)
    )
    if finished is not None:
        fit = fit.join(finished.select("drv_hash"), "drv_hash", "left_anti")
    placed = numbered(
        slots.select("job_id", "priority", "created_at", "free_slots", "at_cap"), schedule_order(), out="job_place"
    )
    open_jobs = placed.where(~F.col("at_cap")).drop("at_cap")
    rows = (
        members.join(fit, "drv_hash")
        .join(open_jobs, "job_id")
        .withColumn("system_choice", F.array_position(F.array(*[F.lit(s) for s in systems]), F.col("system")))
    )
    ranked = numbered(rows, [F.col("system_choice"), F.col("drv_hash")], keys=["job_id"], out="job_rank")
    shown = ranked.where(F.col("free_slots").isNull() | (F.col("job_rank") <= F.col("free_slots"))).select(
        "job_id", "drv_hash", "system", "priority", "created_at", "job_place", "job_rank"
    )
    return numbered(shown, [F.col("job_place"), F.col("job_rank")], out="place")


def exhausted_steps(steps: DataFrame) -> DataFrame:
    """WN-09: failure records for steps out of attempts. These never enter the cache."""
    return steps.where((F.col("tries") >= F.col("max_tries")) & ~F.col("finished")).select(
        "drv_hash",
        "drv_name",
        F.lit("transient").alias("error_category"),
        F.format_string(
            "max_retries_exceeded: %d attempts completed (cap %d); last claim expired before reporting",
            "tries",
            "max_tries",
        ).alias("error_message"),
        F.lit(None).cast("string").alias("worker_id"),
    )


def retryable_later(steps: DataFrame, as_of_ms: Column) -> DataFrame:
    """ST-12: unfinished steps and whether their back-off has passed."""
    return steps.where(~F.col("finished")).withColumn("eligible", F.col("next_attempt_at") <= as_of_ms)


def newest(jobs: DataFrame, n: int) -> DataFrame:
    return jobs.orderBy(F.col("done_at").desc(), F.col("job_id")).limit(n)


def in_flight_top(in_flight: DataFrame, *, show: int = P.IN_FLIGHT_SHOW) -> DataFrame:
    """WN-14: the oldest few builds of each job and how many more there are."""
    top = top_per_key(in_flight, ["job_id"], [F.col("started_at"), F.col("claim_id")], show, "place")
    n = in_flight.groupBy("job_id").agg(F.count(F.lit(1)).alias("__n"))
    return (
        top.join(n, "job_id")
        .withColumn("more", F.greatest(zero(), F.col("__n") - show))
        .drop("__n")
    )
