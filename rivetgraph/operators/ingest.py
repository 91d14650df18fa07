"""Ingest: validation, registry dedup, cache short-circuit, edges, membership, caps.

Ingest rows carry ``batch_id`` (arrival order of batches, sortable), ``pos`` (place
in the batch) and ``job_id`` beside the wire columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rivetgraph import params as P
from rivetgraph.functions import checks, paths
from rivetgraph.operators.blocks import first_per_key, numbered, running_total, top_per_key
from rivetgraph.session import cut

ARRIVAL = ("batch_id", "pos")


def _arrival() -> list[Column]:
    return [F.col(c) for c in ARRIVAL]


def with_reject_reason(rows: DataFrame, **limits: int) -> DataFrame:
    """PRJ-05: ``reject_reason`` and ``drv_hash``; a bad row never costs its batch."""
    return rows.withColumn(
        "reject_reason",
        checks.ingest_reject_reason(
            F.col("drv_path"),
            F.col("drv_name"),
            F.col("system"),
            F.size("input_drvs"),
            F.size("required_features"),
            F.col("attr"),
            **limits,
        ),
    ).withColumn("drv_hash", paths.drv_hash_from_path(F.col("drv_path")))


def registry(rows: DataFrame, liveness: DataFrame | None = None) -> DataFrame:
    """JN-02: the first record of each drv_hash; its metadata wins.

    ``liveness`` (drv_hash, live_from, live_to) lists the spans in which some job
    holds the step (see ``liveness``). With it the first row *of each span* is new again, since a step
    no job holds is forgotten. ``rows`` then needs an ``arrived_at`` column.
    """
    if liveness is None:
        return first_per_key(rows, ["drv_hash"], _arrival())
    spanned = rows.join(liveness, "drv_hash").where(
        (F.col("arrived_at") >= F.col("live_from"))
        & (F.col("live_to").isNull() | (F.col("arrived_at") < F.col("live_to")))
    )
    return first_per_key(spanned, ["drv_hash", "live_from"], _arrival()).drop("live_from", "live_to")


def liveness(members: DataFrame, jobs: DataFrame) -> DataFrame:
    """(drv_hash, live_from, live_to): the spans in which at least one job holds the step.

    ``members``: job_id, drv_hash; ``jobs``: job_id, created_at, done_at (null: still live).
    A sweep adds 1 where a job begins and takes 1 where it ends; a span runs from where the
    sum leaves 0 to where it is 0 again. Jobs that meet at an instant keep the step; one that
    ends as it begins holds nothing. The sweep runs in ranges, so a step that all jobs hold
    spreads over tasks.
    """
    held = members.select("job_id", "drv_hash").distinct().join(jobs.select("job_id", "created_at", "done_at"), "job_id")
    ends = F.array(
        F.struct(F.col("created_at").alias("at"), F.lit(1).alias("add")),
        F.struct(F.col("done_at").alias("at"), F.lit(-1).alias("add")),
    )
    steps = held.select("drv_hash", F.inline(ends)).where(F.col("at").isNotNull())
    net = steps.groupBy("drv_hash", "at").agg(F.sum("add").alias("net")).where("net <> 0")
    swept = running_total(net, [F.col("at")], F.col("net"), keys=["drv_hash"], out="jobs")
    edges = cut(swept.where("jobs = 0 or jobs = net"))

    def nth(rows: DataFrame, name: str) -> DataFrame:
        return numbered(rows.select("drv_hash", F.col("at").alias(name)), [F.col(name)], keys=["drv_hash"])

    begun, over = nth(edges.where("jobs > 0"), "live_from"), nth(edges.where("jobs = 0"), "live_to")
    return begun.join(over, ["drv_hash", "n"], "left").drop("n")


def mark_new(rows: DataFrame) -> DataFrame:
    """``is_new`` on every row: true for the one that mints the step."""
    firsts = registry(rows).select("drv_hash", *ARRIVAL, F.lit(True).alias("is_new"))
    return rows.join(firsts, ["drv_hash", *ARRIVAL], "left").withColumn(
        "is_new", F.coalesce("is_new", F.lit(False))
    )


def cache_hits(steps: DataFrame, failed_outputs: DataFrame, as_of: Column) -> DataFrame:
    """JN-01: ``cached_failed`` for new steps whose output is known bad and not expired.

    No size hint: the cache is filtered and de-duplicated first, and AQE broadcasts
    it only if what is left turns out small.
    """
    live = failed_outputs.where(F.col("expires_at") > as_of).select("output_path").distinct()
    return (
        steps.withColumn("output_path", paths.output_path(F.col("drv_path")))
        .join(live.withColumn("__hit", F.lit(True)), "output_path", "left")
        .withColumn("cached_failed", F.coalesce("__hit", F.lit(False)))
        .drop("__hit")
    )


def exploded_inputs(rows: DataFrame) -> DataFrame:
    """One row per wanted edge with ``edge_error`` (bad path, self loop) or null."""
    return (
        rows.select(
            "job_id",
            *ARRIVAL,
            F.col("drv_hash").alias("src"),
            "system",
            F.explode("input_drvs").alias("dep_path"),
        )
        .withColumn("dst", paths.drv_hash_from_path(F.col("dep_path")))
        .withColumn(
            "edge_error",
            F.when(F.col("dst").isNull(), "bad_path").when(F.col("dst") == F.col("src"), "self_loop"),
        )
    )


def wire_edges(inputs: DataFrame, finished: DataFrame | None = None) -> DataFrame:
    """JN-03: good edges, once each. An input that is already finished (``finished``:
    drv_hash) needs no edge, so its parent neither waits for it nor fails with it."""
    good = inputs.where(F.col("edge_error").isNull()).select("src", "dst").distinct()
    if finished is None:
        return good
    return good.join(finished.select(F.col("drv_hash").alias("dst")).distinct(), "dst", "left_anti").select(
        "src", "dst"
    )


def placeholders(inputs: DataFrame, known: DataFrame) -> DataFrame:
    """JN-03: inputs nobody described, on the system of their first parent.

    A described step always beats a placeholder, whichever came first.
    """
    wanted = inputs.where(F.col("edge_error").isNull())
    unknown = wanted.join(known.select(F.col("drv_hash").alias("dst")).distinct(), "dst", "left_anti")
    first = first_per_key(unknown, ["dst"], [*_arrival(), F.col("src")])
    return first.select(
        F.col("dst").alias("drv_hash"),
        F.col("dep_path").alias("drv_path"),
        paths.placeholder_name(F.col("dep_path")).alias("drv_name"),
        "system",
    )


def membership(job_drvs: DataFrame, inputs: DataFrame, finished: DataFrame | None = None) -> DataFrame:
    """JN-04: a job owns the steps it sent and the good inputs it named for them itself
    (``inputs``: rows of :func:`exploded_inputs`), except those already ``finished``."""
    deps = inputs.where(F.col("edge_error").isNull()).select("job_id", F.col("dst").alias("drv_hash"))
    if finished is not None:
        deps = deps.join(finished.select("drv_hash").distinct(), "drv_hash", "left_anti").select("job_id", "drv_hash")
    return job_drvs.select("job_id", "drv_hash").union(deps).distinct()


def late_batches(batches: DataFrame, jobs: DataFrame) -> DataFrame:
    """JN-17: ``late_reason`` for batches (job_id, arrived_at) against the job's state then."""
    state = jobs.select("job_id", "sealed_at", "done_at", F.lit(True).alias("__known"))
    return (
        batches.join(state, "job_id", "left")
        .withColumn(
            "late_reason",
            F.when(F.col("__known").isNull(), "unknown_job")
            .when(F.col("arrived_at") >= F.col("done_at"), "terminal")
            .when(F.col("arrived_at") >= F.col("sealed_at"), "sealed"),
        )
        .drop("__known", "sealed_at", "done_at")
    )


def cap_reservation(batches: DataFrame, *, cap: int = P.MAX_DRVS_PER_JOB) -> DataFrame:
    """AG-16: batches (job_id, batch_id, incoming, released) up to the first over-cap one.

    ``released`` are the slots given back for dedup hits once a batch is in. A batch
    is over when what earlier ones kept plus its own ``incoming`` passes the cap; the
    job then fails, so nothing of it and nothing later is taken.
    """
    kept = F.col("incoming") - F.col("released")
    order = [F.col("batch_id")]
    totals = running_total(batches, order, kept, keys=["job_id"], out="kept_through")
    tried = totals.withColumn("reserved", F.col("kept_through") - kept + F.col("incoming"))
    first_over = (
        tried.where(F.col("reserved") > cap).groupBy("job_id").agg(F.min("batch_id").alias("__over"))
    )
    return (
        tried.join(first_over, "job_id", "left")
        .withColumn(
            "verdict",
            F.when(F.col("batch_id") == F.col("__over"), "eval_too_large")
            .when(F.col("batch_id") > F.col("__over"), "job_already_failed")
            .otherwise("accepted"),
        )
        .drop("__over", "kept_through")
    )


def accounting(checked: DataFrame, edge_inputs: DataFrame) -> DataFrame:
    """AG-17: new / dedup_skipped / errored per batch; bad edges count as errors too.

    ``checked`` has reject_reason and is_new (null for rejected rows).
    """
    ok = F.col("reject_reason").isNull()
    rows = checked.groupBy("job_id", "batch_id").agg(
        F.count(F.lit(1)).alias("sent"),
        F.count_if(ok & F.col("is_new")).alias("new_drvs"),
        F.count_if(ok & ~F.col("is_new")).alias("dedup_skipped"),
        F.count_if(~ok).alias("row_errors"),
    )
    edges = edge_inputs.groupBy("job_id", "batch_id").agg(
        F.count_if(F.col("edge_error").isNotNull()).alias("edge_errors")
    )
    return (
        rows.join(edges, ["job_id", "batch_id"], "left")
        .withColumn("edge_errors", F.coalesce("edge_errors", F.lit(0).cast("bigint")))
        .withColumn("errored", F.col("row_errors") + F.col("edge_errors"))
        .drop("row_errors")
    )


def submit_stats(eval_lines: DataFrame, batch_stats: DataFrame) -> DataFrame:
    """AG-18: one row per run_id. ``eval_lines`` needs error, drv_path, cached."""
    lines = eval_lines.groupBy("run_id").agg(
        F.count_if(F.col("error").isNotNull()).alias("eval_errors"),
        F.count_if(F.col("error").isNull() & F.col("drv_path").isNotNull() & F.col("cached")).alias(
            "cached_skipped"
        ),
    )
    sent = batch_stats.groupBy("run_id").agg(
        F.sum("new_drvs").alias("new_drvs"),
        F.sum("dedup_skipped").alias("dedup_skipped"),
        F.sum("errored").alias("errors"),
    )
    zero = F.lit(0).cast("bigint")
    return lines.join(sent, "run_id", "full_outer").select(
        "run_id",
        *[
            F.coalesce(c, zero).alias(c)
            for c in ("new_drvs", "dedup_skipped", "cached_skipped", "eval_errors", "errors")
        ],
    )


def job_sizes(members: DataFrame, *, warn_at: int = P.JOB_SIZE_WARN) -> DataFrame:
    """AG-15."""
    return (
        members.groupBy("job_id")
        .agg(F.count(F.lit(1)).alias("members"))
        .withColumn("oversized", F.col("members") >= warn_at)
    )


def capped_eval_errors(errors: DataFrame, *, cap: int = P.EVAL_ERRORS_CAP) -> DataFrame:
    """AG-12: first report of each attr (job_id, ord, attr, error), at most ``cap``
    of them, and one marker row where more were sent."""

    once = first_per_key(errors, ["job_id", "attr"], [F.col("ord")])
    kept = top_per_key(once, ["job_id"], [F.col("ord"), F.col("attr")], cap, "place")
    over = (
        once.groupBy("job_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > cap)
        .select(
            "job_id",
            F.lit(P.TRUNCATED_MARK).alias("attr"),
            F.lit(f"cap of {cap} eval errors reached").alias("error"),
            F.lit(cap + 1).alias("place"),
        )
    )
    return kept.select("job_id", "attr", "error", "place").unionByName(over)


def ordered_roots(root_rows: DataFrame) -> DataFrame:
    """WN-18: distinct roots of a job in first-seen order (job_id, drv_hash, ord)."""
    firsts = root_rows.groupBy("job_id", "drv_hash").agg(F.min("ord").alias("first_ord"))

    return numbered(
        firsts, [F.col("first_ord"), F.col("drv_hash")], keys=["job_id"], out="root_no"
    )


def insert_failed_outputs(
    existing: DataFrame, terminal: DataFrame, *, as_of: Column | None = None, refresh_expired: bool = False
) -> DataFrame:
    """SNK-03: the cache after inserting terminal build failures.

    ``terminal``: output_path, drv_hash, failed_at, expires_at, worker_id,
    error_category, propagated_from. A path already present blocks the insert, even
    if expired but not yet swept; ``refresh_expired`` (with ``as_of``) lets it pass.
    """
    candidates = terminal.where(
        (F.col("error_category") == "build_failure") & F.col("propagated_from").isNull()
    ).select("output_path", "drv_hash", "failed_at", "expires_at", "worker_id")
    if refresh_expired:
        existing = existing.where(F.col("expires_at") > as_of)
    fresh = candidates.join(existing.select("output_path").distinct(), "output_path", "left_anti")
    order = [F.col("failed_at"), F.col("drv_hash"), F.coalesce("worker_id", F.lit(""))]
    return existing.select(*candidates.columns).unionByName(first_per_key(fresh, ["output_path"], order))


def create_jobs(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-02: (jobs created, request → winning job).

    ``requests``: request_id, external_ref, created_at and any job settings. The first
    request of a reference creates the job and its settings stand; requests without a
    reference never meet.
    """
    named = requests.where(F.col("external_ref").isNotNull())
    order = [F.col("created_at"), F.col("request_id")]
    first = first_per_key(named, ["external_ref"], order)
    winners = first.select("external_ref", F.col("request_id").alias("job_id"))
    resolved = named.join(winners, "external_ref").select("request_id", "job_id")
    alone = requests.where(F.col("external_ref").isNull())
    jobs = first.unionByName(alone).withColumnRenamed("request_id", "job_id")
    mapping = resolved.unionByName(alone.select("request_id", F.col("request_id").alias("job_id")))
    return jobs, mapping


