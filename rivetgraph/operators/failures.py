"""Failure analytics: dedup, caps, suspicion, summaries, terminal snapshots, run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rivetgraph import params as P
from rivetgraph.functions.outcomes import is_retryable, status_or_pending
from rivetgraph.operators.blocks import first_per_key, top_per_key, zero

RECORD = (
    "drv_hash",
    "drv_name",
    "error_category",
    "error_message",
    "log_tail",
    "propagated_from",
    "worker_id",
)

def first_failures(failures: DataFrame, order: list[Column]) -> DataFrame:
    """AG-10: one record per (job, drv)."""
    return first_per_key(failures, ["job_id", "drv_hash"], order)


def suspected_workers(failures: DataFrame, *, minimum: int = P.MIN_FAILURES_FOR_SUSPICION) -> DataFrame:
    """AG-09: (job_id, suspected_worker) where one worker has a strict majority of the
    infra-looking originating failures. Counted per (job, worker) first, so a job with
    very many failures reaches the second step as one row per worker."""
    infra = failures.where(
        F.col("propagated_from").isNull()
        & is_retryable(F.col("error_category"))
        & (F.coalesce("worker_id", F.lit("")) != "")
    )
    per_worker = infra.groupBy("job_id", "worker_id").agg(F.count(F.lit(1)).alias("n"))
    per_job = per_worker.groupBy("job_id").agg(
        F.sum("n").alias("total"), F.max_by("worker_id", "n").alias("worker"), F.max("n").alias("top")
    )
    return per_job.where((F.col("total") >= minimum) & (F.col("top") * 2 > F.col("total"))).select(
        "job_id", F.col("worker").alias("suspected_worker")
    )


def capped_failures(
    failures: DataFrame,
    order: list[Column],
    *,
    cap: int = P.MAX_FAILURES_IN_RESULT,
    tails: int = P.MAX_LOG_TAILS_IN_RESULT,
    marker: bool = True,
) -> DataFrame:
    """AG-11: the first ``cap`` records of a job as ``place`` 0.., tails only on the
    first few, and one marker record where more exist (``marker=False``: the live view)."""
    kept = top_per_key(failures, ["job_id"], order, cap, "place").withColumn("place", F.col("place") - 1)
    # the live view serves records as they are; only the stored form strips tails
    tail = F.when(F.col("place") < tails, F.col("log_tail")) if marker else F.col("log_tail")
    kept = kept.withColumn("log_tail", tail).select("job_id", "place", *RECORD)
    if not marker:
        return kept
    types = {f.name: f.dataType for f in kept.schema.fields}

    def null(c: str) -> Column:
        return F.lit(None).cast(types[c]).alias(c)

    over = (
        failures.groupBy("job_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > cap)
        .select(
            "job_id",
            F.lit(cap).alias("place"),
            F.lit(P.TRUNCATED_MARK).try_cast(types["drv_hash"]).alias("drv_hash"),
            F.lit(P.TRUNCATED_MARK).alias("drv_name"),
            F.lit("propagated_failure").alias("error_category"),
            F.format_string("%d additional failures truncated from snapshot", F.col("n") - cap).alias(
                "error_message"
            ),
            *[null(c) for c in ("log_tail", "propagated_from", "worker_id")],
        )
    )
    return kept.unionByName(over)


def failure_arrays(capped: DataFrame) -> DataFrame:
    """One ordered array of records per job. The cap bounds every array."""
    return capped.groupBy("job_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", *RECORD))),
            lambda r: F.struct(*[r[c].alias(c) for c in RECORD]),
        ).alias("failures")
    )


def terminal_snapshots(
    jobs: DataFrame,
    counts: DataFrame,
    failures: DataFrame,
    order: list[Column],
    eval_errors: DataFrame | None = None,
    *,
    cap: int = P.MAX_FAILURES_IN_RESULT,
    tails: int = P.MAX_LOG_TAILS_IN_RESULT,
) -> DataFrame:
    """AG-13: (job_id, result JSON). Suspicion looks at all failures, the list is capped.

    ``jobs``: job_id, status, sealed, eval_error; ``eval_errors``: job_id, attr, error,
    place (already capped).
    """
    lists = failure_arrays(capped_failures(failures, order, cap=cap, tails=tails))
    suspects = suspected_workers(failures)
    count_struct = F.struct(*[F.coalesce(c, zero()).alias(c) for c in ("total", "pending", "building", "done", "failed")])
    out = (
        jobs.join(counts, "job_id", "left")
        .join(lists, "job_id", "left")
        .join(suspects, "job_id", "left")
    )
    no_errors = F.array().cast("array<struct<attr:string,error:string>>")
    errors = no_errors
    if eval_errors is not None:
        arrays = eval_errors.groupBy("job_id").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("place", "attr", "error"))),
                lambda r: F.struct(r["attr"].alias("attr"), r["error"].alias("error")),
            ).alias("eval_errors")
        )
        out = out.join(arrays, "job_id", "left")
        errors = F.coalesce("eval_errors", no_errors)
    empty = F.filter("failures", lambda r: F.lit(False))
    body = F.struct(
        F.col("job_id").cast("string").alias("id"),
        "status",
        "sealed",
        count_struct.alias("counts"),
        F.coalesce("failures", empty, F.array()).alias("failures"),
        "eval_error",
        errors.alias("eval_errors"),
        F.col("suspected_worker").alias("suspected_worker_infra"),
    )
    return out.select("job_id", F.to_json(body).alias("result"))


def job_summary(snapshot: Column) -> Column:
    """AG-08: struct from a *stored* snapshot, so a truncation marker counts as propagated."""
    failures = snapshot["failures"]
    own = F.filter(failures, lambda f: f["error_category"] != "propagated_failure")
    return F.struct(
        F.coalesce(F.transform(F.slice(own, 1, 3), lambda f: f["drv_name"]), F.array().cast("array<string>")).alias(
            "originating_failures"
        ),
        F.coalesce(F.array_size(own), F.lit(0)).alias("originating_failures_total"),
        F.coalesce(F.array_size(failures) - F.array_size(own), F.lit(0)).alias("propagated_failures"),
    )


def summarise_jobs(jobs: DataFrame) -> DataFrame:
    """AG-08 on jobs (… , snapshot struct)."""
    return jobs.select(
        "job_id",
        "external_ref",
        status_or_pending(F.col("status")).alias("status"),
        "done_at",
        job_summary(F.col("snapshot")).alias("s"),
    ).select("job_id", "external_ref", "status", "done_at", "s.*")


def list_jobs(
    jobs: DataFrame,
    status: str,
    *,
    cursor: Column | None = None,
    since: Column | None = None,
    limit: int = P.LIST_LIMIT_DEFAULT,
) -> DataFrame:
    """WN-01: one page, newest first, with ``next_cursor`` on every row.

    One row past the page is fetched to learn whether more exist; ``since`` is applied
    after that fetch. Only finished jobs have a ``done_at``, so a pending list is empty.
    Jobs with the same ``done_at`` as the page's last row are skipped by the next page.
    """
    n = max(1, min(limit, P.LIST_LIMIT_MAX))
    page = jobs.where((F.col("status") == status) & F.col("done_at").isNotNull())
    if cursor is not None:
        page = page.where(F.col("done_at") < cursor)
    order = [F.col("done_at").desc(), F.col("job_id")]
    page = page.orderBy(*order).limit(n + 1)
    if since is not None:
        page = page.where(F.col("done_at") >= since)
    # at most 201 rows from here on
    every = Window.partitionBy(F.lit(0)).orderBy(*order)
    whole = Window.partitionBy(F.lit(0))
    placed = page.withColumn("place", F.row_number().over(every)).withColumn("__n", F.count(F.lit(1)).over(whole))
    shown = placed.where(F.col("place") <= n)
    return shown.withColumn(
        "next_cursor", F.when(F.col("__n") > n, F.min("done_at").over(whole))
    ).drop("__n")


def find_job(jobs: DataFrame, *, external_ref: str | None = None, job_id=None) -> DataFrame:
    """JN-11: by id, or the newest of a reference with open jobs first."""
    if job_id is not None:
        return jobs.where(F.col("job_id") == job_id).limit(1)
    return (
        jobs.where(F.col("external_ref") == external_ref)
        .orderBy(F.col("done_at").desc_nulls_first(), F.col("job_id"))
        .limit(1)
    )


def newest_per_ref(jobs: DataFrame) -> DataFrame:
    """JN-11 for every reference at once."""
    return first_per_key(
        jobs.where(F.col("external_ref").isNotNull()),
        ["external_ref"],
        [F.col("done_at").desc_nulls_first(), F.col("job_id")],
    )


def retry_tallies(attempt_outcomes: DataFrame) -> DataFrame:
    """AG-26: (job_id, outcome, propagated) rows to per-job tallies."""
    return attempt_outcomes.groupBy("job_id").agg(
        F.count_if(F.col("outcome") == "flaky_retry").alias("transient_retries"),
        F.count_if(F.col("outcome") == "propagated").alias("propagated_failed"),
    )


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """JN-13 per drv: originating failures of run A and run B side by side.

    Inputs: pair_id, drv_hash, drv_name, error_category, propagated_from.
    """

    def own(df: DataFrame, side: str) -> DataFrame:
        return df.where(F.col("propagated_from").isNull() & (F.col("drv_name") != P.TRUNCATED_MARK)).select(
            "pair_id",
            "drv_hash",
            F.col("drv_name").alias(f"name_{side}"),
            F.col("error_category").alias(f"category_{side}"),
        )

    both = own(a, "a").join(own(b, "b"), ["pair_id", "drv_hash"], "full_outer")
    return both.select(
        "pair_id",
        "drv_hash",
        F.coalesce("name_a", "name_b").alias("drv_name"),
        "category_a",
        "category_b",
        F.when(F.col("category_b").isNull(), "only_in_a")
        .when(F.col("category_a").isNull(), "only_in_b")
        .when(F.col("category_a") != F.col("category_b"), "category_mismatch")
        .otherwise("same")
        .alias("finding"),
    )


def comparison_report(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """JN-13 per pair. ``pairs``: pair_id, status_a/b, {total,pending,building,done,failed}_a/b,
    suspected_a/b."""
    f = findings.groupBy("pair_id").agg(
        *[
            F.count_if(F.col("finding") == kind).alias(f"n_{kind}")
            for kind in ("only_in_a", "only_in_b", "category_mismatch")
        ]
    )
    out = pairs.join(f, "pair_id", "left")
    for kind in ("only_in_a", "only_in_b", "category_mismatch"):
        out = out.withColumn(f"n_{kind}", F.coalesce(f"n_{kind}", zero()))
    for c in ("total", "pending", "building", "done", "failed"):
        out = out.withColumn(f"{c}_delta", F.col(f"{c}_b") - F.col(f"{c}_a"))
    mismatch = ~F.col("status_a").eqNullSafe(F.col("status_b"))
    severity = (
        F.when(mismatch, "critical")
        .when((F.col("n_only_in_a") > 0) | (F.col("n_only_in_b") > 0), "major")
        .when(
            (F.col("n_category_mismatch") > 0) | (F.col("done_delta") != 0) | (F.col("failed_delta") != 0),
            "minor",
        )
        .otherwise("matched")
    )
    new_suspect = F.col("suspected_b").isNotNull() & ~F.col("suspected_b").eqNullSafe(F.col("suspected_a"))
    return out.select(
        "pair_id",
        mismatch.alias("status_mismatch"),
        *[f"{c}_delta" for c in ("total", "pending", "building", "done", "failed")],
        "n_only_in_a",
        "n_only_in_b",
        "n_category_mismatch",
        severity.alias("severity"),
        (severity == "matched").alias("matched"),
        new_suspect.alias("new_suspicion"),
    )


def run_summary(
    jobs: DataFrame, counts: DataFrame, failures: DataFrame, tallies: DataFrame, order: list[Column], *,
    preview: int = P.PROPAGATED_PREVIEW,
) -> DataFrame:
    """AG-28: final figures of a run, with a preview of what failed by propagation."""
    is_propagated = F.col("error_category") == "propagated_failure"
    totals = failures.groupBy("job_id").agg(
        F.count_if(~is_propagated).alias("originating"), F.count_if(is_propagated).alias("propagated")
    )
    shown = (
        top_per_key(failures.where(is_propagated), ["job_id"], order, preview, "place")
        .groupBy("job_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "drv_name"))).alias("p"))
        .select("job_id", F.array_join(F.transform("p", lambda x: x["drv_name"]), ", ").alias("propagated_preview"))
    )
    label = (
        F.when(F.col("status") == "done", "SUCCEEDED")
        .when(F.col("status") == "failed", "FAILED")
        .when(F.col("status") == "cancelled", "CANCELLED")
    )
    out = jobs.select("job_id", "status").join(counts, "job_id", "left")
    for side in (totals, tallies, shown):
        out = out.join(side, "job_id", "left")
    return out.select(
        "job_id",
        label.alias("label"),
        *[F.coalesce(c, zero()).alias(c) for c in ("total", "done", "failed", "originating", "transient_retries", "propagated")],
        "propagated_preview",
        F.greatest(zero(), F.coalesce("propagated", zero()) - preview).alias("propagated_more"),
    )


def slowest_builds(completed: DataFrame, *, keep: int = P.SLOWEST_KEEP, show: int = P.SLOWEST_SHOW) -> DataFrame:
    """WN-13: the ``keep`` longest builds of each job; ``shown`` marks the printed few."""
    order = [F.col("duration_ms").desc(), F.col("claim_id")]
    return top_per_key(completed, ["job_id"], order, keep, "place").withColumn("shown", F.col("place") <= show)
