"""The system's invariants as queries: each gives the violating rows, so empty is good."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rivetgraph import params as P
from rivetgraph.functions.outcomes import is_terminal
from rivetgraph.operators.blocks import max_before


def terminal_counts_add_up(jobs: DataFrame, counts: DataFrame) -> DataFrame:
    """DQ-01: a terminal job has total = done + failed."""
    done = jobs.where(is_terminal(F.col("status"))).select("job_id")
    return counts.join(done, "job_id", "left_semi").where(F.col("total") != F.col("done") + F.col("failed"))


def duplicate_steps(steps: DataFrame) -> DataFrame:
    """DQ-02: one step per hash."""
    return steps.groupBy("drv_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def runnable_too_early(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """DQ-03: runnable steps that are not fully described or still wait for an input."""
    unfinished = steps.where(~F.col("finished")).select(F.col("drv_hash").alias("dst"))
    waiting = edges.join(unfinished, "dst", "left_semi").select(F.col("src").alias("drv_hash")).distinct()
    waiting = waiting.withColumn("__waits", F.lit(True))
    return (
        steps.where("runnable")
        .join(waiting, "drv_hash", "left")
        .where(~F.col("created") | F.col("__waits").isNotNull())
        .drop("__waits")
    )


def started_before_input(edges: DataFrame, times: DataFrame) -> DataFrame:
    """DQ-04: edges whose source started before the input had ended.

    ``times``: drv_hash, started_at, ended_at.
    """
    src = times.select(F.col("drv_hash").alias("src"), F.col("started_at").alias("src_started"))
    dst = times.select(F.col("drv_hash").alias("dst"), F.col("ended_at").alias("dst_ended"))
    return edges.join(src, "src").join(dst, "dst").where(F.col("src_started") < F.col("dst_ended"))


def overlapping_claims(claims: DataFrame) -> DataFrame:
    """DQ-05: claims that start while an earlier claim of the same step still runs.

    ``claims``: drv_hash, claim_id, started_at, ended_at. A running maximum of the ends
    also catches an earlier claim longer than the previous one.
    """
    order = [F.col("started_at"), F.col("claim_id")]
    busy = max_before(claims, order, F.col("ended_at"), keys=["drv_hash"], out="busy_until")
    return busy.where(F.col("busy_until") > F.col("started_at"))


def bad_job_rows(jobs: DataFrame) -> DataFrame:
    """DQ-06: ``rule`` names what a job row breaks."""
    terminal = is_terminal(F.col("status"))
    rules = [
        ("unknown_status", ~F.coalesce(F.col("status").isin(*P.KNOWN_STATUSES), F.lit(False))),
        ("terminal_without_done_at", terminal & F.col("done_at").isNull()),
        ("done_at_without_terminal", ~terminal & F.col("done_at").isNotNull()),
        ("done_at_without_result", F.col("done_at").isNotNull() & F.col("result").isNull()),
    ]
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda r: r.isNotNull())
    return jobs.select("*", F.explode(broken).alias("rule"))


def unbalanced_batches(stats: DataFrame) -> DataFrame:
    """DQ-07: batches with good edges only where new + dedup + errored ≠ sent."""
    return stats.where(
        (F.col("edge_errors") == 0)
        & (F.col("new_drvs") + F.col("dedup_skipped") + F.col("errored") != F.col("sent"))
    )


def terminal_counter_gap(jobs: DataFrame, counter: DataFrame) -> DataFrame:
    """DQ-08: statuses where the counter (status, value) differs from the table."""
    table = (
        jobs.where(is_terminal(F.col("status"))).groupBy("status").agg(F.count(F.lit(1)).alias("in_table"))
    )
    return table.join(counter.withColumnRenamed("value", "counted"), "status", "full_outer").where(
        ~F.col("in_table").eqNullSafe(F.col("counted"))
    )


def leftover_claims(claims: DataFrame, completions: DataFrame) -> DataFrame:
    """DQ-09: claims still open once everything should be quiet."""
    return claims.join(completions.select("claim_id"), "claim_id", "left_anti")


def oversized_results(
    jobs: DataFrame, snapshot: Column, *, cap: int = P.MAX_FAILURES_IN_RESULT, max_bytes: int = 1 << 20
) -> DataFrame:
    """DQ-10: stored results with too many failures or too many bytes."""
    return (
        jobs.withColumn("n_failures", F.array_size(snapshot["failures"]))
        .withColumn("result_bytes", F.octet_length("result"))
        .where((F.col("n_failures") > cap + 1) | (F.col("result_bytes") >= max_bytes))
    )


def assertion(name: str, violations: DataFrame) -> DataFrame:
    return violations.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("name"),
        (F.col("n") == 0).alias("passed"),
        F.format_string("%d violations", "n").alias("detail"),
    )


def assertions(checks: dict[str, DataFrame]) -> DataFrame:
    """DQ-11: (name, passed, detail), one row per check."""
    return reduce(DataFrame.unionByName, [assertion(name, df) for name, df in checks.items()])
