"""The operator's first question: what failed lately, why, and is a worker to blame?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rivetgraph.operators import failures as fail, graph
from rivetgraph.operators.blocks import top_per_key
from rivetgraph.plans.registry import plain_columns
from rivetgraph.plans.views import ATTEMPT_ORDER, Tables, attempt_order
from rivetgraph.session import cut


def waiting_steps(t: Tables, tried: DataFrame) -> DataFrame:
    """(job_id, node): steps a job owns but never started, which are those that need one of
    the steps it tried."""
    needed = tried.join(graph.to_dependents(t.edges), F.col("drv_hash") == F.col("frm"))
    waiting = needed.select("job_id", F.col("to").alias("drv_hash")).distinct()
    return waiting.join(tried, ["job_id", "drv_hash"], "left_anti").select("job_id", F.col("drv_hash").alias("node"))


def report(t: Tables) -> DataFrame:
    failed = t.jobs.where(F.col("status") == "failed").select("job_id", "external_ref", "status", "done_at")
    # two reports read the same deduplicated failures, so they are computed once
    own = cut(
        fail.first_failures(t.all_failures(t.retried), attempt_order()).select(
            "job_id", "drv_hash", "drv_name", "error_category", "propagated_from", "worker_id", *ATTEMPT_ORDER
        )
    )
    # what the failures of the listed jobs keep from starting, each job inside its own steps
    broken = own.join(failed.select("job_id"), "job_id", "left_semi").select("job_id", F.col("drv_hash").alias("node"))
    tried = t.retried.join(failed.select("job_id"), "job_id", "left_semi").select("job_id", "drv_hash").distinct()
    waiting = cut(waiting_steps(t, tried))
    reached = graph.walk(broken, graph.to_dependents(t.edges), tags=["job_id"], within=waiting.unionByName(broken))
    spoilt = reached.join(waiting, ["job_id", "node"], "left_semi").groupBy("job_id").agg(F.count(F.lit(1)).alias("spoilt"))
    summary = own.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).join(spoilt, "job_id", "left").select(
        "job_id",
        F.col("n").cast("int").alias("originating_failures_total"),
        F.coalesce("spoilt", F.lit(0)).cast("int").alias("propagated_failures"),
    )
    named = (
        top_per_key(own, ["job_id"], attempt_order(), 3, "place")
        .groupBy("job_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "drv_name"))).alias("top"))
        .select("job_id", F.array_join("top.drv_name", ", ").alias("originating_failures"))
    )
    return (
        failed.join(summary, "job_id", "left")
        .join(named, "job_id", "left")
        .join(fail.suspected_workers(own), "job_id", "left")
        .orderBy(F.col("done_at").desc(), "job_id")
    )


def failed_jobs_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_columns(report(Tables(spark, sf_dir)))
