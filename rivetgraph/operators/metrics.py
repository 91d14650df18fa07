"""Counters, fixed-bucket histograms, exact percentiles, quantiles from buckets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rivetgraph.operators.blocks import bucket_of, running_total


def counter(rows: DataFrame, *labels: str) -> DataFrame:
    """AG-19."""
    return rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("value"))


def histogram(rows: DataFrame, value: Column, bounds: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """AG-20: (labels, le, cumulative, total_sum, total_count); le null stands for +Inf.

    One pass and one shuffle: each row adds to one counter of its label set, so what is
    shuffled is one row per label set and task. The cumulative form is arithmetic on it.
    """
    n = len(bounds)
    slot = bucket_of(value, bounds)
    hit = rows.where(value.isNotNull()).select(*labels, value.alias("__v"), slot.alias("__b"))
    per = hit.groupBy(*labels).agg(
        *[F.count_if(F.col("__b") == i).alias(f"__c{i}") for i in range(n + 1)],
        F.sum("__v").cast("double").alias("total_sum"),
        F.count(F.lit(1)).alias("total_count"),
    )
    upto = [reduce(Column.__add__, [F.col(f"__c{j}") for j in range(i + 1)]) for i in range(n + 1)]
    cells = [
        F.struct(
            (F.lit(float(bounds[i])) if i < n else F.lit(None).cast("double")).alias("le"),
            upto[i].alias("cumulative"),
        )
        for i in range(n + 1)
    ]
    return per.select(*labels, F.inline(F.array(*cells)), "total_sum", "total_count")


def exact_summary(rows: DataFrame, value: Column, labels: Sequence[str] = ()) -> DataFrame:
    """AG-21: count, p50, p95, p99, max, mean per label set; nearest rank
    ``round((n − 1)·q)``, never interpolated.

    Equal values are counted together before anything is ordered, then a running count
    over value ranges finds the value at each rank: no label set is sorted in one task.
    """
    counted = (
        rows.where(value.isNotNull())
        .select(*labels, value.cast("double").alias("v"))
        .groupBy(*labels, "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running_total(counted, [F.col("v")], F.col("n"), keys=labels, out="upto")
    totals = counted.groupBy(*labels).agg(
        F.sum("n").alias("count"), F.max("v").alias("max_ms"), (F.sum(F.col("v") * F.col("n"))).alias("s")
    )
    if labels:
        joined = ranked.join(totals, list(labels))
    else:
        joined = ranked.select("*", *[totals.select(c).scalar().alias(c) for c in ("count", "max_ms", "s")])

    def at(q: float) -> Column:
        # half away from zero, as for any non-negative rank
        rank = F.floor((F.col("count") - 1) * F.lit(q) + F.lit(0.5)) + 1
        return F.min(F.when(F.col("upto") >= rank, F.col("v")))

    out = joined.groupBy(*labels).agg(
        F.first("count").alias("count"),
        at(0.50).alias("p50_ms"),
        at(0.95).alias("p95_ms"),
        at(0.99).alias("p99_ms"),
        F.first("max_ms").alias("max_ms"),
        (F.first("s") / F.first("count")).alias("mean_ms"),
    )
    return out


def merge_summaries(summaries: DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    """AG-22: count-weighted percentiles and mean, largest maximum."""
    total = F.sum("count")
    weighted = [
        (F.sum(F.col(c) * F.col("count")) / F.nullif(total, F.lit(0))).alias(c)
        for c in ("p50_ms", "p95_ms", "p99_ms", "mean_ms")
    ]
    return summaries.groupBy(*labels).agg(total.alias("count"), F.max("max_ms").alias("max_ms"), *weighted)


def bucket_quantile(hist: DataFrame, q: float, labels: Sequence[str] = ()) -> DataFrame:
    """AG-23: the smallest bound whose cumulative count reaches q of the total. Infinity
    if only the last bucket does; no row for an empty histogram."""
    bound = F.coalesce("le", F.lit(float("inf")))
    return (
        hist.where((F.col("total_count") > 0) & (F.col("cumulative") >= F.col("total_count") * F.lit(q)))
        .groupBy(*labels)
        .agg(F.min(bound).alias("quantile"))
    )


def hit_rate(hits: Column, ingested: Column) -> Column:
    """AG-24: null when nothing was ingested."""
    return hits / F.nullif(ingested, F.lit(0))


def worker_report(actions: DataFrame) -> DataFrame:
    """AG-27: per worker group: outcomes and latencies of claims and completions.

    ``actions``: worker_group, action (claim / complete), ok, latency_ms.
    """
    claim, complete = F.col("action") == "claim", F.col("action") == "complete"
    totals = actions.groupBy("worker_group").agg(
        F.count_if(claim & F.col("ok")).alias("claims_success"),
        F.count_if(claim & ~F.col("ok")).alias("claims_empty"),
        F.count_if(complete & F.col("ok")).alias("completes_ok"),
        F.count_if(complete & ~F.col("ok")).alias("completes_err"),
    )
    lat = exact_summary(actions, F.col("latency_ms"), ["worker_group", "action"])
    for action in ("claim", "complete"):
        side = lat.where(F.col("action") == action).select(
            "worker_group", *[F.col(c).alias(f"{action}_{c}") for c in ("p50_ms", "p95_ms", "p99_ms", "max_ms")]
        )
        totals = totals.join(side, "worker_group", "left")
    return totals
