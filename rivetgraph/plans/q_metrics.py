"""AG-19 … AG-24, AG-27."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivetgraph import params as P
from rivetgraph.operators import metrics
from rivetgraph.operators.ingest import cache_hits
from rivetgraph.plans.registry import query
from rivetgraph.plans.views import MEASURED_LOGS


def hist_sql(rows: str, value: str, family: str, labels: str = "") -> str:
    bounds = ", ".join(f"(CAST({float(b)!r} AS DOUBLE))" for b in P.BUCKETS[family])
    key = f"{labels}, " if labels else ""
    return f"""SELECT {key}le, count(*) FILTER (le IS NULL OR {value} <= le) AS cumulative, round(CAST(sum({value}) AS DOUBLE), 4) AS total_sum, count(*) AS total_count
FROM {rows}, (SELECT * FROM (VALUES {bounds}, (NULL)) AS b(le)) GROUP BY ALL"""


def hist(*args):
    """Sums of doubles depend on their order in the last digits."""
    return metrics.histogram(*args).withColumn("total_sum", F.round("total_sum", 4))


@query(
    "ag_19_labelled_counters",
    """SELECT 'builds' AS family, CASE WHEN success THEN 'success' WHEN error_category = 'build_failure' THEN 'failure' ELSE 'flaky_retry' END AS label, count(*) AS value FROM attempts GROUP BY ALL
       UNION ALL SELECT 'jobs', status, count(*) FROM jobs WHERE status <> 'pending' GROUP BY ALL""",
)
def _(t):
    outcome = (
        F.when(F.col("success"), "success").when(F.col("error_category") == "build_failure", "failure").otherwise("flaky_retry")
    )
    builds = metrics.counter(t.attempts.select(F.lit("builds").alias("family"), outcome.alias("label")), "family", "label")
    ended = t.jobs.where(F.col("status") != "pending").select(F.lit("jobs").alias("family"), F.col("status").alias("label"))
    return builds.unionByName(metrics.counter(ended, "family", "label"))


@query("ag_20_build_duration_histogram", hist_sql("attempts", "(duration_ms / 1000.0)", "build_duration_seconds", "success"))
def _(t):
    return hist(
        t.attempts, F.col("duration_ms") / 1000, P.BUCKETS["build_duration_seconds"], ["success"]
    )


@query("ag_20_ingest_batch_histogram", hist_sql("(SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL)", "n", "ingest_batch_drvs"))
def _(t):
    sizes = t.raw("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return hist(sizes, F.col("n"), P.BUCKETS["ingest_batch_drvs"])


@query(
    "ag_20_log_bytes_histogram",
    hist_sql("(SELECT job_id, sum(original_size) AS n FROM build_logs GROUP BY ALL)", "n", "log_bytes_per_job"),
    build_logs=MEASURED_LOGS,
)
def _(t):
    sizes = t.measured_logs.groupBy("job_id").agg(F.sum("original_size").alias("n"))
    return hist(sizes, F.col("n"), P.BUCKETS["log_bytes_per_job"])


@query(
    "ag_20_drvs_per_job_histogram",
    hist_sql("(SELECT job_id, count(*) AS n FROM members GROUP BY ALL)", "n", "drvs_per_job"),
)
def _(t):
    return hist(
        t.members.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")), F.col("n"), P.BUCKETS["drvs_per_job"]
    )


@query("ag_20_claim_age_histogram", hist_sql("attempts", "(duration_ms * 60 / 1000.0)", "claim_age_seconds"))
def _(t):
    return hist(t.attempts, F.col("duration_ms") * 60 / 1000, P.BUCKETS["claim_age_seconds"])


@query(
    "ag_20_dispatch_wait_histogram",
    hist_sql("(SELECT *, CAST(CAST(round(value * 100) AS BIGINT) % 7000 AS DOUBLE) / 100 AS v FROM events)", "v", "dispatch_wait_seconds", "event_type"),
)
def _(t):
    v = (F.round(F.col("value") * 100).cast("bigint") % 7000).cast("double") / 100
    return hist(t.raw("events"), v, P.BUCKETS["dispatch_wait_seconds"], ["event_type"])


@query(
    "ag_20_request_latency_histogram",
    hist_sql("(SELECT *, CAST(event_id % 12000 AS DOUBLE) / 1000 AS v FROM events)", "v", "request_duration_seconds"),
)
def _(t):
    v = (F.col("event_id") % 12000).cast("double") / 1000
    return hist(t.raw("events"), v, P.BUCKETS["request_duration_seconds"])


@query(
    "ag_20_ingest_phase_histogram",
    hist_sql("(SELECT event_type AS phase, CAST(event_id % 1000 AS DOUBLE) / 100000 AS v FROM events)", "v", "ingest_phase_seconds", "phase"),
)
def _(t):
    rows = t.raw("events").select(
        F.col("event_type").alias("phase"), ((F.col("event_id") % 1000).cast("double") / 100000).alias("v")
    )
    return hist(rows, F.col("v"), P.BUCKETS["ingest_phase_seconds"], ["phase"])


def summary_sql(rows: str, value: str, labels: str) -> str:
    key = f"{labels}, " if labels else ""
    part = f"PARTITION BY {labels} " if labels else ""
    pick = lambda q: f"max(v) FILTER (rn = 1 + CAST(floor((n - 1) * {q} + 0.5) AS BIGINT))"
    return f"""SELECT {key}count(*) AS count, {pick(0.5)} AS p50_ms, {pick(0.95)} AS p95_ms, {pick(0.99)} AS p99_ms, max(v) AS max_ms, round(sum(v) / count(*), 6) AS mean_ms
FROM (SELECT *, row_number() OVER ({part}ORDER BY v) AS rn, count(*) OVER ({part}) AS n FROM (SELECT *, CAST({value} AS DOUBLE) AS v FROM {rows})) GROUP BY ALL"""


def rounded(df):
    return df.withColumn("mean_ms", F.round("mean_ms", 6))


@query("ag_21_exact_latency_summary", summary_sql("ev", "duration_ms", "kind"))
def _(t):
    return rounded(metrics.exact_summary(t.ev, F.col("duration_ms"), ["kind"]))


@query("ag_21_exact_latency_summary_all", summary_sql("attempts", "duration_ms", ""))
def _(t):
    return rounded(metrics.exact_summary(t.attempts, F.col("duration_ms")))


PER_WORKER = "SELECT worker_id, " + summary_sql("ev", "duration_ms", "worker_id, kind").split("SELECT worker_id, ", 1)[1]


@query(
    "ag_22_merge_summaries",
    """SELECT kind, CAST(sum(count) AS BIGINT) AS count, max(max_ms) AS max_ms, round(sum(p50_ms * count) / sum(count), 4) AS p50_ms, round(sum(p95_ms * count) / sum(count), 4) AS p95_ms,
              round(sum(p99_ms * count) / sum(count), 4) AS p99_ms, round(sum(mean_ms * count) / sum(count), 4) AS mean_ms FROM per_worker GROUP BY ALL""",
    per_worker=PER_WORKER,
)
def _(t):
    each = metrics.exact_summary(t.ev, F.col("duration_ms"), ["worker_id", "kind"])
    merged = metrics.merge_summaries(each, ["kind"])
    return merged.withColumns({c: F.round(c, 4) for c in ("p50_ms", "p95_ms", "p99_ms", "mean_ms")})


@query(
    "ag_23_histogram_quantile",
    "SELECT success, coalesce(min(le) FILTER (le IS NOT NULL), 'Infinity'::DOUBLE) AS quantile FROM hist WHERE cumulative >= total_count * 0.95 GROUP BY ALL",
    hist=hist_sql("attempts", "(duration_ms / 1000.0)", "build_duration_seconds", "success"),
)
def _(t):
    buckets = metrics.histogram(t.attempts, F.col("duration_ms") / 1000, P.BUCKETS["build_duration_seconds"], ["success"])
    return metrics.bucket_quantile(buckets, 0.95, ["success"])


@query(
    "ag_24_cache_hit_rate",
    """SELECT system, round(count(*) FILTER (f.output_path IS NOT NULL) * 1.0 / nullif(count(*), 0), 6) AS hit_rate
       FROM steps s LEFT JOIN failed_outputs f ON f.output_path = regexp_replace(s.drv_path, '(\\.drv)+$', '') AND f.expires_at > TIMESTAMP '1995-01-01' GROUP BY ALL""",
)
def _(t):
    marked = cache_hits(t.steps, t.failed_outputs, F.lit("1995-01-01").cast("timestamp"))
    per = marked.groupBy("system").agg(F.count_if("cached_failed").alias("hits"), F.count(F.lit(1)).alias("n"))
    return per.select("system", F.round(metrics.hit_rate(F.col("hits"), F.col("n")), 6).alias("hit_rate"))


@query(
    "ag_27_worker_report",
    """SELECT c.worker_group, c.ok AS claims_success, c.bad AS claims_empty, d.ok AS completes_ok, d.bad AS completes_err, c.p50_ms AS claim_p50_ms, c.p95_ms AS claim_p95_ms,
              c.p99_ms AS claim_p99_ms, c.max_ms AS claim_max_ms, d.p50_ms AS complete_p50_ms, d.p95_ms AS complete_p95_ms, d.p99_ms AS complete_p99_ms, d.max_ms AS complete_max_ms
       FROM (SELECT * FROM both_sides WHERE action = 'claim') c FULL JOIN (SELECT * FROM both_sides WHERE action = 'complete') d USING (worker_group)""",
    actions="SELECT seq % 8 AS worker_group, CASE kind WHEN 'drv_started' THEN 'claim' ELSE 'complete' END AS action, duration_ms > 5000 AS ok, duration_ms AS latency_ms FROM ev WHERE kind IN ('drv_started', 'drv_completed')",
    lat=summary_sql("actions", "latency_ms", "worker_group, action"),
    both_sides="SELECT l.*, a.ok, a.bad FROM lat l JOIN (SELECT worker_group, action, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS bad FROM actions GROUP BY ALL) a USING (worker_group, action)",
)
def _(t):
    actions = t.ev.where(F.col("kind").isin("drv_started", "drv_completed")).select(
        (F.col("seq") % 8).alias("worker_group"),
        F.when(F.col("kind") == "drv_started", "claim").otherwise("complete").alias("action"),
        (F.col("duration_ms") > 5000).alias("ok"),
        F.col("duration_ms").alias("latency_ms"),
    )
    return metrics.worker_report(actions)
