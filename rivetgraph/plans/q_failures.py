"""AG-08 … AG-13, AG-26, AG-28, WN-01, WN-02, WN-13, JN-12, JN-13, SNK-05, SNK-07, SNK-08."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivetgraph import session
from rivetgraph.functions.logtext import gzip_text
from rivetgraph.operators import failures as fail, logs
from rivetgraph.plans.flagship import report
from rivetgraph.plans.registry import query
from rivetgraph.plans.views import attempt_order
from rivetgraph.sources.documents import snapshots

CAP = 3

SUSPECTS = """
SELECT job_id, worker_id AS suspected_worker FROM (
  SELECT job_id, worker_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY job_id) AS total
  FROM retried_failures WHERE error_category IN ('transient', 'disk_full') AND worker_id <> '' GROUP BY job_id, worker_id)
WHERE total >= 3 AND n * 2 > total"""

PLACED = f"""
SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ended_at, claim_id) - 1 AS place, count(*) OVER (PARTITION BY job_id) AS n FROM retried_failures"""

CAPPED = f"""
SELECT job_id, CAST(place AS INTEGER) AS place, drv_hash, drv_name, error_category, error_message, CASE WHEN place < 2 THEN log_tail END AS log_tail, worker_id
FROM placed WHERE place < {CAP}
UNION ALL SELECT DISTINCT job_id, {CAP}, CAST(NULL AS BIGINT), '<truncated>', 'propagated_failure', (n - {CAP}) || ' additional failures truncated from snapshot', NULL, NULL FROM placed WHERE n > {CAP}"""

VIEWS = {"suspects": SUSPECTS, "placed": PLACED, "capped": CAPPED}


def capped(t):
    return fail.capped_failures(t.retried_failures, attempt_order(), cap=CAP, tails=2)


def stored_jobs(t):
    """jobs with their terminal snapshots as JSON."""
    counts = t.retried.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("done"), F.count_if(~F.col("success")).alias("failed")
    )
    counts = counts.withColumns({"pending": F.lit(0), "building": F.lit(0)})
    jobs = t.jobs.where(F.col("done_at").isNotNull()).withColumn("eval_error", F.lit(None).cast("string"))
    # list, overflow and suspicion each read the failures
    own = session.cut(t.retried_failures)
    snaps = fail.terminal_snapshots(jobs, counts, own, attempt_order(), cap=CAP, tails=2)
    return t.jobs.join(snaps, "job_id", "left")


SUMMARY = """
SELECT j.job_id, j.external_ref, j.status, j.done_at,
       coalesce(array_to_string((list(c.drv_name ORDER BY c.place) FILTER (c.error_category <> 'propagated_failure'))[1:3], '|'), '') AS originating_failures,
       CAST(count(*) FILTER (c.error_category <> 'propagated_failure') AS INTEGER) AS originating_failures_total,
       CAST(count(*) FILTER (c.error_category = 'propagated_failure') AS INTEGER) AS propagated_failures
FROM jobs j LEFT JOIN capped c ON c.job_id = j.job_id AND j.done_at IS NOT NULL GROUP BY j.job_id, j.external_ref, j.status, j.done_at"""


@query(
    "flagship_failed_jobs_report",
    """SELECT j.job_id, j.external_ref, j.status, j.done_at, CAST(any_value(p.n) AS INTEGER) AS originating_failures_total,
              CASE WHEN any_value(p.n) IS NOT NULL THEN CAST(coalesce(any_value(x.n), 0) AS INTEGER) END AS propagated_failures,
              string_agg(p.drv_name, ', ' ORDER BY p.place) FILTER (p.place < 3) AS originating_failures, any_value(s.suspected_worker) AS suspected_worker
       FROM jobs j LEFT JOIN placed p USING (job_id) LEFT JOIN suspects s USING (job_id) LEFT JOIN spoilt x USING (job_id)
       WHERE j.status = 'failed' GROUP BY j.job_id, j.external_ref, j.status, j.done_at""",
    **VIEWS,
    tried="SELECT DISTINCT job_id, drv_hash FROM retried",
    waiting="SELECT DISTINCT t.job_id, e.src AS node FROM tried t JOIN edges e ON e.dst = t.drv_hash ANTI JOIN tried x ON x.job_id = t.job_id AND x.drv_hash = e.src",
    reached="SELECT job_id, drv_hash AS node FROM retried_failures UNION SELECT r.job_id, w.node FROM reached r JOIN edges e ON e.dst = r.node JOIN waiting w ON w.job_id = r.job_id AND w.node = e.src",
    spoilt="SELECT job_id, count(*) AS n FROM reached JOIN waiting USING (job_id, node) GROUP BY job_id",
)
def _(t):
    return report(t)


@query("ag_08_job_summary", "SELECT * FROM summary", summary=SUMMARY, **VIEWS)
def _(t):
    return fail.summarise_jobs(snapshots(stored_jobs(t)))


@query("ag_09_suspected_worker", "SELECT * FROM suspects", **VIEWS)
def _(t):
    return fail.suspected_workers(t.retried_failures)


@query(
    "ag_10_failure_first_wins",
    "SELECT job_id, drv_hash, claim_id, error_category FROM retried_failures",
)
def _(t):
    return t.retried_failures.select("job_id", "drv_hash", "claim_id", "error_category")


@query("ag_11_capped_failures", "SELECT * FROM capped", **VIEWS)
def _(t):
    return capped(t).drop("propagated_from")


@query(
    "ag_11_live_failures",
    "SELECT job_id, CAST(place AS INTEGER) AS place, drv_hash, log_tail FROM placed WHERE place < 500",
    **VIEWS,
)
def _(t):
    live = fail.capped_failures(t.retried_failures, attempt_order(), marker=False)
    return live.select("job_id", "place", "drv_hash", "log_tail")


@query(
    "ag_13_terminal_snapshot",
    f"""SELECT j.job_id, j.status, true AS sealed, coalesce(any_value(a.total), 0) AS total, coalesce(any_value(a.failed), 0) AS failed,
               count(c.drv_name) AS listed, any_value(s.suspected_worker) AS suspected, CAST(count(c.log_tail) AS BIGINT) AS tails
        FROM jobs j LEFT JOIN capped c USING (job_id) LEFT JOIN suspects s USING (job_id)
        LEFT JOIN (SELECT job_id, count(*) AS total, count(*) FILTER (NOT success) AS failed FROM retried GROUP BY ALL) a USING (job_id)
        WHERE j.done_at IS NOT NULL GROUP BY j.job_id, j.status""",
    **VIEWS,
)
def _(t):
    s = snapshots(stored_jobs(t).where(F.col("done_at").isNotNull())).select("job_id", "snapshot.*")
    return s.select(
        "job_id",
        "status",
        "sealed",
        "counts.total",
        "counts.failed",
        F.array_size("failures").cast("bigint").alias("listed"),
        F.col("suspected_worker_infra").alias("suspected"),
        F.array_size(F.filter("failures.log_tail", lambda x: x.isNotNull())).cast("bigint").alias("tails"),
    )


@query(
    "wn_01_job_listing",
    """WITH page AS (SELECT * FROM jobs WHERE status = 'failed' AND done_at < TIMESTAMP '1998-01-01' ORDER BY done_at DESC, job_id LIMIT 51)
       SELECT job_id, CAST(place AS INTEGER) AS place, done_at, CASE WHEN n > 50 THEN min(done_at) OVER () END AS next_cursor
       FROM (SELECT *, row_number() OVER (ORDER BY done_at DESC, job_id) AS place, count(*) OVER () AS n FROM page) WHERE place <= 50""",
)
def _(t):
    page = fail.list_jobs(t.jobs, "failed", cursor=F.lit("1998-01-01").cast("timestamp"))
    return page.select("job_id", "place", "done_at", "next_cursor")


@query(
    "wn_01_job_listing_since",
    """WITH page AS (SELECT * FROM jobs WHERE status = 'done' AND done_at IS NOT NULL ORDER BY done_at DESC, job_id LIMIT 201),
            late AS (SELECT *, row_number() OVER (ORDER BY done_at DESC, job_id) AS place, count(*) OVER () AS n FROM page WHERE done_at >= TIMESTAMP '2000-06-01')
       SELECT job_id, CAST(place AS INTEGER) AS place, done_at, CASE WHEN n > 200 THEN min(done_at) OVER () END AS next_cursor FROM late WHERE place <= 200""",
)
def _(t):
    page = fail.list_jobs(t.jobs, "done", since=F.lit("2000-06-01").cast("timestamp"), limit=1000)
    return page.select("job_id", "place", "done_at", "next_cursor")


@query(
    "wn_02_recent_failures",
    "SELECT * FROM summary WHERE status = 'failed' ORDER BY done_at DESC, job_id LIMIT 5",
    summary=SUMMARY,
    **VIEWS,
)
def _(t):
    recent = t.jobs.where(F.col("status") == "failed").orderBy(F.col("done_at").desc(), "job_id").limit(5)
    mine = fail.capped_failures(
        t.retried_failures.join(recent.select("job_id"), "job_id", "left_semi"), attempt_order(), cap=CAP, tails=2
    )
    snap = F.struct("failures").alias("snapshot")
    return fail.summarise_jobs(recent.join(fail.failure_arrays(mine), "job_id", "left").select("*", snap))


@query(
    "wn_13_slowest_builds",
    """SELECT drv_hash AS job_id, claim_id, duration_ms, CAST(row_number() OVER (PARTITION BY drv_hash ORDER BY duration_ms DESC, claim_id) AS INTEGER) AS place,
              row_number() OVER (PARTITION BY drv_hash ORDER BY duration_ms DESC, claim_id) <= 3 AS shown FROM retried WHERE success QUALIFY place <= 8""",
)
def _(t):
    done = t.retried.where("success").select(F.col("drv_hash").alias("job_id"), "claim_id", "duration_ms")
    return fail.slowest_builds(done)


@query(
    "ag_26_retry_tallies",
    """SELECT job_id, count(*) FILTER (error_category IN ('transient', 'disk_full')) AS transient_retries, count(*) FILTER (exit_code IS NULL AND open) AS propagated_failed
       FROM retried GROUP BY ALL""",
)
def _(t):
    outcome = (
        F.when(F.col("error_category").isin("transient", "disk_full"), "flaky_retry")
        .when(F.col("exit_code").isNull() & F.col("open"), "propagated")
        .otherwise("other")
    )
    return fail.retry_tallies(t.retried.select("job_id", outcome.alias("outcome")))


@query(
    "ag_28_run_summary",
    """SELECT j.job_id, CASE j.status WHEN 'done' THEN 'SUCCEEDED' WHEN 'failed' THEN 'FAILED' WHEN 'cancelled' THEN 'CANCELLED' END AS label,
              coalesce(c.total, 0) AS total, coalesce(c.done, 0) AS done, coalesce(c.failed, 0) AS failed, coalesce(f.orig, 0) AS originating,
              coalesce(c.retries, 0) AS transient_retries, coalesce(f.prop, 0) AS propagated, f.preview AS propagated_preview, greatest(0, coalesce(f.prop, 0) - 2) AS propagated_more
       FROM jobs j LEFT JOIN (SELECT job_id, count(*) AS total, count(*) FILTER (success) AS done, count(*) FILTER (NOT success) AS failed,
                                     count(*) FILTER (error_category IN ('transient', 'disk_full')) AS retries FROM retried GROUP BY ALL) c USING (job_id)
       LEFT JOIN (SELECT job_id, count(*) FILTER (cat <> 'propagated_failure') AS orig, count(*) FILTER (cat = 'propagated_failure') AS prop,
                         array_to_string((list(drv_name ORDER BY ended_at, claim_id) FILTER (cat = 'propagated_failure'))[1:2], ', ') AS preview
                  FROM (SELECT *, CASE WHEN error_category = 'disk_full' THEN 'propagated_failure' ELSE error_category END AS cat FROM retried_failures) GROUP BY ALL) f USING (job_id)""",
)
def _(t):
    counts = t.retried.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("done"), F.count_if(~F.col("success")).alias("failed")
    )
    tallies = t.retried.groupBy("job_id").agg(
        F.count_if(F.col("error_category").isin("transient", "disk_full")).alias("transient_retries")
    )
    cat = F.when(F.col("error_category") == "disk_full", "propagated_failure").otherwise(F.col("error_category"))
    marked = t.retried_failures.withColumn("error_category", cat)
    return fail.run_summary(t.jobs, counts, marked, tallies, attempt_order(), preview=2)


# Two runs per customer: even and odd orders play run A and run B of the same work.
PAIRS = {
    "runs": """
SELECT o.o_custkey AS pair_id, o.o_orderkey % 2 AS side, f.drv_hash, f.drv_name, f.error_category, f.ended_at, f.claim_id
FROM orders o JOIN retried_failures f ON f.job_id = o.o_orderkey""",
    "first_runs": "SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY pair_id, side, drv_hash ORDER BY ended_at, claim_id) = 1",
    "findings": """
SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.drv_hash, b.drv_hash) AS drv_hash, coalesce(a.drv_name, b.drv_name) AS drv_name,
       a.error_category AS category_a, b.error_category AS category_b,
       CASE WHEN b.drv_hash IS NULL THEN 'only_in_a' WHEN a.drv_hash IS NULL THEN 'only_in_b' WHEN a.error_category <> b.error_category THEN 'category_mismatch' ELSE 'same' END AS finding
FROM (SELECT * FROM first_runs WHERE side = 0) a FULL JOIN (SELECT * FROM first_runs WHERE side = 1) b ON a.pair_id = b.pair_id AND a.drv_hash = b.drv_hash""",
    "pairs": """
SELECT o_custkey AS pair_id, min(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END) AS status_a, min(CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END) AS status_b,
       count(*) FILTER (o_orderkey % 2 = 0) AS total_a, count(*) FILTER (o_orderkey % 2 = 1) AS total_b,
       count(*) FILTER (o_orderkey % 2 = 0 AND o_orderstatus = 'O') AS done_a, count(*) FILTER (o_orderkey % 2 = 1 AND o_orderstatus = 'O') AS done_b,
       count(*) FILTER (o_orderkey % 2 = 0 AND o_orderstatus = 'F') AS failed_a, count(*) FILTER (o_orderkey % 2 = 1 AND o_orderstatus = 'F') AS failed_b,
       count(*) FILTER (o_orderkey % 2 = 0 AND o_orderstatus = 'P') AS pending_a, count(*) FILTER (o_orderkey % 2 = 1 AND o_orderstatus = 'P') AS pending_b
FROM orders GROUP BY ALL""",
    "report": """
SELECT p.pair_id, p.status_a IS DISTINCT FROM p.status_b AS status_mismatch, total_b - total_a AS total_delta, pending_b - pending_a AS pending_delta, CAST(0 AS BIGINT) AS building_delta,
       done_b - done_a AS done_delta, failed_b - failed_a AS failed_delta, coalesce(xa, 0) AS n_only_in_a, coalesce(xb, 0) AS n_only_in_b, coalesce(xm, 0) AS n_category_mismatch,
       CASE WHEN p.status_a IS DISTINCT FROM p.status_b THEN 'critical' WHEN coalesce(xa, 0) > 0 OR coalesce(xb, 0) > 0 THEN 'major'
            WHEN coalesce(xm, 0) > 0 OR done_b <> done_a OR failed_b <> failed_a THEN 'minor' ELSE 'matched' END AS severity
FROM pairs p LEFT JOIN (SELECT pair_id, count(*) FILTER (finding = 'only_in_a') AS xa, count(*) FILTER (finding = 'only_in_b') AS xb, count(*) FILTER (finding = 'category_mismatch') AS xm
                        FROM findings GROUP BY ALL) f USING (pair_id)""",
}


def findings(t):
    keys = t.raw("orders").select(F.col("o_custkey").alias("pair_id"), F.col("o_orderkey").alias("job_id"))
    rows = t.retried_failures.join(keys, "job_id").withColumn("side", F.col("job_id") % 2)
    first = fail.first_per_key(rows, ["pair_id", "side", "drv_hash"], attempt_order())
    return fail.compare_runs(first.where(F.col("side") == 0), first.where(F.col("side") == 1))


@query("jn_13_run_comparison_findings", "SELECT * FROM findings", **PAIRS)
def _(t):
    return findings(t)


def comparison(t):
    even = F.col("o_orderkey") % 2 == 0
    status = F.col("o_orderstatus")
    aggs = []
    for side, mine in (("a", even), ("b", ~even)):
        aggs += [
            F.min(F.when(mine, status)).alias(f"status_{side}"),
            F.count_if(mine).alias(f"total_{side}"),
            F.count_if(mine & (status == "O")).alias(f"done_{side}"),
            F.count_if(mine & (status == "F")).alias(f"failed_{side}"),
            F.count_if(mine & (status == "P")).alias(f"pending_{side}"),
            F.count_if(mine & status.isNull()).alias(f"building_{side}"),
            F.min(F.lit(None).cast("string")).alias(f"suspected_{side}"),
        ]
    pairs = t.raw("orders").groupBy(F.col("o_custkey").alias("pair_id")).agg(*aggs)
    return fail.comparison_report(pairs, findings(t))


@query("jn_13_run_comparison_report", "SELECT *, severity = 'matched' AS matched, false AS new_suspicion FROM report", **PAIRS)
def _(t):
    return comparison(t)


@query("snk_08_json_report", "SELECT pair_id, severity, n_only_in_a FROM report", **PAIRS)
def _(t):
    path = session.table_path(t.spark, "comparison-report")
    comparison(t).write.json(path)
    return t.spark.read.schema("pair_id BIGINT, severity STRING, n_only_in_a BIGINT").json(path)


# Logs per supplier, so that names repeat inside a job: names are taken from brands.
NAMED = """
SELECT l_suppkey AS job_id, l_partkey AS drv_hash, CASE l_partkey % 4 WHEN 0 THEN 'gcc' WHEN 1 THEN 'gcc-2' WHEN 2 THEN 'lib/x' ELSE '..' END AS drv_name, min(l_orderkey) AS ord
FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL"""


def named_failures(t):
    k = F.col("l_partkey") % 4
    name = F.when(k == 0, "gcc").when(k == 1, "gcc-2").when(k == 2, "lib/x").otherwise("..")
    rows = (
        t.raw("lineitem")
        .where(F.col("l_returnflag") == "R")
        .groupBy(F.col("l_suppkey").alias("job_id"), F.col("l_partkey").alias("drv_hash"), name.alias("drv_name"))
        .agg(F.min("l_orderkey").alias("ord"))
    )
    return rows.withColumns({"error_category": F.lit("build_failure"), "place": F.struct("ord", "drv_hash")})


# Names one by one: the first of ``base``, ``base-2``, … that the job has not used.
NAMES = {
    "named": NAMED,
    "in_order": "SELECT *, replace(CASE WHEN drv_name IN ('', '.', '..') THEN '_' ELSE drv_name END, '/', '_') AS base, row_number() OVER (PARTITION BY job_id ORDER BY ord, drv_hash) AS n FROM named",
    "taking": """
SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS drv_hash, CAST(NULL AS VARCHAR) AS drv_name, CAST(NULL AS VARCHAR) AS file_name, CAST([] AS VARCHAR[]) AS taken FROM in_order
UNION ALL
SELECT job_id, n, drv_hash, drv_name, pick, list_append(taken, pick) FROM (
  SELECT r.job_id, r.n, r.drv_hash, r.drv_name, t.taken, list_filter(
           list_transform(range(1, len(list_filter(t.taken, lambda x: starts_with(x, r.base))) + 2), lambda i: r.base || CASE WHEN i = 1 THEN '' ELSE '-' || i END || '.log'),
           lambda x: NOT list_contains(t.taken, x))[1] AS pick
  FROM taking t JOIN in_order r ON r.job_id = t.job_id AND r.n = t.n + 1)""",
}


@query("snk_07_unique_filename", "SELECT job_id, drv_hash, drv_name, file_name FROM taking WHERE n > 0", **NAMES)
def _(t):
    return logs.export_names(named_failures(t)).select("job_id", "drv_hash", "drv_name", "file_name")


@query(
    "jn_12_failure_newest_log",
    """WITH newest AS (SELECT * FROM build_logs QUALIFY row_number() OVER (PARTITION BY job_id, drv_hash ORDER BY attempt DESC, claim_id DESC) = 1),
            wanted AS (SELECT f.job_id, f.claim_id, s.src AS drv_hash, CASE WHEN f.claim_id < 'a' THEN f.log_tail END AS log_tail FROM retried_failures f, LATERAL (SELECT ['src0', 'src1', 'src2', 'src3', 'src4'][1 + f.drv_hash % 5] AS src) s)
       SELECT w.claim_id AS failure, w.job_id, CASE WHEN n.claim_id IS NOT NULL THEN 'archive' WHEN w.log_tail IS NOT NULL THEN 'tail' ELSE 'none' END AS log_source,
              md5(CASE WHEN n.claim_id IS NOT NULL THEN n.text ELSE coalesce(w.log_tail, '[log not available: no archived log and no inline log_tail]') END) AS content_md5
       FROM wanted w LEFT JOIN newest n ON n.job_id = w.job_id AND n.drv_hash = w.drv_hash""",
)
def _(t):
    source = F.concat(F.lit("src"), (F.col("drv_hash") % 5).cast("string"))
    failures = t.retried_failures.select(
        F.col("claim_id").alias("failure"),
        "job_id",
        source.alias("drv_hash"),
        F.when(F.col("claim_id") < "a", F.col("log_tail")).alias("log_tail"),
        "propagated_from",
    )
    out = logs.failure_logs(failures, t.build_logs.select("job_id", "drv_hash", "attempt", "claim_id", "text"))
    return out.select("failure", "job_id", "log_source", F.md5("content").alias("content_md5"))


# Failures of suppliers below 100 have archived logs under their job; every fifth of the others has a tail.
@query(
    "snk_05_failure_log_export",
    """WITH newest AS (SELECT * FROM build_logs QUALIFY row_number() OVER (PARTITION BY job_id, drv_hash ORDER BY attempt DESC, claim_id DESC) = 1)
       SELECT t.job_id, t.file_name, md5(coalesce(n.text, CASE WHEN t.drv_hash % 5 = 0 THEN 'tail of ' || t.drv_hash END,
              '[log not available: no archived log and no inline log_tail]')) AS content_md5
       FROM taking t LEFT JOIN newest n ON n.job_id = t.job_id AND n.drv_hash = 'src' || (t.drv_hash % 40) WHERE t.n > 0""",
    **NAMES,
)
def _(t):
    named = logs.export_names(named_failures(t))
    archive = t.build_logs.select("job_id", "drv_hash", "attempt", "claim_id", gzip_text("text").alias("log_gz"))
    failures = named.select(
        "job_id",
        F.concat(F.lit("src"), (F.col("drv_hash") % 40).cast("string")).alias("drv_hash"),
        "file_name",
        F.lit(None).cast("bigint").alias("propagated_from"),
        F.when(F.col("drv_hash") % 5 == 0, F.concat(F.lit("tail of "), F.col("drv_hash").cast("string"))).alias("log_tail"),
    )
    path = session.table_path(t.spark, "failure-logs")
    logs.export_failure_logs(logs.failure_logs(failures, archive), path)
    back = t.spark.read.schema("job_id BIGINT, file_name STRING, content STRING").parquet(path)
    return back.select("job_id", "file_name", F.md5("content").alias("content_md5"))
