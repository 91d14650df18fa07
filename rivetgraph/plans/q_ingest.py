"""Ingest: JN-01 … JN-04, JN-17, AG-12, AG-15 … AG-18, WN-18, SNK-01 … SNK-03, SNK-09, SNK-10."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivetgraph import session
from rivetgraph.functions.times import plus_seconds
from rivetgraph.operators import ingest, lifecycle, logs
from rivetgraph.plans.q_sources import eval_text
from rivetgraph.plans.registry import query
from rivetgraph.sources.documents import eval_lines

# Batches: one per order; a row per attempt. Rows of a few suppliers are broken on
# purpose. Inputs are the step's edges in the layered graph, plus a bad path or a self
# loop for some.
ROWS = """
SELECT a.job_id, a.job_id AS batch_id, a.claim_id AS pos, s.drv_hash AS node, ended_at AS arrived_at,
       CASE WHEN duration_ms % 7000 = 0 THEN '' ELSE drv_path END AS drv_path, drv_name, system,
       split_part(drv_path, '/', -1) AS drv_hash,
       CASE WHEN duration_ms % 7000 = 0 THEN 'empty_field' END AS reject_reason
FROM attempts a JOIN steps s ON a.drv_hash = s.drv_hash"""

FIRSTS = "SELECT drv_hash, min((batch_id, pos)) AS born FROM ingest_rows WHERE reject_reason IS NULL GROUP BY ALL"

INPUTS = """
SELECT r.job_id, r.batch_id, r.pos, r.drv_hash AS src, r.system, x.dep_path,
       CASE WHEN split_part(x.dep_path, '/', -1) LIKE '%.drv' AND contains(split_part(x.dep_path, '/', -1), '-') THEN split_part(x.dep_path, '/', -1) END AS dst,
       CASE x.kind WHEN 'bad' THEN 'bad_path' WHEN 'self' THEN 'self_loop' END AS edge_error
FROM ingest_rows r JOIN (
  SELECT e.src AS node, d.drv_path AS dep_path, 'edge' AS kind FROM edges e JOIN steps d ON e.dst = d.drv_hash
  UNION ALL SELECT drv_hash, 'nodrv', 'bad' FROM steps WHERE drv_hash % 10 = 3
  UNION ALL SELECT drv_hash, drv_path, 'self' FROM steps WHERE drv_hash % 10 = 7
  UNION ALL SELECT drv_hash, '/nix/store/new-' || (drv_hash % 8) || '.drv', 'edge' FROM steps WHERE drv_hash % 10 = 9
) x ON x.node = r.node WHERE r.reject_reason IS NULL"""

VIEWS = {"ingest_rows": ROWS, "firsts": FIRSTS, "inputs": INPUTS}


def wire_rows(t):
    """Ingest rows with wire columns, unchecked."""
    p = F.col("drv_hash")
    named = t.steps.select("drv_hash", "drv_path", "drv_name", "system", "required_features")
    dep = t.steps.select(p.alias("dst"), F.col("drv_path").alias("dep_path"))
    real = t.edges.join(dep, "dst").groupBy(F.col("src").alias("drv_hash")).agg(F.collect_list("dep_path").alias("deps"))
    odd = F.array(
        F.when(p % 10 == 3, F.lit("nodrv")),
        F.when(p % 10 == 7, F.col("drv_path")),
        F.when(p % 10 == 9, F.concat(F.lit("/nix/store/new-"), (p % 8).cast("string"), F.lit(".drv"))),
    )
    none = F.array().cast("array<string>")
    described = named.join(real, "drv_hash", "left").withColumn(
        "input_drvs", F.concat(F.coalesce("deps", none), F.filter(odd, lambda d: d.isNotNull()))
    )
    rows = t.attempts.select("job_id", "drv_hash", "claim_id", "ended_at", "duration_ms").join(described, "drv_hash")
    return rows.select(
        "job_id",
        F.col("job_id").alias("batch_id"),
        F.col("claim_id").alias("pos"),
        F.col("ended_at").alias("arrived_at"),
        F.when(F.col("duration_ms") % 7000 == 0, "").otherwise(F.col("drv_path")).alias("drv_path"),
        "drv_name",
        "system",
        "required_features",
        "input_drvs",
        F.lit(None).cast("string").alias("attr"),
    )


def checked_rows(t):
    return ingest.with_reject_reason(wire_rows(t))


def good_rows(t):
    return checked_rows(t).where(F.col("reject_reason").isNull())


@query(
    "jn_01_cache_hits",
    """SELECT drv_hash, EXISTS (SELECT 1 FROM failed_outputs f WHERE f.output_path = regexp_replace(s.drv_path, '(\\.drv)+$', '')
              AND f.expires_at > TIMESTAMP '1995-01-01') AS cached_failed FROM steps s""",
)
def _(t):
    as_of = F.lit("1995-01-01").cast("timestamp")
    return ingest.cache_hits(t.steps, t.failed_outputs, as_of).select("drv_hash", "cached_failed")


@query("jn_02_registry_dedup", "SELECT drv_hash, born[1] AS batch_id, born[2] AS pos FROM firsts", **VIEWS)
def _(t):
    return ingest.registry(good_rows(t)).select("drv_hash", "batch_id", "pos")


# A batch's job lives from its first row to 1 to 40 days after its last one.
@query(
    "jn_02_registry_dedup_live",
    """SELECT drv_hash, min((batch_id, pos))[1] AS batch_id, min((batch_id, pos))[2] AS pos FROM good JOIN islands USING (drv_hash, batch_id) GROUP BY drv_hash, n""",
    **VIEWS,
    good="SELECT * FROM ingest_rows WHERE reject_reason IS NULL",
    lives="SELECT batch_id, min(arrived_at) AS a, max(arrived_at) + to_days(CAST(1 + batch_id % 40 AS INTEGER)) AS b FROM good GROUP BY batch_id",
    holds="SELECT DISTINCT drv_hash, batch_id, a, b FROM good JOIN lives USING (batch_id)",
    islands="""
SELECT drv_hash, batch_id, sum(opens) OVER (PARTITION BY drv_hash ORDER BY a, b, batch_id ROWS UNBOUNDED PRECEDING) AS n FROM (
  SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY drv_hash ORDER BY a, b, batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM holds)""",
)
def _(t):
    rows = session.cut(good_rows(t).select("batch_id", "pos", "arrived_at", "drv_hash"))
    job = F.col("batch_id").alias("job_id")
    jobs = rows.groupBy(job).agg(F.min("arrived_at").alias("created_at"), F.max("arrived_at").alias("last"))
    jobs = jobs.withColumn("done_at", plus_seconds(F.col("last"), (1 + F.col("job_id") % 40) * 86_400))
    live = ingest.liveness(rows.select(job, "drv_hash"), jobs)
    return ingest.registry(rows, live).select("drv_hash", "batch_id", "pos")


@query("jn_03_edge_wiring", "SELECT DISTINCT src, dst FROM inputs WHERE edge_error IS NULL", **VIEWS)
def _(t):
    return ingest.wire_edges(ingest.exploded_inputs(good_rows(t)))


@query(
    "jn_03_placeholders",
    """SELECT dst AS drv_hash, dep_path AS drv_path, substr(regexp_replace(dst, '(\\.drv)+$', ''), instr(dst, '-') + 1) AS drv_name, system
       FROM inputs WHERE edge_error IS NULL AND dst NOT IN (SELECT drv_hash FROM firsts)
       QUALIFY row_number() OVER (PARTITION BY dst ORDER BY batch_id, pos, src) = 1""",
    **VIEWS,
)
def _(t):
    rows = good_rows(t)
    return ingest.placeholders(ingest.exploded_inputs(rows), ingest.registry(rows))


@query(
    "jn_04_membership",
    "SELECT job_id, drv_hash FROM ingest_rows WHERE reject_reason IS NULL UNION SELECT job_id, dst FROM inputs WHERE edge_error IS NULL",
    **VIEWS,
)
def _(t):
    rows = good_rows(t)
    return ingest.membership(rows, ingest.exploded_inputs(rows))


@query(
    "jn_17_late_batches",
    """SELECT claim_id, CASE WHEN j.job_id IS NULL THEN 'unknown_job' WHEN a.ended_at >= j.done_at THEN 'terminal'
              WHEN j.sealed AND a.ended_at >= j.created_at + to_hours(12) THEN 'sealed' END AS late_reason
       FROM attempts a LEFT JOIN jobs j ON a.job_id = j.job_id AND j.job_id % 17 <> 0""",
)
def _(t):
    jobs = t.jobs.where(F.col("job_id") % 17 != 0).withColumn(
        "sealed_at", F.when(F.col("sealed"), plus_seconds(F.col("created_at"), 12 * 3600))
    )
    batches = t.attempts.select("claim_id", "job_id", F.col("ended_at").alias("arrived_at"))
    return ingest.late_batches(batches, jobs).select("claim_id", "late_reason")


@query(
    "ag_12_eval_error_cap",
    """WITH once AS (SELECT job_id, attr, min(ord) AS ord FROM eval_errors GROUP BY ALL)
       SELECT job_id, attr, CAST(row_number() OVER (PARTITION BY job_id ORDER BY ord, attr) AS INTEGER) AS place, 'error of ' || attr AS error
       FROM once QUALIFY place <= 20
       UNION ALL SELECT job_id, '<truncated>', 21, 'cap of 20 eval errors reached' FROM once GROUP BY job_id HAVING count(*) > 20""",
    eval_errors="SELECT l_suppkey AS job_id, 'attr-' || (l_partkey % 40) AS attr, (l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS ord FROM lineitem WHERE l_returnflag = 'R'",
)
def _(t):
    attr = F.concat(F.lit("attr-"), (F.col("l_partkey") % 40).cast("string"))
    errors = (
        t.raw("lineitem")
        .where(F.col("l_returnflag") == "R")
        .select(
            F.col("l_suppkey").alias("job_id"),
            attr.alias("attr"),
            F.concat(F.lit("error of "), attr).alias("error"),
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("ord"),
        )
    )
    return ingest.capped_eval_errors(errors, cap=20)


@query(
    "ag_15_job_size",
    "SELECT l_suppkey AS job_id, count(DISTINCT l_partkey) AS members, count(DISTINCT l_partkey) >= 440 AS oversized FROM lineitem GROUP BY ALL",
)
def _(t):
    members = t.raw("lineitem").select(F.col("l_suppkey").alias("job_id"), F.col("l_partkey").alias("drv_hash")).distinct()
    return ingest.job_sizes(members, warn_at=440)


BATCH_SIZES = """
SELECT l_suppkey AS job_id, l_orderkey AS batch_id, count(*) AS incoming, count(*) - count(DISTINCT l_partkey % 5) AS released
FROM lineitem GROUP BY ALL"""


@query(
    "ag_16_cap_reservation",
    """WITH run AS (SELECT *, incoming + coalesce(sum(incoming - released) OVER (PARTITION BY job_id ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reserved FROM sizes),
            over_cap AS (SELECT job_id, min(batch_id) AS first_over FROM run WHERE reserved > 300 GROUP BY ALL)
       SELECT r.job_id, r.batch_id, incoming, released, CAST(reserved AS BIGINT) AS reserved,
              CASE WHEN batch_id = first_over THEN 'eval_too_large' WHEN batch_id > first_over THEN 'job_already_failed' ELSE 'accepted' END AS verdict
       FROM run r LEFT JOIN over_cap o USING (job_id)""",
    sizes=BATCH_SIZES,
)
def _(t):
    sizes = (
        t.raw("lineitem")
        .groupBy(F.col("l_suppkey").alias("job_id"), F.col("l_orderkey").alias("batch_id"))
        .agg(
            F.count(F.lit(1)).alias("incoming"),
            (F.count(F.lit(1)) - F.count_distinct(F.col("l_partkey") % 5)).alias("released"),
        )
    )
    return ingest.cap_reservation(sizes, cap=300)


ACCOUNTS = """
SELECT r.job_id, r.batch_id, count(*) AS sent,
       count(*) FILTER (r.reject_reason IS NULL AND (r.batch_id, r.pos) = f.born) AS new_drvs,
       count(*) FILTER (r.reject_reason IS NULL AND (r.batch_id, r.pos) <> f.born) AS dedup_skipped,
       coalesce(any_value(e.n), 0) AS edge_errors,
       count(*) FILTER (r.reject_reason IS NOT NULL) + coalesce(any_value(e.n), 0) AS errored
FROM ingest_rows r LEFT JOIN firsts f ON r.drv_hash = f.drv_hash AND r.reject_reason IS NULL
LEFT JOIN (SELECT batch_id, count(*) AS n FROM inputs WHERE edge_error IS NOT NULL GROUP BY ALL) e ON e.batch_id = r.batch_id
GROUP BY r.job_id, r.batch_id"""


def batch_accounts(t):
    checked = checked_rows(t)
    good = checked.where(F.col("reject_reason").isNull())
    firsts = ingest.registry(good).select("drv_hash", "batch_id", "pos", F.lit(True).alias("is_new"))
    marked = checked.join(firsts, ["drv_hash", "batch_id", "pos"], "left").withColumn(
        "is_new", F.coalesce("is_new", F.lit(False))
    )
    return ingest.accounting(marked, ingest.exploded_inputs(good))


@query("ag_17_ingest_accounting", "SELECT * FROM accounts", accounts=ACCOUNTS, **VIEWS)
def _(t):
    return batch_accounts(t)


@query(
    "ag_18_submit_stats",
    """SELECT run_id, CAST(sum(new_drvs) AS BIGINT) AS new_drvs, CAST(sum(dedup_skipped) AS BIGINT) AS dedup_skipped, any_value(cached) AS cached_skipped,
              any_value(errs) AS eval_errors, CAST(sum(errored) AS BIGINT) AS errors
       FROM (SELECT job_id % 10 AS run_id, * FROM accounts) b
       JOIN (SELECT drv_hash % 10 AS run_id, count(*) FILTER (drv_hash % 11 = 0) AS errs, count(*) FILTER (drv_hash % 11 <> 0 AND (drv_hash % 4 = 0 OR drv_hash % 9 = 0)) AS cached
             FROM steps WHERE drv_hash % 13 <> 0 GROUP BY ALL) l USING (run_id) GROUP BY run_id""",
    accounts=ACCOUNTS,
    **VIEWS,
)
def _(t):
    lines, _bad = eval_lines(eval_text(t))
    lines = lines.withColumn("run_id", F.col("line_no") % 10)
    return ingest.submit_stats(lines, batch_accounts(t).withColumn("run_id", F.col("job_id") % 10))


@query(
    "wn_18_ordered_roots",
    """SELECT job_id, drv_hash, row_number() OVER (PARTITION BY job_id ORDER BY first_at, drv_hash) AS root_no
       FROM (SELECT job_id, drv_hash, min(ended_at) AS first_at FROM retried GROUP BY ALL)""",
)
def _(t):
    rows = t.retried.select("job_id", "drv_hash", F.col("ended_at").alias("ord"))
    return ingest.ordered_roots(rows).select("job_id", "drv_hash", "root_no")


@query(
    "snk_01_terminal_write_once",
    """SELECT j.job_id, CASE WHEN take THEN w.status ELSE j.status END AS status, CASE WHEN take THEN w.done_at ELSE j.done_at END AS done_at,
              CASE WHEN take THEN w.result END AS result
       FROM jobs j LEFT JOIN (SELECT job_id, CASE WHEN success THEN 'done' ELSE 'failed' END AS status, ended_at AS done_at, claim_id AS result
                              FROM attempts QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ended_at, CASE WHEN success THEN 'done' ELSE 'failed' END, claim_id) = 1) w USING (job_id),
            LATERAL (SELECT j.done_at IS NULL AND w.done_at IS NOT NULL AS take)""",
)
def _(t):
    writes = t.attempts.select(
        "job_id",
        F.when(F.col("success"), "done").otherwise("failed").alias("status"),
        F.col("ended_at").alias("done_at"),
        F.col("claim_id").alias("result"),
    )
    jobs = t.jobs.select("job_id", "status", "done_at", F.lit(None).cast("string").alias("result"))
    return lifecycle.write_terminal_once(jobs, writes)


REQUESTS = """
SELECT job_id AS request_id, CASE WHEN job_id % 4 > 0 THEN external_ref END AS external_ref, created_at, priority, max_workers FROM jobs"""


@query(
    "snk_02_job_create_mapping",
    """SELECT request_id, CASE WHEN external_ref IS NULL THEN request_id ELSE first(request_id) OVER (PARTITION BY external_ref ORDER BY created_at, request_id) END AS job_id FROM requests""",
    requests=REQUESTS,
)
def _(t):
    return ingest.create_jobs(job_requests(t))[1]


@query(
    "snk_02_job_create",
    """SELECT request_id AS job_id, external_ref, created_at, priority, max_workers FROM requests
       QUALIFY external_ref IS NULL OR row_number() OVER (PARTITION BY external_ref ORDER BY created_at, request_id) = 1""",
    requests=REQUESTS,
)
def _(t):
    return ingest.create_jobs(job_requests(t))[0]


def job_requests(t):
    return t.jobs.select(
        F.col("job_id").alias("request_id"),
        F.when(F.col("job_id") % 4 > 0, F.col("external_ref")).alias("external_ref"),
        "created_at",
        "priority",
        "max_workers",
    )


OLD_AND_NEW = {
    "old": "SELECT * FROM failed_outputs WHERE drv_hash % 3 = 0",
    "fresh": "SELECT output_path, drv_hash, failed_at, expires_at, worker_id FROM terminal_failures WHERE true",
}


@query(
    "snk_03_failed_output_insert",
    """SELECT * FROM old UNION ALL
       SELECT * FROM fresh WHERE output_path NOT IN (SELECT output_path FROM old)
       QUALIFY row_number() OVER (PARTITION BY output_path ORDER BY failed_at, drv_hash, worker_id) = 1""",
    **OLD_AND_NEW,
)
def _(t):
    old = t.failed_outputs.where(F.col("drv_hash") % 3 == 0)
    return ingest.insert_failed_outputs(old, t.terminal_failures)


@query(
    "snk_03_failed_output_refresh",
    """SELECT * FROM old WHERE expires_at > TIMESTAMP '1995-06-01' UNION ALL
       SELECT * FROM fresh WHERE output_path NOT IN (SELECT output_path FROM old WHERE expires_at > TIMESTAMP '1995-06-01')
       QUALIFY row_number() OVER (PARTITION BY output_path ORDER BY failed_at, drv_hash, worker_id) = 1""",
    **OLD_AND_NEW,
)
def _(t):
    old = t.failed_outputs.where(F.col("drv_hash") % 3 == 0)
    as_of = F.lit("1995-06-01").cast("timestamp")
    return ingest.insert_failed_outputs(old, t.terminal_failures, as_of=as_of, refresh_expired=True)


@query(
    "snk_09_heartbeat_fold",
    """SELECT j.job_id, j.status, CASE WHEN j.status = 'pending' THEN greatest(j.last_heartbeat, h.ts) ELSE j.last_heartbeat END AS last_heartbeat
       FROM jobs j LEFT JOIN (SELECT job_id, max(ended_at) AS ts FROM attempts GROUP BY ALL) h USING (job_id)""",
)
def _(t):
    beats = t.attempts.select("job_id", F.col("ended_at").alias("ts"))
    return lifecycle.fold_heartbeats(t.jobs.select("job_id", "status", "last_heartbeat"), beats)


@query(
    "snk_10_lifecycle_fold",
    """WITH r AS (SELECT job_id, seq AS request_id, ts, CASE seq % 9 WHEN 0 THEN 'cancel' WHEN 1 THEN 'fail' WHEN 2 THEN 'done' WHEN 3 THEN 'create' WHEN 4 THEN 'create' ELSE 'seal' END AS kind FROM ev),
            e AS (SELECT * FROM r WHERE kind IN ('cancel', 'fail', 'done') QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts, request_id) = 1)
       SELECT r.job_id, min(r.ts) FILTER (r.kind = 'create') AS created_at,
              coalesce(CASE any_value(e.kind) WHEN 'fail' THEN 'failed' WHEN 'cancel' THEN 'cancelled' WHEN 'done' THEN 'done' END, 'pending') AS status,
              coalesce(min(r.ts) FILTER (r.kind = 'seal') <= coalesce(any_value(e.ts), TIMESTAMP '2999-01-01'), false) AS sealed,
              any_value(e.ts) AS done_at, 'cause ' || any_value(e.request_id) AS eval_error
       FROM r LEFT JOIN e USING (job_id) GROUP BY r.job_id""",
)
def _(t):
    k = F.col("seq") % 9
    kind = F.when(k == 0, "cancel").when(k == 1, "fail").when(k == 2, "done").when(k.isin(3, 4), "create").otherwise("seal")
    requests = t.ev.select(
        "job_id", F.col("seq").alias("request_id"), "ts", kind.alias("kind"),
        F.concat(F.lit("cause "), F.col("seq").cast("string")).alias("message"),
    )
    return lifecycle.fold_lifecycle(requests)


@query(
    "snk_04_build_log_upsert",
    """SELECT claim_id, first(drv_hash ORDER BY up) AS drv_hash, first(attempt ORDER BY up) AS attempt,
              last(original_size ORDER BY up) AS original_size, last(truncated ORDER BY up) AS truncated, last(stored_at ORDER BY up) AS stored_at
       FROM (SELECT claim_id // 4 AS claim_id, drv_hash, attempt, original_size, truncated, stored_at, claim_id AS up FROM build_logs) GROUP BY ALL""",
)
def _(t):
    cols = ["claim_id", "drv_hash", "attempt", "original_size", "truncated", "log_gz", "stored_at"]
    rows = t.build_logs.withColumn("upload_id", F.col("claim_id")).withColumn("claim_id", F.floor(F.col("claim_id") / 4))
    existing = rows.where(F.col("upload_id") % 4 == 0).select(*cols)
    uploads = rows.where(F.col("upload_id") % 4 != 0).select(*cols, "upload_id")
    return logs.upsert_logs(existing, uploads).drop("log_gz")
