"""SRC-01 … SRC-11. Documents are made from the given tables row by row, then parsed."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from rivetgraph import schemas
from rivetgraph.plans.registry import query
from rivetgraph.session import table_path
from rivetgraph.sources import derivations, documents, exposition, tables


def stored(t, rows, ddl: str, label: str) -> str:
    """``rows`` as a table of type ``ddl``, columns it lacks null; the path."""
    fields = T.StructType.fromDDL(ddl).fields
    columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    path = table_path(t.spark, label)
    rows.select(columns).write.parquet(path)
    return path


@query(
    "src_01_jobs_scan",
    """SELECT CAST(job_id AS VARCHAR) AS job_id, external_ref, status, sealed, CAST(NULL AS VARCHAR) AS result, created_at, last_heartbeat, done_at, priority,
              CAST(max_workers AS BIGINT) AS max_workers, CAST(claim_deadline_secs AS BIGINT) AS claim_deadline_secs FROM jobs""",
)
def _(t):
    return tables.jobs(t.spark, stored(t, t.jobs, schemas.JOBS, "jobs"))


@query("src_02_failed_outputs_scan", "SELECT output_path, CAST(drv_hash AS VARCHAR) AS drv_hash, failed_at, expires_at, worker_id FROM failed_outputs")
def _(t):
    return tables.failed_outputs(t.spark, stored(t, t.failed_outputs, schemas.FAILED_OUTPUTS, "failed-outputs"))


@query(
    "src_03_build_logs_scan",
    """SELECT CAST(claim_id AS VARCHAR) AS claim_id, CAST(job_id AS VARCHAR) AS job_id, drv_hash, attempt, CAST(NULL AS BOOLEAN) AS success, CAST(NULL AS INTEGER) AS exit_code,
              CAST(NULL AS TIMESTAMP) AS started_at, CAST(NULL AS TIMESTAMP) AS ended_at, original_size, truncated, stored_size, stored_at FROM build_logs""",
)
def _(t):
    return tables.build_logs(t.spark, stored(t, t.build_logs, schemas.BUILD_LOGS, "build-logs"))


def eval_text(t):
    """One evaluator line per part; some broken, some failed, some cached."""
    p = F.col("drv_hash")
    status = (
        F.when(p % 4 == 0, F.lit('"cached"')).when(p % 4 == 1, F.lit('"local"')).when(p % 4 == 2, F.lit('{"state":"cached"}')).otherwise(F.lit("null"))
    )
    error = F.when(p % 11 == 0, F.lit(',"error":"attribute missing"')).otherwise(F.lit(""))
    attr = F.when(p % 7 != 0, F.concat(F.lit(',"attr":"pkgs.'), p.cast("string"), F.lit('"'))).otherwise(F.lit(""))
    line = F.concat(
        F.lit('{"drvPath":"'), F.col("drv_path"), F.lit('","name":"'), F.col("drv_name"), F.lit('","cacheStatus":'),
        status, F.lit(',"isCached":'), F.when(p % 9 == 0, "true").otherwise("false"),
        F.lit(',"neededBuilds":["a.drv","'), F.col("drv_path"), F.lit('"],"extra":{"x":1}'), attr, error, F.lit("}"),
    )
    return t.steps.select(p.alias("line_no"), F.when(p % 13 == 0, F.lit('{"drvPath": oops')).otherwise(line).alias("value"))


@query(
    "src_04_evaluator_lines",
    """SELECT drv_hash AS line_no, drv_hash % 13 <> 0 AS good,
              CASE WHEN drv_hash % 13 <> 0 THEN CASE WHEN drv_hash % 7 <> 0 THEN 'pkgs.' || drv_hash ELSE drv_name END END AS label,
              CASE WHEN drv_hash % 13 <> 0 AND drv_hash % 11 = 0 THEN 'attribute missing' END AS error,
              CASE WHEN drv_hash % 13 <> 0 THEN drv_hash % 4 = 0 OR drv_hash % 9 = 0 END AS cached,
              CASE WHEN drv_hash % 13 <> 0 THEN drv_path END AS drv_path, CASE WHEN drv_hash % 13 <> 0 THEN 2 END AS needed FROM steps""",
)
def _(t):
    good, bad = documents.eval_lines(eval_text(t))
    rows = good.select(
        "line_no", F.lit(True).alias("good"), "label", "error", "cached", "drv_path", F.size("needed_builds").alias("needed")
    )
    return rows.unionByName(bad.select("line_no", F.lit(False).alias("good")), allowMissingColumns=True)


@query(
    "src_05_ingest_batches",
    """SELECT drv_hash AS batch_id, pos, CASE pos WHEN 0 THEN drv_path ELSE 'x-dep.drv' END AS drv_path,
              CASE pos WHEN 0 THEN CAST(len(required_features) AS INTEGER) ELSE 0 END AS features, CASE pos WHEN 0 THEN 1 ELSE 0 END AS inputs,
              pos = 0 AND drv_hash % 5 = 4 AS is_root, CASE WHEN drv_hash % 3 = 0 THEN 1 ELSE 0 END AS eval_errors
       FROM steps, (VALUES (0), (1)) AS p(pos)""",
)
def _(t):
    p = F.col("drv_hash")
    full = F.to_json(
        F.struct(
            "drv_path", "drv_name", "system", "required_features",
            F.array(F.lit("x-dep.drv")).alias("input_drvs"), (p % 5 == 4).alias("is_root"),
        )
    )
    errors = F.when(p % 3 == 0, F.lit(',"eval_errors":[{"attr":"a","error":"e"}]')).otherwise("")
    doc = F.concat(
        F.lit('{"drvs":['), full, F.lit(',{"drv_path":"x-dep.drv","drv_name":"dep","system":"x86_64-linux"}]'), errors, F.lit("}")
    )
    batches = documents.ingest_batches(t.steps.select(p.alias("batch_id"), doc.alias("value")))
    rows = documents.batch_rows(batches.withColumn("n_errors", F.size("eval_errors")))
    return rows.select(
        "batch_id", "pos", "drv_path", F.size("required_features").alias("features"),
        F.size("input_drvs").alias("inputs"), "is_root", F.col("n_errors").alias("eval_errors"),
    )


def event_text(t):
    """ev as JSON lines; every fiftieth line is cut off, some kinds are unknown."""
    line = F.to_json(F.struct("kind", F.col("job_id").cast("string").alias("job_id"), "seq", "ts", "worker_id", "duration_ms"))
    odd = F.when(F.col("seq") % 50 == 0, F.substring(line, 1, 20)).when(
        F.col("seq") % 50 == 1, F.replace(line, F.lit("drv_"), F.lit("new_"))
    )
    return t.ev.select(F.coalesce(odd, line).alias("value"))


@query(
    "src_06_job_events",
    """SELECT kind, CAST(job_id AS VARCHAR) AS job_id, seq, epoch_us(ts) // 1000 AS ts_ms, worker_id, duration_ms FROM ev
       WHERE seq % 50 <> 0 AND NOT (seq % 50 = 1 AND kind LIKE 'drv_%')""",
)
def _(t):
    # the lines carry milliseconds
    parsed = documents.job_events(event_text(t))
    return parsed.select("kind", "job_id", "seq", F.unix_millis("ts").alias("ts_ms"), "worker_id", "duration_ms")


@query(
    "src_07_status_snapshots",
    """SELECT job_id, CASE WHEN job_id % 10 > 1 THEN status END AS status, CASE WHEN job_id % 10 > 1 THEN job_id % 50 END AS total,
              CASE WHEN job_id % 10 > 1 THEN 1 END AS failures FROM jobs""",
)
def _(t):
    k = F.col("job_id")
    doc = F.concat(
        F.lit('{"id":"'), k.cast("string"), F.lit('","status":"'), F.col("status"), F.lit('","sealed":true,"counts":{"total":'),
        (k % 50).cast("string"), F.lit(',"pending":0,"building":0,"done":0,"failed":0},"failures":[{"drv_hash":"h","drv_name":"n","error_category":"transient"}],"eval_error":null}'),
    )
    result = F.when(k % 10 == 0, F.lit("not json")).when(k % 10 == 1, F.lit("[]")).otherwise(doc)
    s = documents.snapshots(t.jobs.select("job_id", result.alias("result")))
    return s.select("job_id", "snapshot.status", "snapshot.counts.total", F.array_size("snapshot.failures").alias("failures"))


def metric_text(t):
    k = F.col("event_id")
    sample = F.concat(
        F.lit('builds_completed_total{outcome="'), F.col("event_type"), F.lit('",shard="'), (k % 4).cast("string"), F.lit('"} '), k.cast("string")
    )
    line = (
        F.when(k % 10 == 0, F.lit("# HELP builds_completed_total Builds"))
        .when(k % 10 == 1, F.lit("   "))
        .when(k % 10 == 2, F.concat(F.lit("in_flight "), k.cast("string")))
        .when(k % 10 == 3, F.lit("bad_value not_a_number"))
        .otherwise(sample)
    )
    return t.raw("events").select(line.alias("value"))


@query(
    "src_08_metrics_text",
    """SELECT CASE event_id % 10 WHEN 2 THEN 'in_flight' ELSE 'builds_completed_total' END AS name,
              CASE WHEN event_id % 10 > 3 THEN event_type END AS outcome, CASE WHEN event_id % 10 > 3 THEN CAST(event_id % 4 AS VARCHAR) END AS shard,
              CAST(event_id AS DOUBLE) AS metric_value FROM events WHERE event_id % 10 NOT IN (0, 1, 3)""",
)
def _(t):
    m = exposition.metric_lines(metric_text(t))
    return m.select("name", F.col("labels")["outcome"].alias("outcome"), F.col("labels")["shard"].alias("shard"), "metric_value")


@query(
    "src_09_metric_select",
    """SELECT CAST(event_id AS DOUBLE) AS metric_value FROM events WHERE event_id % 10 > 3 AND event_type = 'error' AND event_id % 4 = 1""",
)
def _(t):
    m = exposition.metric_lines(metric_text(t))
    return exposition.select_metric(m, "builds_completed_total", {"outcome": "error", "shard": "1"}).select("metric_value")


def derivation_files(t):
    """Every step as an ATerm file with its inputs; the classes of bad files occur too."""
    p = F.col("drv_hash")
    paths = t.steps.select("drv_hash", "drv_path")
    inputs = (
        t.edges.join(paths.withColumnRenamed("drv_hash", "dst"), "dst")
        .groupBy(F.col("src").alias("drv_hash"))
        .agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('("'), "drv_path", F.lit('",["out"])')))), ",").alias("inputs"))
    )
    fixed = F.when(p % 6 == 0, F.lit('"sha256","abc"')).otherwise('"",""')
    extra = F.when(p % 4 == 0, F.lit(',("dev","/nix/store/d","","")')).otherwise("")
    env_name = F.when(p % 9 == 0, F.lit("")).otherwise(F.concat(F.lit('("name","café \\"'), "drv_name", F.lit('\\"\\q"),')))
    body = F.concat(
        F.lit('[("out","/nix/store/o",'), fixed, F.lit(")"), extra, F.lit("],["), F.coalesce("inputs", F.lit("")),
        F.lit('],["/nix/store/src"],"'), "system", F.lit('","/bin/sh",["-e","a\\nb)"],['), env_name, F.lit('("system","x")]'),
    )
    good = F.concat(F.lit("Derive("), body, F.lit(")\n")).cast("binary")
    bad = (
        F.when(p % 50 == 1, F.unhex(F.lit("4465726976FF")))
        .when(p % 50 == 2, F.concat(F.lit("Drv("), body, F.lit(")")).cast("binary"))
        .when(p % 50 == 3, F.concat(F.lit("Derive("), body).cast("binary"))
        .when(p % 50 == 4, F.lit('Derive([("out","x"],[])').cast("binary"))
    )
    return (
        t.steps.join(inputs, "drv_hash", "left")
        .select(F.col("drv_path").alias("path"), F.coalesce(bad, good).alias("content"))
    )


@query(
    "src_10_derivation_parse",
    """SELECT drv_path AS path, CASE k WHEN 1 THEN 'NotUtf8' WHEN 2 THEN 'MissingHeader' WHEN 3 THEN 'MissingFooter' WHEN 4 THEN 'BadSyntax' END AS error_class,
              CASE WHEN good THEN CASE WHEN drv_hash % 9 = 0 THEN 'unknown' ELSE 'café "' || drv_name || '"\\q' END END AS name,
              CASE WHEN good THEN system END AS system, CASE WHEN good THEN CASE WHEN drv_hash % 4 = 0 THEN 2 ELSE 1 END END AS outputs,
              CASE WHEN good THEN coalesce((SELECT string_agg(d.drv_path, ',' ORDER BY d.drv_path) FROM edges e JOIN steps d ON e.dst = d.drv_hash WHERE e.src = s.drv_hash), '') END AS inputs
       FROM (SELECT *, drv_hash % 50 AS k, drv_hash % 50 NOT IN (1, 2, 3, 4) AS good FROM steps) s""",
)
def _(t):
    parsed = derivations.parse(derivation_files(t))
    return parsed.select(
        "path", "error_class", "name", "system", F.array_size("outputs").alias("outputs"),
        F.array_join("input_drvs.path", ",").alias("inputs"),
    )


@query(
    "src_11_fixed_output",
    "SELECT drv_path AS path, drv_hash % 4 <> 0 AND drv_hash % 6 = 0 AS fixed_output FROM steps WHERE drv_hash % 50 NOT IN (1, 2, 3, 4)",
)
def _(t):
    parsed = derivations.parse(derivation_files(t)).where(F.col("error_class").isNull())
    return parsed.select("path", derivations.is_fixed_output(F.col("outputs")).alias("fixed_output"))
