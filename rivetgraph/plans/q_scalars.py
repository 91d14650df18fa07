"""PRJ-01 … PRJ-24 over whole given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivetgraph.functions import checks, logtext, outcomes, paths, times
from rivetgraph.operators import ingest
from rivetgraph.plans.registry import query
from rivetgraph.plans.views import MEASURED_LOGS

AS_OF = "2024-06-01 00:00:00"

# Sample messages for the classifier.
MESSAGES = (
    "",
    "error: No space left on device",
    "write failed: Disk quota exceeded",
    "cc1plus: out of memory allocating 65536 bytes",
    "error: builder for '/nix/store/x.drv' failed with exit code 1",
    "error: Cannot build '/nix/store/x.drv'. Reason: builder failed due to signal 9 (Killed)",
    "error: Cannot build '/nix/store/x.drv'. Reason: builder failed due to signal 6 (Aborted)",
    "error: builder for '/nix/store/x.drv' failed to produce output path '/nix/store/o'",
    "error: hash mismatch in fixed-output derivation '/nix/store/x.drv'",
    "error: output path '/nix/store/o' is missing",
    "error: output path '/nix/store/o' is not allowed to refer to path '/nix/store/p'",
    "nix-daemon failed with exit code 3",
    "unable to download: Connection reset",
    "Killed process 42 (oom_score_adj 0)",
    "read: Input/output error",
    "systemd: killed by SIGTERM",
)


def _sql_list(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


ODD_PATHS = """
SELECT drv_hash, CASE drv_hash % 6 WHEN 0 THEN drv_path WHEN 1 THEN drv_path || '.drv' WHEN 2 THEN replace(drv_path, '-', '')
       WHEN 3 THEN replace(drv_path, '.drv', '') WHEN 4 THEN drv_name || '.drv' ELSE '' END AS path
FROM steps"""


def odd_paths(t):
    p, path = F.col("drv_hash") % 6, F.col("drv_path")
    return t.steps.select(
        "drv_hash",
        F.when(p == 0, path)
        .when(p == 1, F.concat(path, F.lit(".drv")))
        .when(p == 2, F.replace(path, F.lit("-"), F.lit("")))
        .when(p == 3, F.replace(path, F.lit(".drv"), F.lit("")))
        .when(p == 4, F.concat("drv_name", F.lit(".drv")))
        .otherwise("")
        .alias("path"),
    )


@query(
    "prj_01_drv_hash_from_path",
    """SELECT drv_hash, CASE WHEN b LIKE '%.drv' AND contains(b, '-') THEN b END AS hash
       FROM (SELECT drv_hash, split_part(path, '/', -1) AS b FROM odd_paths)""",
    odd_paths=ODD_PATHS,
)
def _(t):
    return odd_paths(t).select("drv_hash", paths.drv_hash_from_path(F.col("path")).alias("hash"))


@query(
    "prj_02_placeholder_name",
    """SELECT drv_hash, CASE WHEN contains(s, '-') THEN substr(s, instr(s, '-') + 1) ELSE s END AS name
       FROM (SELECT drv_hash, regexp_replace(split_part(path, '/', -1), '(\\.drv)+$', '') AS s FROM odd_paths)""",
    odd_paths=ODD_PATHS,
)
def _(t):
    return odd_paths(t).select("drv_hash", paths.placeholder_name(F.col("path")).alias("name"))


@query(
    "prj_03_output_path",
    "SELECT drv_hash, regexp_replace(path, '(\\.drv)+$', '') AS output_path FROM odd_paths",
    odd_paths=ODD_PATHS,
)
def _(t):
    return odd_paths(t).select("drv_hash", paths.output_path(F.col("path")).alias("output_path"))


@query(
    "prj_04_comma_list",
    """SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ' , ' || p_type || ',,' || p_brand, ','),
              lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM part""",
)
def _(t):
    text = F.concat("p_name", F.lit(" , "), "p_type", F.lit(",,"), "p_brand")
    return t.raw("part").select("p_partkey", paths.comma_list(text).alias("items"))


@query(
    "prj_05_ingest_row_validation",
    """SELECT drv_hash, CASE
         WHEN path = '' OR drv_name = '' OR system = '' THEN 'empty_field'
         WHEN strlen(path) > 60 OR strlen(drv_name) > 24 THEN 'too_long'
         WHEN drv_hash % 11 > 8 THEN 'too_many_inputs'
         WHEN drv_hash % 5 > 3 THEN 'too_many_features'
         WHEN strlen(attr) > 20 THEN 'attr_too_long'
         WHEN NOT (split_part(path, '/', -1) LIKE '%.drv' AND contains(split_part(path, '/', -1), '-')) THEN 'bad_hash'
       END AS reject_reason
       FROM (SELECT o.drv_hash, path, drv_name || repeat('é', o.drv_hash % 5) AS drv_name, system,
                    CASE WHEN o.drv_hash % 3 > 0 THEN repeat('ä', o.drv_hash % 13) END AS attr
             FROM odd_paths o JOIN steps s ON o.drv_hash = s.drv_hash)""",
    odd_paths=ODD_PATHS,
)
def _(t):
    key = F.col("drv_hash")
    rows = (
        odd_paths(t)
        .join(t.steps.select("drv_hash", "drv_name", "system"), "drv_hash")
        .select(
            key.alias("step"),
            F.col("path").alias("drv_path"),
            F.concat("drv_name", F.repeat(F.lit("é"), (key % 5).cast("int"))).alias("drv_name"),
            "system",
            F.array_repeat(F.lit("/nix/store/a-b.drv"), (key % 11).cast("int")).alias("input_drvs"),
            F.array_repeat(F.lit("kvm"), (key % 5).cast("int")).alias("required_features"),
            F.when(key % 3 > 0, F.repeat(F.lit("ä"), (key % 13).cast("int"))).alias("attr"),
        )
    )
    checked = ingest.with_reject_reason(
        rows, max_path_bytes=60, max_name_bytes=24, max_inputs=8, max_features=3, max_attr_bytes=20
    )
    return checked.select(F.col("step").alias("drv_hash"), "reject_reason")


@query(
    "prj_06_request_validation",
    """SELECT o_orderkey, CASE WHEN 2 * (o_orderkey % 400) > 512 THEN 'external_ref_too_long'
              WHEN o_orderkey % 5 = 0 THEN 'zero_claim_deadline'
              WHEN o_orderkey % 7 = 0 THEN 'zero_max_workers' END AS job_reason,
              CASE WHEN o_orderkey % 600 = 0 THEN 'worker_id_empty' WHEN o_orderkey % 600 > 512 THEN 'worker_id_too_long' END AS admin_reason
       FROM orders""",
)
def _(t):
    key = F.col("o_orderkey")
    return t.raw("orders").select(
        "o_orderkey",
        checks.job_request_reject_reason(F.repeat(F.lit("é"), (key % 400).cast("int")), key % 5, key % 7).alias(
            "job_reason"
        ),
        checks.worker_id_reject_reason(F.repeat(F.lit("w"), (key % 600).cast("int")), admin=True).alias(
            "admin_reason"
        ),
    )


@query(
    "prj_07_batch_verdict",
    """SELECT l_orderkey AS batch_id, CASE WHEN count(*) FILTER (l_returnflag <> 'R') = 0 AND count(*) FILTER (l_returnflag = 'R') = 0 THEN 'empty'
              WHEN count(*) FILTER (l_returnflag = 'R') > 2 THEN 'too_many_eval_errors' ELSE 'accept' END AS verdict
       FROM lineitem GROUP BY ALL""",
)
def _(t):
    is_error = F.col("l_returnflag") == "R"
    batches = (
        t.raw("lineitem")
        .groupBy(F.col("l_orderkey").alias("batch_id"))
        .agg(F.count_if(~is_error).alias("drvs"), F.count_if(is_error).alias("errors"))
    )
    return batches.select(
        "batch_id", checks.batch_verdict(F.col("drvs"), F.col("errors"), max_eval_errors=2).alias("verdict")
    )


@query(
    "prj_08_log_tail",
    """SELECT doc_id, md5(tail) AS tail_md5, CAST(strlen(tail) AS BIGINT) AS tail_bytes FROM (
         SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN text ELSE
           right(text, list_max(list_filter(range(250, 1001), lambda k: strlen(right(text, k)) <= 1000))) END AS tail
         FROM documents)""",
)
def _(t):
    tail = logtext.log_tail(F.col("text"), max_bytes=1000)
    return t.raw("documents").select(
        "doc_id", F.md5(tail).alias("tail_md5"), F.octet_length(tail).cast("bigint").alias("tail_bytes")
    )


@query(
    "prj_09_raw_log_cap",
    """SELECT doc_id, md5(right(hex(encode(text)), 4000)) AS kept_md5, strlen(text) > 2000 AS truncated,
              CAST(strlen(text) AS BIGINT) AS original_size FROM documents""",
)
def _(t):
    capped = logtext.capped_log(F.col("text").cast("binary"), max_bytes=2000)
    return (
        t.raw("documents")
        .select("doc_id", capped.alias("c"))
        .select("doc_id", F.md5(F.hex("c.kept")).alias("kept_md5"), "c.truncated", "c.original_size")
    )


@query(
    "prj_10_classify_failure",
    f"""SELECT m, exit_code, CASE
          WHEN contains(s, 'no space left on device') OR contains(s, 'disk full') OR contains(s, 'disk quota exceeded')
            OR contains(s, 'out of memory') OR contains(s, 'cannot allocate memory') OR contains(s, 'oom reaper')
            OR contains(s, 'oom-kill') OR contains(s, 'killed by oom') OR contains(s, 'input/output error')
            OR (contains(s, 'killed') AND contains(s, 'oom')) THEN 'disk_full'
          WHEN coalesce(exit_code IN (137, 143, 124), false) OR contains(s, 'signal 9') OR contains(s, 'signal 15')
            OR contains(s, 'killed by sigkill') OR contains(s, 'killed by sigterm') THEN 'transient'
          WHEN (contains(s, 'builder for ') OR contains(s, 'cannot build ''')) AND (contains(s, 'failed with exit code')
            OR contains(s, 'failed to produce output path') OR contains(s, 'failed due to signal')) THEN 'build_failure'
          WHEN contains(s, 'hash mismatch in fixed-output derivation')
            OR (contains(s, 'output path ') AND contains(s, ' is not allowed to refer to ')) THEN 'build_failure'
          ELSE 'transient' END AS category, count(*) AS n
        FROM (SELECT l_suppkey % 16 AS m, lower({_sql_list(MESSAGES)}[1 + l_suppkey % 16]) AS s,
                     CASE l_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 137 WHEN 2 THEN 143 WHEN 3 THEN 124 END AS exit_code FROM lineitem)
        GROUP BY ALL""",
)
def _(t):
    m, p = F.col("l_suppkey") % 16, F.col("l_partkey") % 5
    text = F.element_at(F.array(*[F.lit(x) for x in MESSAGES]), (m + 1).cast("int"))
    code = F.when(p == 0, 1).when(p == 1, 137).when(p == 2, 143).when(p == 3, 124)
    rows = t.raw("lineitem").select(m.alias("m"), code.alias("exit_code"), text.alias("stderr"))
    return rows.select(
        "m", "exit_code", outcomes.classify_failure(F.col("stderr"), F.col("exit_code")).alias("category")
    ).groupBy("m", "exit_code", "category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj_11_enum_predicates",
    """SELECT coalesce(error_category, 'none') AS category, coalesce(error_category IN ('transient', 'disk_full'), false) AS retryable,
              status IN ('done', 'failed', 'cancelled') AS terminal, count(*) AS n
       FROM attempts JOIN jobs USING (job_id) GROUP BY ALL""",
)
def _(t):
    joined = t.attempts.select("job_id", "error_category").join(t.jobs.select("job_id", "status"), "job_id")
    return joined.groupBy(
        F.coalesce("error_category", F.lit("none")).alias("category"),
        F.coalesce(outcomes.is_retryable(F.col("error_category")), F.lit(False)).alias("retryable"),
        outcomes.is_terminal(F.col("status")).alias("terminal"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj_12_step_state",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'failed' WHEN p_partkey % 2 = 0 THEN 'done'
              WHEN p_partkey % 5 = 0 THEN 'pending' WHEN p_partkey % 4 > 0 THEN 'building' ELSE 'pending' END AS state FROM part""",
)
def _(t):
    p = F.col("p_partkey")
    return t.raw("part").select(
        "p_partkey", outcomes.step_state(p % 2 == 0, p % 3 == 0, p % 5 == 0, p % 4).alias("state")
    )


@query(
    "prj_13_feature_subset",
    """SELECT drv_hash, list_has_all(['kvm'], required_features) AS kvm_worker, list_has_all(CAST([] AS VARCHAR[]), required_features) AS plain_worker,
              list_has_all(['big-parallel', 'kvm', 'x'], required_features) AS big_worker FROM steps""",
)
def _(t):
    need = F.col("required_features")
    none = F.array().cast("array<string>")
    return t.steps.select(
        "drv_hash",
        outcomes.features_ok(need, F.array(F.lit("kvm"))).alias("kvm_worker"),
        outcomes.features_ok(need, none).alias("plain_worker"),
        outcomes.features_ok(need, F.array(F.lit("big-parallel"), F.lit("kvm"), F.lit("x"))).alias("big_worker"),
    )


@query(
    "prj_14_retry_decision",
    """SELECT claim_id, coalesce(error_category, 'build_failure') IN ('transient', 'disk_full') AND 1 + duration_ms % 3 < 2 AS will_retry
       FROM attempts WHERE NOT success""",
)
def _(t):
    attempt = 1 + F.col("duration_ms") % 3
    return t.attempts.where(~F.col("success")).select(
        "claim_id", outcomes.will_retry(F.col("error_category"), attempt).alias("will_retry")
    )


@query(
    "prj_15_linear_backoff",
    "SELECT claim_id, epoch_ms(ended_at) + 30000 * (1 + duration_ms % 3) AS next_attempt_at FROM attempts WHERE NOT success",
)
def _(t):
    attempt = 1 + F.col("duration_ms") % 3
    return t.attempts.where(~F.col("success")).select(
        "claim_id", outcomes.next_attempt_at_ms(F.unix_millis("ended_at"), attempt).alias("next_attempt_at")
    )


@query(
    "prj_16_attr_cached",
    """SELECT event_id, coalesce(CASE event_id % 4 WHEN 0 THEN 'cached' WHEN 1 THEN 'local' WHEN 2 THEN 'notBuilt' END = 'cached', false)
              OR coalesce(CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END, false) AS cached FROM events""",
)
def _(t):
    k4, k3 = F.col("event_id") % 4, F.col("event_id") % 3
    status = F.when(k4 == 0, "cached").when(k4 == 1, "local").when(k4 == 2, "notBuilt")
    flag = F.when(k3 == 0, True).when(k3 == 1, False)
    return t.raw("events").select("event_id", outcomes.attr_cached(status, flag).alias("cached"))


@query(
    "prj_17_upload_validation",
    """SELECT claim_id, CASE WHEN original_size * 900 > 8388608 THEN 'body_too_large'
              WHEN original_size * 1000 > 4194304 AND NOT truncated THEN 'size_without_truncation' END AS reason FROM build_logs""",
    build_logs=MEASURED_LOGS,
)
def _(t):
    size = F.col("original_size")
    return t.measured_logs.select(
        "claim_id", checks.upload_reject_reason(size * 900, size * 1000, F.col("truncated")).alias("reason")
    )


@query("prj_18_log_decompress", "SELECT doc_id, md5(text) AS text_md5, CAST(NULL AS VARCHAR) AS error FROM documents")
def _(t):
    packed = t.raw("documents").select("doc_id", logtext.gzip_text("text").alias("log_gz"))
    opened = packed.select("doc_id", logtext.gunzip("log_gz").alias("u"))
    return opened.select("doc_id", F.md5("u.text").alias("text_md5"), "u.error")


@query(
    "prj_19_duration_formats",
    """SELECT event_id, CASE WHEN h > 0 THEN format('{}h {}m {}s', h, m, s) WHEN m > 0 THEN format('{}m {}s', m, s) WHEN s > 0 THEN format('{}s', s)
              ELSE format('{}ms', ms) END AS long_form,
              CASE WHEN h > 0 THEN format('{}h{}m', h, m) WHEN m > 0 THEN format('{}m{}s', m, s) ELSE format('{}s', s) END AS short_form,
              substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS short_id
       FROM (SELECT event_id, ms, ms // 3600000 AS h, (ms // 60000) % 60 AS m, (ms // 1000) % 60 AS s
             FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) * (event_id % 1000) AS ms FROM events))""",
)
def _(t):
    ms = F.round(F.col("value") * 100).cast("bigint") * (F.col("event_id") % 1000)
    return t.raw("events").select(
        "event_id",
        times.fmt_ms(ms).alias("long_form"),
        times.format_elapsed(ms).alias("short_form"),
        paths.short_id(F.md5(F.col("event_id").cast("string"))).alias("short_id"),
    )


@query(
    "prj_20_relative_time",
    f"""SELECT event_id, CASE WHEN event_id % 5 < 4 THEN TIMESTAMP '{AS_OF}' - to_seconds((event_id % 50) * [1, 60, 3600, 86400][1 + event_id % 5]) END AS since
        FROM events""",
)
def _(t):
    unit = F.element_at(F.array(*[F.lit(u) for u in "smhdw"]), (F.col("event_id") % 5 + 1).cast("int"))
    text = F.concat((F.col("event_id") % 50).cast("string"), unit)
    as_of = F.lit(AS_OF).cast("timestamp")
    return t.raw("events").select("event_id", times.since(text, as_of).alias("since"))


@query(
    "prj_21_progress_percent",
    """SELECT job_id, CASE WHEN status <> 'pending' THEN CASE WHEN total > 0 THEN round(bad * 100.0 / total, 6) ELSE 100.0 END END AS percent
       FROM (SELECT j.job_id, j.status, count(a.claim_id) AS total, count(a.claim_id) FILTER (NOT a.success) AS bad
             FROM jobs j LEFT JOIN attempts a USING (job_id) GROUP BY ALL)""",
)
def _(t):
    per_job = t.attempts.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("success")).alias("bad")
    )
    total, bad = (F.coalesce(c, F.lit(0)) for c in ("total", "bad"))
    return t.jobs.join(per_job, "job_id", "left").select(
        "job_id", F.round(outcomes.progress_percent(F.lit(0), bad, total, F.col("sealed")), 6).alias("percent")
    )


@query(
    "prj_22_compression_ratio",
    """SELECT claim_id, original_size AS stored_size, round(original_size * 4.0 / nullif(original_size, 0), 6) AS ratio FROM build_logs""",
    build_logs=MEASURED_LOGS,
)
def _(t):
    return t.measured_logs.select(
        "claim_id",
        "stored_size",
        F.round(logtext.compression_ratio(F.col("original_size") * 4, F.col("stored_size")), 6).alias("ratio"),
    )


@query(
    "prj_23_status_parse",
    """SELECT o_orderkey, CASE WHEN s IN ('pending', 'building', 'done', 'failed', 'cancelled') THEN s ELSE 'pending' END AS status
       FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'Done' WHEN 2 THEN 'cancelled' END AS s FROM orders)""",
)
def _(t):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, "done").when(k == 1, "Done").when(k == 2, "cancelled")
    return t.raw("orders").select("o_orderkey", outcomes.status_or_pending(raw).alias("status"))


@query(
    "prj_24_completion_outcome",
    """SELECT claim_id, CASE WHEN job_id % 7 = 0 THEN 'ignored' WHEN success THEN 'success'
              WHEN error_category IN ('transient', 'disk_full') AND 1 + duration_ms % 3 < 2 THEN 'flaky_retry' ELSE 'failure' END AS outcome FROM attempts""",
)
def _(t):
    outcome = outcomes.completion_outcome(
        F.col("job_id") % 7 != 0, F.col("success"), F.col("error_category"), 1 + F.col("duration_ms") % 3
    )
    return t.attempts.select("claim_id", outcome.alias("outcome"))


@query(
    "snk_06_sanitize_filename",
    """SELECT doc_id, CASE WHEN c IN ('', '.', '..') THEN '_' ELSE c END AS file_name
       FROM (SELECT doc_id, regexp_replace(CASE doc_id % 5 WHEN 0 THEN '..' WHEN 1 THEN '' ELSE source || ':' || lang || '/' || text END,
             '[/\\\\:*?"<>|]', '_', 'g') AS c FROM documents)""",
)
def _(t):
    k = F.col("doc_id") % 5
    name = F.when(k == 0, "..").when(k == 1, "").otherwise(F.concat("source", F.lit(":"), "lang", F.lit("/"), "text"))
    return t.raw("documents").select("doc_id", paths.sanitize_filename(name).alias("file_name"))
