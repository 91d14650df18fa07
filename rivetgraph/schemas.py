"""Row types of the tables, wire documents and events, as DDL."""

JOBS = (
    "job_id STRING, external_ref STRING, status STRING, sealed BOOLEAN, result STRING, "
    "created_at TIMESTAMP, last_heartbeat TIMESTAMP, done_at TIMESTAMP, "
    "priority INT, max_workers BIGINT, claim_deadline_secs BIGINT"
)
FAILED_OUTPUTS = (
    "output_path STRING, drv_hash STRING, failed_at TIMESTAMP, expires_at TIMESTAMP, worker_id STRING"
)
BUILD_LOGS = (
    "claim_id STRING, job_id STRING, drv_hash STRING, attempt INT, success BOOLEAN, exit_code INT, "
    "started_at TIMESTAMP, ended_at TIMESTAMP, original_size BIGINT, truncated BOOLEAN, "
    "stored_size BIGINT, log_gz BINARY, stored_at TIMESTAMP"
)
EVAL_LINE = (
    "drvPath STRING, attr STRING, name STRING, error STRING, cacheStatus STRING, "
    "isCached BOOLEAN, neededBuilds ARRAY<STRING>"
)
DRVS_DDL = (
    "ARRAY<STRUCT<drv_path STRING, drv_name STRING, system STRING, required_features ARRAY<STRING>, "
    "input_drvs ARRAY<STRING>, is_root BOOLEAN, attr STRING>>"
)
EVAL_ERRORS_DDL = "ARRAY<STRUCT<attr STRING, error STRING>>"
INGEST_BATCH = f"drvs {DRVS_DDL}, eval_errors {EVAL_ERRORS_DDL}"
COUNTS_DDL = "STRUCT<total BIGINT, pending BIGINT, building BIGINT, done BIGINT, failed BIGINT>"
FAILURE_DDL = (
    "STRUCT<drv_hash STRING, drv_name STRING, error_category STRING, error_message STRING, "
    "log_tail STRING, propagated_from STRING, worker_id STRING>"
)
JOB_EVENT = (
    "kind STRING, job_id STRING, seq BIGINT, ts TIMESTAMP, drv_hash STRING, drv_name STRING, "
    "claim_id STRING, attempt INT, duration_ms BIGINT, error_category STRING, error_message STRING, "
    "log_tail STRING, will_retry BOOLEAN, used_by_attrs ARRAY<STRING>, "
    f"counts {COUNTS_DDL}, in_flight ARRAY<STRUCT<drv_name STRING, started_at_ms BIGINT>>, "
    "propagated_failed BIGINT, transient_retries BIGINT, sealed BOOLEAN, status STRING, "
    f"failures ARRAY<{FAILURE_DDL}>, missed BIGINT, worker_id STRING"
)
STATUS_SNAPSHOT = (
    f"id STRING, status STRING, sealed BOOLEAN, counts {COUNTS_DDL}, "
    f"failures ARRAY<{FAILURE_DDL}>, eval_error STRING, "
    "eval_errors ARRAY<STRUCT<attr STRING, error STRING>>, suspected_worker_infra STRING"
)
DERIVATION = (
    "path STRING, error_class STRING, error_context STRING, "
    "outputs ARRAY<STRUCT<name STRING, path STRING, hash_algo STRING, hash STRING>>, "
    "input_drvs ARRAY<STRUCT<path STRING, outputs ARRAY<STRING>>>, system STRING, name STRING"
)
DERIVATION_COLUMNS = ("path", "error_class", "error_context", "outputs", "input_drvs", "system", "name")
