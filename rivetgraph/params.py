"""Default thresholds. Every operator takes them as keyword arguments."""

# Limits and timings that results depend on.
CLAIM_DEADLINE_SECS = 3600
HEARTBEAT_TIMEOUT_SECS = 30
JOB_RETENTION_DAYS = 14
LOG_RETENTION_DAYS = 7
RETRY_BACKOFF_STEP_MS = 30_000
MAX_ATTEMPTS = 2
MAX_PATH_BYTES = 4096
MAX_NAME_BYTES = 1024
MAX_IDENTIFIER_BYTES = 512
MAX_INPUTS_PER_DRV = 4096
MAX_FEATURES_PER_DRV = 32
MAX_EVAL_ERRORS_PER_BATCH = 10_000
MAX_FAILURES_IN_RESULT = 500
MAX_LOG_TAILS_IN_RESULT = 10
EVAL_ERRORS_CAP = 500
JOB_SIZE_WARN = 200_000
MAX_DRVS_PER_JOB = 2_000_000
FAILED_OUTPUT_TTL_SECS = 3600
LOG_BYTES_PER_JOB_WARN = 100 * 1024 * 1024
LOG_STORE_CEILING_BYTES = 50 * 1024**3
QUARANTINE_FAILURES = 5
QUARANTINE_WINDOW_SECS = 300
QUARANTINE_COOLDOWN_SECS = 900
LOG_TAIL_BYTES = 65_536
RAW_LOG_BYTES = 4 * 1024 * 1024
UPLOAD_BYTES = 2 * RAW_LOG_BYTES
MIN_FAILURES_FOR_SUSPICION = 3
LIST_LIMIT_DEFAULT = 50
LIST_LIMIT_MAX = 200
SLOWEST_KEEP = 8
SLOWEST_SHOW = 3
IN_FLIGHT_SHOW = 4
PROPAGATED_PREVIEW = 5
CYCLE_PREVIEW = 5
PROGRESS_TICK_SECS = 10
U32_MAX = 4_294_967_295

TERMINAL_STATUSES = ("done", "failed", "cancelled")
KNOWN_STATUSES = ("pending", "building", "done", "failed", "cancelled")
RETRYABLE_CATEGORIES = ("transient", "disk_full")
EVENT_KINDS = (
    "drv_started",
    "drv_completed",
    "drv_failed",
    "progress",
    "job_done",
    "lagged",
)
TRUNCATED_MARK = "<truncated>"

# Upper bounds of the histogram buckets, by metric family.
BUCKETS = {
    "build_duration_seconds": (0.1, 0.5, 1, 2.5, 5, 10, 30, 60, 120, 300, 600, 1800),
    "dispatch_wait_seconds": (0.001, 0.01, 0.1, 0.5, 1, 5, 30, 60),
    "claim_age_seconds": (0.5, 1, 5, 10, 30, 60, 300, 900, 1800, 3600),
    "drvs_per_job": (1, 10, 100, 1_000, 10_000, 100_000, 500_000, 1_000_000, 5_000_000),
    "ingest_batch_drvs": (1, 5, 10, 50, 100, 500, 1_000, 5_000, 10_000, 50_000),
    "log_bytes_per_job": (
        1_024,
        10_240,
        102_400,
        1_048_576,
        10_485_760,
        104_857_600,
        1_073_741_824,
        5_368_709_120,
    ),
    "request_duration_seconds": (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10),
    "ingest_phase_seconds": (1e-5, 1e-4, 0.001, 0.01, 0.1, 1, 10),
}
