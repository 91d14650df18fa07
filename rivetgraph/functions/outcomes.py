"""Failure classification and the small state rules built on it."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, functions as F

from rivetgraph import params as P

# Phrases looked for in lower-cased standard error.
EXHAUSTION_PHRASES = (
    "no space left on device",
    "disk full",
    "disk quota exceeded",
    "out of memory",
    "cannot allocate memory",
    "oom reaper",
    "oom-kill",
    "killed by oom",
    "input/output error",
)
KILL_EXIT_CODES = (137, 143, 124)
KILL_PHRASES = ("signal 9", "killed by sigkill", "signal 15", "killed by sigterm")
BUILD_ANCHORS = ("builder for ", "cannot build '")
BUILD_MARKERS = ("failed with exit code", "failed to produce output path", "failed due to signal")
HASH_MISMATCH = "hash mismatch in fixed-output derivation"
REFERENCE_VIOLATION = ("output path ", " is not allowed to refer to ")


def _any(text: Column, phrases) -> Column:
    return reduce(Column.__or__, [text.contains(p) for p in phrases])


def _all(text: Column, phrases) -> Column:
    return reduce(Column.__and__, [text.contains(p) for p in phrases])


def classify_failure(stderr_tail: Column, exit_code: Column) -> Column:
    """disk_full / transient / build_failure; whatever is unclear stays retryable."""
    raw = F.coalesce(stderr_tail, F.lit(""))
    text = F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)
    exhausted = _any(text, EXHAUSTION_PHRASES) | _all(text, ("killed", "oom"))
    killed = F.coalesce(exit_code.isin(*KILL_EXIT_CODES), F.lit(False)) | _any(text, KILL_PHRASES)
    deterministic = (
        (_any(text, BUILD_ANCHORS) & _any(text, BUILD_MARKERS))
        | text.contains(HASH_MISMATCH)
        | _all(text, REFERENCE_VIOLATION)
    )
    return (
        F.when(exhausted, "disk_full")
        .when(killed, "transient")
        .when(deterministic, "build_failure")
        .otherwise("transient")
    )


def is_retryable(category: Column) -> Column:
    return category.isin(*P.RETRYABLE_CATEGORIES)


def is_terminal(status: Column) -> Column:
    return status.isin(*P.TERMINAL_STATUSES)


def status_or_pending(status: Column) -> Column:
    return F.when(status.isin(*P.KNOWN_STATUSES), status).otherwise("pending")


def step_state(finished: Column, failed: Column, runnable: Column, tries: Column) -> Column:
    return (
        F.when(finished & failed, "failed")
        .when(finished, "done")
        .when(runnable, "pending")
        .when(tries > 0, "building")
        .otherwise("pending")
    )


def features_ok(required: Column, supported: Column) -> Column:
    return F.size(F.array_except(required, supported)) == 0


def effective_category(category: Column) -> Column:
    return F.coalesce(category, F.lit("build_failure"))


def will_retry(category: Column, attempt: Column, max_tries: Column | int = P.MAX_ATTEMPTS) -> Column:
    return is_retryable(effective_category(category)) & (attempt < max_tries)


def next_attempt_at_ms(
    completed_ms: Column, attempt: Column, *, step_ms: int = P.RETRY_BACKOFF_STEP_MS
) -> Column:
    return completed_ms + F.lit(step_ms).cast("bigint") * attempt


def completion_outcome(
    accepted: Column, success: Column, category: Column, attempt: Column, max_tries: Column | int = P.MAX_ATTEMPTS
) -> Column:
    return (
        F.when(~accepted, "ignored")
        .when(success, "success")
        .when(will_retry(category, attempt, max_tries), "flaky_retry")
        .otherwise("failure")
    )


def attr_cached(cache_status_json: Column, is_cached: Column) -> Column:
    """``cacheStatus`` must be the JSON *string* ``cached``; a local copy does not count."""
    return F.coalesce(cache_status_json == "cached", F.lit(False)) | F.coalesce(is_cached, F.lit(False))


def progress_percent(done: Column, failed: Column, total: Column, sealed: Column) -> Column:
    """Null until the job is sealed, since the total still grows."""
    return F.when(
        sealed, F.when(total > 0, (done + failed) * F.lit(100.0) / total).otherwise(F.lit(100.0))
    )
