"""Validation of ingest rows, requests and uploads.

Each function yields the name of the first broken rule, or null for a good row.
All sizes are bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rivetgraph import params as P
from rivetgraph.functions.paths import drv_hash_from_path


def first_broken(*rules: tuple[str, Column]) -> Column:
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules])


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def ingest_reject_reason(
    drv_path: Column,
    drv_name: Column,
    system: Column,
    input_count: Column,
    feature_count: Column,
    attr: Column,
    *,
    max_path_bytes: int = P.MAX_PATH_BYTES,
    max_name_bytes: int = P.MAX_NAME_BYTES,
    max_inputs: int = P.MAX_INPUTS_PER_DRV,
    max_features: int = P.MAX_FEATURES_PER_DRV,
    max_attr_bytes: int = P.MAX_IDENTIFIER_BYTES,
) -> Column:
    return first_broken(
        ("empty_field", _blank(drv_path) | _blank(drv_name) | _blank(system)),
        (
            "too_long",
            (F.octet_length(drv_path) > max_path_bytes) | (F.octet_length(drv_name) > max_name_bytes),
        ),
        ("too_many_inputs", input_count > max_inputs),
        ("too_many_features", feature_count > max_features),
        ("attr_too_long", F.octet_length(attr) > max_attr_bytes),
        ("bad_hash", drv_hash_from_path(drv_path).isNull()),
    )


def job_request_reject_reason(
    external_ref: Column,
    claim_deadline_secs: Column,
    max_workers: Column,
    *,
    max_identifier_bytes: int = P.MAX_IDENTIFIER_BYTES,
) -> Column:
    return first_broken(
        ("external_ref_too_long", F.octet_length(external_ref) > max_identifier_bytes),
        ("zero_claim_deadline", claim_deadline_secs == 0),
        ("zero_max_workers", max_workers == 0),
    )


def worker_id_reject_reason(
    worker_id: Column, *, admin: bool = False, max_identifier_bytes: int = P.MAX_IDENTIFIER_BYTES
) -> Column:
    rules = [("worker_id_too_long", F.octet_length(worker_id) > max_identifier_bytes)]
    if admin:
        rules.insert(0, ("worker_id_empty", _blank(worker_id)))
    return first_broken(*rules)


def batch_verdict(
    drv_count: Column, eval_error_count: Column, *, max_eval_errors: int = P.MAX_EVAL_ERRORS_PER_BATCH
) -> Column:
    """``empty`` (nothing to do), ``too_many_eval_errors`` (reject) or ``accept``."""
    return (
        F.when((drv_count == 0) & (eval_error_count == 0), "empty")
        .when(eval_error_count > max_eval_errors, "too_many_eval_errors")
        .otherwise("accept")
    )


def upload_reject_reason(
    body_bytes: Column,
    original_size: Column,
    truncated: Column,
    *,
    max_upload_bytes: int = P.UPLOAD_BYTES,
    max_raw_bytes: int = P.RAW_LOG_BYTES,
) -> Column:
    return first_broken(
        ("body_too_large", body_bytes > max_upload_bytes),
        ("size_without_truncation", (original_size > max_raw_bytes) & ~truncated),
    )
