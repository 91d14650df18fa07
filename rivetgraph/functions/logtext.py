"""Build-log bytes: tails, caps, sizes, gzip."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from rivetgraph import params as P


def _continuation(data: Column, pos: int) -> Column:
    """Byte ``pos`` (1-based) is inside a multi-byte character (10xxxxxx)."""
    return F.hex(F.substring(data, pos, 1)).between("80", "BF")


def log_tail(text: Column, *, max_bytes: int = P.LOG_TAIL_BYTES) -> Column:
    """At most ``max_bytes`` from the end, never starting inside a character."""
    data = text.cast("binary")
    tail = F.substring(data, -max_bytes, max_bytes)
    skip = (
        F.when(~_continuation(tail, 1), 0)
        .when(~_continuation(tail, 2), 1)
        .when(~_continuation(tail, 3), 2)
        .otherwise(3)
    )
    trimmed = F.substring(tail, skip + F.lit(1), F.lit(max_bytes)).cast("string")
    return F.when(F.octet_length(data) <= max_bytes, text).otherwise(trimmed)


def capped_log(data: Column, *, max_bytes: int = P.RAW_LOG_BYTES) -> Column:
    """Struct of the kept bytes, whether the head was dropped, and the size before."""
    size = F.octet_length(data).cast("bigint")
    kept = F.when(size <= max_bytes, data).otherwise(F.substring(data, -max_bytes, max_bytes))
    return F.struct(
        kept.alias("kept"),
        (size > max_bytes).alias("truncated"),
        F.least(size, F.lit(P.U32_MAX)).alias("original_size"),
    )


def stored_size(log_gz: Column) -> Column:
    return F.octet_length(log_gz).cast("bigint")


def compression_ratio(original_size: Column, stored: Column) -> Column:
    """``stored``: the stored size, a column of the archive."""
    return original_size / F.nullif(stored, F.lit(0))


GUNZIPPED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


_SLICE = 100  # values that are Python objects at a time


def _sliced(values: pa.Array, one: Callable, kind: pa.DataType) -> pa.Array:
    parts = [
        pa.array([one(v) for v in values.slice(at, _SLICE).to_pylist()], kind) for at in range(0, len(values), _SLICE)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(GUNZIPPED)
def gunzip(blobs: pa.Array) -> pa.Array:
    """Text with bad bytes replaced; a corrupt archive gives an error instead."""

    def one(blob):
        if blob is None:
            return {"text": None, "error": None}
        try:
            return {"text": gzip.decompress(blob).decode("utf-8", errors="replace"), "error": None}
        except (OSError, EOFError, zlib.error) as exc:
            return {"text": None, "error": f"corrupt gzip: {exc}"}

    return _sliced(blobs, one, pa.struct([("text", pa.string()), ("error", pa.string())]))


@F.arrow_udf(T.BinaryType())
def gzip_text(texts: pa.Array) -> pa.Array:
    return _sliced(texts, lambda t: None if t is None else gzip.compress(t.encode("utf-8"), mtime=0), pa.binary())
