"""Durations as text and relative times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _parts(ms: Column) -> tuple[Column, Column, Column]:
    secs = F.floor(ms / 1000)
    return F.floor(secs / 3600), F.floor((secs % 3600) / 60), secs % 60


def fmt_ms(ms: Column) -> Column:
    h, m, s = _parts(ms)
    return (
        F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s))
        .when(m > 0, F.format_string("%dm %ds", m, s))
        .when(s > 0, F.format_string("%ds", s))
        .otherwise(F.format_string("%dms", ms))
    )


def format_elapsed(ms: Column) -> Column:
    """Two units at most, without blanks."""
    h, m, s = _parts(ms)
    return (
        F.when(h > 0, F.format_string("%dh%dm", h, m))
        .when(m > 0, F.format_string("%dm%ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )


def since(text: Column, as_of: Column) -> Column:
    """``<n>[smhd]`` before ``as_of``; null where the text is not of that form."""
    t = F.trim(text)
    n = F.regexp_extract(t, r"^([+-]?\d+)[smhd]$", 1)
    unit = F.substring(t, -1, 1)
    secs = (
        F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    ).cast("bigint")
    shift = n.try_cast("bigint") * secs
    return F.when(n != "", F.timestamp_micros(F.unix_micros(as_of) - shift * 1_000_000))


def plus_seconds(ts: Column, secs: Column | int) -> Column:
    secs = secs if isinstance(secs, Column) else F.lit(secs)
    return F.timestamp_micros(F.unix_micros(ts) + secs.cast("bigint") * 1_000_000)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)
