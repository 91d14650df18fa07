"""Store-path and identifier columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TRAILING_DRV = r"(\.drv)+$"
# Characters a file name may not hold.
UNSAFE_FILENAME = "[/\\\\:*?\"<>|\\x00]"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def drv_hash_from_path(path: Column) -> Column:
    """The file name, or null where it is not ``<hash>-<name>.drv``-like."""
    base = basename(path)
    return F.when(base.endswith(".drv") & base.contains("-"), base)


def output_path(path: Column) -> Column:
    return F.regexp_replace(path, TRAILING_DRV, "")


def placeholder_name(path: Column) -> Column:
    """Name for a step known only as someone's input."""
    stem = output_path(basename(path))
    dash = F.instr(stem, "-")
    return F.when(dash > 0, F.substring(stem, dash + F.lit(1), F.length(stem))).otherwise(stem)


def comma_list(text: Column) -> Column:
    """Split, trim, drop empties, keep order. Null text gives an empty list."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p, F.lit(" \t\r\n")))
    return F.filter(parts, lambda p: p != "")


def sanitize_filename(name: Column) -> Column:
    clean = F.regexp_replace(name, UNSAFE_FILENAME, "_")
    return F.when(clean.isin("", ".", ".."), F.lit("_")).otherwise(clean)


def short_id(value: Column) -> Column:
    return F.substring(value.cast("string"), 1, 8)
