"""Metrics exposition text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def metric_lines(lines: DataFrame) -> DataFrame:
    """SRC-08: (name, labels map, value). The value follows the last blank; comments,
    blank lines and non-numbers are dropped."""
    carried = [c for c in lines.columns if c != "value"]
    text = F.col("value")
    head = F.regexp_extract(text, r"^(.*) ([^ ]*)$", 1)
    number = F.regexp_extract(text, r"^(.*) ([^ ]*)$", 2).try_cast("double")
    label_text = F.regexp_extract(F.col("head"), r"\{(.*)\}", 1)
    pairs = F.regexp_extract_all(label_text, F.lit(r'(\w+="[^"]*")'), F.lit(1))
    labels = F.map_from_entries(
        F.transform(
            pairs,
            lambda p: F.struct(
                F.substring_index(p, "=", 1).alias("key"),
                F.regexp_extract(p, r'^\w+="(.*)"$', 1).alias("value"),
            ),
        )
    )
    return (
        lines.where(~text.startswith("#") & (F.trim(text) != "") & text.contains(" "))
        .select(*carried, head.alias("head"), number.alias("metric_value"))
        .where(F.col("metric_value").isNotNull())
        .select(*carried, F.substring_index("head", "{", 1).alias("name"), labels.alias("labels"), "metric_value")
    )


def select_metric(metrics: DataFrame, name: str, labels: dict[str, str] | None = None) -> DataFrame:
    """SRC-09: samples of one name that carry all wanted labels."""
    wanted: list[Column] = [F.col("labels")[k] == v for k, v in (labels or {}).items()]
    return metrics.where(reduce(Column.__and__, wanted, F.col("name") == name))
