"""Derivation files (ATerm text) to rows.

ATerm differs from JSON in its tuples and in a few escapes. A file is rewritten to JSON
token by token and read by the standard JSON parser, field after field; then its shape
is checked. Spark spreads the files over the tasks and moves them as Arrow batches.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rivetgraph import schemas

TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[()]', re.S)
ODD_ESCAPE = re.compile(r'\\(?:(["\\nrt])|(.))', re.S)
DECODER = json.JSONDecoder(strict=False)
FIELDS = ("outputs", "inputDrvs", "inputSrcs", "system", "builder", "args", "env")


def _to_json(match: re.Match) -> str:
    token = match.group(0)
    if token == "(":
        return '{"tuple":['
    if token == ")":
        return "]}"
    # an escape JSON does not know keeps its backslash
    return ODD_ESCAPE.sub(lambda m: m.group(0) if m.group(1) else "\\\\" + m.group(2), token)


def _tuples(value, *kinds: type) -> list[list]:
    rows = [item["tuple"] for item in value]
    if any(len(r) != len(kinds) or not all(map(isinstance, r, kinds)) for r in rows):
        raise ValueError("tuple of the wrong shape")
    return rows


def _read(data: bytes) -> tuple[str | None, str | None, dict]:
    try:
        text = data.decode("utf-8").strip()
    except UnicodeDecodeError:
        return "NotUtf8", None, {}
    if not text.startswith("Derive("):
        return "MissingHeader", None, {}
    if not text.endswith(")"):
        return "MissingFooter", None, {}
    body = TOKEN.sub(_to_json, text[len("Derive(") : -1])
    fields, at = {}, 0
    for name in FIELDS:
        try:
            while body[at : at + 1].isspace():
                at += 1
            fields[name], at = DECODER.raw_decode(body, at)
            if name != FIELDS[-1]:
                at = body.index(",", at) + 1 if body[at:].lstrip()[:1] == "," else -1
                if at < 0:
                    raise ValueError("expected a comma")
        except ValueError as exc:
            return "BadSyntax", f"parsing {name}: {exc}", {}
    try:
        inputs = _tuples(fields["inputDrvs"], str, list)
        if not all(isinstance(o, str) for _, outs in inputs for o in outs):
            raise ValueError("output names must be strings")
        if not isinstance(fields["system"], str) or not isinstance(fields["builder"], str):
            raise ValueError("system and builder must be strings")
        if not isinstance(fields["inputSrcs"], list) or not isinstance(fields["args"], list):
            raise ValueError("inputSrcs and args must be lists")
        env = dict(reversed(_tuples(fields["env"], str, str)))
        row = {
            "outputs": [dict(zip(("name", "path", "hash_algo", "hash"), o)) for o in _tuples(fields["outputs"], *[str] * 4)],
            "input_drvs": [{"path": p, "outputs": outs} for p, outs in inputs],
            "system": fields["system"],
            "name": env.get("name", "unknown"),
        }
    except (ValueError, TypeError, KeyError) as exc:
        return "BadSyntax", str(exc), {}
    return None, None, row


def _parse_batches(batches):
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            error_class, context, row = _read(bytes(content))
            known = {"path": path, "error_class": error_class, "error_context": context}
            rows.append(dict.fromkeys(schemas.DERIVATION_COLUMNS) | known | row)
        yield pd.DataFrame(rows, columns=list(schemas.DERIVATION_COLUMNS))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.drv").load(path).select("path", "content")


def parse(files: DataFrame) -> DataFrame:
    """SRC-10: (path, content) to rows; a bad file has ``error_class`` and nothing else."""
    return files.select("path", "content").mapInPandas(_parse_batches, schemas.DERIVATION)


def is_fixed_output(outputs: Column) -> Column:
    """SRC-11."""
    return (F.size(outputs) == 1) & (F.get(outputs, F.lit(0))["hash"] != "")


def graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node), edges (src, dst) and fixed-output nodes of a parsed corpus."""
    good = parsed.where(F.col("error_class").isNull())
    nodes = good.select(F.col("path").alias("node"))
    edges = good.select(F.col("path").alias("src"), F.explode("input_drvs.path").alias("dst")).distinct()
    fixed = good.where(is_fixed_output(F.col("outputs"))).select(F.col("path").alias("node"))
    return nodes, edges, fixed
