"""JSON documents: evaluator lines, ingest batches, job events, stored snapshots.

Each parser takes a DataFrame with a ``value`` string column, so the same code serves
``spark.read.text``, ``spark.readStream`` and tables that hold JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rivetgraph import params as P, schemas
from rivetgraph.functions.outcomes import attr_cached

CORRUPT = "_corrupt_record"


def _parse(value: Column, ddl: str) -> Column:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return F.from_json(value, f"{ddl}, {CORRUPT} STRING", options)


def eval_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-04: (good lines, bad lines). A bad line is set aside, never fatal.

    ``cached`` applies the skip rule; blank lines are no lines. ``cacheStatus`` counts
    only as a JSON string, which ``get_json_object`` plus the raw text tells apart.
    """
    parsed = lines.where(F.trim("value") != "").withColumn("p", _parse(F.col("value"), schemas.EVAL_LINE))
    bad = parsed.where(F.col(f"p.{CORRUPT}").isNotNull() | F.col("p").isNull()).drop("p")
    carried = [c for c in lines.columns if c != "value"]
    status_is_text = F.col("value").rlike(r'"cacheStatus"\s*:\s*"')
    good = parsed.where(F.col(f"p.{CORRUPT}").isNull()).select(
        *carried,
        F.col("p.drvPath").alias("drv_path"),
        F.coalesce("p.attr", "p.name").alias("label"),
        F.col("p.attr").alias("attr"),
        F.col("p.name").alias("name"),
        F.col("p.error").alias("error"),
        attr_cached(F.when(status_is_text, F.col("p.cacheStatus")), F.col("p.isCached")).alias("cached"),
        F.coalesce("p.neededBuilds", F.array().cast("array<string>")).alias("needed_builds"),
    )
    return good, bad


def eval_errors(good: DataFrame) -> DataFrame:
    """Error lines as (attr, error), named by attr, else name, else ``<unknown>``."""
    carried = [c for c in good.columns if c in ("run_id", "job_id", "line_no")]
    return good.where(F.col("error").isNotNull()).select(
        *carried, F.coalesce("label", F.lit("<unknown>")).alias("attr"), "error"
    )


def ingest_batches(docs: DataFrame) -> DataFrame:
    """SRC-05: batches with the wire defaults filled in (empty lists, not root, no attr)."""
    none = F.array().cast("array<string>")
    parsed = docs.withColumn("b", F.from_json("value", schemas.INGEST_BATCH))
    drvs = F.transform(
        F.coalesce("b.drvs", F.array().cast(schemas.DRVS_DDL)),
        lambda d: d.withField("required_features", F.coalesce(d["required_features"], none))
        .withField("input_drvs", F.coalesce(d["input_drvs"], none))
        .withField("is_root", F.coalesce(d["is_root"], F.lit(False))),
    )
    errors = F.coalesce("b.eval_errors", F.array().cast(schemas.EVAL_ERRORS_DDL))
    return parsed.select(
        *[c for c in docs.columns if c != "value"], drvs.alias("drvs"), errors.alias("eval_errors")
    )


def batch_rows(batches: DataFrame) -> DataFrame:
    """One row per sent derivation with ``pos``, its place in the batch."""
    carried = [c for c in batches.columns if c not in ("drvs", "eval_errors")]
    return batches.select(*carried, F.posexplode("drvs").alias("pos", "d")).select(*carried, "pos", "d.*")


def job_events(lines: DataFrame) -> DataFrame:
    """SRC-06: events of known kind; lines that do not parse are skipped."""
    parsed = lines.withColumn("e", _parse(F.col("value"), schemas.JOB_EVENT))
    carried = [c for c in lines.columns if c != "value"]
    known = F.col(f"e.{CORRUPT}").isNull() & F.col("e.kind").isin(*P.EVENT_KINDS)
    return parsed.where(known).select(*carried, "e.*").drop(CORRUPT)


def snapshots(jobs: DataFrame) -> DataFrame:
    """SRC-07: ``snapshot`` struct from ``result``; null where it does not parse."""
    parsed = _parse(F.col("result"), schemas.STATUS_SNAPSHOT)
    return (
        jobs.withColumn("__s", parsed)
        .withColumn(
            "snapshot",
            F.when(
                F.col(f"__s.{CORRUPT}").isNull() & F.col("__s.status").isNotNull(),
                F.col("__s").dropFields(CORRUPT),
            ),
        )
        .drop("__s")
    )
