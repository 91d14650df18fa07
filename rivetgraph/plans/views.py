"""The given tables in the roles of the domain tables, for Spark and for the SQL oracle.

``Tables(spark, sf_dir)`` offers each view as an attribute; ``CTES`` holds the same view
as DuckDB SQL. Every view is row-local on its table (no window, no shuffle) except where
the role itself is an aggregate. Times are TIMESTAMP in UTC.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from rivetgraph.functions.logtext import stored_size
from rivetgraph.functions.paths import output_path
from rivetgraph.functions.times import plus_seconds
from rivetgraph.operators import failures as fail
from rivetgraph.operators.graph import layered_edges
from rivetgraph.session import cut

ATTEMPT_ORDER = ("ended_at", "claim_id")


def attempt_order():
    return [F.col(c) for c in ATTEMPT_ORDER]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def jobs(self) -> DataFrame:
        key = F.col("o_orderkey")
        created = F.col("o_orderdate").cast("timestamp")
        pending = F.col("o_orderstatus") == "P"
        return self.raw("orders").select(
            key.alias("job_id"),
            F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("external_ref"),
            F.when(F.col("o_orderstatus") == "F", "failed").when(pending, "pending").otherwise("done").alias("status"),
            (~pending).alias("sealed"),
            created.alias("created_at"),
            F.when(~pending, plus_seconds(created, (key % 72) * 3600)).alias("done_at"),
            plus_seconds(created, (key % 7) * 86400).alias("last_heartbeat"),
            (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
            F.when(key % 5 != 0, 1 + key % 4).alias("max_workers"),
            F.when(key % 3 == 0, F.lit(600) + key % 1000).alias("claim_deadline_secs"),
        )

    @cached_property
    def steps(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), key.cast("string"))
        features = F.filter(
            F.array(F.when(size % 3 == 0, F.lit("kvm")), F.when(size % 5 == 0, F.lit("big-parallel"))),
            lambda f: f.isNotNull(),
        )
        return self.raw("part").select(
            key.alias("drv_hash"),
            name.alias("drv_name"),
            F.concat(F.lit("/nix/store/"), F.lpad(key.cast("string"), 32, "0"), F.lit("-"), name, F.lit(".drv")).alias("drv_path"),
            F.when(size % 4 == 0, "aarch64-linux").otherwise("x86_64-linux").alias("system"),
            features.alias("required_features"),
        )

    @cached_property
    def layers(self) -> DataFrame:
        """part as nodes of a five-layer graph: node, layer, i."""
        key = F.col("p_partkey")
        return self.raw("part").select(
            key.alias("node"),
            (key % 5).cast("bigint").alias("layer"),
            F.floor(key / 5).alias("i"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        width = self.raw("part").agg(F.floor(F.count(F.lit(1)) / 5)).scalar()
        return layered_edges(self.layers, width, 2, lambda layer, i, _: i * 5 + layer, F.col("i"))

    @cached_property
    def latches(self) -> DataFrame:
        """part as step state: size says what became of the step."""
        key, size = F.col("p_partkey"), F.col("p_size")
        return self.raw("part").select(
            key.alias("drv_hash"),
            F.concat(F.lit("step-"), key.cast("string")).alias("drv_name"),
            ((size > 40) | (size < 6)).alias("finished"),
            (size < 6).alias("previous_failure"),
            size.between(20, 30).alias("runnable"),
            (size != 17).alias("created"),
            (size % 4).alias("tries"),
            F.lit(2).alias("max_tries"),
            F.round(F.col("p_retailprice") * 1000).cast("bigint").alias("next_attempt_at"),
            plus_seconds(F.lit("2024-01-01").cast("timestamp"), size * 1000 + key % 97).alias("ended_at"),
            F.substring("p_brand", 7, 2).cast("bigint").alias("brand"),
        )

    @cached_property
    def active_claims(self) -> DataFrame:
        return self.attempts.where(F.col("open") & F.col("success"))

    @cached_property
    def roots(self) -> DataFrame:
        key = F.col("p_partkey")
        attr = F.concat_ws(".", F.lit("packages"), F.col("p_brand"), key.cast("string"))
        return (
            self.raw("part")
            .where(key % 5 == 4)
            .select(key.alias("drv_hash"), F.when(key % 7 != 0, attr).alias("attr"))
        )

    def _attempts(self, node, worker) -> DataFrame:
        cents = lambda c: F.round(F.col(c) * 100).cast("bigint").cast("string")
        text = lambda c: F.col(c).cast("string")
        ship = F.col("l_shipdate").cast("timestamp")
        parts = [
            text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey"),
            cents("l_quantity"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"),
            F.col("l_returnflag"), F.col("l_linestatus"), F.unix_seconds(ship).cast("string"),
        ]
        ended = plus_seconds(ship, F.col("l_linenumber") * 60 + F.col("l_suppkey") % 60)
        flag, line = F.col("l_returnflag"), F.col("l_linestatus")
        return self.raw("lineitem").select(
            F.md5(F.concat_ws("|", *parts)).alias("claim_id"),
            F.col("l_orderkey").alias("job_id"),
            node.alias("drv_hash"),
            worker.alias("worker_id"),
            plus_seconds(ended, -F.col("l_quantity").cast("bigint")).alias("started_at"),
            ended.alias("ended_at"),
            (F.col("l_quantity") * 1000).cast("bigint").alias("duration_ms"),
            (flag == "N").alias("success"),
            F.when(flag == "R", "build_failure")
            .when((flag == "A") & (line == "F"), "transient")
            .when((flag == "A") & (line == "O"), "disk_full")
            .alias("error_category"),
            F.when(flag == "R", 1).when(flag == "A", 137).alias("exit_code"),
            (line == "O").alias("open"),
        )

    @cached_property
    def attempts(self) -> DataFrame:
        supp = F.col("l_suppkey")
        named = F.concat(F.lit("w"), supp.cast("string"))
        return self._attempts(F.col("l_partkey"), F.when(supp % 11 == 0, F.lit("")).otherwise(named))

    @cached_property
    def retried(self) -> DataFrame:
        """Attempts on twenty steps and three workers, so that keys repeat."""
        named = F.concat(F.lit("w"), (F.col("l_suppkey") % 3).cast("string"))
        return self._attempts(F.col("l_partkey") % 20, named)

    @cached_property
    def retried_once(self) -> DataFrame:
        """``retried`` written out, for queries that read it several times: its keys are digests."""
        return cut(self.retried)

    def all_failures(self, attempts: DataFrame) -> DataFrame:
        null = F.lit(None)
        return attempts.where(~F.col("success")).select(
            "job_id",
            "drv_hash",
            F.concat(F.lit("step-"), F.col("drv_hash").cast("string")).alias("drv_name"),
            "error_category",
            F.concat(F.lit("exit "), F.col("exit_code").cast("string")).alias("error_message"),
            F.concat(F.lit("tail of "), F.col("claim_id")).alias("log_tail"),
            null.cast("bigint").alias("propagated_from"),
            "worker_id",
            "ended_at",
            "claim_id",
        )

    @cached_property
    def failures(self) -> DataFrame:
        return fail.first_failures(self.all_failures(self.attempts), attempt_order())

    @cached_property
    def retried_failures(self) -> DataFrame:
        return fail.first_failures(self.all_failures(self.retried), attempt_order())

    @cached_property
    def members(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("drv_hash")
        ).distinct()

    @cached_property
    def terminal_failures(self) -> DataFrame:
        """Build failures with the output they spoil."""
        bad = self.all_failures(self.attempts).where(F.col("error_category") == "build_failure")
        named = self.steps.select("drv_hash", output_path(F.col("drv_path")).alias("output_path"))
        return bad.join(named, "drv_hash").select(
            "output_path",
            "drv_hash",
            F.col("ended_at").alias("failed_at"),
            plus_seconds(F.col("ended_at"), 3600).alias("expires_at"),
            "worker_id",
            "error_category",
            F.lit(None).cast("bigint").alias("propagated_from"),
            "claim_id",
        )

    @cached_property
    def failed_outputs(self) -> DataFrame:
        first = (
            self.terminal_failures.groupBy("output_path", "drv_hash")
            .agg(F.min_by(F.struct("failed_at", "expires_at", "worker_id"), F.struct("failed_at", "claim_id")).alias("f"))
        )
        return first.select("output_path", "drv_hash", "f.*")

    @cached_property
    def ev(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            F.col("event_id").alias("seq"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("worker_id"),
            F.get_json_object("props", "$.k").cast("bigint").alias("job_id"),
            F.when(kind == "error", "drv_failed")
            .when(kind == "purchase", "drv_completed")
            .when(kind == "click", "drv_started")
            .when(kind == "view", "progress")
            .otherwise("job_done")
            .alias("kind"),
            F.round(F.col("value") * 1000).cast("bigint").alias("duration_ms"),
        )

    @cached_property
    def build_logs(self) -> DataFrame:
        """Documents as archived logs; their number of characters plays the sizes, so that a
        listing reads no text. ``log_gz`` holds the text bytes."""
        doc = F.col("doc_id")
        return self.raw("documents").select(
            doc.alias("claim_id"),
            (doc % 100).alias("job_id"),
            F.col("source").alias("drv_hash"),
            (1 + F.floor(doc / 100)).cast("int").alias("attempt"),
            (3 * F.col("n_chars")).alias("original_size"),
            F.col("n_chars").alias("stored_size"),
            (doc % 10 == 0).alias("truncated"),
            F.col("text").cast("binary").alias("log_gz"),
            "text",
            plus_seconds(F.lit("2024-01-01").cast("timestamp"), doc * 60).alias("stored_at"),
        )

    @cached_property
    def measured_logs(self) -> DataFrame:
        """``build_logs`` with the bytes of each whole text as its sizes."""
        size = F.octet_length("text").cast("bigint")
        return self.build_logs.withColumns({"original_size": size, "stored_size": stored_size(F.col("log_gz"))})


_ATTEMPTS = """
SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CAST(round(l_quantity * 100) AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT),
         CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT),
         l_returnflag, l_linestatus, CAST(epoch(l_shipdate) AS BIGINT))) AS claim_id,
       l_orderkey AS job_id, {node} AS drv_hash, {worker} AS worker_id,
       l_shipdate + to_seconds(l_linenumber * 60 + l_suppkey % 60 - CAST(l_quantity AS BIGINT)) AS started_at,
       l_shipdate + to_seconds(l_linenumber * 60 + l_suppkey % 60) AS ended_at,
       CAST(l_quantity * 1000 AS BIGINT) AS duration_ms, l_returnflag = 'N' AS success,
       CASE WHEN l_returnflag = 'R' THEN 'build_failure'
            WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'transient'
            WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'disk_full' END AS error_category,
       CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 137 END AS exit_code, l_linestatus = 'O' AS open
FROM lineitem"""

_ALL_FAILURES = """
SELECT job_id, drv_hash, 'step-' || drv_hash AS drv_name, error_category, 'exit ' || exit_code AS error_message,
       'tail of ' || claim_id AS log_tail, CAST(NULL AS BIGINT) AS propagated_from, worker_id, ended_at, claim_id
FROM {attempts} WHERE NOT success"""

_FIRST = " QUALIFY row_number() OVER (PARTITION BY job_id, drv_hash ORDER BY ended_at, claim_id) = 1"

CTES = {
    "jobs": """
SELECT o_orderkey AS job_id, 'cust-' || o_custkey AS external_ref,
       CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'pending' ELSE 'done' END AS status,
       o_orderstatus <> 'P' AS sealed, o_orderdate AS created_at,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_hours(o_orderkey % 72) END AS done_at,
       o_orderdate + to_hours((o_orderkey % 7) * 24) AS last_heartbeat,
       5 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
       CASE WHEN o_orderkey % 5 <> 0 THEN 1 + o_orderkey % 4 END AS max_workers,
       CASE WHEN o_orderkey % 3 = 0 THEN 600 + o_orderkey % 1000 END AS claim_deadline_secs
FROM orders""",
    "steps": """
SELECT p_partkey AS drv_hash, replace(p_name, ' ', '-') || '-' || p_partkey AS drv_name,
       '/nix/store/' || lpad(CAST(p_partkey AS VARCHAR), 32, '0') || '-' || replace(p_name, ' ', '-') || '-' || p_partkey || '.drv' AS drv_path,
       CASE WHEN p_size % 4 = 0 THEN 'aarch64-linux' ELSE 'x86_64-linux' END AS system,
       list_filter([CASE WHEN p_size % 3 = 0 THEN 'kvm' END, CASE WHEN p_size % 5 = 0 THEN 'big-parallel' END], lambda f: f IS NOT NULL) AS required_features
FROM part""",
    "edges": """
SELECT DISTINCT p_partkey AS src,
       (((p_partkey // 5) * 31 + k * 7 + p_partkey % 5) % (SELECT count(*) // 5 FROM part)) * 5 + p_partkey % 5 - 1 AS dst
FROM part, (VALUES (0), (1)) AS t(k) WHERE p_partkey % 5 > 0""",
    "roots": """
SELECT p_partkey AS drv_hash,
       CASE WHEN p_partkey % 7 <> 0 THEN 'packages.' || p_brand || '.' || p_partkey END AS attr
FROM part WHERE p_partkey % 5 = 4""",
    "latches": """
SELECT p_partkey AS drv_hash, 'step-' || p_partkey AS drv_name, p_size > 40 OR p_size < 6 AS finished, p_size < 6 AS previous_failure,
       p_size BETWEEN 20 AND 30 AS runnable, p_size <> 17 AS created, p_size % 4 AS tries, 2 AS max_tries,
       CAST(round(p_retailprice * 1000) AS BIGINT) AS next_attempt_at,
       TIMESTAMP '2024-01-01' + to_seconds(p_size * 1000 + p_partkey % 97) AS ended_at,
       CAST(substr(p_brand, 7, 2) AS BIGINT) AS brand
FROM part""",
    "active_claims": "SELECT * FROM attempts WHERE open AND success",
    "attempts": _ATTEMPTS.format(
        node="l_partkey", worker="CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE 'w' || l_suppkey END"
    ),
    "retried": _ATTEMPTS.format(node="l_partkey % 20", worker="'w' || (l_suppkey % 3)"),
    "failures": _ALL_FAILURES.format(attempts="attempts") + _FIRST,
    "retried_failures": _ALL_FAILURES.format(attempts="retried") + _FIRST,
    "members": "SELECT DISTINCT l_orderkey AS job_id, l_partkey AS drv_hash FROM lineitem",
    "terminal_failures": """
SELECT regexp_replace(s.drv_path, '(\\.drv)+$', '') AS output_path, a.drv_hash, a.ended_at AS failed_at,
       a.ended_at + to_seconds(3600) AS expires_at, a.worker_id, a.error_category,
       CAST(NULL AS BIGINT) AS propagated_from, a.claim_id
FROM attempts a JOIN steps s USING (drv_hash) WHERE a.error_category = 'build_failure'""",
    "failed_outputs": """
SELECT output_path, drv_hash, failed_at, expires_at, worker_id FROM terminal_failures
QUALIFY row_number() OVER (PARTITION BY output_path ORDER BY failed_at, claim_id) = 1""",
    "ev": """
SELECT event_id AS seq, ts, 'w' || user_id AS worker_id, CAST(props ->> '$.k' AS BIGINT) AS job_id,
       CASE event_type WHEN 'error' THEN 'drv_failed' WHEN 'purchase' THEN 'drv_completed'
            WHEN 'click' THEN 'drv_started' WHEN 'view' THEN 'progress' ELSE 'job_done' END AS kind,
       CAST(round(value * 1000) AS BIGINT) AS duration_ms
FROM events""",
    "build_logs": """
SELECT doc_id AS claim_id, doc_id % 100 AS job_id, source AS drv_hash, CAST(1 + doc_id // 100 AS INTEGER) AS attempt,
       3 * n_chars AS original_size, n_chars AS stored_size, doc_id % 10 = 0 AS truncated, text,
       TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS stored_at
FROM documents""",
}

# takes the place of ``build_logs`` in queries on sizes
MEASURED_LOGS = """
SELECT doc_id AS claim_id, doc_id % 100 AS job_id, source AS drv_hash, CAST(1 + doc_id // 100 AS INTEGER) AS attempt,
       CAST(strlen(text) AS BIGINT) AS original_size, doc_id % 10 = 0 AS truncated, text,
       TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS stored_at
FROM documents"""


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the views it uses, in order of need."""
    known = CTES | (extra or {})
    order: list[str] = []
    open_names: set[str] = set()

    def need(text: str) -> None:
        for name in known:
            if name not in open_names and re.search(rf"\b{name}\b", text):
                open_names.add(name)
                need(known[name])
                order.append(name)

    need(sql)
    head = ",\n".join(f"{n} AS ({known[n].strip()})" for n in order)
    own_with = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if own_with:
        return "WITH RECURSIVE " + (head + ",\n" if head else "") + sql[own_with.end():]
    return f"WITH RECURSIVE {head}\n{sql}" if head else sql
