"""WN-04, WN-05, JN-09, JN-10 on the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivetgraph.operators import workers
from rivetgraph.plans.registry import query

DAY = 86_400
POLICY = {"threshold": 5, "window_secs": 3 * DAY}

VIEWS = {
    "counted": """
SELECT worker_id, ts, seq, count(*) OVER (PARTITION BY worker_id ORDER BY ts RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND CURRENT ROW) AS failures_in_window
FROM ev WHERE kind = 'drv_failed'""",
    "trips": "SELECT *, ts - lag(ts) OVER (PARTITION BY worker_id ORDER BY ts) > INTERVAL 1 DAY AS gap FROM counted WHERE failures_in_window >= 5",
    "islands": """
SELECT worker_id, min(ts) AS trip_ts, max(ts) + INTERVAL 1 DAY AS release_at, count(*) AS trips
FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap THEN 1 ELSE 0 END) OVER (PARTITION BY worker_id ORDER BY ts) AS island FROM trips) GROUP BY worker_id, island""",
}


def failed(t):
    return t.ev.where(F.col("kind") == "drv_failed").select("worker_id", "ts", "seq")


def checks(t):
    return t.ev.where(F.col("kind") == "drv_started").select("worker_id", "ts", "seq")


def intervals(t):
    return workers.quarantine_intervals(workers.trips(failed(t), **POLICY), cooldown_secs=DAY)


@query("wn_04_trailing_failures", "SELECT worker_id, ts, seq, failures_in_window FROM counted", **VIEWS)
def _(t):
    return workers.trailing_failures(failed(t), window_secs=3 * DAY)


@query("wn_05_quarantine_intervals", "SELECT worker_id, trip_ts, release_at, CAST(trips AS BIGINT) AS trips FROM islands", **VIEWS)
def _(t):
    return intervals(t)


def resets_sql(log: str = "TRUE") -> tuple[str, dict[str, str]]:
    """The quarantine rule step by step over the rows of ``ev`` where ``log`` holds: SQL and its views."""
    sql = """SELECT worker_id, trip AS trip_ts, ended AS release_at, cleared AS cleared_at FROM fold WHERE cleared IS NOT NULL
       UNION ALL SELECT worker_id, first_trip, release, NULL FROM (SELECT * FROM fold QUALIFY n = max(n) OVER (PARTITION BY worker_id)) WHERE release IS NOT NULL"""
    worker_log = f"SELECT worker_id, ts, kind = 'drv_failed' AS bad, row_number() OVER (PARTITION BY worker_id ORDER BY ts) AS n FROM ev WHERE kind IN ('drv_failed', 'drv_started') AND {log}"
    fold = """
SELECT DISTINCT worker_id, CAST(0 AS BIGINT) AS n, CAST([] AS TIMESTAMP[]) AS fails, CAST(NULL AS TIMESTAMP) AS release, CAST(NULL AS TIMESTAMP) AS first_trip,
       CAST(NULL AS TIMESTAMP) AS trip, CAST(NULL AS TIMESTAMP) AS ended, CAST(NULL AS TIMESTAMP) AS cleared FROM worker_log
UNION ALL
SELECT worker_id, n, CASE WHEN clears THEN CAST([] AS TIMESTAMP[]) ELSE kept END,
       CASE WHEN trips THEN ts + INTERVAL 1 DAY WHEN clears THEN NULL ELSE release END,
       CASE WHEN trips THEN coalesce(first_trip, ts) WHEN clears THEN NULL ELSE first_trip END,
       CASE WHEN clears THEN first_trip END, CASE WHEN clears THEN release END, CASE WHEN clears THEN ts END
FROM (SELECT f.worker_id, s.n, s.ts, f.first_trip, f.release,
             CASE WHEN s.bad THEN list_append(list_filter(f.fails, lambda x: x >= s.ts - INTERVAL 3 DAYS), s.ts) ELSE f.fails END AS kept,
             s.bad AND len(list_filter(f.fails, lambda x: x >= s.ts - INTERVAL 3 DAYS)) + 1 >= 5 AS trips,
             NOT s.bad AND f.release IS NOT NULL AND s.ts >= f.release AS clears
      FROM fold f JOIN worker_log s ON s.worker_id = f.worker_id AND s.n = f.n + 1)"""
    return sql, {"worker_log": worker_log, "fold": fold}


RESETS_SQL, RESETS_VIEWS = resets_sql()


@query("wn_05_quarantine_with_resets", RESETS_SQL, **RESETS_VIEWS)
def _(t):
    return workers.quarantine_with_resets(failed(t), checks(t), cooldown_secs=DAY, **POLICY)


@query(
    "jn_09_fence_filter",
    "SELECT claim_id, worker_id FROM attempts WHERE worker_id NOT IN (SELECT 'w' || s_suppkey FROM supplier WHERE s_acctbal < 0)",
)
def _(t):
    fenced = t.raw("supplier").where(F.col("s_acctbal") < 0)
    fenced = fenced.select(F.concat(F.lit("w"), F.col("s_suppkey").cast("string")).alias("worker_id"))
    return workers.unfenced(t.attempts.select("claim_id", "worker_id"), fenced)


@query(
    "jn_10_quarantine_as_of",
    """SELECT seq, EXISTS (SELECT 1 FROM islands i WHERE i.worker_id = ev.worker_id AND ev.ts >= i.trip_ts AND ev.ts < i.release_at) AS quarantined
       FROM ev WHERE kind = 'drv_started'""",
    **VIEWS,
)
def _(t):
    out = workers.quarantined_as_of(checks(t), intervals(t), cooldown_secs=DAY)
    return out.select("seq", "quarantined")
