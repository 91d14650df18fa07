"""ST-01 … ST-11: streams over the given tables, drained and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivetgraph.functions.times import plus_seconds
from rivetgraph.plans.q_sources import event_text
from rivetgraph.plans.q_workers import resets_sql
from rivetgraph.plans.registry import query
from rivetgraph.plans.views import Tables
from rivetgraph.streaming import jobs as sj, stateful
from rivetgraph.streaming.runner import drain, drain_updates, file_stream

DAY = 86_400


class Streams(Tables):
    """The same views, with every given table read as a stream."""

    def raw(self, name: str):
        schema = self.spark.read.parquet(f"{self.dir}/{name}.parquet").schema
        # as a pattern, since a stream takes a plain path for a folder
        return file_stream(self.spark, f"{self.dir}/{name}.parque[t]", schema)


def live(t: Tables) -> Streams:
    return Streams(t.spark, t.dir)


@query(
    "st_01_event_router",
    "SELECT kind, seq, duration_ms FROM ev WHERE seq % 50 <> 0 AND NOT (seq % 50 = 1 AND kind LIKE 'drv_%')",
)
def _(t):
    return sj.routed(event_text(live(t))).select("kind", "seq", "duration_ms")


@query(
    "st_02_progress_ticks",
    """SELECT job_id, time_bucket(INTERVAL 1 HOUR, ts) AS tick, count(*) FILTER (kind = 'drv_started') AS started, count(*) FILTER (kind = 'drv_completed') AS completed,
              count(*) FILTER (kind = 'drv_failed') AS failed FROM ev GROUP BY ALL""",
)
def _(t):
    return drain_updates(sj.progress_ticks(live(t).ev, every_secs=3600, late="1 minute"), ["job_id", "tick"])


@query("st_03_missed_events", "SELECT job_id, max(seq) AS last_seq, max(seq) - min(seq) + 1 - count(*) AS missed FROM ev GROUP BY ALL")
def _(t):
    return drain_updates(sj.missed_events(live(t).ev), ["job_id"])


@query(
    "st_03_sequence_gaps",
    """SELECT job_id, seq, missed FROM (SELECT job_id, seq, seq - lag(seq) OVER (PARTITION BY job_id ORDER BY seq) - 1 AS missed FROM ev) WHERE missed > 0""",
)
def _(t):
    return sj.sequence_gaps(t.ev)


@query(
    "st_04_run_fold",
    """WITH done AS (SELECT job_id, min(seq) AS ended_seq FROM ev WHERE kind = 'job_done' GROUP BY ALL),
            live AS (SELECT ev.*, d.ended_seq FROM ev LEFT JOIN done d USING (job_id) WHERE d.ended_seq IS NULL OR seq <= d.ended_seq)
       SELECT job_id, any_value(ended_seq) AS ended_seq, 'status ' || any_value(ended_seq) AS status, count(*) FILTER (kind = 'drv_failed' AND seq % 3 = 0) AS retries,
              count(*) FILTER (kind = 'drv_failed' AND seq % 3 > 0 AND seq % 5 > 0) AS own_failures, max(seq) FILTER (kind = 'progress') AS progress_seq,
              max_by(duration_ms, seq) FILTER (kind = 'progress') AS progress FROM live GROUP BY job_id""",
)
def _(t):
    stream = live(t)
    events = stream.ev.select(
        "job_id",
        "seq",
        "kind",
        (F.col("seq") % 3 == 0).alias("will_retry"),
        F.when(F.col("seq") % 5 == 0, "propagated_failure").otherwise("transient").alias("error_category"),
        F.concat(F.lit("status "), F.col("seq").cast("string")).alias("status"),
        F.col("duration_ms").alias("progress"),
    )
    return sj.folded_runs(events)


# The streams' watermark stands an hour behind their newest row; what is at or before it is settled.
LATE, LATE_MS = "1 hour", 3_600_000


def settled(rows: str, us: str) -> str:
    return f"{us} <= (SELECT max(epoch_us({rows}.ts)) // 1000 - {LATE_MS} FROM {rows}) * 1000"


def results(stream_rows):
    return stateful.split_late(drain(stream_rows))[0]


CHECKED = "SELECT * FROM ev WHERE kind IN ('drv_failed', 'drv_started')"
QUARANTINE_SQL, QUARANTINE_VIEWS = resets_sql(settled("checked", "epoch_us(ts)"))


@query("st_05_streaming_quarantine", QUARANTINE_SQL, **QUARANTINE_VIEWS, checked=CHECKED)
def _(t):
    bad = F.col("kind") == "drv_failed"
    events = live(t).ev.where(bad | (F.col("kind") == "drv_started")).select("worker_id", "ts", bad.alias("is_failure"))
    changes = results(stateful.quarantine_stream(events, threshold=5, window_secs=3 * DAY, cooldown_secs=DAY, late=LATE))
    return stateful.quarantines_of(changes)


# Leases of 20 or 30 s by job, some with a lifetime of 40 s; long builds extend after 15 and 29 s.
@query(
    "st_06_lease_expiry",
    f"""SELECT claim_id, due2 AS expired_us, CASE WHEN due2 >= hard THEN 'hard_ceiling' ELSE 'lease_lapsed' END AS cause
        FROM extended WHERE (open OR epoch_us(ended_at) >= due2) AND {settled("lease_events", "due2")}""",
    terms="""SELECT *, epoch_us(started_at) AS t0, CASE WHEN job_id % 3 = 0 THEN 20 ELSE 30 END * 1000000 AS w,
                    CASE WHEN job_id % 2 = 0 THEN epoch_us(started_at) + 40000000 END AS hard FROM attempts""",
    extended="""SELECT *, CASE WHEN duration_ms >= 29000 AND t0 + 29000000 < due1 THEN least(t0 + 29000000 + w, hard) ELSE due1 END AS due2
                FROM (SELECT *, CASE WHEN duration_ms >= 15000 THEN least(t0 + 15000000 + w, hard) ELSE t0 + w END AS due1 FROM terms)""",
    lease_events="""SELECT started_at AS ts FROM attempts UNION ALL SELECT started_at + to_seconds(15) FROM attempts WHERE duration_ms >= 15000
                    UNION ALL SELECT started_at + to_seconds(29) FROM attempts WHERE duration_ms >= 29000 UNION ALL SELECT ended_at FROM attempts WHERE NOT open""",
)
def _(t):
    event = lambda ts, kind: F.struct(ts.alias("ts"), F.lit(kind).alias("kind"))
    start, took = F.col("started_at"), F.col("duration_ms")
    each = F.array(
        event(start, "issue"),
        event(F.when(took >= 15_000, plus_seconds(start, 15)), "extend"),
        event(F.when(took >= 29_000, plus_seconds(start, 29)), "extend"),
        event(F.when(~F.col("open"), F.col("ended_at")), "complete"),
    )
    window = F.when(F.col("job_id") % 3 == 0, F.lit(20))
    lifetime = F.when(F.col("job_id") % 2 == 0, F.lit(40))
    events = live(t).attempts.select("claim_id", window.alias("window_secs"), lifetime.alias("lifetime_secs"), F.inline(each))
    return results(stateful.lease_expiries(events.where(F.col("ts").isNotNull()), window_secs=30, late=LATE))


@query(
    "st_07_heartbeat_timeout",
    f"""WITH b AS (SELECT job_id, epoch_us(ts) AS us, CASE WHEN ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS opens FROM ev),
            s AS (SELECT job_id, us, sum(opens) OVER (PARTITION BY job_id ORDER BY us) AS n FROM b),
            e AS (SELECT job_id, n, max(us) + 43200000000 AS out_us FROM s GROUP BY ALL)
       SELECT job_id, min(out_us) AS cancelled_us FROM e WHERE {settled("ev", "out_us")} GROUP BY ALL""",
)
def _(t):
    beats = live(t).ev.select("job_id", "ts")
    return results(stateful.heartbeat_timeouts(beats, gap_secs=12 * 3600, forget_secs=None, late=LATE))


@query("st_08_dedup_within_watermark", "SELECT DISTINCT worker_id, kind FROM ev")
def _(t):
    rows = sj.dedup_within(live(t).ev.select("worker_id", "kind", "ts"), ["worker_id", "kind"], late="400 days")
    return drain(rows).select("worker_id", "kind")


@query("st_08_dedup_exact", "SELECT worker_id, kind, min(seq) AS seq FROM ev GROUP BY ALL")
def _(t):
    stream = live(t)
    return sj.dedup_exact(stream.ev.select("worker_id", "kind", "seq"), ["worker_id", "kind"], ["seq"])


@query(
    "st_09_cache_enrichment",
    """SELECT drv_hash, output_path, output_path IN (SELECT output_path FROM failed_outputs WHERE expires_at > TIMESTAMP '1995-01-01') AS cached_failed
       FROM (SELECT drv_hash, regexp_replace(drv_path, '(\\.drv)+$', '') AS output_path FROM steps)""",
)
def _(t):
    rows = sj.cache_enriched(live(t).steps.select("drv_hash", "drv_path"), t.failed_outputs, F.lit("1995-01-01").cast("timestamp"))
    return drain(rows).select("drv_hash", "output_path", "cached_failed")


@query(
    "st_10_log_upsert_stream",
    """SELECT claim_id, first(drv_hash ORDER BY up) AS drv_hash, first(attempt ORDER BY up) AS attempt,
              last(original_size ORDER BY up) AS original_size, last(truncated ORDER BY up) AS truncated, last(stored_at ORDER BY up) AS stored_at
       FROM (SELECT claim_id // 4 AS claim_id, drv_hash, attempt, original_size, truncated, stored_at, claim_id AS up FROM build_logs) GROUP BY ALL""",
)
def _(t):
    uploads = live(t).build_logs.select(
        F.floor(F.col("claim_id") / 4).alias("claim_id"),
        "drv_hash",
        "attempt",
        "original_size",
        "truncated",
        "log_gz",
        "stored_at",
        F.col("claim_id").alias("upload_id"),
    )
    return sj.LogArchive(t.spark).keep(uploads).listing().drop("upload_id", "stored_size")


@query(
    "st_11_terminal_detection",
    f"""WITH run AS (SELECT job_id, us, sum(CAST(kind = 'member' AS INT)) OVER w AS members, sum(CAST(kind = 'finished' AS INT)) OVER w AS finished,
                    sum(CAST(kind = 'failed' AS INT)) OVER w AS failed, bool_or(kind = 'seal') OVER w AS sealed, row_number() OVER w AS n
                    FROM life WHERE {settled("life", "us")}
                    WINDOW w AS (PARTITION BY job_id ORDER BY us, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT job_id, us AS ended_us, CAST(finished AS BIGINT) AS finished, CAST(failed AS BIGINT) AS failed FROM run WHERE sealed AND finished + failed >= members
        QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n) = 1""",
    life="""
SELECT job_id, started_at AS ts, 'member' AS kind, 1 AS ord, epoch_us(started_at) AS us FROM attempts
UNION ALL SELECT job_id, ended_at, CASE WHEN success THEN 'finished' ELSE 'failed' END, CASE WHEN success THEN 2 ELSE 3 END, epoch_us(ended_at) FROM attempts
UNION ALL SELECT job_id, done_at, 'seal', 4, epoch_us(done_at) FROM jobs WHERE sealed""",
)
def _(t):
    stream = live(t)
    end = F.when(F.col("success"), "finished").otherwise("failed")
    each = F.array(
        F.struct(F.col("started_at").alias("ts"), F.lit("member").alias("kind")),
        F.struct(F.col("ended_at").alias("ts"), end.alias("kind")),
    )
    seals = stream.jobs.where("sealed").select("job_id", F.col("done_at").alias("ts"), F.lit("seal").alias("kind"))
    events = stream.attempts.select("job_id", F.inline(each)).unionByName(seals)
    return results(stateful.terminal_jobs(events, forget_secs=None, late=LATE))


# Levels by the minute: each attempt is announced 5 s before it starts; open ones never end.
@query(
    "st_02_progress_levels",
    f"""WITH ticks AS (SELECT job_id, (us // 60000000 + 1) * 60000000 AS tick_us, sum(total) AS total, sum(done) AS done, sum(failed) AS failed, sum(retries) AS retries,
                            sum(propagated) AS propagated, bool_or(sealed) AS sealed FROM steps_log GROUP BY ALL),
             levels AS (SELECT job_id, tick_us, sum(total) OVER w AS total, sum(done) OVER w AS done, sum(failed) OVER w AS failed, sum(retries) OVER w AS retries,
                               sum(propagated) OVER w AS propagated, bool_or(sealed) OVER w AS sealed FROM ticks WINDOW w AS (PARTITION BY job_id ORDER BY tick_us)),
             flying AS (SELECT l.job_id, l.tick_us, count(*) AS building, string_agg(a.claim_id || '@' || epoch_us(a.started_at), '|' ORDER BY a.started_at, a.claim_id) AS in_flight
                        FROM levels l JOIN attempts a ON a.job_id = l.job_id AND epoch_us(a.started_at) < l.tick_us AND (a.open OR epoch_us(a.ended_at) >= l.tick_us) GROUP BY ALL)
        SELECT job_id, tick_us, CAST(total AS BIGINT) AS total, CAST(greatest(0, total - done - failed - coalesce(building, 0)) AS BIGINT) AS pending,
               CAST(coalesce(building, 0) AS BIGINT) AS building, CAST(done AS BIGINT) AS done, CAST(failed AS BIGINT) AS failed, CAST(retries AS BIGINT) AS retries,
               CAST(propagated AS BIGINT) AS propagated, sealed, coalesce(in_flight, '') AS in_flight
        FROM levels LEFT JOIN flying USING (job_id, tick_us) WHERE {settled("steps_log", "tick_us")}""",
    steps_log="""
SELECT *, epoch_us(ts) AS us FROM (
SELECT job_id, started_at - to_seconds(5) AS ts, 1 AS total, 0 AS done, 0 AS failed, 0 AS retries, 0 AS propagated, false AS sealed FROM attempts
UNION ALL SELECT job_id, started_at, 0, 0, 0, 0, 0, false FROM attempts
UNION ALL SELECT job_id, ended_at, 0, CAST(success AS INT), CAST(error_category = 'build_failure' AS INT), CAST(error_category IN ('transient', 'disk_full') AS INT), 0, false
          FROM (SELECT * REPLACE (coalesce(error_category, '') AS error_category) FROM attempts WHERE NOT open)
UNION ALL SELECT job_id, ended_at + to_seconds(30), 0, 0, 1, 0, 1, false FROM attempts WHERE error_category = 'build_failure' AND NOT open AND duration_ms % 7000 = 0
UNION ALL SELECT job_id, ended_at + to_seconds(90), 0, 0, 0, 0, 0, true FROM attempts WHERE duration_ms % 5000 = 0)""",
)
def _(t):
    event = lambda ts, kind: F.struct(ts.alias("ts"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))
    ended, over = F.col("ended_at"), ~F.col("open")
    end = F.when(F.col("success"), "completed").when(F.col("error_category") == "build_failure", "failed").otherwise("retried")
    spoils = over & (F.col("error_category") == "build_failure") & (F.col("duration_ms") % 7000 == 0)
    each = F.array(
        event(plus_seconds(F.col("started_at"), -5), "member"),
        event(F.col("started_at"), "started"),
        event(F.when(over, ended), end),
        event(F.when(spoils, plus_seconds(ended, 30)), "propagated"),
        event(F.when(F.col("duration_ms") % 5000 == 0, plus_seconds(ended, 90)), "seal"),
    )
    events = live(t).attempts.select("job_id", F.col("claim_id").alias("step"), F.inline(each)).where(F.col("ts").isNotNull())
    levels = results(stateful.progress_levels(events, every_secs=60, late=LATE))
    shown = F.transform("in_flight", lambda o: F.concat(o["step"], F.lit("@"), o["started_us"].cast("string")))
    return levels.withColumn("in_flight", F.array_join(shown, "|"))
