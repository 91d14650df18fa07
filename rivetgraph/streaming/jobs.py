"""The event stream of CI runs: routing, flow counts, gaps, folds, dedup, upserts.

What needs state in event-time order is in ``stateful``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rivetgraph import params as P
from rivetgraph.functions.logtext import stored_size
from rivetgraph.functions.paths import output_path
from rivetgraph.operators.blocks import first_per_key, max_before
from rivetgraph.session import cut, table_path
from rivetgraph.sources.documents import job_events
from rivetgraph.streaming.bucketed import VERSION, BucketedTable
from rivetgraph.streaming.runner import drain, finish


def routed(lines: DataFrame) -> DataFrame:
    """ST-01: parse the stream and land it by kind; what does not parse is skipped."""
    return drain(job_events(lines), partition_by=["kind"])


def progress_ticks(events: DataFrame, *, every_secs: int = P.PROGRESS_TICK_SECS, late: str) -> DataFrame:
    """ST-02, flow counts per job and tick (job_id, kind, ts, …), batch or stream; the levels
    are in ``stateful.progress_levels``."""
    kind = F.col("kind")
    return (
        events.withWatermark("ts", late)
        .groupBy("job_id", F.window("ts", f"{every_secs} seconds").alias("w"))
        .agg(
            F.count_if(kind == "drv_started").alias("started"),
            F.count_if(kind == "drv_completed").alias("completed"),
            F.count_if(kind == "drv_failed").alias("failed"),
        )
        .select("job_id", F.col("w.start").alias("tick"), "started", "completed", "failed")
    )


def missed_events(events: DataFrame) -> DataFrame:
    """ST-03, stream form: per job, how many sequence numbers are missing so far."""
    return events.groupBy("job_id").agg(
        F.max("seq").alias("last_seq"),
        (F.max("seq") - F.min("seq") + 1 - F.count(F.lit(1))).alias("missed"),
    )


def sequence_gaps(events: DataFrame) -> DataFrame:
    """ST-03, batch form: each gap (job_id, seq, missed), the event after it named by seq.

    The sequence ascends, so the number before is the largest one so far.
    """
    rows = max_before(events.select("job_id", "seq"), [F.col("seq")], F.col("seq"), keys=["job_id"], out="prev")
    missed = F.col("seq") - F.col("prev") - 1
    return rows.select("job_id", "seq", missed.alias("missed")).where(F.col("missed") > 0)


RUN_COLUMNS = ("job_id", "ended_seq", "status", "retries", "own_failures", "progress_seq", "progress")


def run_summaries(events: DataFrame) -> DataFrame:
    """One row per job of what these events say, up to the job's first job_done."""
    e = F.col("kind")
    ends = events.where(e == "job_done").groupBy("job_id").agg(F.min("seq").alias("ended_seq"))
    live = events.join(ends, "job_id", "left").where(F.col("ended_seq").isNull() | (F.col("seq") <= F.col("ended_seq")))
    failed, retry = e == "drv_failed", F.coalesce("will_retry", F.lit(False))
    own = F.coalesce("error_category", F.lit("")) != "propagated_failure"
    progress_seq = F.when(e == "progress", F.col("seq"))
    return live.groupBy("job_id").agg(
        F.min("ended_seq").alias("ended_seq"),
        F.min_by("status", F.when(e == "job_done", F.col("seq"))).alias("status"),
        F.count_if(failed & retry).alias("retries"),
        F.count_if(failed & ~retry & own).alias("own_failures"),
        F.max(progress_seq).alias("progress_seq"),
        F.max_by(F.when(e == "progress", F.col("progress")), progress_seq).alias("progress"),
    )


def fold_summaries(rows: DataFrame) -> DataFrame:
    """Summaries of a job's batches as one; what came after the batch that ended it is ignored.

    A job has few summaries at a time (the table's deltas)."""
    listed = rows.groupBy("job_id").agg(
        F.collect_list(F.struct(VERSION, *RUN_COLUMNS[1:])).alias("all"),
        F.min(F.when(F.col("ended_seq").isNotNull(), F.col(VERSION))).alias("last"),
    )
    counted = F.filter("all", lambda r: F.col("last").isNull() | (r[VERSION] <= F.col("last")))
    each = listed.select("job_id", F.inline(counted))
    return each.groupBy("job_id").agg(
        F.min("ended_seq").alias("ended_seq"),
        F.max("status").alias("status"),
        F.sum("retries").alias("retries"),
        F.sum("own_failures").alias("own_failures"),
        F.max("progress_seq").alias("progress_seq"),
        F.max_by("progress", "progress_seq").alias("progress"),
    ).select(*RUN_COLUMNS)


def folded_runs(events: DataFrame, **table: int) -> DataFrame:
    """ST-04: what a watcher of each run shows, up to the run's first job_done.

    Retries are counted, propagated failures do not count as failures of their own, the
    last progress wins, everything after the end is ignored.
    """
    return BucketedTable(events.sparkSession, ["job_id"], fold_summaries, **table).keep(events, run_summaries)


def dedup_within(rows: DataFrame, keys: Sequence[str], *, late: str) -> DataFrame:
    """ST-08, bounded state: repeats further apart than the watermark pass again."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def dedup_exact(stream: DataFrame, keys: Sequence[str], order: Sequence[str], **table: int) -> DataFrame:
    """ST-08, exact: the first row of each key over the whole stream, kept in a table.

    An earlier batch wins, inside a batch the smallest ``order``."""
    rest = [c for c in stream.columns if c not in keys]

    def fold(rows: DataFrame) -> DataFrame:
        first = F.min_by(F.struct(*rest), F.struct(VERSION, *order)).alias("r")
        return rows.groupBy(*keys).agg(first).select(*keys, "r.*")

    def prepare(batch: DataFrame) -> DataFrame:
        return first_per_key(batch, keys, [F.col(c) for c in order])

    return BucketedTable(stream.sparkSession, keys, fold, **table).keep(stream, prepare)


def cache_enriched(rows: DataFrame, failed_outputs: DataFrame, as_of: Column) -> DataFrame:
    """ST-09: stream-static join against the cache of known failures."""
    live = failed_outputs.where(F.col("expires_at") > as_of).select("output_path").distinct()
    return (
        rows.withColumn("output_path", output_path(F.col("drv_path")))
        .join(live.withColumn("__hit", F.lit(True)), "output_path", "left")
        .withColumn("cached_failed", F.coalesce("__hit", F.lit(False)))
        .drop("__hit")
    )


class LogArchive:
    """ST-10: the build-log archive as a table of rows and a table of blobs.

    A row names its blob (claim, upload); a batch writes the blobs of its winners only, and
    nothing else ever moves one. Compacting the blobs of a bucket keeps the newest of a claim.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, **table: int) -> None:
        path = path or table_path(spark, "log-archive")
        self.rows = BucketedTable(spark, ["claim_id"], fold_uploads, path=f"{path}/rows", **table)
        self.blobs = BucketedTable(spark, ["claim_id"], newest_blob, path=f"{path}/blobs", **table)

    def apply(self, version: int, uploads: DataFrame) -> None:
        """One batch of uploads (the archive's columns, log_gz and upload_id)."""
        sized = uploads.withColumn("stored_size", stored_size(F.col("log_gz")))
        delta = cut(batch_winners(sized.drop("log_gz")))
        won = delta.select("claim_id", F.col("upload_id").alias("__u"))
        blobs = uploads.select("claim_id", "upload_id", "log_gz").join(
            won.withColumnRenamed("claim_id", "__c"),
            (F.col("claim_id") == F.col("__c")) & F.col("upload_id").eqNullSafe(F.col("__u")),
            "left_semi",
        )
        # a repeated upload id of a claim has one blob
        self.blobs.apply(version, blobs.dropDuplicates(["claim_id"]))
        self.rows.apply(version, delta)

    def keep(self, uploads: DataFrame) -> LogArchive:
        finish(uploads.writeStream.foreachBatch(lambda batch, version: self.apply(version, batch)), uploads.sparkSession)
        return self

    def listing(self) -> DataFrame:
        """One row per claim; no blob is read."""
        return self.rows.read()

    def with_blobs(self, claims: DataFrame) -> DataFrame:
        """claim_id and log_gz of the claims asked for, each blob fetched once."""
        wanted = self.listing().join(claims.select("claim_id"), "claim_id", "left_semi").select("claim_id", "upload_id")
        return self.blobs.raw().drop(VERSION).join(wanted, ["claim_id", "upload_id"]).select("claim_id", "log_gz")


REFRESHED_ROW = ("original_size", "truncated", "stored_at", "stored_size", "upload_id")


def batch_winners(uploads: DataFrame) -> DataFrame:
    """One row per claim: the first upload's columns, the newest one's sizes, time and id."""
    return _first_and_last(uploads, F.struct("stored_at", "upload_id"))


def fold_uploads(rows: DataFrame) -> DataFrame:
    return _first_and_last(rows, F.col(VERSION)).drop(VERSION)


def _first_and_last(rows: DataFrame, order: Column) -> DataFrame:
    refreshed = [c for c in rows.columns if c in REFRESHED_ROW]
    kept = [c for c in rows.columns if c != "claim_id" and c not in refreshed]
    return rows.groupBy("claim_id").agg(
        F.min_by(F.struct(*kept), order).alias("first"), F.max_by(F.struct(*refreshed), order).alias("last")
    ).select("claim_id", "first.*", "last.*")


def newest_blob(rows: DataFrame) -> DataFrame:
    """The blobs that are the newest of their claim: versions are compared, then one is kept."""
    newest = rows.groupBy("claim_id").agg(F.max(VERSION).alias("__newest"))
    kept = rows.join(newest, "claim_id").where(F.col(VERSION) == F.col("__newest"))
    return kept.drop(VERSION, "__newest")
