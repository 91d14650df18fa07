"""Build-log archive: upsert, listings, export names, size ceiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rivetgraph import params as P
from rivetgraph.functions.logtext import gunzip
from rivetgraph.functions.paths import sanitize_filename
from rivetgraph.operators.blocks import first_per_key, numbered, running_total, zero
from rivetgraph.session import Rounds, cut, cut_counted

NO_LOG = "[log not available: no archived log and no inline log_tail]"  # fixed value: readers look for it
UPLOAD_ORDER = ("stored_at", "upload_id")
REFRESHED = ("log_gz", "original_size", "truncated", "stored_at", "stored_size")


def upsert_logs(existing: DataFrame, uploads: DataFrame) -> DataFrame:
    """SNK-04: one row per claim. The newest upload gives the blob, sizes and time; all
    other columns keep what the first one said.

    ``uploads`` = the table's columns plus upload_id, which tells a claim's uploads apart;
    ``existing`` counts as the oldest. Winners are found on the columns without blobs. A blob
    then moves at most once: rows that nothing was uploaded for pass as they are, the old
    blob of any other row is not read, and of the uploads only the winners' blobs are joined.
    """
    refreshed = [c for c in REFRESHED if c in existing.columns and c != "log_gz"]
    kept = [c for c in existing.columns if c not in ("claim_id", "log_gz", *refreshed)]
    at = F.struct(*UPLOAD_ORDER)
    new = cut(
        uploads.drop("log_gz")
        .groupBy("claim_id")
        .agg(F.min_by(F.struct(*kept), at).alias("first"), F.max_by(F.struct(*refreshed, "upload_id"), at).alias("last"))
    )
    untouched = existing.join(new.select("claim_id"), "claim_id", "left_anti")
    known = existing.select("claim_id", F.struct(*kept).alias("known"))
    touched = new.join(known, "claim_id", "left").select(
        "claim_id", F.coalesce("known", "first").alias("first"), "last", F.col("last.upload_id").alias("upload_id")
    )
    blobs = uploads.select("claim_id", "upload_id", "log_gz")
    won = touched.join(blobs, ["claim_id", "upload_id"]).select("claim_id", "first.*", "last.*", "log_gz")
    return untouched.unionByName(won.select(*existing.columns))


def attempt_history(logs: DataFrame) -> DataFrame:
    """WN-11: attempts of each (job, drv), newest first when sorted; no blob is read."""
    return logs.select(
        "job_id",
        "drv_hash",
        "attempt",
        "claim_id",
        "original_size",
        "stored_size",
        "truncated",
    )


def newest_logs(logs: DataFrame) -> DataFrame:
    """(job_id, drv_hash, claim_id) of the latest archived attempt of each (job, drv)."""
    keys = logs.select("job_id", "drv_hash", "attempt", "claim_id")
    order = [F.col("attempt").desc(), F.col("claim_id").desc()]
    return first_per_key(keys, ["job_id", "drv_hash"], order).drop("attempt")


def failure_logs(failures: DataFrame, logs: DataFrame) -> DataFrame:
    """JN-12: text for each originating failure: newest archived log, else the tail, else
    a note. ``logs``: job_id, drv_hash, attempt, claim_id and text, or log_gz, which is
    unpacked here; a corrupt archive counts as none.

    The newest attempts are found on keys; only what a failure asks for is fetched, by claim.
    """
    wanted = failures.where(F.col("propagated_from").isNull())
    asked = wanted.select("job_id", "drv_hash").distinct()
    newest = cut(newest_logs(logs).join(asked, ["job_id", "drv_hash"], "left_semi"))
    if "text" in logs.columns:
        texts = logs.join(newest.select("claim_id"), "claim_id", "left_semi").select("claim_id", F.col("text").alias("__text"))
    else:
        blobs = logs.join(newest.select("claim_id"), "claim_id", "left_semi").select("claim_id", "log_gz")
        texts = blobs.select("claim_id", gunzip("log_gz")["text"].alias("__text"))
    found = newest.join(texts, "claim_id").where(F.col("__text").isNotNull()).drop("claim_id")
    archived = F.col("__text").isNotNull()
    return (
        wanted.join(found, ["job_id", "drv_hash"], "left")
        .withColumn("content", F.coalesce("__text", "log_tail", F.lit(NO_LOG)))
        .withColumn(
            "log_source", F.when(archived, "archive").when(F.col("log_tail").isNotNull(), "tail").otherwise("none")
        )
        .drop("__text", "log_tail")
    )


def export_names(failures: DataFrame) -> DataFrame:
    """SNK-07: a file name of its own for every originating failure.

    ``failures``: records with a ``place`` that orders a job's rows. A row takes the smallest
    free number of its base name: ``base.log``, then ``base-2.log``, … The only other owner of
    the name ``base-m`` is the first row of a base spelt ``base-m``, its child. So:

    1. rows are numbered per (job, base), and for each child it is counted how many rows of
       its parent came before its first row;
    2. from parents to children, round by round: child ``m`` finds its name free, and its
       parent later skips ``m``, unless the parent had used all numbers up to ``m`` by then;
    3. the n-th use of a base takes its n-th number that is not skipped, found by counting
       the skipped numbers of lower rank in one ordered union.

    All orderings are by ranges; an array holds one base's children, not its rows.
    """
    own = failures.where(F.col("error_category") != "propagated_failure").select(
        "job_id", "place", "drv_hash", "drv_name", sanitize_filename(F.col("drv_name")).alias("base")
    )
    used = cut(numbered(own, [F.col("place")], keys=["job_id", "base"], out="use"))
    firsts = used.where("use = 1").select("job_id", "base", "place")
    kids, found = cut_counted(_children(firsts))
    taken, skipped = _skips(kids, used) if found else (None, None)
    if taken is None:
        numbers = used.withColumn("number", F.col("use"))
    else:
        numbers = _free_numbers(used, taken, skipped)
    suffix = F.when(F.col("number") == 1, "").otherwise(F.concat(F.lit("-"), F.col("number").cast("string")))
    named = numbers.withColumn("file_name", F.concat("base", suffix, F.lit(".log")))
    return named.select("job_id", "place", "drv_hash", "drv_name", "base", "file_name")


def _children(firsts: DataFrame) -> DataFrame:
    """(job_id, base, m, child, place) of bases spelt ``base-m``, where ``base`` is one too."""
    rule = r"^(.*)-([1-9][0-9]{0,17})$"
    m = F.regexp_extract("base", rule, 2)
    spelt = firsts.where(m != "").select(
        "job_id", F.regexp_extract("base", rule, 1).alias("base"), m.cast("bigint").alias("m"), F.col("base").alias("child"), "place"
    )
    return spelt.where("m > 1").join(firsts.select("job_id", "base"), ["job_id", "base"], "left_semi")


def _skips(kids: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(job_id, base) whose own name its parent took first; and (job_id, base, m, own_lost,
    k) of the numbers a base skips, the k-th of it from 0."""
    marks = used.select("job_id", "base", "place", F.lit(1).alias("one"), F.lit(None).cast("bigint").alias("m"), F.lit(None).cast("string").alias("child"))
    marks = marks.join(kids.select("job_id", "base"), ["job_id", "base"], "left_semi")
    both = marks.unionByName(kids.select("job_id", "base", "place", F.lit(0).alias("one"), "m", "child"))
    counted = running_total(both, [F.col("place")], F.col("one"), keys=["job_id", "base"], out="before")
    waiting = cut(counted.where("child is not null").select("job_id", "base", "m", "child", "before"))

    def step(acc: Column, kid: Column) -> Column:
        free = kid["before"] + F.col("own_lost") + acc["skips"] <= kid["m"] - 1
        row = F.struct(kid["m"].alias("m"), kid["child"].alias("child"), free.alias("free"), acc["skips"].alias("k"))
        return F.struct((acc["skips"] + free.cast("bigint")).alias("skips"), F.concat(acc["out"], F.array(row)).alias("out"))

    start = F.struct(
        F.lit(0).cast("bigint").alias("skips"),
        F.array().cast("array<struct<m:bigint,child:string,free:boolean,k:bigint>>").alias("out"),
    )
    rounds = Rounds(kids.sparkSession)
    named = waiting.select("job_id", F.col("child").alias("base"))
    ready = waiting.select("job_id", "base").distinct().join(named, ["job_id", "base"], "left_anti")
    ready = ready.withColumn("own_lost", F.lit(0))
    left = True
    while left:
        listed = waiting.join(ready, ["job_id", "base"]).groupBy("job_id", "base", "own_lost").agg(
            F.array_sort(F.collect_list(F.struct("m", "before", "child"))).alias("kids")
        )
        decided, left = rounds.add(listed.select("job_id", "base", "own_lost", F.inline(F.aggregate("kids", start, step)["out"])))
        ready = decided.select("job_id", F.col("child").alias("base"), (~F.col("free")).cast("int").alias("own_lost"))
    every = rounds.all()
    lost = every.where(~F.col("free")).select("job_id", F.col("child").alias("base"))
    return lost, every.where("free").select("job_id", "base", "m", "own_lost", "k")


def _free_numbers(used: DataFrame, lost: DataFrame, skipped: DataFrame) -> DataFrame:
    """``number`` of every use: its rank among the numbers that are neither skipped nor lost."""
    rows = used.join(lost.withColumn("__lost", F.lit(1)), ["job_id", "base"], "left").withColumn(
        "__lost", F.coalesce("__lost", F.lit(0))
    )
    parents = cut(skipped.select("job_id", "base").distinct())
    plain = rows.join(parents, ["job_id", "base"], "left_anti").withColumn("number", F.col("use") + F.col("__lost"))
    # a use of higher rank than the free numbers below a skipped one lies above it
    ranks = skipped.select("job_id", "base", (F.col("m") - 1 - F.col("own_lost") - F.col("k")).alias("use"), F.lit(1).alias("__skip"))
    held = rows.join(parents, ["job_id", "base"], "left_semi").withColumn("__skip", F.lit(0))
    both = held.unionByName(ranks, allowMissingColumns=True)
    order = [F.col("use"), F.col("__skip"), F.col("place")]
    above = running_total(both, order, F.col("__skip"), keys=["job_id", "base"], out="__above").where("__skip = 0")
    shifted = above.withColumn("number", F.col("use") + F.col("__lost") + F.col("__above"))
    return plain.select(*used.columns, "number").unionByName(shifted.select(*used.columns, "number"))


def export_failure_logs(named: DataFrame, path: str, *, as_files: bool = False) -> None:
    """SNK-05: logs under the names of ``export_names``.

    A table of (job_id, file_name, content), since a file each would mean millions of
    tiny objects. ``as_files`` writes them as text under job_id=/file_name= folders; that
    suits the few hundred failures of one run.
    """
    rows = named.select("job_id", "file_name", "content")
    if not as_files:
        rows.write.mode("overwrite").parquet(path)
        return
    text = rows.withColumnRenamed("content", "value").repartition("job_id", "file_name")
    text.write.partitionBy("job_id", "file_name").mode("overwrite").text(path)


def prune_to_ceiling(logs: DataFrame, *, max_bytes: int = P.LOG_STORE_CEILING_BYTES) -> DataFrame:
    """WN-03: ``keep`` per claim. Newest first until the ceiling; a total within it keeps all.

    Works on (claim, time, size) alone, so no blob is read or moved.
    """
    sizes = logs.select("claim_id", "stored_at", F.col("stored_size").alias("bytes"))
    newest_first = [F.col("stored_at").desc(), F.col("claim_id").desc()]
    summed = running_total(sizes, newest_first, F.col("bytes"), out="running_bytes")
    return summed.withColumn("keep", F.col("running_bytes") <= max_bytes).drop("running_bytes")


def log_bytes_per_job(logs: DataFrame, *, warn_at: int = P.LOG_BYTES_PER_JOB_WARN) -> DataFrame:
    """AG-14: running bytes per upload; ``crossed`` on the first at or over the threshold."""
    sizes = logs.select("job_id", "claim_id", "stored_at", F.col("stored_size").alias("bytes"))
    total = running_total(
        sizes, [F.col("stored_at"), F.col("claim_id")], F.col("bytes"), keys=["job_id"], out="job_bytes"
    )
    return total.withColumn(
        "crossed", (F.col("job_bytes") >= warn_at) & (F.col("job_bytes") - F.col("bytes") < warn_at)
    )


def archive_capacity(logs: DataFrame) -> DataFrame:
    """AG-25."""
    return logs.agg(
        F.coalesce(F.sum("stored_size"), zero()).alias("total_bytes"),
        F.count(F.lit(1)).alias("row_count"),
    )
