"""Keyed tables that a stream keeps up to date without rewriting them.

A table is cut by the hash of its key into buckets. A micro-batch adds one delta file set to
the buckets it touches and nothing to the others; a manifest per batch names the file sets of
each bucket. Reading folds base and deltas by key. A bucket with more than ``max_deltas``
deltas is compacted into a new base when the next batch touches it.

Manifest ``n`` is written last and made from manifest ``n − 1``, so a batch that is run again
overwrites its own files and gives the same table. File sets that manifest ``n`` has replaced
are removed once manifest ``n + 1`` stands, since until then batch ``n + 1`` may be run again.

    <path>/manifest/<batch>          one JSON line
    <path>/data/<batch>/bucket=<b>   deltas of a batch
    <path>/data/<batch>-base/bucket=<b>   compacted buckets
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from rivetgraph.session import table_path
from rivetgraph.streaming.runner import finish

BUCKETS = 64
MAX_DELTAS = 8
VERSION = "__v"  # the batch a row came with
Manifest = dict[str, list[str]]


class BucketedTable:
    """``fold`` turns rows with the column ``__v`` (any number per key) into one row per key,
    without ``__v``; folding what was folded, with the rows that followed, must give the same."""

    def __init__(
        self,
        spark: SparkSession,
        keys: Sequence[str],
        fold: Callable[[DataFrame], DataFrame],
        *,
        path: str | None = None,
        buckets: int = BUCKETS,
        max_deltas: int = MAX_DELTAS,
    ) -> None:
        self.spark, self.keys, self.fold = spark, list(keys), fold
        self.path = path or table_path(spark, "bucketed")
        self.buckets, self.max_deltas = buckets, max_deltas

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    # files

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _remove(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    def versions(self) -> list[int]:
        """Batches whose manifest stands."""
        fs, at = self._fs(f"{self.path}/manifest")
        if not fs.exists(at):
            return []
        done = (str(s.getPath()) for s in fs.listStatus(at))
        return sorted(int(p.rsplit("/", 1)[1]) for p in done if fs.exists(self._fs(f"{p}/_SUCCESS")[1]))

    def manifest(self, version: int) -> Manifest:
        """bucket → its file sets, the base first; empty before the first batch."""
        if version not in self.versions():
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{version}").first()[0])

    def _commit(self, version: int, manifest: Manifest) -> None:
        line = self.spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{version}")

    def _write(self, rows: DataFrame, label: str) -> list[int]:
        """One file set per bucket that has rows; the buckets."""
        seen = Observation()
        placed = rows.withColumn("bucket", self.bucket()).repartition("bucket")
        placed.observe(seen, F.collect_set("bucket").alias("b")).write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.path}/data/{label}"
        )
        return sorted(seen.get["b"])

    def _rows(self, sets: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/data/{s}" for s in sets]
        return self.spark.read.parquet(*paths)

    # use

    def apply(self, version: int, delta: DataFrame) -> None:
        """Batch ``version``: ``delta`` has at most one row per key."""
        before = self.manifest(version - 1)
        rows = delta.withColumn(VERSION, F.lit(version).cast("bigint"))
        touched = self._write(rows, str(version))
        after = {b: list(sets) for b, sets in before.items()}
        for b in touched:
            after.setdefault(str(b), []).append(f"{version}/bucket={b}")
        full = [str(b) for b in touched if len(after[str(b)]) > self.max_deltas + 1]
        if full:
            old = self._rows(s for b in full for s in after[b])
            base = self.fold(old).withColumn(VERSION, F.lit(version).cast("bigint")).select(rows.columns)
            for b in self._write(base, f"{version}-base"):
                after[str(b)] = [f"{version}-base/bucket={b}"]
        self._commit(version, after)
        for b in full:
            self._remove(f"{self.path}/data/{version}/bucket={b}")  # already in the new base
        self._sweep(version, before)

    def _sweep(self, version: int, before: Manifest) -> None:
        """Drop what manifest ``version − 1`` had already replaced."""
        old = self.manifest(version - 2)
        live = {s for sets in before.values() for s in sets}
        for s in (s for sets in old.values() for s in sets if s not in live):
            self._remove(f"{self.path}/data/{s}")
        if old:
            self._remove(f"{self.path}/manifest/{version - 2}")

    def raw(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version with ``__v``, not folded."""
        version = max(self.versions(), default=None) if version is None else version
        sets = [] if version is None else [s for b in self.manifest(version).values() for s in b]
        return self._rows(sets) if sets else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """One row per key, as of a batch (default: the newest)."""
        rows = self.raw(version)
        return None if rows is None else self.fold(rows)

    def keep(self, stream: DataFrame, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
        """Run ``stream`` to its end; ``prepare`` makes a micro-batch's delta."""
        finish(stream.writeStream.foreachBatch(lambda batch, version: self.apply(version, prepare(batch))), self.spark)
        return self.read()
