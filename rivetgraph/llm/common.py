"""Pieces that the corpus operators share: words, shingles, text keys, components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from rivetgraph.session import cut, table_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(
    df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, max_bytes: int = 8 << 20
) -> DataFrame:
    """Arrow batches through ``fn``: columns as Python lists in, columns (lists or arrays) out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch, max_bytes):
                out = fn({n: piece.column(n).to_pylist() for n in piece.schema.names})
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(out.values(), target)],
                    schema=target,
                )

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``max_bytes``, so that Python objects stay few at a time."""
    step = max(1, int(batch.num_rows * max_bytes / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every ``k`` consecutive words; none if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * _MUL + (hashes[j : j + n] ^ (out >> np.uint64(31)))
    return mixed(out)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Distinct hashes of the text's ``k``-word shingles, sorted. A text of fewer words is
    one shingle made of all of them; a text without words has none."""
    h = word_hashes(words_of(text))
    if not len(h):
        return h
    return np.unique(grams(h, min(k, len(h))) + np.uint64(min(k, len(h)) * 2 + 1))


def text_key(text="text"):
    """128-bit content key of a text that any later pass can compute again."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) bigint pairs → (node, root): the smallest node of each node's component.

    Alternating large-star and small-star steps: every step is a minimum per node (combined
    before the shuffle) and a join that Spark may split where a node is hot. Every step is
    written to the shared folder; it ends when a step changes nothing.
    """
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen, path = Observation(), table_path(spark, "star")
        mark = F.bit_xor(F.xxhash64("u", "v")).alias("x")
        df.observe(seen, F.count(F.lit(1)).alias("n"), mark).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), (seen.get["n"], seen.get["x"])

    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    cur, state = written(edges.where("u <> v").select(high, low).distinct())
    while state[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(
            both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(parent, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt, after = written(moved.unionByName(parent.select("u", F.col("m").alias("v"))).distinct())
        cur, done, state = nxt, after == state, after
        if done:
            break
    roots = cur.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
