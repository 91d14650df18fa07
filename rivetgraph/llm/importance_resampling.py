"""Importance resampling towards a target distribution, over hashed word features.

A feature is a run of 1 to ``n_max`` consecutive words; its bucket is the CRC-32 of its bytes
modulo ``n_buckets``. A bucket's gain is the smoothed log ratio of its share in the target to
its share in the corpus; a document weighs the mean gain of its features. The draw is without
replacement by Gumbel noise: of the documents long enough, the highest weight + noise stay.

CRCs are made for the distinct features of a slice of texts at a time: features of equal
length form the rows of a uint8 matrix, all their CRCs advance column by column by table
look-up, and the buckets are scattered back to the texts (``buckets``).

Two passes over the texts: the first sends a task's bucket counts (``n_buckets`` numbers), the
second needs the gains alone. Ranks are counted in ranges of the score, see
``blocks.numbered``. Nothing else leaves the tasks.

Defined cases: null and empty texts have no feature and weight 0; a null doc_id draws the noise
of an empty one; repeated rows are drawn each on its own; equal scores go by smaller doc_id
(null first); without documents the result is empty; an empty target gives gains from its
smoothing alone; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rivetgraph.llm.common import mapped, sliced
from rivetgraph.operators.blocks import numbered
from rivetgraph.session import cut

N_BUCKETS = 10_000
N_MAX = 1
SEED = "2024"
MIN_WORDS = 20
PERCENT = 10

# digits, lower-case letters and all bytes above ASCII are kept, capitals lowered, the rest parts words
_KEPT = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def crc32_rows(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a two-dimensional uint8 array."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in rows.T:
        crc = _CRC[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def buckets(features: list[bytes], n_buckets: int = N_BUCKETS) -> np.ndarray:
    """The bucket of every feature, by one matrix for each length."""
    size = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(size, kind="stable")
    out = np.empty(len(features), np.int64)
    for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        if not len(group):
            continue
        width = int(size[group[0]])
        # very long features come in pieces, so that a matrix stays small
        for part in np.array_split(group, max(1, len(group) * width >> 24)):
            joined = b"".join([features[i] for i in part])
            out[part] = crc32_rows(np.frombuffer(joined, np.uint8).reshape(len(part), width)) % n_buckets
    return out


def features_of(text: str | None, n_max: int = N_MAX) -> list[bytes]:
    words = text.encode().translate(_KEPT).split() if text else []
    out = words
    for n in range(2, n_max + 1):
        out = out + [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return out


def bucket_lists(texts: Iterable[str | None], n_buckets: int, n_max: int) -> list[np.ndarray]:
    """The buckets of every text's features, repeats included."""
    lists = [features_of(t, n_max) for t in texts]
    distinct = list(set(itertools.chain.from_iterable(lists)))
    place = dict(zip(distinct, buckets(distinct, n_buckets).tolist()))
    return [np.fromiter(map(place.__getitem__, f), np.int64, len(f)) for f in lists]


def bucket_counts(texts: DataFrame, n_buckets: int = N_BUCKETS, n_max: int = N_MAX) -> DataFrame:
    """(bucket, n) of all features of all texts; a task sends each bucket once."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for piece in sliced(batch):
                lists = bucket_lists(piece.column("text").to_pylist(), n_buckets, n_max)
                total += np.bincount(np.concatenate(lists), minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    per_task = texts.select("text").mapInArrow(counted, "bucket bigint, n bigint")
    return per_task.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS, n_max: int = N_MAX) -> np.ndarray:
    """Gain of every bucket; the driver holds ``n_buckets`` numbers."""
    both = bucket_counts(docs, n_buckets, n_max).withColumn("target", F.lit(False)).unionByName(
        bucket_counts(target, n_buckets, n_max).withColumn("target", F.lit(True))
    )
    s, t = np.zeros(n_buckets), np.zeros(n_buckets)
    for row in both.collect():
        (t if row.target else s)[row.bucket] = row.n
    return np.floor(
        1000 * np.log((t + 1) * (s.sum() + n_buckets) / ((s + 1) * (t.sum() + n_buckets)))
    ).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, n_max: int = N_MAX) -> DataFrame:
    """doc_id, n_features, n_words and weight of every row."""
    n_buckets = len(gain)

    def weighed(c: dict) -> dict:
        lists = bucket_lists(c["text"], n_buckets, n_max)
        size = [len(ids) for ids in lists]
        return {
            "doc_id": c["doc_id"],
            "n_features": size,
            "n_words": size if n_max == 1 else [len(features_of(t, 1)) for t in c["text"]],
            "weight": [int(gain[ids].sum()) // n if n else 0 for ids, n in zip(lists, size)],
        }

    return mapped(docs.select("doc_id", "text"), weighed, "doc_id bigint, n_features bigint, n_words bigint, weight bigint")


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    n_buckets: int = N_BUCKETS,
    n_max: int = N_MAX,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; the rank is null
    where a row is not drawn."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(
        weights(docs, gains(docs, target, n_buckets, n_max), n_max)
        .withColumn("score", F.col("weight") + noise)
        .withColumn("long", F.col("n_words") >= min_words)
    )
    ranked = numbered(
        scored.where("long"), [F.col("score").desc(), F.col("doc_id").asc_nulls_first()], out="rank"
    )
    room = scored.agg(F.floor(F.count_if("long") * percent / 100).alias("room"))
    drawn = ranked.join(F.broadcast(room), F.col("rank") <= F.col("room"), "left")
    rank = F.when(F.col("room").isNotNull(), F.col("rank"))
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(~F.col("long")).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return drawn.select(*columns, rank.alias("rank")).unionByName(rest)


# CRC-32 in SQL: two table look-ups a byte, low half first, over the hexadecimal digits of the bytes
def _nibble_table() -> str:
    t = np.arange(16, dtype=np.uint64)
    for _ in range(4):
        t = np.where(t & 1, (t >> np.uint64(1)) ^ np.uint64(0xEDB88320), t >> np.uint64(1))
    return "[" + ", ".join(map(str, t.tolist())) + "]"


ORACLE = f"""
WITH words AS (
  SELECT 0 AS part, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 1, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
crcs AS (
  SELECT w, (4294967295 - list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(0, CAST(length(h) AS BIGINT), 2), lambda i:
           [CAST(strpos('0123456789ABCDEF', h[i + 2]) - 1 AS BIGINT), CAST(strpos('0123456789ABCDEF', h[i + 1]) - 1 AS BIGINT)]))),
         lambda c, d: xor(({_nibble_table()})[xor(c & 15, d) + 1], c >> 4))) % 10000 AS b
  FROM (SELECT w, hex(w) AS h FROM (SELECT DISTINCT w FROM words))),
per AS (SELECT b, count(*) FILTER (part = 0) AS s, count(*) FILTER (part = 1) AS t FROM words JOIN crcs USING (w) GROUP BY b),
sums AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM per),
gain AS (SELECT b, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS g FROM per, sums),
per_doc AS (SELECT id AS doc_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS g FROM words JOIN crcs USING (w) JOIN gain USING (b) WHERE part = 0 GROUP BY id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN CAST(floor(g / n) AS BIGINT) ELSE 0 END AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM documents d LEFT JOIN per_doc USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.weight + s.noise AS score, CASE WHEN r.r <= 10 * r.n // 100 THEN r.r END AS rank
FROM scored s LEFT JOIN ranked r USING (doc_id)"""
