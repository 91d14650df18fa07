"""N-gram Jaccard join: MinHash bands find candidates, full shingle sets decide.

1. One pass over the texts gives each its band hashes. Equal texts fold into one class
   (grouped by content key, combined before the shuffle).
2. Classes that share a band hash with a bucket's smallest class fall into one cluster
   (connected components), so every candidate pair lies inside a cluster.
3. Each cluster is cut into blocks of bounded total shingles, and each pair of blocks is
   one group: an inverted index over its shingles gives all intersections exactly. A group
   gives back one row per class: its links, and its local root. No pair is ever a row.

Bands and rows come from the recall wanted at the threshold (:func:`choose_bands`).

Defined cases: a null text counts as empty; a text without words links with nothing and is
its own class; a text of fewer than k words is one shingle; a row whose doc_id is null takes
part and has a null class_id only if its whole group has none; repeated rows each get a row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rivetgraph.llm.common import components, mapped, mixed, shingles, text_key
from rivetgraph.session import cut

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.99999
BLOCK_SHINGLES = 400_000


def choose_bands(threshold: float, recall: float, max_hashes: int = 160) -> tuple[int, int]:
    """(bands, rows): the most selective bands that find a pair at ``threshold`` with
    probability ``recall`` and take at most ``max_hashes`` hash values."""
    best = (max_hashes, 1)
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def band_hashes(sh: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band; the same for equal shingle sets."""
    rng = np.random.RandomState(20240229)
    a = rng.randint(1, 2**62, bands * rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sh), 512):
        np.minimum(low, (sh[at : at + 512, None] * a).min(axis=0), out=low)
    low = low.reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64)
    for j in range(rows):
        out = mixed(out + low[:, j])
    return out.view(np.int64)


def _classes(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """One row per different text with words: cid, key, first_doc, size, n_sh, bands."""

    def sign(c: dict) -> dict:
        sets = [shingles(t, k) for t in c["text"]]
        return {
            "doc_id": c["doc_id"],
            "key": c["key"],
            "n_sh": [len(s) for s in sets],
            "bands": [band_hashes(s, bands, rows) if len(s) else [] for s in sets],
        }

    signed = mapped(docs, sign, "doc_id bigint, key binary, n_sh bigint, bands array<bigint>").where("n_sh > 0")
    folded = signed.groupBy("key").agg(
        F.min("doc_id").alias("first_doc"),
        F.count(F.lit(1)).alias("size"),
        F.first("n_sh").alias("n_sh"),
        F.first("bands").alias("bands"),
    )
    # numbered in the written table: a recomputed partition must not renumber classes
    return cut(folded.withColumn("cid", F.monotonically_increasing_id()))


def _verify(k: int, threshold: float):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("cid").sort_values("cid", ignore_index=True)
        n, block, size = len(pdf), pdf["block"].to_numpy(), pdf["size"].to_numpy()
        across = pdf["bi"].iat[0] != pdf["bj"].iat[0]
        sets = [shingles(t, k) for t in pdf["text"]]
        lens = np.array([len(s) for s in sets])
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(n), lens)[np.argsort(code, kind="stable")]
        width = np.bincount(code)
        first = np.cumsum(width) - width
        ends = np.cumsum(lens)
        found, label = np.zeros(n, np.int64), np.arange(n)
        for a in range(n):
            own = code[ends[a] - lens[a] : ends[a]]
            own = own[width[own] > 1]
            w = width[own]
            at = np.repeat(first[own] - np.cumsum(w) + w, w) + np.arange(w.sum())
            common = np.bincount(owner[at], minlength=n)
            near = common / (lens[a] + lens - common) >= threshold
            near[a] = False
            if across:
                near &= block != block[a]
            hit = np.flatnonzero(near)
            if len(hit):
                found[a] = size[hit].sum()
                joined = np.unique(np.append(label[hit], label[a]))
                if len(joined) > 1:
                    label[np.isin(label, joined)] = joined[0]
        ids = pdf["cid"].to_numpy()
        return pd.DataFrame({"cid": ids, "n_links": found, "root": ids[label]})

    return links


def _linked(docs: DataFrame, k: int, threshold: float, recall: float, block_shingles: int) -> DataFrame:
    """Per class: key, first_doc, class_doc (smallest doc_id of its group), top (cid of the
    class that stands for the group) and n_links of each of its documents."""
    classes = _classes(docs, k, *choose_bands(threshold, recall))
    banded = classes.select("cid", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("cid").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star = banded.join(shared, "band").where("cid <> v").select(F.col("cid").alias("u"), "v")
    cluster = cut(components(star))
    sized = cluster.join(classes.drop("bands"), F.col("node") == F.col("cid")).drop("node")
    blocks = sized.groupBy("root").agg(F.ceil(F.sum("n_sh") / block_shingles).cast("int").alias("blocks"))
    placed = sized.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    # the text of one row per class
    texts = (
        docs.withColumnRenamed("doc_id", "d")
        .join(placed, "key")
        .where(F.col("d").eqNullSafe(F.col("first_doc")))
    )
    pairs = texts.select(
        "root", "cid", "size", "block", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select(
        "root", "cid", "size", "block", "text",
        F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"),
    )
    links = cut(
        pairs.groupBy("root", "bi", "bj").applyInPandas(
            _verify(k, threshold), "cid bigint, n_links bigint, root bigint"
        )
    )
    groups = components(links.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("cid").agg(F.sum("n_links").alias("others"))
    named = (
        classes.select("cid", "key", "first_doc", "size")
        .join(groups.withColumnRenamed("node", "cid"), "cid", "left")
        .join(counts, "cid", "left")
        .withColumn("root", F.coalesce("root", "cid"))
    )
    least = named.groupBy("root").agg(
        F.min("first_doc").alias("class_doc"), F.min(F.struct(F.col("first_doc").isNull(), "first_doc", "cid")).alias("t")
    )
    return named.join(least, "root").select(
        "cid", "key", "first_doc", "class_doc", F.col("t.cid").alias("top"),
        (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
    )


def similar_documents(
    docs: DataFrame,
    k: int = SHINGLE_WORDS,
    threshold: float = THRESHOLD,
    recall: float = TARGET_RECALL,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of its group of linked
    documents) and n_links (other documents whose shingle sets reach ``threshold``)."""
    keyed = docs.select("doc_id", "text").withColumn("key", text_key())
    linked = _linked(keyed, k, threshold, recall, block_shingles).select("key", "class_doc", "n_links")
    rows = keyed.select("doc_id", "key", F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    worded = rows.where("worded").join(linked, "key").select("doc_id", F.col("class_doc").alias("class_id"), "n_links")
    bare = rows.where("not coalesce(worded, false)")
    return worded.unionByName(
        bare.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    )


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each group: the one of the smallest doc_id. Texts
    without words stay."""
    params = dict(k=SHINGLE_WORDS, threshold=THRESHOLD, recall=TARGET_RECALL, block_shingles=BLOCK_SHINGLES) | how
    keyed = docs.withColumn("__key", text_key())
    linked = _linked(keyed.select("doc_id", "text", F.col("__key").alias("key")), **params)
    tops = linked.where("cid = top").select(F.col("key").alias("__key"), F.col("first_doc").alias("__doc"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    first = keyed.where(worded).join(tops, "__key").where(F.col("doc_id").eqNullSafe(F.col("__doc")))
    # several rows are left here only where a row is repeated
    return first.dropDuplicates(["__key"]).select(*docs.columns).unionByName(docs.where(~worded))
