"""Near copies of vectors through a robust-pruned flat graph.

Equal vectors fold into one. Centres fitted on a bounded sample cut the space into shards;
every vector goes to its ``OVERLAP`` nearest shards, the nearest is its home. Shards above
``BLOCK`` vectors are cut into blocks by hash. In each block a graph is built by robust
pruning of near and random candidates; the adjacency lists that a vector got in its shards
are united. Then every vector is searched for in its home shard, block by block: greedily
from the medoid with a beam, then outwards through all nodes within the range. Every link is
verified by its cosine in double precision and counted for both its ends, whichever found it;
a pair that two shards could find counts in the smaller one. Pairs are no rows: all links of
two blocks are united where they meet, and every class they touch gives one row.

Recall is audited by brute force on ``AUDIT`` vectors against all (``MAX_AUDIT`` where those
have fewer than ``AUDIT_LINKS`` links); below ``TARGET_RECALL`` the search is repeated with
twice the overlap and beam. ``audited_recall`` is null where the sample has no link at all.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing and are their own component, equal ones too; vectors of different lengths link
with nothing of another length; repeated rows each count as a vector; a null vec_id takes
part, and is a component's id only if it holds no other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rivetgraph.llm.common import components, mapped
from rivetgraph.session import cut

THRESHOLD = 0.95
OVERLAP = 2
SHARD = 700
BLOCK = 1024
SAMPLE = 8192
MAX_CENTRES = 512
DEGREE = 24
ALPHA = 1.2
BEAM = 24
AUDIT = 256
MAX_AUDIT = 2048
AUDIT_LINKS = 100
TARGET_RECALL = 0.95
ROUNDS = 3


def unit(x: list | None) -> list[float] | None:
    """The vector at length one, in double precision; None if it can't link."""
    if not x or any(v is None for v in x):
        return None
    v = np.array(x, np.float64)
    top = np.abs(v).max() if np.isfinite(v).all() else 0.0
    if not top > 0:
        return None
    v = v / top
    return (v / np.sqrt((v * v).sum())).tolist()


def centres_of(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means on the sample, started from rows spread over it."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(8):
        near = (sample @ c.T).argmax(axis=1)
        for i in range(k):
            rows = sample[near == i]
            if len(rows):
                m = rows.sum(axis=0)
                c[i] = m / max(np.sqrt((m * m).sum()), 1e-12)
    return c


def prune(v: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust-pruned neighbours [n, degree] of every vector; -1 where there are fewer."""
    n = len(v)
    out = np.full((n, degree), -1, np.int32)
    if n == 1:
        return out
    dist = np.sqrt(np.maximum(2 - 2 * (v @ v.T), 0))
    np.fill_diagonal(dist, np.inf)
    near = np.argsort(dist, axis=1)[:, : min(n - 1, 3 * degree)]
    far = np.random.RandomState(n).randint(0, n, (n, min(n, degree)))
    cand = np.concatenate([near, far], axis=1)
    rows = np.arange(n)
    d = dist[rows[:, None], cand]
    for slot in range(degree):
        best = d.argmin(axis=1)
        live = np.isfinite(d[rows, best])
        if not live.any():
            break
        pick = cand[rows, best]
        out[live, slot] = pick[live]
        drop = alpha * dist[pick[:, None], cand] <= d
        d[drop | (cand == pick[:, None])] = np.inf
        d[~live] = np.inf
    return out


def range_search(v: np.ndarray, adj: np.ndarray, q: np.ndarray, threshold: float, beam: int) -> np.ndarray:
    """Cosines [queries, nodes] of the nodes a search has reached, -2 for the others."""
    n, m = len(v), len(q)
    sim = np.full((m, n), -2.0)
    done = np.zeros((m, n), bool)
    medoid = int((v @ v.sum(axis=0)).argmax())
    sim[:, medoid] = q @ v[medoid]
    rows = np.arange(m)
    for step in range(4 * beam):
        open_ = np.where(done, -3.0, sim)
        best = open_.argmax(axis=1)
        if step >= beam:
            kth = np.partition(sim, -min(beam, n), axis=1)[:, -min(beam, n)]
            live = open_[rows, best] >= np.maximum(kth, -1.5)
        else:
            live = open_[rows, best] > -1.5
        if not live.any():
            break
        at = rows[live]
        done[at, best[live]] = True
        to = adj[best[live]]
        _reach(sim, v, q, np.repeat(at, to.shape[1]), to.ravel())
    links = np.zeros((n, n), np.float32)
    have = adj >= 0
    links[np.repeat(np.arange(n), have.sum(axis=1)), adj[have]] = 1
    while True:
        front = (sim >= threshold - 0.05) & ~done
        if not front.any():
            return sim
        done |= front
        a, b = np.nonzero(front.astype(np.float32) @ links > 0)
        _reach(sim, v, q, a, b)


def _reach(sim: np.ndarray, v: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    new = (b >= 0) & (sim[a, np.maximum(b, 0)] < -1.5)
    a, b = a[new], b[new]
    for i in range(0, len(a), 200_000):
        x, y = a[i : i + 200_000], b[i : i + 200_000]
        sim[x, y] = np.einsum("ij,ij->i", q[x], v[y])


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, v = pdf["cid"].to_numpy(), np.stack(pdf["x"].to_numpy())
    adj = prune(v)
    return pd.DataFrame({"cid": ids, "near": [ids[a[a >= 0]].tolist() for a in adj]})


def _joined(hit: np.ndarray, to: np.ndarray, own: np.ndarray, every: np.ndarray) -> np.ndarray:
    """The smallest class of ``every`` that the hits [own, to] join each with."""
    label, at = np.arange(len(every)), np.searchsorted(every, to)
    for a, row in zip(np.searchsorted(every, own), hit):
        some = np.unique(np.append(label[at[row]], label[a]))
        if len(some) > 1:
            label[np.isin(label, some)] = some[0]
    return every[label]


def _hits(ask: pd.DataFrame, node: pd.DataFrame, shard: int, threshold: float, beam: int) -> np.ndarray:
    """Which of ``node`` each home row of ``ask`` finds, rows that ask nothing left False.

    A pair of two homes may be open to a search in either; it counts in the smaller shard alone.
    """
    out = np.zeros((len(ask), len(node)), bool)
    home = ask["home"].to_numpy(bool)
    if not home.any() or not len(node):
        return out
    place = {c: i for i, c in enumerate(node["cid"].tolist())}
    lists = [[place[c] for c in near if c in place] for near in node["near"]]
    adj = np.full((len(node), max(1, max(map(len, lists)))), -1, np.int32)
    for i, x in enumerate(lists):
        adj[i, : len(x)] = x
    q, v = np.stack(ask["x"][home].to_numpy()), np.stack(node["x"].to_numpy())
    hit = range_search(v, adj, q, threshold, beam) >= threshold
    mine = np.stack(ask["shards"][home].to_numpy())
    theirs = np.array([s[0] for s in node["shards"]])
    for k in range(mine.shape[1]):
        hit &= (mine[:, k][:, None] != theirs[None, :]) | (theirs >= shard)[None, :]
    hit &= ask["cid"].to_numpy()[home][:, None] != node["cid"].to_numpy()[None, :]
    out[home] = hit
    return out


def _search(threshold: float, beam: int):
    """Links of one block with itself or with another block of its shard. What either side
    finds counts for both; a class only found, never asking here, is credited too."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, lo, hi = int(pdf["shard"].iloc[0]), pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        a = pdf[pdf["block"] == lo].reset_index(drop=True)
        b = a if lo == hi else pdf[pdf["block"] == hi].reset_index(drop=True)
        link = _hits(a, b, shard, threshold, beam)
        link |= link.T if lo == hi else _hits(b, a, shard, threshold, beam).T
        ids, to = a["cid"].to_numpy(), b["cid"].to_numpy()
        every = np.unique(np.concatenate([ids, to]))
        root = _joined(link, to, ids, every)
        found = np.zeros(len(every), np.int64)
        found[np.searchsorted(every, ids)] = link @ b["size"].to_numpy()
        if lo != hi:
            found[np.searchsorted(every, to)] = link.T @ a["size"].to_numpy()
        said = found > 0
        return pd.DataFrame({"cid": every[said], "found": found[said], "root": root[said]}).astype("int64")

    return run


def _graph_links(classes: DataFrame, n: int, threshold: float, overlap: int, beam: int) -> DataFrame:
    """classes(cid, x, size) → cid, found (links to other classes' vectors), root (smallest
    class that a search group's links join it with, or itself). One vector length only."""
    k = min(MAX_CENTRES, max(1, -(-n * overlap // SHARD)))
    taken = classes.orderBy(F.xxhash64("cid")).limit(SAMPLE).select("x").toPandas()["x"]  # bounded sample
    centres = centres_of(np.stack(taken.to_numpy()), min(k, len(taken)))

    def assign(c: dict) -> dict:
        near = np.argsort(-(np.array(c["x"]) @ centres.T), axis=1, kind="stable")[:, :overlap] if c["x"] else []
        return {
            "cid": [i for i, s in zip(c["cid"], near) for _ in s],
            "x": [x for x, s in zip(c["x"], near) for _ in s],
            "size": [x for x, s in zip(c["size"], near) for _ in s],
            "shard": [int(j) for s in near for j in s],
            "home": [j == 0 for s in near for j in range(len(s))],
            "shards": [s.tolist() for s in near for _ in s],
        }

    schema = "cid bigint, x array<double>, size bigint, shard int, home boolean, shards array<int>"
    placed = mapped(classes.select("cid", "x", "size"), assign, schema)
    counts = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    # a row per centre, at most MAX_CENTRES
    placed = cut(
        placed.join(F.broadcast(counts), "shard").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    )
    built = placed.groupBy("shard", "block").applyInPandas(_build, "cid bigint, near array<bigint>")
    united = built.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = placed.join(united, "cid").withColumn("other", other)
    pairs = pairs.select(
        "shard", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        "block", "home", "shards", "cid", "x", "size", "near",
    )
    searched = pairs.groupBy("shard", "lo", "hi")
    return searched.applyInPandas(_search(threshold, beam), "cid bigint, found bigint, root bigint")


def audit(classes: DataFrame, counts: DataFrame, threshold: float, sample: int = AUDIT) -> float | None:
    """Share of the true links of ``sample`` classes that ``counts`` has, by brute force over
    all; None where these classes have no link."""
    left = classes.join(counts, "cid", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    rows = left.orderBy(F.xxhash64("cid", F.lit(7))).limit(sample).toPandas()
    if not len(rows):
        return None
    q, own = np.stack(rows["x"].to_numpy()), rows["cid"].to_numpy()

    def brute(c: dict) -> dict:
        v, ids, size = np.array(c["x"]).reshape(-1, q.shape[1]), np.array(c["cid"]), np.array(c["size"])
        hit = (v @ q.T >= threshold) & (ids[:, None] != own[None, :])
        return {"q": own.tolist(), "n": (size @ hit).tolist() if len(v) else [0] * len(own)}

    true = mapped(classes.select("cid", "x", "size"), brute, "q bigint, n bigint").groupBy("q").agg(F.sum("n").alias("n"))
    want = {r.q: r.n for r in true.collect()}  # a row per sampled class
    total = sum(want.values())
    if total < AUDIT_LINKS and len(rows) == sample < MAX_AUDIT:
        return audit(classes, counts, threshold, MAX_AUDIT)
    return sum(min(f, want[c]) for c, f in zip(own, rows["found"])) / total if total else None


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept, and the audited recall."""
    raw = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    made = mapped(
        raw, lambda c: {"vec_id": c["vec_id"], "x": [unit(e) for e in c["e"]]}, "vec_id bigint, x array<double>"
    )
    rows = cut(made)
    folded = rows.where("x is not null").groupBy("x").agg(
        F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("first_id")
    )
    # numbered in the written table
    classes = cut(folded.withColumn("cid", F.monotonically_increasing_id()))
    lengths = [(r[0], r[1]) for r in classes.groupBy(F.size("x")).count().collect()]  # a row per vector length
    found: DataFrame | None = None
    recall: float | None = None
    for length, n in lengths:
        own = classes.where(F.size("x") == length)
        for step in range(ROUNDS):
            links = cut(_graph_links(own, n, threshold, OVERLAP * 2**step, BEAM * 2**step))
            counts = links.groupBy("cid").agg(F.sum("found").alias("found"))
            got = audit(own, counts, threshold)
            if got is None or got >= TARGET_RECALL:
                break
        recall = got if recall is None else recall if got is None else min(recall, got)
        found = links if found is None else found.unionByName(links)
    alone = rows.where("x is null").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    if found is None:
        out = alone
    else:
        groups = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
        counts = found.groupBy("cid").agg(F.sum("found").alias("found"))
        named = classes.join(counts, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
        named = named.withColumn("root", F.coalesce("root", "cid"))
        least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
        per = named.join(least, "root").select(
            "x", "component_id", (F.col("size") - 1 + F.coalesce("found", F.lit(0))).alias("n_links")
        )
        out = rows.join(per, "x").select("vec_id", "n_links", "component_id").unionByName(alone)
    kept = F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    return out.select("vec_id", "n_links", "component_id", kept, F.lit(recall).cast("double").alias("audited_recall"))
