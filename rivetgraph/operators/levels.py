"""Levels of a directed graph by counters: what can be resolved, and in which wave.

A node resolves once all that it waits for has; its level is one above the highest of them.
Nodes are dealt into blocks of bounded size. In a round every block takes the decrements that
came in from other blocks, resolves as far as its own edges carry it (many waves at once, on
arrays), and sends one decrement per node of another block that it touched. Only these and the
levels found are written; a block's counters are made again from its base and the decrements
since. Bases are compacted after 1, 2, 4, 8, … rounds, without what has been resolved.

Ids may carry a home in their lowest bits, so that the nodes of one job meet in one block: homes
are filled into blocks in turn, and one larger than a block is dealt over blocks of its own.

Edges of nodes with more than ``LIGHT`` edges out are not dealt to a block; Spark joins them
with the levels found, and sums of decrements are combined before they are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rivetgraph.session import Rounds, cut

BLOCK_ROWS = 400_000  # nodes and edges that one task holds
LIGHT = 10_000
HOMES = 4096  # a power of two; more rows than HOMES * BLOCK_ROWS only make homes larger than a block

# kinds of rows: a node and what it waits for, an edge, decrements taken and fresh, a level found
NODE, EDGE, TAKEN, FRESH, LEVEL = range(5)
ROW = "kind int, a bigint, b bigint, c bigint"
_SCHEMA = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])


class _Block:
    """Counters of one block's nodes and the edges that leave them."""

    def __init__(self, nodes: list[np.ndarray], edges: list[np.ndarray]) -> None:
        order = np.argsort(nodes[0])
        self.ids, self.need, self.level = (column[order] for column in nodes)
        self.open = np.ones(len(self.ids), bool)
        frm = np.searchsorted(self.ids, edges[0]).astype(np.int32)
        by_frm = np.argsort(frm, kind="stable")
        self.frm, self.to = frm[by_frm], edges[1][by_frm]
        del frm, by_frm
        self.starts = np.searchsorted(self.frm, np.arange(len(self.ids) + 1))
        self.at = np.minimum(np.searchsorted(self.ids, self.to), max(len(self.ids) - 1, 0)).astype(np.int32)
        self.own = self.ids[self.at] == self.to if len(self.ids) else np.zeros(0, bool)

    def take(self, decrements: list[np.ndarray]) -> None:
        to, sent, highest = decrements
        at = np.searchsorted(self.ids, to)
        np.subtract.at(self.need, at, sent)
        np.maximum.at(self.level, at, highest + 1)

    def resolve(self) -> tuple[np.ndarray, np.ndarray]:
        """Resolve all that can be: indices of the nodes found and of their edges to other blocks."""
        found, away = [], []
        front = np.flatnonzero(self.open & (self.need == 0))
        while len(front):
            self.open[front] = False
            found.append(front)
            sizes = self.starts[front + 1] - self.starts[front]
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            edges = np.repeat(self.starts[front], sizes) + within
            own = self.own[edges]
            away.append(edges[~own])
            edges = edges[own]
            to = self.at[edges]
            np.subtract.at(self.need, to, 1)
            np.maximum.at(self.level, to, self.level[self.frm[edges]] + 1)
            front = np.unique(to)
            front = front[(self.need[front] == 0) & self.open[front]]
        none = np.zeros(0, np.int64)
        return np.concatenate(found or [none]), np.concatenate(away or [none])


def _rows(kind: int, *columns: np.ndarray) -> pa.Table:
    columns = [*columns, *[np.zeros(len(columns[0]), np.int64)] * (3 - len(columns))]
    return pa.table([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], schema=_SCHEMA)


def _round(first: bool, compact: bool):
    def step(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()

        def rows(kind: int, columns: str = "abc") -> list[np.ndarray]:
            mine = kinds == kind
            return [table.column(c).to_numpy()[mine] for c in columns]

        block = _Block(rows(NODE), rows(EDGE, "ab"))
        if not first:
            # what earlier rounds have done and told
            block.take(rows(TAKEN))
            block.resolve()
        block.take(rows(FRESH))
        found, away = block.resolve()
        to, at = np.unique(block.to[away], return_inverse=True)
        sent, highest = np.zeros(len(to), np.int64), np.zeros(len(to), np.int64)
        np.add.at(sent, at, 1)
        np.maximum.at(highest, at, block.level[block.frm[away]])
        out = [_rows(LEVEL, block.ids[found], block.level[found]), _rows(FRESH, to, sent, highest)]
        if compact:
            left, held = block.open, block.open[block.frm]
            out.append(_rows(NODE, block.ids[left], block.need[left], block.level[left]))
            out.append(_rows(EDGE, block.ids[block.frm[held]], block.to[held]))
        return pa.concat_tables(out)

    return step


def _places(sizes: dict[int, int], block_rows: int) -> tuple[list[tuple[int, int, int]], int]:
    """(home, its first block, the number of blocks it is dealt over) and the blocks in all."""
    places, blocks, room = [], 0, 0
    for home, size in sorted(sizes.items()):
        many = max(1, -(-size // block_rows))
        if size > room:
            blocks += many
            # a home that fills several blocks shares none
            room = block_rows if many == 1 else 0
        room = max(room - size, 0)
        places.append((home, blocks - many, many))
    return places, max(blocks, 1)


def resolved_levels(
    nodes: DataFrame,
    waits: DataFrame,
    *,
    homes: int = 1,
    distinct: bool = False,
    block_rows: int = BLOCK_ROWS,
    light: int = LIGHT,
) -> DataFrame:
    """(id, level) of every node that resolves; nodes on or behind a cycle do not.

    ``nodes``: id bigint, distinct; ``waits``: id, for (id ``id`` waits for id ``for``), both
    of them in ``nodes``. A node that waits for nothing has level 0. ``homes``: a power of two;
    the rest of an id by it is its home. ``distinct``: ``waits`` is written out and has no row twice.
    """
    edges = waits.select(F.col("for").alias("frm"), F.col("id").alias("to"))
    if not distinct:
        edges = cut(edges.distinct())
    # what a node waits for and what waits for it, in one shuffle
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    ends = F.array(
        F.struct(F.col("to").alias("id"), one.alias("need"), zero.alias("out")),
        F.struct(F.col("frm").alias("id"), zero.alias("need"), one.alias("out")),
    )
    counted = nodes.select("id", zero.alias("need"), zero.alias("out")).unionByName(edges.select(F.inline(ends)))
    known = cut(counted.groupBy("id").agg(F.sum("need").alias("need"), F.sum("out").alias("out")))
    home = lambda key: F.col(key).bitwiseAND(F.lit(homes - 1).cast("bigint"))
    per_home = known.groupBy(home("id").alias("home")).agg(
        F.sum(F.col("out") + 1).alias("size"), F.count_if(F.col("out") > light).alias("heavy")
    )
    sizes = per_home.collect()  # at most ``homes`` rows
    n_heavy = sum(r.heavy for r in sizes)
    places, blocks = _places({r.home: r.size for r in sizes}, block_rows)
    if len(places) > 1 and blocks > 1:
        placed = cut(nodes.sparkSession.createDataFrame(places, "home bigint, first bigint, many bigint"))
    heavy = known.where(F.col("out") > light).select(F.col("id").alias("frm"))

    def dealt(kind: int, key: str, rows: DataFrame, *columns: str) -> DataFrame:
        values = [F.col(c).cast("bigint") for c in columns] + [F.lit(0).cast("bigint")] * (3 - len(columns))
        first, many = F.lit(0), F.lit(blocks)
        if len(places) > 1 and blocks > 1:
            rows = rows.withColumn("home", home(key)).join(F.broadcast(placed), "home")
            first, many = F.col("first"), F.col("many")
        block: Column = first + F.pmod(F.xxhash64(F.col(key)), many)
        return rows.select(block.cast("bigint").alias("block"), F.lit(kind).alias("kind"), *[v.alias(n) for v, n in zip(values, "abc")])

    light_edges = edges.join(heavy, "frm", "left_anti") if n_heavy else edges
    base = dealt(NODE, "id", known, "id", "need").unionByName(dealt(EDGE, "frm", light_edges, "frm", "to"))
    levels, told = Rounds(nodes.sparkSession), Rounds(nodes.sparkSession)
    n, due, rows = 0, 1, base
    while True:
        compact = n == due
        out = cut(rows.groupBy("block").applyInArrow(_round(n == 0, compact), ROW))
        kind = F.col("kind")
        found, _ = levels.add(out.where(kind == LEVEL).select(F.col("a").alias("id"), F.col("b").alias("level")))
        if blocks == 1 and not n_heavy:
            break
        sent = out.where(kind == FRESH).select("a", "b", "c")
        if n_heavy:
            by_spark = found.join(edges, F.col("id") == F.col("frm")).join(heavy, "frm", "left_semi")
            sent = sent.unionByName(by_spark.select(F.col("to").alias("a"), F.lit(1).cast("bigint").alias("b"), F.col("level").alias("c")))
        if compact:
            base = dealt(NODE, "a", out.where(kind == NODE), "a", "b", "c").unionByName(dealt(EDGE, "a", out.where(kind == EDGE), "a", "b"))
            told, due = Rounds(nodes.sparkSession), 2 * due
        summed = sent.groupBy("a").agg(F.sum("b").alias("b"), F.max("c").alias("c"))
        _, n_told = told.add(summed.withColumn("n", F.lit(n)))
        if not n_told:
            break
        is_new = F.col("n") == n
        rows = base
        for k, mine in ((TAKEN, ~is_new), (FRESH, is_new)):
            rows = rows.unionByName(dealt(k, "a", told.all().where(mine), "a", "b", "c"))
        n += 1
    return levels.all()
