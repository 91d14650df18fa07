"""Operators on the dependency graph: ``edges(src, dst)``, src depends on dst.

Walks run as rounds of joins. Every round is written to the shared folder, so the
plan stays short and a lost executor costs no more than the round at hand. A walk
ends when a round adds nothing; visited rows are never joined twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rivetgraph import params as P
from rivetgraph.operators.blocks import top_per_key
from rivetgraph.operators.levels import HOMES, resolved_levels
from rivetgraph.session import Rounds, cut


def walk(
    start: DataFrame,
    hops: DataFrame,
    *,
    node: str = "node",
    tags: Sequence[str] = (),
    expand: DataFrame | None = None,
    within: DataFrame | None = None,
) -> DataFrame:
    """All (tags, node) reachable from ``start`` over ``hops(frm, to)``.

    Tags that are columns of ``hops`` too must match: each tag then has hops of its own.

    ``expand``: nodes the walk may leave again (others are visited but not left).
    ``within``: (subset of tags, node) pairs that may be entered; also applied to
    ``start``. Both are joins, so they may be as large as the graph.
    """
    cols = [*tags, node]
    own = [c for c in tags if c in hops.columns]

    def allowed(df: DataFrame) -> DataFrame:
        if within is None:
            return df
        keys = [c for c in cols if c in within.columns]
        return df.join(within.select(*keys), keys, "left_semi")

    hops = cut(hops)
    rounds = Rounds(start.sparkSession)
    frontier, found = rounds.add(allowed(start.select(*cols).distinct()))
    while found:
        leaving = frontier if expand is None else frontier.join(expand.select(node), node, "left_semi")
        reached = (
            leaving.join(hops.withColumnRenamed("frm", node), [*own, node])
            .select(*tags, F.col("to").alias(node))
            .distinct()
        )
        frontier, found = rounds.add(allowed(reached).join(rounds.all(), cols, "left_anti"))
    return rounds.all()


WORD_BITS = 64


def numbered_tags(start: DataFrame, tag: str, order: Sequence[str] = ()) -> DataFrame:
    """A number for each tag, rising with ``order``: neighbours in that order share a word of a
    bit set. Numbers are written out, so they stay what they are."""
    own = [F.col(c) for c in (*order, tag)]
    ranged = start.select(*own).distinct().repartitionByRange(*own).sortWithinPartitions(*own)
    return cut(ranged.withColumn("__id", F.monotonically_increasing_id()))


def bit_of() -> tuple[Column, Column]:
    """The word and the bit of a tag's number."""
    bit = F.expr("shiftleft(1L, cast(__id & 63 as int))")
    return F.shiftright("__id", 6).alias("word"), bit.alias("bits")


def walk_sets(
    start: DataFrame,
    hops: DataFrame,
    *,
    tag: str,
    ids: DataFrame,
    own: Sequence[str] = (),
    within: DataFrame | None = None,
) -> DataFrame:
    """Which tags reach each node over ``hops(frm, to)``, as bit sets: (own, node, word, bits).

    Bit ``b`` of word ``w`` stands for the tag numbered ``64·w + b`` in ``ids``
    (``numbered_tags``), so up to 64 tags travel in one row and a round merges what arrives at
    a node with ``bit_or``, combined before the shuffle. Only bits that are new go on. What is
    known is kept as rounds and folded into one table after 4, 8, 16, … of them.

    ``own`` columns separate walks: they are in ``start``, in ``within``, and may be in ``hops``.
    """
    keys = [*own, "node", "word"]
    numbers = ids.select("__id", F.col(tag).alias("__tag"))
    placed = start.join(numbers, start[tag].eqNullSafe(F.col("__tag"))).select(*own, "node", *bit_of())
    merged = lambda df: df.groupBy(*keys).agg(F.bit_or("bits").alias("bits"))

    def allowed(df: DataFrame) -> DataFrame:
        if within is None:
            return df
        cols = [c for c in (*own, "node") if c in within.columns]
        return df.join(within.select(*cols), cols, "left_semi")

    hops = cut(hops)
    by = [c for c in own if c in hops.columns]
    rounds = Rounds(start.sparkSession)
    frontier, found = rounds.add(merged(allowed(placed)))
    while found:
        reached = frontier.join(hops.withColumnRenamed("frm", "node"), [*by, "node"])
        offers = merged(allowed(reached.select(*own, F.col("to").alias("node"), "word", "bits")))
        if rounds.n > 2 and rounds.n & (rounds.n - 1) == 0:
            base = Rounds(start.sparkSession)
            base.add(merged(rounds.all()))
            base.n = rounds.n
            rounds = base
        known = merged(rounds.all()).withColumnRenamed("bits", "known")
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("bigint"))))
        new = offers.join(known, keys, "left").select(*keys, fresh.alias("bits")).where("bits <> 0")
        frontier, found = rounds.add(new)
    return merged(rounds.all())


def tags_of(sets: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    """The (tag, …) rows that the bits of ``sets`` stand for, other columns kept."""
    places = F.expr("filter(sequence(0, 63), i -> (shiftrightunsigned(bits, i) & 1L) = 1L)")
    listed = sets.withColumn("__bit", F.explode(places)).withColumn("__id", F.col("word") * WORD_BITS + F.col("__bit"))
    return listed.join(ids.select("__id", tag), "__id").drop("__id", "__bit", "word", "bits")


def to_deps(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("frm"), F.col("dst").alias("to"))


def to_dependents(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("frm"), F.col("src").alias("to"))


def closure(roots: DataFrame, edges: DataFrame, fixed_output: DataFrame) -> DataFrame:
    """GR-01: visited (root, node). Fixed-output nodes are visited but not left.

    ``roots``: root, node (normally equal). ``closure_sets`` is the form for further joins.
    """
    sets, ids = closure_sets(roots, edges, fixed_output)
    return tags_of(sets, ids, "root").select("root", "node")


def closure_sets(
    roots: DataFrame, edges: DataFrame, fixed_output: DataFrame, ids: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """GR-01 as bit sets of roots per node, and the roots' numbers (``ids`` if given): at most a
    row per node and 64 roots, where (root, node) pairs grow with every root that reaches a node."""
    leaving = edges.join(fixed_output.select(F.col("node").alias("src")), "src", "left_anti")
    ids = numbered_tags(roots, "root") if ids is None else ids
    return walk_sets(roots, to_deps(leaving), tag="root", ids=ids), ids


def needed_sets(
    visited: DataFrame, ids: DataFrame, needed: DataFrame, fixed_output: DataFrame, edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """GR-02 on bit sets: emitted (node, word, bits) and their edges (src, dst, word, bits).

    ``visited``, ``ids``: as ``closure_sets`` gives them. ``needed``: (root, node), or (node)
    where a node is needed by every root that meets it; the root itself always counts.
    """
    usable = visited.join(fixed_output.select("node"), "node", "left_anti")
    itself = ids.select(F.col("root").alias("node"), *bit_of())
    if "root" in needed.columns:
        asked = needed.join(ids, "root").select("node", *bit_of())
    else:
        asked = usable.join(needed.select("node"), "node", "left_semi")
    wanted = asked.unionByName(itself).groupBy("node", "word").agg(F.bit_or("bits").alias("want"))
    both = usable.join(wanted, ["node", "word"]).withColumn("bits", F.col("bits").bitwiseAND(F.col("want")))
    nodes = cut(both.where("bits <> 0").select("node", "word", "bits"))
    near = nodes.select(F.col("node").alias("src"), "word", F.col("bits").alias("near"))
    far = nodes.select(F.col("node").alias("dst"), "word", F.col("bits").alias("far"))
    kept = near.join(edges.select("src", "dst"), "src").join(far, ["dst", "word"])
    kept = kept.select("src", "dst", "word", F.col("near").bitwiseAND(F.col("far")).alias("bits"))
    return nodes, kept.where("bits <> 0")


def needed_subgraph(
    roots: DataFrame, needed: DataFrame, fixed_output: DataFrame, edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """GR-02: emitted (root, node) and their edges (root, src, dst), listed from the bit sets.

    ``roots``: root, node. ``needed``: as in ``needed_sets``. An edge stays if its far end is
    needed and not a fixed output.
    """
    visited, ids = closure_sets(roots, edges, fixed_output)
    nodes, kept = needed_sets(visited, ids, needed, fixed_output, edges)
    listed = tags_of(nodes, ids, "root").select("root", "node")
    return listed, tags_of(kept, ids, "root").select("root", "src", "dst")


def first_submitter(
    roots: DataFrame, lines: DataFrame, needed: DataFrame, fixed_output: DataFrame, edges: DataFrame
) -> DataFrame:
    """GR-03: each emitted node once, under the first eval line that walked it.

    ``lines``: root, line_no, attr; other arguments as in ``needed_subgraph``. Only the line's
    own root carries the attr, and only if that line is the one that submits it. Roots are
    numbered in the order of their lines, so a node's first line is the lowest bit of its
    lowest word, and no (root, node) pair is listed.
    """
    ids = numbered_tags(lines, "root", ["line_no"])
    visited, _ = closure_sets(roots, edges, fixed_output, ids)
    nodes, _ = needed_sets(visited, ids, needed, fixed_output, edges)
    lowest = F.expr("array_position(transform(sequence(0, 63), i -> shiftrightunsigned(bits, i) & 1L), 1L) - 1")
    first = nodes.groupBy("node").agg(F.min(F.col("word") * WORD_BITS + lowest).alias("__id"))
    named = first.join(ids, "__id").join(lines, ["root", "line_no"])
    own = F.col("root") == F.col("node")
    return named.select("node", "line_no", own.alias("is_root"), F.when(own, F.col("attr")).alias("attr"))


def _numbered_ends(edges: DataFrame, tags: Sequence[str], nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A number for each (tags, node), and the edges as (id, for) by number: ``src`` waits for
    ``dst``. Numbers are written out, so they stay what they are; all numbers of one tag have
    the same rest by ``HOMES``."""
    ends = edges.select(*tags, F.col("src").alias("node")).union(edges.select(*tags, F.col("dst").alias("node")))
    if nodes is not None:
        ends = ends.union(nodes.select(*tags, "node"))
    home = F.pmod(F.xxhash64(*tags), F.lit(HOMES)) if tags else F.lit(0)
    ids = cut(ends.distinct().withColumn("id", F.monotonically_increasing_id() * HOMES + home))
    waits = (
        edges.select(*tags, "src", "dst")
        .join(ids.withColumnRenamed("node", "src"), [*tags, "src"])
        .join(ids.select(*tags, F.col("node").alias("dst"), F.col("id").alias("for")), [*tags, "dst"])
    )
    return ids, cut(waits.select("id", "for"))


def _trim(edges: DataFrame, tags: Sequence[str], **blocks: int) -> DataFrame:
    """Edges (tags, src, dst; each once) that lie on or between cycles.

    What resolves from below is neither on nor behind a cycle; of the rest, what resolves from
    above is not before one.
    """
    ids, waits = _numbered_ends(edges, tags)

    def unresolved(nodes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        levels = resolved_levels(nodes, pairs, homes=HOMES, distinct=True, **blocks)
        left = cut(nodes.join(levels, "id", "left_anti").select("id"))
        inside = pairs.join(left, "id", "left_semi").join(left.withColumnRenamed("id", "for"), "for", "left_semi")
        return left, cut(inside.select("id", "for"))

    left, inside = unresolved(ids.select("id"), waits)
    left, inside = unresolved(left, inside.select(F.col("for").alias("id"), F.col("id").alias("for")))
    names = ids.join(left, "id", "left_semi")
    src = names.select(*tags, F.col("node").alias("src"), F.col("id").alias("for"))
    dst = names.select(F.col("node").alias("dst"), "id")
    return inside.join(src, "for").join(dst, "id").select(*tags, "src", "dst")


def cycle_core(
    roots: DataFrame, edges: DataFrame, members: DataFrame | None = None, *, tag: str = "job_id", **blocks: int
) -> DataFrame:
    """GR-04: (tag, node) left after trimming everything that is not on, or between,
    cycles reachable from the tag's roots.

    ``roots``: tag, node; ``edges``: src, dst and optionally tag; ``members``: tag, node.
    """
    if tag in edges.columns:
        hops = edges.select(tag, F.col("src").alias("frm"), F.col("dst").alias("to"))
        reach = walk(roots, hops, tags=[tag])
        own = edges.join(reach.withColumnRenamed("node", "src"), [tag, "src"], "left_semi")
    else:
        reach = walk(roots, to_deps(edges), tags=[tag], within=members)
        own = reach.withColumnRenamed("node", "src").join(edges, "src")
    if members is not None:
        own = own.join(members.select(tag, F.col("node").alias("dst")), [tag, "dst"], "left_semi")
    core = cut(_trim(own.select(tag, "src", "dst").distinct(), [tag], **blocks))
    return core.select(tag, F.col("src").alias("node")).union(core.select(tag, F.col("dst").alias("node"))).distinct()


def cycle_verdict(jobs: DataFrame, core: DataFrame, *, preview: int = P.CYCLE_PREVIEW) -> DataFrame:
    """Jobs with has_cycle, the number of nodes concerned and the smallest few of them."""

    shown = (
        top_per_key(core, ["job_id"], [F.col("node")], preview)
        .groupBy("job_id")
        .agg(F.array_sort(F.collect_list("node")).alias("preview"))
    )
    sizes = core.groupBy("job_id").agg(F.count(F.lit(1)).alias("core_nodes"))
    return (
        jobs.select("job_id")
        .join(sizes, "job_id", "left")
        .join(shown, "job_id", "left")
        .select(
            "job_id",
            F.col("core_nodes").isNotNull().alias("has_cycle"),
            F.coalesce("core_nodes", F.lit(0).cast("bigint")).alias("core_nodes"),
            "preview",
        )
    )


def ready_frontier(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-05: steps (drv_hash, finished, created) that could start now."""
    open_steps = steps.where(~F.col("finished"))
    open_deps = open_steps.select(F.col("drv_hash").alias("dst"))
    blocked = edges.join(open_deps, "dst", "left_semi").select(F.col("src").alias("drv_hash")).distinct()
    return open_steps.where(F.col("created")).join(blocked, "drv_hash", "left_anti")


def waves(nodes: DataFrame, edges: DataFrame, **blocks: int) -> DataFrame:
    """GR-06: (node, wave). Leaves are wave 0; every step sits one above its deepest
    input. Nodes on or above a cycle get no wave and are left out; an input that is not in
    ``nodes`` holds nothing back."""
    known = nodes.select("node").distinct()
    inside = edges.join(known.withColumnRenamed("node", "dst"), "dst", "left_semi").join(
        known.withColumnRenamed("node", "src"), "src", "left_semi"
    )
    ids, waits = _numbered_ends(inside, [], known)
    levels = resolved_levels(ids.select("id"), waits, **blocks)
    return levels.join(ids, "id").select("node", F.col("level").cast("int").alias("wave"))


def propagate_failures(
    failed: DataFrame, edges: DataFrame, finished: DataFrame, cached_failed: DataFrame | None = None
) -> DataFrame:
    """GR-07: unfinished transitive dependents (node, origin, origin_at).

    ``failed``: node, failed_at. ``finished``: nodes already done, which stop the walk.
    A node reached from several origins keeps the earliest one (then the smallest key).
    Labels only ever improve, so a round re-sends just the nodes that improved.
    An input known bad at ingest (``cached_failed``: node) never got an edge; pass it to
    take those edges out.
    """
    if cached_failed is not None:
        edges = edges.join(cached_failed.select(F.col("node").alias("dst")), "dst", "left_anti")
    stop = finished.select("node").union(failed.select("node")).distinct()
    open_edges = cut(
        to_dependents(edges).join(stop.select(F.col("node").alias("to")), "to", "left_anti").distinct()
    )
    label = F.struct(F.col("failed_at").alias("at"), F.col("node").alias("origin"))
    frontier = failed.groupBy("node").agg(F.min(label).alias("label"))
    offers = _offers(frontier, open_edges)
    rounds = Rounds(failed.sparkSession)
    improved = True
    while improved:
        if rounds.n:
            known = best_labels(rounds.all()).withColumnRenamed("label", "known")
            offers = (
                offers.join(known, "node", "left")
                .where(F.col("known").isNull() | (F.col("label") < F.col("known")))
                .select("node", "label")
            )
        frontier, improved = rounds.add(offers)
        offers = _offers(frontier, open_edges)
    best = best_labels(rounds.all())
    return best.select("node", F.col("label.origin").alias("origin"), F.col("label.at").alias("origin_at"))


def _offers(frontier: DataFrame, hops: DataFrame) -> DataFrame:
    return (
        frontier.join(hops, F.col("node") == F.col("frm"))
        .groupBy(F.col("to").alias("node"))
        .agg(F.min("label").alias("label"))
    )


def best_labels(offers: DataFrame) -> DataFrame:
    return offers.groupBy("node").agg(F.min("label").alias("label"))


def propagated_rows(propagated: DataFrame, members: DataFrame) -> DataFrame:
    """GR-08: one failure record per job that owns the node."""
    return propagated.join(members, propagated["node"] == members["drv_hash"]).select(
        "job_id",
        "drv_hash",
        F.lit("propagated_failure").alias("error_category"),
        F.concat(F.lit("dep failed: "), F.col("origin").cast("string")).alias("error_message"),
        F.col("origin").alias("propagated_from"),
        F.lit(None).cast("string").alias("worker_id"),
        "origin_at",
    )


def broken_labels(failed: DataFrame, edges: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame:
    """GR-09, one row per label: (job_id, drv_hash, label) of the roots a failed step
    breaks, inside each job.

    ``failed``: job_id, drv_hash; ``members``: job_id, drv_hash; ``roots``: job_id,
    drv_hash, label (attr or name).
    """
    start = failed.select("job_id", F.col("drv_hash").alias("failed"), F.col("drv_hash").alias("node"))
    own = members.select("job_id", F.col("drv_hash").alias("node"))
    # a step's number is the same in every job, so its jobs share the numbers' table
    ids = numbered_tags(failed, "drv_hash").withColumnRenamed("drv_hash", "failed")
    reach = walk_sets(start, to_dependents(edges), tag="failed", ids=ids, own=["job_id"], within=own)
    hit = reach.join(roots.select("job_id", F.col("drv_hash").alias("node"), "label"), ["job_id", "node"])
    merged = hit.groupBy("job_id", "label", "word").agg(F.bit_or("bits").alias("bits"))
    return tags_of(merged, ids, "failed").select("job_id", F.col("failed").alias("drv_hash"), "label")


def used_by_attrs(failed: DataFrame, edges: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame:
    """GR-09 as the report shows it: the labels as one sorted array, at most as long as
    the job has roots. ``broken_labels`` is the form for further joins."""
    return (
        broken_labels(failed, edges, members, roots)
        .groupBy("job_id", "drv_hash")
        .agg(F.array_sort(F.collect_list("label")).alias("used_by_attrs"))
    )


def fan_out(edges: DataFrame) -> DataFrame:
    """GR-10: dependents per node."""
    return edges.groupBy(F.col("dst").alias("drv_hash")).agg(F.count(F.lit(1)).alias("dependents"))


def orphan_steps(steps: DataFrame, members: DataFrame, live_jobs: DataFrame) -> DataFrame:
    """GR-11: steps no live job holds."""
    held = members.join(live_jobs.select("job_id"), "job_id", "left_semi").select("drv_hash")
    return steps.join(held, "drv_hash", "left_anti")


def layered_dag(spark, layers: int, width: int, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """GR-12: nodes (node, layer, is_root) and edges of a fixed layered graph.

    Node ``i`` of a layer needs nodes ``(i*31 + k*7 + layer) % width`` of the one below.
    """
    nodes = spark.range(layers * width).select(
        F.col("id").alias("node"),
        F.floor(F.col("id") / width).cast("int").alias("layer"),
        (F.col("id") >= (layers - 1) * width).alias("is_root"),
    )
    return nodes, layered_edges(nodes, F.lit(width), fan_in)


def layered_edges(
    nodes: DataFrame, width: Column, fan_in: int, node_of=lambda layer, i, width: layer * width + i, index=None
) -> DataFrame:
    """Edges of the layered form for any numbering ``node_of(layer, i, width)``."""
    i = F.col("node") % width if index is None else index
    layer = F.col("layer")
    targets = F.array(*[(i * 31 + k * 7 + layer) % width for k in range(fan_in)])
    return (
        nodes.where(layer > 0)
        .select(F.col("node").alias("src"), layer.alias("layer"), F.explode(F.array_distinct(targets)).alias("j"))
        .select("src", node_of(F.col("layer") - 1, F.col("j"), width).cast("bigint").alias("dst"))
    )


def labelled(roots: DataFrame, attr: Column, name: Column) -> DataFrame:
    """Roots with the label used in reports: the attr, else the name."""
    return roots.withColumn("label", F.coalesce(attr, name))




def jobs_of(steps: DataFrame, members: DataFrame) -> DataFrame:
    """JN-16: every job that references one of the steps."""
    return members.join(steps.select("drv_hash").distinct(), "drv_hash").select("drv_hash", "job_id").distinct()


def sharing(members: DataFrame) -> DataFrame:
    """JN-16: in how many jobs each step is."""
    return members.groupBy("drv_hash").agg(F.count_distinct("job_id").alias("jobs"))
