"""GR-01 … GR-12 on the five-layer graph over all parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivetgraph.operators import graph
from rivetgraph.plans.registry import query

# Steps on the aarch64 system play the fixed outputs; big parts are not needed.
VIEWS = {
    "fixed": "SELECT drv_hash AS node FROM steps WHERE system = 'aarch64-linux'",
    "visited": """
SELECT drv_hash AS root, drv_hash AS node FROM roots
UNION SELECT v.root, e.dst FROM visited v JOIN edges e ON v.node = e.src WHERE v.node NOT IN (SELECT node FROM fixed)""",
    "needed": "SELECT root, node FROM visited JOIN part ON p_partkey = node WHERE p_size < 35 OR node = root",
    "usable": "SELECT root, node FROM needed WHERE node NOT IN (SELECT node FROM fixed)",
    "lines": "SELECT drv_hash AS root, p_retailprice AS price, attr FROM roots JOIN part ON p_partkey = drv_hash",
}


def fixed(t):
    return t.steps.where(F.col("system") == "aarch64-linux").select(F.col("drv_hash").alias("node"))


def starts(t):
    return t.roots.select(F.col("drv_hash").alias("root"), F.col("drv_hash").alias("node"))


def small_parts(t):
    return t.raw("part").where(F.col("p_size") < 35).select(F.col("p_partkey").alias("node"))


def needed_parts(t):
    return graph.needed_subgraph(starts(t), small_parts(t), fixed(t), t.edges)


@query("gr_01_closure_walk", "SELECT root, node FROM visited", **VIEWS)
def _(t):
    return graph.closure(starts(t), t.edges, fixed(t))


@query("gr_02_needed_nodes", "SELECT root, node FROM usable", **VIEWS)
def _(t):
    return needed_parts(t)[0]


@query(
    "gr_02_needed_edges",
    """SELECT u.root, e.src, e.dst FROM usable u JOIN edges e ON e.src = u.node JOIN usable d ON d.root = u.root AND d.node = e.dst""",
    **VIEWS,
)
def _(t):
    return needed_parts(t)[1]


@query(
    "gr_03_first_submitter",
    """SELECT node, price AS line_no, root = node AS is_root, CASE WHEN root = node THEN attr END AS attr
       FROM usable JOIN lines USING (root) QUALIFY row_number() OVER (PARTITION BY node ORDER BY price, root) = 1""",
    **VIEWS,
)
def _(t):
    price = t.raw("part").select(F.col("p_partkey").alias("drv_hash"), F.col("p_retailprice").alias("line_no"))
    lines = t.roots.join(price, "drv_hash").withColumnRenamed("drv_hash", "root")
    return graph.first_submitter(starts(t), lines, small_parts(t), fixed(t), t.edges)


# Per-order graphs with cycles: each line links two of six steps of its order.
CYCLIC = {
    "links": """
SELECT DISTINCT l_orderkey AS job_id, l_partkey % 6 AS src, (l_suppkey + l_linenumber) % 6 AS dst FROM lineitem
WHERE l_partkey % 6 <> (l_suppkey + l_linenumber) % 6""",
    "tops": "SELECT DISTINCT job_id, src AS node FROM links WHERE src < 3",
    "reach": "SELECT job_id, src, dst FROM links UNION SELECT r.job_id, r.src, l.dst FROM reach r JOIN links l ON r.job_id = l.job_id AND r.dst = l.src",
    "live": "SELECT job_id, node FROM tops UNION SELECT r.job_id, r.dst FROM reach r JOIN tops t ON r.job_id = t.job_id AND r.src = t.node",
    "loops": "SELECT l.job_id, l.node FROM live l JOIN reach r ON r.job_id = l.job_id AND r.src = l.node AND r.dst = l.node",
    "core": """
SELECT DISTINCT n.job_id, n.node FROM live n
WHERE EXISTS (SELECT 1 FROM loops c LEFT JOIN reach r ON r.job_id = c.job_id AND r.src = c.node AND r.dst = n.node
              WHERE c.job_id = n.job_id AND (c.node = n.node OR r.dst IS NOT NULL))
  AND EXISTS (SELECT 1 FROM loops c LEFT JOIN reach r ON r.job_id = c.job_id AND r.dst = c.node AND r.src = n.node
              WHERE c.job_id = n.job_id AND (c.node = n.node OR r.dst IS NOT NULL))""",
}


def cycle_core(t):
    src, dst = F.col("l_partkey") % 6, (F.col("l_suppkey") + F.col("l_linenumber")) % 6
    links = (
        t.raw("lineitem")
        .where(src != dst)
        .select(F.col("l_orderkey").alias("job_id"), src.alias("src"), dst.alias("dst"))
        .distinct()
    )
    tops = links.where(F.col("src") < 3).select("job_id", F.col("src").alias("node")).distinct()
    return graph.cycle_core(tops, links)


@query("gr_04_cycle_core", "SELECT job_id, node FROM core", **CYCLIC)
def _(t):
    return cycle_core(t)


@query(
    "gr_04_cycle_verdict",
    """SELECT j.job_id, count(c.node) > 0 AS has_cycle, count(c.node) AS core_nodes,
              CASE WHEN count(c.node) > 0 THEN array_to_string(list(c.node ORDER BY c.node)[1:5], '|') END AS preview
       FROM jobs j LEFT JOIN core c USING (job_id) GROUP BY ALL""",
    **CYCLIC,
)
def _(t):
    return graph.cycle_verdict(t.jobs, cycle_core(t))


@query("gr_04_layered_is_acyclic", "SELECT brand AS job_id, false AS has_cycle FROM latches GROUP BY ALL")
def _(t):
    jobs = t.latches.select(F.col("brand").alias("job_id")).distinct()
    tops = t.latches.join(t.roots.select("drv_hash"), "drv_hash").select(
        F.col("brand").alias("job_id"), F.col("drv_hash").alias("node")
    )
    core = graph.cycle_core(tops, t.edges)
    return graph.cycle_verdict(jobs, core).select("job_id", "has_cycle")


# Every 97th edge of the layered graph also runs the other way; a brand's roots are one job.
@query(
    "gr_04_planted_cycles",
    """SELECT job_id, node FROM (SELECT job_id, node FROM down INTERSECT SELECT job_id, node FROM up)""",
    back="SELECT dst AS src, src AS dst FROM edges WHERE (src * 7 + dst) % 97 = 0",
    looped="SELECT src, dst FROM edges UNION SELECT src, dst FROM back",
    live="SELECT l.brand AS job_id, l.drv_hash AS node FROM latches l JOIN roots r USING (drv_hash) UNION SELECT v.job_id, e.dst FROM live v JOIN looped e ON e.src = v.node",
    tied="SELECT DISTINCT v.job_id, x.node FROM live v JOIN back b ON b.dst = v.node, LATERAL (SELECT unnest([b.src, b.dst]) AS node) x",
    down="SELECT job_id, node FROM tied UNION SELECT d.job_id, e.dst FROM down d JOIN looped e ON e.src = d.node",
    up="SELECT job_id, node FROM tied UNION SELECT u.job_id, e.src FROM up u JOIN looped e ON e.dst = u.node JOIN live v ON v.job_id = u.job_id AND v.node = e.src",
)
def _(t):
    back = t.edges.where((F.col("src") * 7 + F.col("dst")) % 97 == 0).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    tops = t.latches.join(t.roots.select("drv_hash"), "drv_hash").select(
        F.col("brand").alias("job_id"), F.col("drv_hash").alias("node")
    )
    return graph.cycle_core(tops, t.edges.unionByName(back))


@query(
    "gr_05_ready_frontier",
    """SELECT drv_hash FROM latches WHERE NOT finished AND created AND drv_hash NOT IN
         (SELECT e.src FROM edges e JOIN latches d ON d.drv_hash = e.dst WHERE NOT d.finished)""",
)
def _(t):
    return graph.ready_frontier(t.latches, t.edges).select("drv_hash")


@query(
    "gr_06_topological_waves",
    """SELECT node, CAST(max(wave) AS INTEGER) AS wave FROM climb GROUP BY ALL""",
    climb="SELECT p_partkey AS node, 0 AS wave FROM part UNION SELECT e.src, wave + 1 FROM climb c JOIN edges e ON e.dst = c.node",
)
def _(t):
    return graph.waves(t.raw("part").select(F.col("p_partkey").alias("node")), t.edges)


SPREAD = {
    "hit": """
SELECT e.src AS node, f.drv_hash AS origin, f.ended_at AS origin_at FROM latches f JOIN edges e ON e.dst = f.drv_hash JOIN latches s ON s.drv_hash = e.src
WHERE f.previous_failure AND NOT s.finished
UNION SELECT e.src, h.origin, h.origin_at FROM hit h JOIN edges e ON e.dst = h.node JOIN latches s ON s.drv_hash = e.src WHERE NOT s.finished""",
    "spread": "SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY node ORDER BY origin_at, origin) = 1",
}


def spread(t):
    node = F.col("drv_hash").alias("node")
    failed = t.latches.where("previous_failure").select(node, F.col("ended_at").alias("failed_at"))
    finished = t.latches.where("finished").select(node)
    return graph.propagate_failures(failed, t.edges, finished)


@query("gr_07_failure_propagation", "SELECT node, origin, origin_at FROM spread", **SPREAD)
def _(t):
    return spread(t)


@query(
    "gr_07_propagation_past_cache_hits",
    """SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY node ORDER BY origin_at, origin) = 1""",
    open_edges="SELECT e.* FROM edges e JOIN latches d ON d.drv_hash = e.dst WHERE NOT (d.previous_failure AND d.tries = 0)",
    hit=SPREAD["hit"].replace("edges", "open_edges"),
)
def _(t):
    node = F.col("drv_hash").alias("node")
    failed = t.latches.where("previous_failure").select(node, F.col("ended_at").alias("failed_at"))
    cached = t.latches.where(F.col("previous_failure") & (F.col("tries") == 0)).select(node)
    finished = t.latches.where("finished").select(node)
    return graph.propagate_failures(failed, t.edges, finished, cached)


@query(
    "gr_08_scoped_propagation",
    """SELECT m.job_id, m.drv_hash, 'propagated_failure' AS error_category, 'dep failed: ' || origin AS error_message, origin AS propagated_from,
              CAST(NULL AS VARCHAR) AS worker_id, origin_at FROM spread s JOIN members m ON m.drv_hash = s.node""",
    **SPREAD,
)
def _(t):
    return graph.propagated_rows(spread(t), t.members)


BRANDS = {
    "owned": """
SELECT brand AS job_id, drv_hash FROM latches WHERE drv_hash IN (SELECT drv_hash FROM roots)
UNION SELECT o.job_id, e.dst FROM owned o JOIN edges e ON e.src = o.drv_hash""",
    "up": """
SELECT o.job_id, o.drv_hash AS failed, o.drv_hash AS node FROM owned o JOIN latches l USING (drv_hash) WHERE l.previous_failure
UNION SELECT u.job_id, u.failed, e.src FROM up u JOIN edges e ON e.dst = u.node JOIN owned o ON o.job_id = u.job_id AND o.drv_hash = e.src""",
}


def broken_inputs(t):
    """Failed steps, edges, members and labelled roots; the parts of a brand are one job."""
    brand = F.col("brand").alias("job_id")
    roots = t.roots.join(t.steps.select("drv_hash", "drv_name"), "drv_hash").join(
        t.latches.select("drv_hash", brand), "drv_hash"
    )
    roots = graph.labelled(roots, F.col("attr"), F.col("drv_name"))
    start = roots.select("job_id", F.col("drv_hash").alias("node"))
    members = graph.walk(start, graph.to_deps(t.edges), tags=["job_id"]).withColumnRenamed("node", "drv_hash")
    failed = members.join(t.latches.where("previous_failure").select("drv_hash"), "drv_hash", "left_semi")
    return failed, t.edges, members, roots


@query(
    "gr_09_used_by_attrs",
    """SELECT u.job_id, u.failed AS drv_hash, array_to_string(list(DISTINCT coalesce(r.attr, s.drv_name) ORDER BY coalesce(r.attr, s.drv_name)), '|') AS used_by_attrs
       FROM up u JOIN latches l ON l.drv_hash = u.node AND l.brand = u.job_id JOIN roots r ON r.drv_hash = u.node JOIN steps s ON s.drv_hash = u.node
       GROUP BY ALL""",
    **BRANDS,
)
def _(t):
    return graph.used_by_attrs(*broken_inputs(t))


@query(
    "gr_09_broken_labels",
    """SELECT DISTINCT u.job_id, u.failed AS drv_hash, coalesce(r.attr, s.drv_name) AS label
       FROM up u JOIN latches l ON l.drv_hash = u.node AND l.brand = u.job_id JOIN roots r ON r.drv_hash = u.node JOIN steps s ON s.drv_hash = u.node""",
    **BRANDS,
)
def _(t):
    return graph.broken_labels(*broken_inputs(t))


@query("gr_10_fan_out", "SELECT dst AS drv_hash, count(*) AS dependents FROM edges GROUP BY ALL")
def _(t):
    return graph.fan_out(t.edges)


@query(
    "gr_11_orphan_steps",
    "SELECT drv_hash FROM steps WHERE drv_hash NOT IN (SELECT drv_hash FROM members JOIN jobs USING (job_id) WHERE status = 'pending' AND priority = 4)",
)
def _(t):
    live = t.jobs.where((F.col("status") == "pending") & (F.col("priority") == 4))
    return graph.orphan_steps(t.steps.select("drv_hash"), t.members, live)


@query(
    "gr_12_layered_dag",
    """SELECT DISTINCT 'edge' AS part, l * w + i AS a, (l - 1) * w + (i * 31 + k * 7 + l) % w AS b FROM
         (SELECT CAST(count(*) AS BIGINT) AS w FROM supplier), range(1, 6) t(l), range(0, w) u(i), range(0, 3) v(k)
       UNION ALL SELECT 'root', 5 * w + i, NULL FROM (SELECT CAST(count(*) AS BIGINT) AS w FROM supplier), range(0, w) u(i)""",
)
def _(t):
    width = t.raw("supplier").count()
    nodes, edges = graph.layered_dag(t.spark, 6, width, 3)
    roots = nodes.where("is_root").select(F.lit("root").alias("part"), F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"))
    return edges.select(F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(roots)


@query(
    "jn_16_cross_job_sharing",
    "SELECT drv_hash, count(DISTINCT job_id) AS jobs FROM members GROUP BY ALL",
)
def _(t):
    return graph.sharing(t.members)


@query(
    "jn_16_jobs_of_failed_steps",
    "SELECT DISTINCT f.drv_hash, m.job_id FROM latches f JOIN members m USING (drv_hash) WHERE f.previous_failure",
)
def _(t):
    return graph.jobs_of(t.latches.where("previous_failure").select("drv_hash"), t.members)
