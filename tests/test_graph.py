"""Graph operators on the known small shapes, and properties on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from rivetgraph.operators import graph
from rivetgraph.operators.levels import resolved_levels
from tests.conftest import rows_of

EDGES = "src string, dst string"


def nodes_of(make, names):
    return make([(n,) for n in names], "node string")


def test_waves_of_chain_and_diamond(make):
    chain = graph.waves(nodes_of(make, "abc"), make([("c", "b"), ("b", "a")], EDGES))
    assert rows_of(chain, "node", "wave") == [("a", 0), ("b", 1), ("c", 2)]
    diamond = graph.waves(nodes_of(make, "abcd"), make([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a")], EDGES))
    assert rows_of(diamond, "node", "wave") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_waves_leave_out_cycles(make):
    got = graph.waves(nodes_of(make, "abcx"), make([("a", "b"), ("b", "a"), ("c", "b")], EDGES))
    assert rows_of(got, "node", "wave") == [("x", 0)]


def failures(make, rows):
    return make(rows, "node string, failed_at int")


def spread(make, edges, failed, finished="", cached=None):
    done = make([(n,) for n in finished], "node string")
    cached = cached and nodes_of(make, cached)
    return rows_of(graph.propagate_failures(failures(make, failed), make(edges, EDGES), done, cached), "node", "origin")


def test_propagation_down_a_chain(make):
    assert spread(make, [("c", "b"), ("b", "a")], [("a", 1)]) == [("b", "a"), ("c", "a")]


def test_earlier_of_two_origins_wins_even_when_farther(make):
    edges = [("d", "c"), ("c", "b"), ("b", "a"), ("d", "x")]
    assert spread(make, edges, [("a", 1), ("x", 2)]) == [("b", "a"), ("c", "a"), ("d", "a")]
    assert spread(make, edges, [("a", 3), ("x", 2)]) == [("b", "a"), ("c", "a"), ("d", "x")]
    assert spread(make, [("c", "a"), ("c", "b")], [("b", 1), ("a", 1)]) == [("c", "a")]


def test_finished_step_blocks(make):
    assert spread(make, [("c", "b"), ("b", "a")], [("a", 1)], finished="b") == []


def test_edges_to_cached_failures_do_not_carry(make):
    assert spread(make, [("c", "b"), ("b", "a")], [("a", 1)], cached="a") == []


def test_shared_step_is_recorded_only_where_owned(make):
    p = graph.propagate_failures(failures(make, [("x", 1)]), make([("y", "x")], EDGES), make([], "node string"))
    members = make([("J1", "x"), ("J2", "x"), ("J1", "y")], "job_id string, drv_hash string")
    got = graph.propagated_rows(p, members)
    assert rows_of(got, "job_id", "drv_hash", "error_message") == [("J1", "y", "dep failed: x")]


def cycle(make, roots, edges, members=None):
    r = make([("j", x) for x in roots], "job_id string, node string")
    m = members and make([("j", x) for x in members], "job_id string, node string")
    return [n for _, n in rows_of(graph.cycle_core(r, make(edges, EDGES), m), "job_id", "node")]


def test_cycles(make):
    assert cycle(make, "a", [("a", "b"), ("b", "a")]) == ["a", "b"]
    assert cycle(make, "r", [("r", "a"), ("a", "b"), ("b", "a"), ("b", "z")]) == ["a", "b"]
    assert cycle(make, "r", [("r", "q"), ("a", "b"), ("b", "a")]) == []
    assert cycle(make, "r", [("r", "a"), ("a", "b")]) == []
    # a dependency outside the job's members cannot close a cycle
    assert cycle(make, "r", [("r", "a"), ("a", "b"), ("b", "a")], members="ra") == []


def test_ready_frontier_of_diamond(make):
    edges = make([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a")], EDGES)

    def ready(done, created="abcd"):
        steps = make([(n, n in done, n in created) for n in "abcd"], "drv_hash string, finished boolean, created boolean")
        return "".join(r[0] for r in rows_of(graph.ready_frontier(steps, edges), "drv_hash"))

    assert ready("") == "a"
    assert ready("a") == "bc"
    assert ready("ab") == "c"
    assert ready("abc") == "d"
    assert ready("a", created="ac") == "c"


def test_closure_stops_at_fixed_outputs_and_filters_edges(make):
    edges = make([("r", "m"), ("m", "leaf"), ("r", "f"), ("f", "deep"), ("r", "x")], EDGES)
    fixed = make([("f",)], "node string")
    roots = make([("r", "r")], "root string, node string")
    seen = graph.closure(roots, edges, fixed)
    assert [n for _, n in rows_of(seen, "root", "node")] == ["f", "leaf", "m", "r", "x"]
    needed = make([("r", "leaf"), ("r", "f"), ("r", "x")], "root string, node string")
    nodes, kept = graph.needed_subgraph(roots, needed, fixed, edges)
    assert [n for _, n in rows_of(nodes, "root", "node")] == ["leaf", "r", "x"]
    # the middle step is not needed, so its edges go; the fixed output too
    assert rows_of(kept, "src", "dst") == [("r", "x")]


@pytest.mark.parametrize("n_roots", [5, 150])
def test_bit_sets_equal_a_walk_in_memory(make, n_roots):
    """More roots than a word has bits, shared inputs, fixed outputs among the roots, two
    lines for one root."""
    rng = random.Random(n_roots)
    names = [f"n{i:03}" for i in range(240)]
    below = {n: {rng.choice(names[: max(1, i - 40)]) for _ in range(rng.randint(0, 3))} for i, n in enumerate(names) if i}
    pairs = [(a, b) for a, bs in below.items() for b in bs]
    tops, fixed = names[-n_roots:], set(rng.sample(names, 12))

    def seen_from(root):
        seen, todo = {root}, [root]
        while todo:
            n = todo.pop()
            for d in below.get(n, ()) if n not in fixed else ():
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        return seen

    walked = {r: seen_from(r) for r in tops}
    wanted = {(r, n) for r, ns in walked.items() for n in ns if rng.random() < 0.6}
    keep = {r: {n for n in ns if n not in fixed and (n == r or (r, n) in wanted)} for r, ns in walked.items()}
    edges, stop = make(pairs, EDGES), make([(n,) for n in fixed], "node string")
    roots, needed = make([(r, r) for r in tops], "root string, node string"), make(sorted(wanted), "root string, node string")
    assert rows_of(graph.closure(roots, edges, stop), "root", "node") == sorted((r, n) for r, ns in walked.items() for n in ns)
    nodes, kept = graph.needed_subgraph(roots, needed, stop, edges)
    assert rows_of(nodes, "root", "node") == sorted((r, n) for r, ns in keep.items() for n in ns)
    assert rows_of(kept, "root", "src", "dst") == sorted((r, a, b) for r, ns in keep.items() for a, b in pairs if {a, b} <= ns)

    at = rng.sample(range(1000), n_roots)
    lines = [(r, i, f"attr.{r}") for r, i in zip(tops, at)] + [(tops[0], 2000, "again")]
    first = {}
    for r, i in sorted(zip(tops, at), key=lambda x: x[1]):
        for n in keep[r]:
            first.setdefault(n, (n, i, n == r, f"attr.{r}" if n == r else None))
    got = graph.first_submitter(roots, make(lines, "root string, line_no int, attr string"), needed, stop, edges)
    assert sorted(tuple(r) for r in got.select("node", "line_no", "is_root", "attr").collect()) == sorted(first.values())


def test_bit_sets_of_no_roots_and_of_a_cycle(make):
    edges, none = make([("a", "b"), ("b", "a"), ("b", "c")], EDGES), make([], "node string")
    assert graph.closure(make([], "root string, node string"), edges, none).count() == 0
    seen = graph.closure(make([("a", "a"), ("b", "b")], "root string, node string"), edges, none)
    assert rows_of(seen, "root", "node") == [(r, n) for r in "ab" for n in "abc"]


def test_used_by_attrs_stays_inside_the_job(make):
    edges = make([("t1", "a"), ("t2", "a"), ("t3", "a")], EDGES)
    members = make([("J", "a"), ("J", "t1"), ("J", "t2"), ("K", "a"), ("K", "t3")], "job_id string, drv_hash string")
    roots = make([("J", "t1", "pkgs.one"), ("J", "t2", "pkgs.one"), ("K", "t3", "other")], "job_id string, drv_hash string, label string")
    failed = make([("J", "a")], "job_id string, drv_hash string")
    assert rows_of(graph.used_by_attrs(failed, edges, members, roots)) == [("J", "a", ["pkgs.one"])]


@pytest.mark.parametrize("seed", [1, 7])
def test_random_graphs(make, seed):
    """Waves order every edge; propagation equals a walk in memory."""
    rng = random.Random(seed)
    n = 40
    edges = sorted({(i, j) for i in range(1, n) for j in rng.sample(range(i), min(i, rng.randint(0, 3)))})
    e = make(edges, "src bigint, dst bigint")
    wave = dict(rows_of(graph.waves(make([(i,) for i in range(n)], "node bigint"), e), "node", "wave"))
    assert len(wave) == n and all(wave[s] > wave[d] for s, d in edges)
    failed = {i: rng.randint(0, 5) for i in rng.sample(range(n // 2), 5)}
    done = {i for i in range(n) if rng.random() < 0.15} - set(failed)
    want = {}
    for at, origin in sorted((t, i) for i, t in failed.items()):
        todo = [origin]
        while todo:
            here = todo.pop()
            for s, d in edges:
                if d == here and s not in done and s not in failed and s not in want:
                    want[s] = origin
                    todo.append(s)
    got = graph.propagate_failures(
        make(list(failed.items()), "node bigint, failed_at int"), e, make([(i,) for i in done], "node bigint")
    )
    assert dict(rows_of(got, "node", "origin")) == want


def test_layered_dag(spark):
    nodes, edges = graph.layered_dag(spark, 4, 10, 2)
    assert nodes.count() == 40 and nodes.where("is_root").count() == 10
    wave = graph.waves(nodes.select("node"), edges)
    both = wave.join(nodes, "node").where(F.col("wave") != F.col("layer"))
    assert both.count() == 0


def brute_levels(n, waits):
    need = {i: {f for k, f in waits if k == i} for i in range(n)}
    out = {}
    while True:
        ready = [i for i in need if i not in out and need[i] <= out.keys()]
        if not ready:
            return sorted(out.items())
        for i in ready:
            out[i] = 1 + max((out[f] for f in need[i]), default=-1)


@pytest.mark.parametrize("rows,light", [(10**6, 10**4), (12, 10**4), (25, 2)])
def test_levels_in_blocks_equal_brute_force(make, spark, rows, light):
    rng = random.Random(rows)
    n = 40
    waits = {(i, rng.randrange(n)) for i in range(n) for _ in range(rng.randrange(3)) if i % 7}
    waits |= {(i, 3) for i in range(10, 30)} | {(i, i - 1) for i in range(31, 38)}
    pairs = make(sorted(waits), "id bigint, for bigint")
    got = resolved_levels(spark.range(n), pairs, block_rows=rows, light=light)
    assert rows_of(got, "id", "level") == sorted(brute_levels(n, waits), key=repr)


def test_levels_of_nothing(make, spark):
    none = make([], "id bigint, for bigint")
    assert resolved_levels(spark.range(0), none).count() == 0
    assert rows_of(resolved_levels(spark.range(2), none), "id", "level") == [(0, 0), (1, 0)]


def test_long_chain_in_few_rounds(make, spark):
    n = 2000
    edges = spark.range(1, n).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    got = graph.waves(spark.range(n).withColumnRenamed("id", "node"), edges)
    assert got.where("wave <> node").count() == 0 and got.count() == n


def test_small_jobs_share_blocks_and_large_ones_have_their_own():
    """A job's nodes meet in one block; one larger than a block is dealt over several."""
    from rivetgraph.operators.levels import _places

    assert _places({0: 1, 1: 1, 2: 5, 3: 1, 4: 1, 5: 2}, 2) == ([(0, 0, 1), (1, 0, 1), (2, 1, 3), (3, 4, 1), (4, 4, 1), (5, 5, 1)], 6)
    assert _places({}, 4) == ([], 1)


def test_cycles_of_many_jobs_over_small_blocks(make):
    """Jobs on both sides of the block size, against one block for all."""
    rng = random.Random(5)
    edges = {(j, rng.randrange(6), rng.randrange(6)) for j in range(30) for _ in range(7)}
    edges = make(sorted(e for e in edges if e[1] != e[2]), "job_id bigint, src bigint, dst bigint")
    tops = edges.where("src < 3").select("job_id", F.col("src").alias("node")).distinct()
    got = rows_of(graph.cycle_core(tops, edges, block_rows=12), "job_id", "node")
    assert got and got == rows_of(graph.cycle_core(tops, edges), "job_id", "node")
