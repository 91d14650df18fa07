"""Ordered operators: ranges must equal an ordinary loop, whatever the skew."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from rivetgraph.operators import blocks, metrics
from tests.conftest import rows_of

DDL = "k string, t int, v bigint"


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(3)
    keys = ["hot"] * 400 + [f"k{i % 40}" for i in range(200)]
    times = rng.sample(range(10_000), len(keys))
    return [(k, t, rng.randint(0, 50)) for k, t in zip(keys, times)]


def expected(rows, keyed=True):
    out, totals, tops = [], {}, {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        key = k if keyed else None
        totals[key] = totals.get(key, 0) + v
        out.append((k, t, totals[key], tops.get(key)))
        tops[key] = max(tops.get(key, v), v)
    return out


@pytest.mark.parametrize("parts", [1, 3, None])
def test_running_total_and_max_before(make, skewed, parts):
    df = make(skewed, DDL)
    want = expected(skewed)
    got = blocks.running_total(df, [F.col("t")], F.col("v"), keys=["k"], parts=parts)
    assert rows_of(got, "k", "t", "running") == sorted(((k, t, s) for k, t, s, _ in want), key=repr)
    got = blocks.max_before(df, [F.col("t")], F.col("v"), keys=["k"], out="m", parts=parts)
    assert rows_of(got, "k", "t", "m") == sorted(((k, t, m) for k, t, _, m in want), key=repr)


@pytest.mark.parametrize("parts", [1, 5])
def test_keyless_numbering_descending(make, skewed, parts):
    got = blocks.numbered(make(skewed, DDL), [F.col("t").desc()], parts=parts)
    order = sorted((t for _, t, _ in skewed), reverse=True)
    assert rows_of(got, "t", "n") == sorted(((t, i + 1) for i, t in enumerate(order)), key=repr)


def test_null_keys_are_keys(make):
    df = make([(None, 1, 2), (None, 2, 3), ("a", 1, 5)], DDL)
    assert rows_of(blocks.running_total(df, [F.col("t")], F.col("v"), keys=["k"]), "k", "t", "running") == [
        ("a", 1, 5), (None, 1, 2), (None, 2, 5),
    ]


def test_a_hot_key_meets_no_one_task(make, skewed):
    rows = blocks.frozen_ranges(make(skewed, DDL), ["k"], [F.col("t")], 6)
    sizes = [r["count"] for r in rows.groupBy("__range").count().collect()]
    assert len(sizes) == 6 and max(sizes) < 250  # of 600 rows, 400 of one key


def test_top_per_key_limits_before_the_shuffle(make, skewed):
    top = blocks.top_per_key(make(skewed, DDL), ["k"], [F.col("t")], 3)
    want = [
        (k, t)
        for k, g in itertools.groupby(sorted(skewed), key=lambda r: r[0])
        for _, t, _ in list(g)[:3]
    ]
    assert rows_of(top, "k", "t") == sorted(want, key=repr)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    # beyond Spark's own limit the rows are numbered in ranges
    assert rows_of(blocks.top_per_key(make(skewed, DDL), ["k"], [F.col("t")], 5000), "k", "t") == sorted(
        ((k, t) for k, t, _ in skewed), key=repr
    )


def test_exact_summary_is_nearest_rank(make):
    values = {"a": [5.0], "b": list(range(1, 101)), "c": [1.0, 2.0], "d": [7.0] * 50 + [9.0] * 3}
    df = make([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    got = {r["k"]: r for r in metrics.exact_summary(df, F.col("v"), ["k"]).collect()}
    for k, vs in values.items():
        vs = sorted(vs)
        for q, c in ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms")):
            assert got[k][c] == vs[int((len(vs) - 1) * q + 0.5)], (k, q)
        assert got[k]["count"] == len(vs) and got[k]["max_ms"] == vs[-1]
        assert abs(got[k]["mean_ms"] - sum(vs) / len(vs)) < 1e-9


def test_histogram_and_quantile(make):
    df = make([("a", v) for v in (0.1, 0.5, 0.6, 99.0)] + [("b", 0.2)], "k string, v double")
    hist = metrics.histogram(df, F.col("v"), (0.1, 0.5, 1), ["k"])
    assert rows_of(hist.where("k = 'a'"), "le", "cumulative") == [(0.1, 1), (0.5, 2), (1.0, 3), (None, 4)]
    assert rows_of(metrics.bucket_quantile(hist, 0.5, ["k"])) == [("a", 0.5), ("b", 0.5)]
    assert rows_of(metrics.bucket_quantile(hist, 0.99, ["k"]))[0] == ("a", float("inf"))


def test_merge_summaries_weighs_by_count(make):
    ddl = "count bigint, p50_ms double, p95_ms double, p99_ms double, max_ms double, mean_ms double"
    r = metrics.merge_summaries(make([(1, 10.0, 10.0, 10.0, 10.0, 10.0), (3, 20.0, 30.0, 40.0, 50.0, 20.0)], ddl)).first()
    assert (r["count"], r["p50_ms"], r["p95_ms"], r["p99_ms"], r["max_ms"]) == (4, 17.5, 25.0, 32.5, 50.0)


def test_hit_rate_of_nothing_is_null(make):
    df = make([(0, 0), (1, 4)], "h bigint, n bigint")
    assert [r[0] for r in df.select(metrics.hit_rate(F.col("h"), F.col("n"))).collect()] == [None, 0.25]


def test_running_total_joins_only_keys_that_cross_ranges(make):
    """All rows meet the sums before their range by broadcast; null is a key."""
    rows = [(k, i, i) for k in ("a", "b", None) for i in range(40)]
    df = make(rows, "k string, i int, v bigint")
    got = blocks.running_total(df, [F.col("i")], F.col("v"), keys=["k"], parts=7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert {(r.k, r.i): r.running for r in got.collect()} == {(k, i): i * (i + 1) // 2 for k, i, _ in rows}
