"""Skew-safe building blocks shared by the operators.

One key may own a third of all rows. None of these sends a whole key to one task:

* ``first_per_key`` / ``top_per_key`` rely on Spark's partial window group limit,
  so each map task forwards at most ``k`` rows per key;
* ``running_total`` / ``numbered`` / ``max_before`` cut all rows along (key, order) into
  ranges of similar size, total each range, add up the totals before it, and order rows
  inside their range only; the same plan at every size;
* ``trailing_tiles`` cuts time into tiles of the window's own length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rivetgraph.session import cut

def zero() -> Column:
    return F.lit(0).cast("bigint")


GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str | None = None
) -> DataFrame:
    """The first ``k`` rows of every key. ``order`` must be total.

    Up to Spark's own limit every map task forwards ``k`` rows of a key at the most; beyond
    it the rows are numbered in ranges.
    """
    limit = int(df.sparkSession.conf.get(GROUP_LIMIT_CONF, "1000"))
    rn = rank_col or "__rn"
    if k < limit:
        ranked = df.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        ranked = numbered(df, order, keys=keys, out=rn)
    kept = ranked.where(F.col(rn) <= k)
    return kept if rank_col else kept.drop(rn)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def frozen_ranges(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], parts: int | None = None
) -> DataFrame:
    """Rows with a frozen ``__range`` number that follows (keys, order).

    The range number depends on where Spark put the row, so it is written out
    before anything uses it: a recomputed partition could number rows differently.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
    return cut(ranged.withColumn("__range", F.spark_partition_id()))


def _in_ranges(
    df: DataFrame,
    order: Sequence[Column],
    value: Column,
    keys: Sequence[str],
    out: str,
    parts: int | None,
    total: Callable[[str], Column],
    last: int,
    joined: Callable[[Column, Column], Column],
) -> DataFrame:
    """``total`` of ``value`` over a key's rows up to the ``last`` one before or at a row:
    inside its range, and of the ranges before it, ``joined``. Only the first and last key of a
    range can lie in several ranges, so only these are totalled: two keys a range at most."""
    first = Window.unboundedPreceding
    rows = frozen_ranges(df.withColumn("__v", value), keys, order, parts)
    scope = [*keys, "__range"]

    def same(names: Sequence[str]) -> Column:
        pairs = (F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(names))
        return reduce(Column.__and__, pairs, F.lit(True))

    shared = rows
    if keys:
        key = F.struct(*keys)
        ends = rows.groupBy("__range").agg(F.min(key).alias("a"), F.max(key).alias("b"))
        ends = ends.select(F.explode(F.array("a", "b")).alias("k")).distinct()
        named = ends.select(*[F.col("k")[c].alias(f"__k{i}") for i, c in enumerate(keys)])
        shared = rows.join(F.broadcast(named), same(keys), "left_semi")
    totals = shared.groupBy(*scope).agg(total("__v").alias("__total"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__range").rowsBetween(first, -1)
    earlier = totals.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(scope)], total("__total").over(before).alias("__earlier")
    ).where(F.col("__earlier").isNotNull())
    inside = Window.partitionBy(*scope).orderBy(*order).rowsBetween(first, last)
    local = rows.withColumn("__here", total("__v").over(inside)).join(F.broadcast(earlier), same(scope), "left")
    return local.select(*df.columns, joined(F.col("__here"), F.col("__earlier")).alias(out))


def running_total(
    df: DataFrame,
    order: Sequence[Column],
    value: Column,
    *,
    keys: Sequence[str] = (),
    out: str = "running",
    parts: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` per key (null is a key) in a total ``order``."""
    add = lambda here, earlier: F.coalesce(earlier, F.lit(0)) + here
    return _in_ranges(df, order, value, keys, out, parts, F.sum, 0, add)


def numbered(
    df: DataFrame, order: Sequence[Column], *, keys: Sequence[str] = (), out: str = "n", parts: int | None = None
) -> DataFrame:
    """1, 2, 3, ... per key in a total ``order``."""
    return running_total(df, order, F.lit(1).cast("bigint"), keys=keys, out=out, parts=parts)


def max_before(
    df: DataFrame, order: Sequence[Column], value: Column, *, keys: Sequence[str], out: str, parts: int | None = None
) -> DataFrame:
    """The largest ``value`` among the earlier rows of the key; null on its first row."""
    return _in_ranges(df, order, value, keys, out, parts, F.max, -1, F.greatest)


def trailing_tiles(df: DataFrame, ts_micros: Column, width_micros: int) -> DataFrame:
    """Place each row in its own time tile and, as history, in the next one.

    A window of ``width_micros`` ending at a row of tile ``__tile`` finds all it
    needs there. Rows with ``__own`` false are history and must not be reported.
    """
    own = F.floor(ts_micros / F.lit(width_micros)).cast("bigint")
    return (
        df.withColumn("__us", ts_micros)
        .withColumn("__home", own)
        .withColumn("__tile", F.explode(F.array(F.col("__home"), F.col("__home") + 1)))
        .withColumn("__own", F.col("__tile") == F.col("__home"))
    )


def bucket_of(value: Column, bounds: Sequence[float]) -> Column:
    """Index of the first bound that is not below ``value``; past the last one, their count."""
    expr = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        expr = F.when(value <= F.lit(float(bounds[i])), i).otherwise(expr)
    return expr
