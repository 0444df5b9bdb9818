"""Range, stab, flank and upsert joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], start: str = "s", end: str = "e", bin_size: int = 10_000, how: str = "inner", levels: int = 8) -> DataFrame:
    """Pairs of closed intervals that overlap within equal ``keys``; right columns get the prefix ``r_``.

    Every interval lies in at most two bins of its own level, the first one
    whose bins, eight times wider each, are as long as it; the last level takes
    all that is longer. Pairs meet on the level of the longer one, where the
    shorter one lies in at most two bins as well. So a key with many intervals
    is split along the axis, and a long interval takes two rows, not one per
    bin. A pair is kept only in the bin where its overlap starts, so it comes
    out once. ``how`` is inner or left (a left row without partner comes out
    once, also where it has nulls; one with a null bound or key has none).
    """
    size = [bin_size * 8**i for i in range(levels)]

    def spread(df: DataFrame, s: str, e: str, p: str) -> DataFrame:
        n = F.col(e) - F.col(s) + 1
        own = F.lit(levels - 1)
        for i in range(levels - 2, -1, -1):
            own = F.when(n <= size[i], i).otherwise(own)
        width = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in size]), F.col(f"{p}level") + 1)
        d = df.withColumn(f"{p}own", own).withColumn(f"{p}level", F.explode(F.sequence(F.col(f"{p}own"), F.lit(levels - 1))))
        return d.withColumn(f"{p}bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))

    a = spread(left, start, end, "_a")
    b = spread(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), f"r_{start}", f"r_{end}", "_b")
    width = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in size]), F.col("_alevel") + 1)
    on = (F.col("_alevel") == F.col("_blevel")) & (F.col("_abin") == F.col("_bbin")) & (F.col(start) <= F.col(f"r_{end}")) & (F.col(f"r_{start}") <= F.col(end)) & (F.floor(F.greatest(start, f"r_{start}") / width) == F.col("_abin"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    # one side at its own level, the other at that level or lifted to it
    inner = a.filter("_aown = _alevel").join(b, on).unionByName(a.filter("_aown < _alevel").join(b.filter("_bown = _blevel"), on))
    inner = inner.drop("_aown", "_alevel", "_abin", "_bown", "_blevel", "_bbin")
    if how == "inner":
        return inner
    met = inner.select(*[F.col(c).alias(f"_m{i}") for i, c in enumerate(left.columns)]).distinct()
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_m{i}")) for i, c in enumerate(left.columns)])
    return inner.unionByName(left.join(met, same, "left_anti"), allowMissingColumns=True)


def nearest_before(df: DataFrame, points: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """As-of join: for every row of ``points`` the ``value`` of the last row of ``df`` at or before ``at``.

    One sort of both sides by key and place instead of a join on a range; of
    rows at the same place the largest value counts.
    """
    a = df.filter(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.max(value).alias("_v")).select(*keys, at, "_v", F.lit(0).alias("_p"))
    both = a.unionByName(points.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "_p").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(w)).filter("_p = 1").drop("_v", "_p")


def upsert(base: DataFrame, override: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``override`` replace those of ``base`` with the same keys."""
    return base.join(override.select(*keys).distinct(), keys, "left_anti").unionByName(override)


def densify(df: DataFrame, rows: DataFrame, columns: DataFrame, keys: list[str], default: dict[str, Column]) -> DataFrame:
    """One row for every pair of a row key and a column key; missing ones get the defaults. ``columns`` is a small list of fixed size."""
    grid = rows.crossJoin(F.broadcast(columns))
    return grid.join(df, keys, "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in default.items()})


def reciprocal_best(df: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Every scored pair with its ``status``: reciprocal_best, query_best_only or not_reciprocal_best.

    A pair counts in both directions: the best partners of an id are taken
    from all pairs that name it on either side, all ties kept. Best scores
    come from aggregation, not from windows over all pairs of an id, so an id
    with very many pairs is combined before the shuffle.
    """
    pairs = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & F.col(score).isNotNull()).groupBy(left, right).agg(F.max(score).alias(score))
    both = pairs.select(F.col(left).alias("_x"), F.col(right).alias("_y"), F.col(score).alias("_s")).unionByName(pairs.select(F.col(right).alias("_x"), F.col(left).alias("_y"), F.col(score).alias("_s")))
    top = both.groupBy("_x", "_y").agg(F.max("_s").alias("_s"))  # the better of a pair's two directions
    best = both.groupBy(F.col("_x").alias("_id")).agg(F.max("_s").alias("_b"))
    d = pairs.join(top, (F.col(left) == F.col("_x")) & (F.col(right) == F.col("_y")))
    d = d.join(best.select(F.col("_id").alias("_l"), F.col("_b").alias("_bl")), F.col(left) == F.col("_l")).join(best.select(F.col("_id").alias("_r"), F.col("_b").alias("_br")), F.col(right) == F.col("_r"))
    of_left, of_right = F.abs(F.col("_s") - F.col("_bl")) < 1e-12, F.abs(F.col("_s") - F.col("_br")) < 1e-12
    return d.select(left, right, score, F.when(of_left & of_right, "reciprocal_best").when(of_left, "query_best_only").otherwise("not_reciprocal_best").alias("status"))
